"""N-gram Jaccard join by vertical partitioning.

A document's set is its distinct 5-word shingles (ASCII-lowered words; a shorter text is one shingle; no words, no set).
All shingles have one global order: rare ones by hash, then the corpus' frequent ones by rising frequency. Documents
with equal sets form a class and take part once. Classes that share a shingle among their first |s| - ceil(0.8 |s|) + 1
may be similar.

The order is cut into FRAGMENTS ranges and one more of the frequent shingles, and every set into the slices that lie in
them. The overlap of a pair is counted in each fragment by a join that ships that fragment's slices alone, as rows (a,
b, fragment, count), which are summed by pair; between rounds a pair goes whose fragments not yet counted can't make up
what it lacks. A pair is linked if 100 * intersection >= 80 * union. A class in more than SPLIT pairs is salted: its
slices are copied once for each SPLIT of its pairs, so that no hub's pairs meet in one task.

A shingle shared by m classes doesn't make m^2 pairs: its classes are first compared with the most central one among
them, and only classes that connected components leave apart are compared further. Within a component no link is
needed to know the result, so this loses nothing.

Null or blank texts are linked with nothing and are their own component. Repeated rows each give a row. A null doc_id
is never a component's id unless all its members are null. Shingles, classes and texts are known by 64-bit hashes; an
id only names the result, so that rows without one link others all the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import Members, WordHasher, forget, grams, materialise, may_have, signed, table
from loomgraph.tables import components

SHINGLE = 5
#: Frequent shingles with a place of their own in the order (16 bytes each are broadcast). They only save work.
FREQUENT = 1 << 18
#: Shingle hashes that are counted together, and how often one must occur among them to be reported as frequent.
CHUNK, OFTEN = 1 << 22, 3
#: Fragments of the rare part of the order; the frequent shingles are one more.
FRAGMENTS = 4
#: Fragments that are counted together; pairs are dropped after each round.
ROUNDS = ((0,), tuple(range(1, FRAGMENTS + 1)))
#: Pairs of a class that may meet in one task.
SPLIT = 64
#: Rows of a table that is broadcast, at most (16 bytes each); a larger one is joined by a shuffle.
SMALL = 1 << 17


def shingle_set(text: str | None, hasher: WordHasher) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    words = hasher.words(text or "", lower=True)[0]
    if len(words) == 0:
        return words
    return np.unique(grams(words, min(SHINGLE, len(words))))


def class_id(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str | None, int]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("key").to_pylist(), strict=True)


def text_key() -> Column:
    """The hash by which a text is found again."""
    return F.xxhash64(F.col("text").cast("string"))


def _source(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key().alias("key"))


def frequent_shingles(documents: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of at most FREQUENT shingles that are frequent in some chunk of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen, held, size = WordHasher(), set(), [], 0

        def flush() -> pa.RecordBatch:
            h = np.concatenate(held) if held else np.zeros(0, np.uint64)
            held.clear()
            h.sort()
            edges = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))
            n = np.diff(edges) if len(h) else np.zeros(0, np.int64)
            often = n >= OFTEN
            return pa.RecordBatch.from_arrays([pa.array(signed(h[edges[:-1][often]] if len(h) else h)), pa.array(n[often])], names=["h", "n"])

        for _, text, _ in _texts(batches):
            s = shingle_set(text, hasher)
            if (c := class_id(s)) in seen:
                continue
            seen.add(c)
            held.append(s)
            size += len(s)
            if size >= CHUNK:
                yield flush()
                size = 0
                seen.clear()
        yield flush()

    counted = _source(documents).mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    h, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def rank_frequent(shingles: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The place of each shingle among the frequent ones, -1 for a rare one."""
    if not len(often):
        return np.full(len(shingles), -1)
    at = np.minimum(np.searchsorted(often, shingles), len(often) - 1)
    return np.where(often[at] == shingles, at, -1)


def prefix(shingles: np.ndarray, often: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first |s| - ceil(0.8 |s|) + 1 shingles of a sorted set in the global order."""
    n = len(shingles)
    size = n - (4 * n + 4) // 5 + 1
    at = rank_frequent(shingles, often)
    rare = shingles[at < 0]
    if len(rare) >= size:
        return rare[:size]
    common, at = shingles[at >= 0], at[at >= 0]
    return np.concatenate((rare, common[np.lexsort((common, counts[at]))]))[:size]


def cell_sizes(shingles: np.ndarray, often: np.ndarray) -> np.ndarray:
    """How many rare shingles lie in each of 2**k equal cuts of their order, 4 to 8 on average, and how many are frequent.

    The sums of two sets' minima bound their overlaps by fragment; there are FRAGMENTS cuts or more.
    """
    rare = shingles[rank_frequent(shingles, often) < 0]
    bits = max(int(np.log2(FRAGMENTS)), int(np.log2(max(len(shingles), 1) / 4)))
    cells = np.bincount((rare >> np.uint64(32)).astype(np.int64) >> (32 - bits), minlength=1 << bits)
    return np.append(cells, len(shingles) - len(rare)).astype(np.int32)


def signatures(documents: DataFrame, often: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(doc_id, n, node, key, prefix, sizes) of every row; node is its class, null without a set, key the text's hash.

    prefix and sizes are given once a class and partition.
    """
    shared = documents.sparkSession.sparkContext.broadcast((often, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = WordHasher(), set()
        often, counts = shared.value
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            ids, n, nodes, keys, heads, sizes = zip(*rows, strict=True)
            lists = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(keys, pa.int64()), pa.array(heads, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(lists, names=["doc_id", "n", "node", "key", "prefix", "sizes"])

        for doc_id, text, key in _texts(batches):
            s = shingle_set(text, hasher)
            node = class_id(s) if len(s) else None
            fresh = node is not None and node not in seen
            if fresh:
                seen.add(node)
            rows.append((doc_id, len(s), node, key, signed(prefix(s, often, counts)) if fresh else None, cell_sizes(s, often) if fresh else None))
            if len(rows) >= 512:
                yield out()
                rows = []
        if rows:
            yield out()

    return _source(documents).mapInArrow(run, "doc_id bigint, n bigint, node bigint, key bigint, prefix array<bigint>, sizes array<int>")


def postings(signed_docs: DataFrame) -> DataFrame:
    """(token, x, nx, px): class, size and place of tokens that several rows have.

    A bitmap drops nearly all tokens that only one row has; some of those stay, and a class may come once a partition.
    """
    heads = signed_docs.where("prefix is not null")
    counts = heads.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("m"))
    several = Members(counts.where("m > 1"), "token")
    shared = several.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prefix")
            tokens = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = np.asarray(lists.value_lengths())
            row = np.repeat(np.arange(len(sizes)), sizes)
            pos = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = np.flatnonzero(may_have(shared.value, tokens))
            pick = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([pa.array(tokens[keep]), batch.column("node").take(pick), batch.column("n").take(pick), pa.array(pos[keep], pa.int64())], names=["token", "x", "nx", "px"])

    found = heads.select("n", "node", "prefix").mapInArrow(run, "token bigint, x bigint, nx bigint, px bigint")
    held = materialise(several.exact(found, "token").select("token", "x", "nx", "px"), "postings")
    several.done()
    return held


def _possible(na: str, pa_: str, nb: str, pb: str) -> str:
    """Length and position filter for a pair whose first common shingle stands at these places."""
    return f"5 * least({na}, {nb}) >= 4 * greatest({na}, {nb}) and 9 * least({na} - {pa_}, {nb} - {pb}) >= 4 * ({na} + {nb})"


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs with the lesser node first; columns x, nx, y, ny."""
    low = F.col("x") < F.col("y")
    return pairs.select(*(F.when(low, F.col(p)).otherwise(F.col(q)).alias(r) for p, q, r in (("x", "y", "a"), ("nx", "ny", "na"), ("y", "x", "b"), ("ny", "nx", "nb")))).dropDuplicates(["a", "b"])


def slices(documents: DataFrame, keys: DataFrame, often: np.ndarray) -> DataFrame:
    """(node, fragment, slice) of the classes that have a text in ``keys`` (key), and of a few more: sets cut by fragment."""
    wanted = Members(keys, "key")
    shared = documents.sparkSession.sparkContext.broadcast(often)
    member = wanted.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = WordHasher(), set()
        often = shared.value
        for batch in batches:
            part = batch.take(pa.array(np.flatnonzero(may_have(member.value, batch.column("key").to_numpy(zero_copy_only=False)))))
            for at in range(0, part.num_rows, 128):
                nodes, fragments, cut = [], [], []
                for text in part.column("text").slice(at, 128).to_pylist():
                    s = shingle_set(text, hasher)
                    if not len(s) or (c := class_id(s)) in seen:
                        continue
                    seen.add(c)
                    f = np.where(rank_frequent(s, often) < 0, (s >> np.uint64(32)).astype(np.int64) * FRAGMENTS >> 32, FRAGMENTS)
                    for k in np.unique(f):
                        nodes.append(c)
                        fragments.append(k)
                        cut.append(signed(s[f == k]))
                if nodes:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(fragments, pa.int32()), pa.array(cut, pa.list_(pa.int64()))], names=["node", "fragment", "slice"])

    found = wanted.exact(_source(documents), "key").select("doc_id", "text", "key").mapInArrow(run, "node bigint, fragment int, slice array<bigint>")
    held = materialise(found.dropDuplicates(["node", "fragment"]), "slices")
    wanted.done()
    return held


def cell_table(signed_docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, sizes) of the classes in ``pairs``, once each."""
    wanted = Members(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node")
    member = wanted.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.take(pa.array(np.flatnonzero(may_have(member.value, batch.column("node").to_numpy(zero_copy_only=False)))))

    rows = signed_docs.where("sizes is not null").select("node", "sizes").mapInArrow(run, "node bigint, sizes array<int>")
    return wanted.exact(rows, "node").dropDuplicates(["node"])


def salted(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pairs`` with a salt for each side, and (node, salts) of the classes of more than SPLIT pairs, which have several."""
    degrees = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    hubs = materialise(degrees.where(F.col("n") > SPLIT).select("node", F.ceil(F.col("n") / SPLIT).cast("int").alias("salts")), "hubs")
    known = F.broadcast(hubs) if hubs.count() <= SMALL else hubs
    for k, other in (("a", "b"), ("b", "a")):
        salts = known.select(F.col("node").alias(k), "salts")
        pairs = pairs.join(salts, k, "left").withColumn(f"salt_{k}", F.pmod(F.xxhash64(other), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    return pairs, known


def copied(rows: DataFrame, hubs: DataFrame) -> DataFrame:
    """``rows`` (node, ...) once for each salt of their class."""
    return rows.join(hubs, "node", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")


def bounded(pairs: DataFrame, hubs: DataFrame, signed_docs: DataFrame) -> DataFrame:
    """The salted pairs that the cell sizes don't rule out, with caps: how much they can share at most in each fragment."""
    sizes = copied(cell_table(signed_docs, pairs), hubs)
    left, right = (sizes.select(F.col("node").alias(k), F.col("salt").alias(f"salt_{k}"), F.expr("slice(sizes, 1, size(sizes) - 1)").alias(f"s{k}"), F.element_at("sizes", -1).alias(f"f{k}")) for k in "ab")

    def folded(s: str, n: str) -> str:
        return f"case when size({s}) > size({n}) then transform(sequence(0, size({n}) - 1), i -> {s}[2 * i] + {s}[2 * i + 1]) else {s} end"

    least = f"zip_with({folded('sa', 'sb')}, {folded('sb', 'sa')}, (p, q) -> least(p, q))"
    width = f"least(size(sa), size(sb)) div {FRAGMENTS}"
    caps = f"concat(transform(sequence(0, {FRAGMENTS - 1}), f -> aggregate(slice(least, cast(f * ({width}) + 1 as int), cast({width} as int)), 0, (acc, v) -> acc + v)), array(least(fa, fb)))"
    rows = pairs.join(left, ["a", "salt_a"]).join(right, ["b", "salt_b"]).withColumn("least", F.expr(least)).withColumn("caps", F.expr(caps))
    return rows.where("9 * aggregate(caps, 0, (acc, v) -> acc + v) >= 4 * (na + nb)").select("a", "b", "na", "nb", "salt_a", "salt_b", "caps")


def verified(documents: DataFrame, pairs: DataFrame, signed_docs: DataFrame, often: np.ndarray) -> DataFrame:
    """The linked pairs (a, b): partial overlaps by fragment, summed by pair. pairs: a, b, na, nb."""
    pairs, hubs = salted(pairs)
    state = materialise(bounded(pairs, hubs, signed_docs), "bounded")
    nodes = state.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = signed_docs.where("prefix is not null").select("node", "key").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("key").alias("key"))
    own = slices(documents, texts, often)
    parts = copied(own, hubs)
    before = state = state.withColumn("known", F.lit(0).cast("bigint"))
    for i, fragments in enumerate(ROUNDS):
        cut = parts.where(F.col("fragment").isin(*fragments))
        left, right = (cut.select(F.col("node").alias(k), F.col("salt").alias(f"salt_{k}"), "fragment", F.col("slice").alias(f"slice_{k}")) for k in "ab")
        partial = state.select("a", "b", "salt_a", "salt_b").join(left, ["a", "salt_a"]).join(right, ["b", "salt_b", "fragment"]).select("a", "b", "fragment", F.size(F.array_intersect("slice_a", "slice_b")).alias("count"))
        summed = partial.groupBy("a", "b").agg(F.sum("count").alias("count"))
        later = [f for fs in ROUNDS[i + 1 :] for f in fs]
        hope = sum((F.col("caps")[f] for f in later), F.col("known"))
        state = state.join(summed, ["a", "b"], "left").withColumn("known", F.col("known") + F.coalesce("count", F.lit(0))).drop("count")
        state = materialise(state.where(9 * hope >= 4 * (F.col("na") + F.col("nb"))), "overlaps")
        forget(before)
        before = state
    forget(own)
    return state.select("a", "b")


def similar_classes(documents: DataFrame, signed_docs: DataFrame, often: np.ndarray) -> DataFrame:
    """(node, root): the connected component of every class that is linked to another."""
    held = postings(signed_docs)
    central = held.groupBy("token").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.max(F.struct(F.expr("nx - px").alias("rest"), F.col("x").alias("y"), F.col("nx").alias("ny"), F.col("px").alias("py"))).alias("c"))
    shared = materialise(held.join(central.where("low <> high").select("token", "c.y", "c.ny", "c.py"), "token"), "shared")
    forget(held)
    star = materialise(_ordered(shared.where("x <> y and " + _possible("nx", "px", "ny", "py"))), "star")
    links = verified(documents, star, signed_docs, often)
    root = components(links)
    # Classes that share a token but lie apart so far: every such pair that the filters leave and the star hasn't seen.
    placed = shared.select("token", "x", "nx", "px").join(root.select(F.col("node").alias("x"), "root"), "x", "left").withColumn("root", F.coalesce("root", "x"))
    apart = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
    placed = materialise(placed.join(apart, "token").dropDuplicates(["token", "x"]), "placed")
    forget(shared)
    other = placed.select("token", *(F.col(c).alias(c.replace("x", "y")) for c in ("x", "nx", "px")), F.col("root").alias("root_y"))
    rest = materialise(_ordered(placed.join(other, "token").where("x < y and root <> root_y and " + _possible("nx", "px", "ny", "py"))).join(star.select("a", "b"), ["a", "b"], "left_anti"), "rest")
    forget(placed)
    forget(star)
    more = verified(documents, rest, signed_docs, often)
    found = materialise(components(links.unionByName(more)), "roots")
    for used in (rest, links, more):
        forget(used)
    return found


def linked(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, node, key) of every row, and (node, root) of every class that is linked to another."""
    often, counts = frequent_shingles(documents)
    signed_docs = materialise(signatures(documents, often, counts), "signatures")
    rows = materialise(signed_docs.select("doc_id", "n", "node", "key"), "rows")
    root = similar_classes(documents, signed_docs, often)
    forget(signed_docs)
    return rows, root


def representatives(documents: DataFrame) -> DataFrame:
    """(doc_id, key, n_rows, first) of the distinct ids and texts with words; first in one of each component, of least doc_id, null last."""
    rows, root = linked(documents)
    pairs = materialise(rows.where("node is not null").groupBy("doc_id", "key").agg(F.first("node").alias("node"), F.count(F.lit(1)).alias("n_rows")), "pairs")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key"))
    classes = pairs.groupBy("node").agg(least.alias("least")).join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = classes.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias("i"), F.col("least.key").alias("k"))
    found = pairs.join(firsts, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left")
    return found.select("doc_id", "key", "n_rows", F.col("k").isNotNull().alias("first"))


def join(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id reachable by links) of every row."""
    rows, root = linked(documents)
    classes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least")).join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = materialise(classes.join(classes.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id"), "components")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "node").join(ids, "node", "left").select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, in DuckDB SQL.
ORACLE = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
g as (select distinct doc_id, array_to_string(w[p:p + 4], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as p from d where len(w) > 0)),
n as (select doc_id, count(*) as n from g group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as k from g a join g b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
l as (select c.a, c.b from c join n x on x.doc_id = c.a join n y on y.doc_id = c.b where 100 * k >= 80 * (x.n + y.n - k)),
r as (select a, b from l union select r.a, l.b from r join l on l.a = r.b),
m as (select a, min(b) as low from r group by a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) as component_id
from d left join n using (doc_id) left join m on m.a = d.doc_id"""
