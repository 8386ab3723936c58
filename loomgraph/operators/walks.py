"""Walks in the graph of facts (src, dst): first simple paths between names, chains of the first nodes, drawn chains.

Facts with a null end and self-loops are no edges, and repeated facts are one. Empty tables give no rows. Uuids hold no ``>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.columns import clamped
from loomgraph.tables import materialise

#: Partial paths that are extended at once; it bounds what a step writes and broadcasts, and changes no result.
BEAM = 1000


def plain_edges(facts: DataFrame) -> DataFrame:
    return materialise(facts.select("src", "dst").where("src <> dst").distinct(), "edges")


def hops_from(edges: DataFrame, starts: DataFrame, here: str, there: str, most: int) -> DataFrame:
    """(uuid, hops) of all nodes within ``most`` edges of a start, with the least number; each level but the first is written.

    It ends with the first level that has no new node.
    """
    known = level = starts.select("uuid", F.lit(0).alias("hops"))
    for hop in range(1, most + 1):
        ends = edges.join(level.select(F.col("uuid").alias(here)), here, "left_semi").select(F.col(there).alias("uuid")).distinct()
        level = materialise(ends.join(known, "uuid", "left_anti").select("uuid", F.lit(hop).alias("hops")), "level")
        if level.isEmpty():
            break
        known = known.unionByName(level)
    return known


def _extended(edges: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Every prefix (path, names) with one more edge to a node that it doesn't hold. Prefixes are at most a beam of rows."""
    ends = prefixes.select("path", "names", F.element_at("path", -1).alias("src"))
    rows = edges.join(F.broadcast(ends), "src").where(~F.array_contains("path", F.col("dst")))
    return rows.select(F.concat("path", F.array("dst")).alias("path"), F.concat_ws(">", "names", "dst").alias("names"), "far")


def _first_of_length(edges: DataFrame, starts: DataFrame, length: int, most: int, beam: int) -> list[str]:
    """The names of the first ``most`` simple paths of ``length`` edges.

    Partial paths are extended first one first, at most ``beam`` at a time. With the separator behind it no partial path
    is the beginning of another of its length, so all ends of one come before all ends of the next: what waits is only
    looked at when those before it have come to too few ends. A node stays on the way only while a target is near enough.
    A beam is a top-k result of bounded size that the next step broadcasts; it goes through the driver as that.
    """
    found: list[str] = []
    waiting: list[tuple[DataFrame | None, int, str | None]] = [(None, 0, None)]  # prefixes, edges of their extensions, the last one taken
    while waiting and len(found) < most:
        prefixes, done, after = waiting.pop()
        last, take = done == length, min(most - len(found), beam) if done == length else beam
        rows = (starts if prefixes is None else _extended(edges, prefixes)).where(F.col("far") <= length - done)
        rows = rows.withColumn("place", F.col("names") if last else F.concat("names", F.lit(">")))
        chunk = (rows if after is None else rows.where(F.col("place") > after)).orderBy("place").limit(take).toArrow()
        if chunk.num_rows == take:
            waiting.append((prefixes, done, chunk["place"][-1].as_py()))
        if last:
            found += chunk["names"].to_pylist()
        elif chunk.num_rows:
            waiting.append((edges.sparkSession.createDataFrame(chunk.select(["path", "names"])), done + 1, None))
    return found


def paths(entities: DataFrame, facts: DataFrame, source: str, target: str, hops: int = 4, most: int = 3, beam: int = BEAM) -> DataFrame:
    """The first ``most`` simple directed paths between entities whose names contain the texts, by (hops, names).

    Nodes are labelled with their least hops from a source, the edges from near nodes are written, and on these alone
    nodes are labelled with their hops to a target: the way back doesn't visit all that leads to the targets. Only edges
    of which both ends are near enough are kept. On these the paths of 1, 2, ... edges are looked for first one first, so that no step
    holds more than ``beam`` partial paths however many paths there are. Hops are from 1 to 6.
    """
    hops = clamped(hops, 1, 6, 4)
    edges = plain_edges(facts)
    named = lambda text: entities.where(F.col("name").contains(text) & F.col("uuid").isNotNull()).select("uuid").distinct()
    sources, targets = materialise(named(source), "sources"), materialise(named(target), "targets")
    near = hops_from(edges, sources, "src", "dst", hops - 1).select(F.col("uuid").alias("src"), F.col("hops").alias("near"))
    reached = materialise(edges.join(near, "src"), "reached")
    far = hops_from(reached, targets, "dst", "src", hops - 1).select(F.col("uuid").alias("dst"), F.col("hops").alias("far"))
    between = materialise(reached.join(far, "dst").where(F.col("near") + F.col("far") < hops).select("src", "dst", "far"), "between")
    first = between.groupBy("src").agg((F.min("far") + 1).alias("far")).withColumnRenamed("src", "uuid")
    starts = materialise(sources.join(first, "uuid").select(F.array("uuid").alias("path"), F.col("uuid").alias("names"), "far"), "starts")
    found: list[tuple[int, str]] = []
    for length in range(1, hops + 1):
        if len(found) < most:
            found += [(length, names) for names in _first_of_length(between, starts, length, most - len(found), beam)]
    return facts.sparkSession.createDataFrame(found, "hops int, names string").orderBy("hops", "names")


def _ends(edges: DataFrame, starts: DataFrame, least: int, most: int) -> DataFrame:
    """(first, last, hops) of the simple chains of some lengths from ``starts`` (src); each hop is written."""
    walk, found = starts.select(F.col("src").alias("at"), F.array("src").alias("path")), None
    for hop in range(1, most + 1):
        walk = walk.join(edges, walk["at"] == edges["src"]).where(~F.array_contains("path", F.col("dst"))).select(F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"))
        walk = materialise(walk, "walks")
        if hop >= least:
            ends = walk.select(F.element_at("path", 1).alias("first"), F.col("at").alias("last"), F.lit(hop).alias("hops"))
            found = ends if found is None else found.unionByName(ends)
    return found.groupBy("first", "last").agg(F.min("hops").alias("hops"))


def chains(facts: DataFrame, least: int, most: int, k: int) -> DataFrame:
    """The first k end pairs (by first, last) of simple chains of ``least`` to ``most`` edges, with the least hops.

    Nodes are taken in their order in lots of k, 8 k, 64 k, ...; the edges within ``most`` hops of a lot are written, and
    all else is done on these: of the lot, only nodes from which ``least`` edges can be walked are starts, and they are
    taken k at a time until k pairs are found. A start mostly gives one at least, so walks grow with k starts and not
    with the graph, which is read once a hop. They do grow with the degrees on the way; ``drawn_chains`` doesn't.
    """
    edges = plain_edges(facts)
    nodes = materialise(edges.select("src").distinct(), "nodes")
    found, n_found, size, passed = None, 0, k, None
    while True:
        lot, n_lot, passed = _next(nodes, passed, size)
        near = hops_from(edges, lot.withColumnRenamed("src", "uuid"), "src", "dst", most - 1)
        reached = materialise(edges.join(near.select(F.col("uuid").alias("src")), "src", "left_semi"), "reached")
        alive = reached.select("src").distinct()
        for _ in range(least - 1):
            alive = reached.join(alive.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src").distinct()
        alive = materialise(lot.join(alive, "src", "left_semi"), "alive")
        n, after = k, None
        while n == k:
            starts, n, after = _next(alive, after, k)
            ends = materialise(_ends(reached, starts, least, most), "ends")
            found = ends if found is None else found.unionByName(ends)
            n_found += ends.count()
            if n_found >= k:
                break
        if n_lot < size or n_found >= k:
            return found.orderBy("first", "last").limit(k)
        size *= 8


def _next(nodes: DataFrame, after: str | None, size: int) -> tuple[DataFrame, int, str | None]:
    """The next nodes (src) in their order, their number and the last of them."""
    lot = materialise((nodes if after is None else nodes.where(F.col("src") > after)).orderBy("src").limit(size), "starts")
    n, last = lot.agg(F.count(F.lit(1)), F.max("src")).first()
    return lot, n, last


def race(weight: Column, *of: Column) -> Column:
    """An exponential race: among candidates the least value is drawn with a chance in proportion to its weight."""
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", *of)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.ln(u) / weight.cast("double")


def _count(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def walk_counts(edges: DataFrame, most: int) -> DataFrame:
    """(uuid, hops, walks): how many walks of 1 to ``most`` edges begin at a node; nodes without any are left out.

    Layer i holds the edges whose first node is reached by i edges. From the innermost layer outwards, one pass over a
    layer sums the counts of all hops at once, since the nodes behind its edges have theirs from the layer within. Layers
    mostly shrink fast; where one doesn't (a core of cycles), its counts are made hop by hop.
    """
    layers, sizes = [edges], [edges.count()]
    while len(layers) < most:
        outer = layers[-1]
        inner = materialise(outer.join(outer.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"), "inner")
        size = inner.count()
        if size == sizes[-1]:
            break
        layers.append(inner)
        sizes.append(size)
    core, hops = layers.pop(), most - len(layers)
    level, found = None, None
    for hop in range(1, hops + 1):
        if level is None:
            counted = core.groupBy("src").agg(_count(F.count(F.lit(1))).alias("walks"))
        else:
            counted = core.join(level.select(F.col("uuid").alias("dst"), "walks"), "dst").groupBy("src").agg(_count(F.sum("walks")).alias("walks"))
        level = materialise(counted.select(F.col("src").alias("uuid"), F.lit(hop).alias("hops"), "walks"), "counts")
        found = level if found is None else found.unionByName(level)
    if not layers:
        return found
    wide = found.groupBy("uuid").agg(*(F.max(F.when(F.col("hops") == h, F.col("walks"))).alias(f"w{h}") for h in range(1, hops + 1)))
    for layer in reversed(layers):
        hops += 1
        counted = layer.join(wide.withColumnRenamed("uuid", "dst"), "dst", "left").groupBy(F.col("src").alias("uuid"))
        wide = materialise(counted.agg(_count(F.count(F.lit(1))).alias("w1"), *(_count(F.sum(f"w{h - 1}")).alias(f"w{h}") for h in range(2, hops + 1))), "counts")
    return wide.select("uuid", F.posexplode(F.array(*(f"w{h}" for h in range(1, hops + 1)))).alias("hops", "walks")).where("walks is not null").withColumn("hops", F.col("hops") + 1)


def drawn_chains(facts: DataFrame, least: int, most: int, k: int, seed: int, draws: int | None = None) -> DataFrame:
    """first, last, hops, names of k chains drawn from all facts, each end pair once; the same for the same seed.

    ``draws`` (8 k, if not given) starts and lengths are drawn without replacement, weighted by how many walks of that
    length begin there; then each draw takes one edge a step, weighted by the walks left beyond it. Nodes that are on the
    chain already are left out, and a draw that can't go on is dropped, so that fewer than k may come back. A step
    writes the edges that its draws may take and looks up the counts of their ends; it leaves one row a draw.
    """
    draws = draws or 8 * k
    edges = plain_edges(facts)
    counts = walk_counts(edges, most)
    beyond = counts.select(F.col("uuid").alias("dst"), F.col("hops").alias("left"), "walks")
    starts = counts.where(F.col("hops") >= least).withColumn("race", race(F.col("walks"), F.lit(str(seed)), F.col("uuid"), F.col("hops")))
    walk = materialise(starts.orderBy("race", "uuid", "hops").limit(draws).select(F.col("uuid").alias("first"), "hops", "race", F.array("uuid").alias("path")), "draws")
    for step in range(1, most + 1):
        going = walk.where(F.col("hops") >= step).withColumn("src", F.element_at("path", -1))
        rows = edges.join(F.broadcast(going), "src").where(~F.array_contains("path", F.col("dst")))
        rows = materialise(rows.withColumn("left", F.col("hops") - step), "steps")
        rows = rows.where("left = 0").withColumn("walks", _count(F.lit(1))).unionByName(rows.join(beyond, ["dst", "left"]))
        next_ = F.struct(race(F.col("walks"), F.lit(str(seed)), F.col("first"), F.col("hops"), F.lit(step), F.col("dst")).alias("r"), "dst")
        # One row a draw: its path and race are the same in all of its rows.
        taken = rows.groupBy("first", "hops").agg(F.min(next_).alias("next"), F.any_value("race").alias("race"), F.any_value("path").alias("path"))
        taken = taken.select("first", "hops", "race", F.concat("path", F.array("next.dst")).alias("path"))
        walk = materialise(taken.unionByName(walk.where(F.col("hops") < step)), "draws")
    ends = walk.groupBy("first", F.element_at("path", -1).alias("last")).agg(F.min(F.struct("race", "hops", F.array_join("path", ">").alias("names"))).alias("d"))
    return ends.orderBy("d.race", "first", "last").limit(k).select("first", "last", "d.hops", "d.names")
