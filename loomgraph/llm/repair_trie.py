"""Conversation structure repair: cheapest edits of every conversation, by dynamic programming shared in a prefix trie.

Rows of a conversation are read in the order of their turns (nulls first; rows of one turn by role, then by a hash of
role and text). A row becomes one character of the conversation's signature: its role (system, user, assistant, other),
in upper case if its text is truncated, or ``x`` if it is blank or a duplicate and has to go. Signatures are sorted, so
that each task walks a trie of them depth first: the layer of costs after a prefix is computed once for all signatures
that begin with it, and the answer is read off where a signature ends. Conversations get the answer of their signature.

Both passes over the rows are sorted streams: a conversation's rows go to one task, since it is repaired in order, but
are never gathered there. Held are its signature and the hashes of its distinct rows.

Nulls: a null role or text is one space, a null turn sorts first and counts for no gap, and the rows of a null conv_id
are one conversation. Roles other than system, user and assistant are judged by their first letter. Equal rows of one
turn are duplicates but the first. A conversation of which nothing is left has zeros, an empty audit and no rows. Empty
tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import SPACE, materialise, table

#: Costs of the edits. Fixed values.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States of the repaired roles: nothing yet, after system, after user, after assistant; the last and the first may end.
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Where a new or rerolled row leads, and where a kept row of a role leads.
TURN = (USER, USER, ASSISTANT, USER)
KEEP = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None), "o": (None,) * 4}
FAR = 1 << 60

Layer = tuple[int, int, int, int]
REPORT = "rows bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def closed(a: int, b: int, c: int, d: int) -> Layer:
    """A layer with the rows that may be inserted after it."""
    c = min(c, a + INSERT, b + INSERT, d + INSERT)
    return a, b, c, min(d, c + INSERT)


def moves(symbol: str) -> list[tuple[str, int, tuple]]:
    """(edit, cost, next state by state) of a row, in the order of the edits' letters."""
    out = [("D", DELETE, (START, SYSTEM, USER, ASSISTANT))]
    if symbol != "x":
        more = TRUNCATED if symbol.isupper() else 0
        out += [("K", more, KEEP[symbol.lower()]), ("R", REROLE + more, TURN)]
    return out


MOVES = {s: moves(s) for s in "xsuaoSUAO"}
FIRST = closed(0, FAR, FAR, FAR)


def advance(layer: Layer, symbol: str) -> Layer:
    """The least costs by state after one more row."""
    out = [FAR] * 4
    for _, cost, to in MOVES[symbol]:
        for q, p in enumerate(to):
            if p is not None and layer[q] + cost < out[p]:
                out[p] = layer[q] + cost
    return closed(*out)


def answer(signature: str, layers: list[Layer]) -> tuple[int, str]:
    """(cost, edits) of a whole signature: the ASCII-least edits among the cheapest, from the layers of its prefixes.

    Backward, the states on a cheapest way are marked; forward, each step takes the first letter that stays on one.
    """
    n = len(signature)
    best = min(layers[n][START], layers[n][ASSISTANT])
    good = [q in (START, ASSISTANT) and layers[n][q] == best for q in range(4)]
    marked = [good] * (n + 1)
    for i in range(n, -1, -1):
        f = layers[i]
        if i < n:
            good = [any(p is not None and marked[i + 1][p] and f[q] + cost == layers[i + 1][p] for _, cost, to in MOVES[signature[i]] for p in (to[q],)) for q in range(4)]
        good[USER] |= good[ASSISTANT] and f[USER] + INSERT == f[ASSISTANT]
        for q in (START, SYSTEM, ASSISTANT):
            good[q] |= good[USER] and f[q] + INSERT == f[USER]
        marked[i] = good
    out, i, q = [], 0, START
    while not (i == n and q in (START, ASSISTANT) and layers[n][q] == best):
        f, p = layers[i][q], TURN[q]
        options = [("I", INSERT, i, p)] + ([(e, cost, i + 1, to[q]) for e, cost, to in MOVES[signature[i]] if to[q] is not None] if i < n else [])
        edit, _, i, q = min(x for x in options if marked[x[2]][x[3]] and f + x[1] == layers[x[2]][x[3]])
        out.append(edit)
    return best, "".join(out)


def solve(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of the distinct values of column ``signature``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, layers = "", [FIRST]
        for batch in batches:
            found = []
            for signature in batch.column(0).to_pylist():
                at = 0
                while at < len(path) and path[at : at + 64] == signature[at : at + 64]:
                    at += 64
                while at < min(len(path), len(signature)) and path[at] == signature[at]:
                    at += 1
                at = min(at, len(path), len(signature))
                del layers[at + 1 :]
                for symbol in signature[at:]:
                    layers.append(advance(layers[-1], symbol))
                path = signature
                found.append(answer(signature, layers))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())], names=["signature", "cost", "audit"])

    distinct = signatures.select("signature").distinct()
    return distinct.repartitionByRange("signature").sortWithinPartitions("signature").mapInArrow(run, "signature string, cost bigint, audit string")


def _damaged(conversations: DataFrame) -> DataFrame:
    """The rows as damage leaves them, with ``gone`` for the dropped ones."""
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat_ws(":", whole("conv_id"), whole("turn")).cast("binary")) % 20
    text = F.when(fate == 1, F.lit("")).when(fate == 2, F.regexp_replace(whole("text"), "[.!?]", "")).otherwise(whole("text"))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.when(fate == 4, F.lit("user")).otherwise(whole("role")).alias("role"), text.alias("text"), (fate == 0).alias("gone"), F.when(fate == 3, 2).otherwise(1).alias("times"))
    same = F.unhex(F.sha2(F.concat_ws(":", F.char_length("role").cast("string"), "role", "text"), 256))
    return rows.withColumn("same", same).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "copy")


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage that crc32 of ``conv_id:turn`` deals out."""
    return _damaged(conversations).where("not gone").select("conv_id", "turn", "role", "text")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of sorted batches one by one, followed by None."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 1000).columns), strict=True)
    yield None


def _order(first: str | None = None) -> list[Column]:
    return [F.col("conv_id"), *([F.col(first)] if first else []), F.col("turn").asc_nulls_first(), F.col("role"), F.col("same")]


def diagnose(rows: DataFrame) -> DataFrame:
    """A row a conversation with its counts of faults, its gaps and its signature; rows as ``_damaged`` gives them."""
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    slim = rows.select("conv_id", "turn", "role", "same", "gone", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), (~F.col("text").rlike(f"[.!?][{SPACE}]*\\z")).alias("cut"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, state = [], (), None
        shape = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("rows", "gaps", "blank", "duplicate", "truncated", "illegal")), ("signature", pa.string())])

        def done() -> tuple:
            n = state
            turns = 0 if n["least"] is None else n["last"] - n["least"] + 1 - n["turns"]
            return now[0], len(n["signature"]), turns, n["blank"], n["duplicate"], n["truncated"], n["illegal"], "".join(n["signature"])

        for row in _runs(batches):
            if state is not None and (row is None or row[0] != now[0]):
                out.append(done())
                if row is None or len(out) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), shape, strict=True)], schema=shape)
                    out = []
                state = None
            if row is None:
                return
            conv, turn, _, same, gone, initial, empty, cut = row
            if state is None:
                now, state = (conv,), {"least": None, "last": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "before": None, "seen": set(), "signature": []}
            if gone:
                continue
            if turn is not None and turn != state["last"]:
                state["turns"] += 1
                state["last"] = turn
                if state["least"] is None:
                    state["least"] = turn
            if state["before"] is not None and state["before"] + initial not in ("su", "ua", "au"):
                state["illegal"] += 1
            state["before"] = initial
            symbol = initial if initial in ("s", "u", "a") else "o"
            if empty:
                state["blank"] += 1
                symbol = "x"
            elif same in state["seen"]:
                state["duplicate"] += 1
                symbol = "x"
            elif cut:
                state["truncated"] += 1
                symbol = symbol.upper()
            state["seen"].add(same)
            state["signature"].append(symbol)

    return slim.repartition("conv_id").sortWithinPartitions(*_order()).mapInArrow(run, "conv_id bigint, rows bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, signature string")


def reports(conversations: DataFrame) -> DataFrame:
    """conv_id, rows, gaps, blank, duplicate, truncated, illegal, cost and audit of every conversation; written once.

    The join by signature is one of two plain exchanges, so that a signature of very many conversations is split.
    """
    found = materialise(diagnose(_damaged(conversations)), "diagnosed")
    return materialise(found.join(solve(found), "signature").drop("signature"), "reports")


def repair(conversations: DataFrame, digest: bool = False) -> DataFrame:
    """Every edit in order: conv_id, position, edit, turn, role and text of the repaired row (nulls for a deleted one).

    With ``digest`` a row a conversation: the columns of ``reports`` and the hash of the repaired rows.
    """
    names = [x.split()[0] for x in REPORT.split(", ")]
    rows = _damaged(conversations).where("not gone").select("conv_id", F.lit(True).alias("is_row"), "turn", "role", "same", "text", *(F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in REPORT.split(", ")))
    heads = reports(conversations).select("conv_id", F.lit(False).alias("is_row"), F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("same"), F.lit(None).cast("string").alias("text"), *names)
    stream = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions(*_order("is_row"))

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(head, None) before each conversation and (None, (position, edit, turn, role, text)) for its edits; None at the end."""
        audit, at, last = "", 0, START

        def inserts() -> Iterator[tuple]:
            nonlocal at, last
            while at < len(audit) and audit[at] == "I":
                last = TURN[last]
                yield None, (at, "I", None, NAMES[last], "")
                at += 1

        for row in _runs(batches):
            if row is None:
                yield None
            elif not row[1]:
                yield row, None
                audit, at, last = row[-1], 0, START
                yield from inserts()
            else:
                turn, role, text = row[2], row[3], row[5]
                if audit[at] == "D":
                    yield None, (at, "D", turn, None, None)
                else:
                    last = TURN[last] if audit[at] == "R" else KEEP[role[0]][last]
                    yield None, (at, audit[at], turn, NAMES[last] if audit[at] == "R" else role, text)
                at += 1
                yield from inserts()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in names[:-1]), ("audit", pa.string()), ("repaired_sha256", pa.string())])
        out, head, total = [], None, None
        for item in edited(batches):
            if item is not None and item[1] is not None:
                if item[1][1] != "D":
                    total.update(("\n" if started else "").encode() + f"{item[1][3]}:{item[1][4]}".encode("utf-8", "surrogatepass"))
                    started = True
                continue
            if head is not None:
                out.append((head[0], *head[6:], total.hexdigest()))
            if out and (item is None or len(out) >= 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), shape, strict=True)], schema=shape)
                out = []
            if item is not None:
                head, total, started = item[0], hashlib.sha256(), False

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
        out, size, conv = [], 0, None
        for item in edited(batches):
            if item is not None and item[1] is None:
                conv = item[0][0]
                continue
            if item is not None:
                out.append((conv, *item[1]))
                size += len(item[1][4] or "")
            if out and (item is None or len(out) >= 1000 or size >= 1 << 22):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), shape, strict=True)], schema=shape)
                out, size = [], 0

    if digest:
        return stream.mapInArrow(hashed, f"conv_id bigint, {REPORT}, repaired_sha256 string")
    return stream.mapInArrow(listed, "conv_id bigint, position bigint, edit string, turn bigint, role string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"), digest=True).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
