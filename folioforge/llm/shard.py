"""Balanced label propagation: documents move towards their neighbours' shards under capacity quotas.

Documents start in shards by a hash of their id. In each round a join counts, for every linked document, its
neighbours' shards; documents that would cut fewer edges elsewhere ask to move there (by turns a random half, and all
but those with the least number among their neighbours, so that neighbours don't swap places for ever), and a shard admits linked documents up to the quota that its capacity leaves.
Shards that are then too large give documents away, unlinked ones first and linked groups last and whole, until row
counts differ by one at most (law `rows`).

Only counts by shard, and by shard and hash bucket, reach the driver. Slots are numbered by bucket counts and within
buckets, so no task holds a whole shard.

Defined results: a null text counts as empty: size 1, the checksum of no bytes; each row is placed by itself, also
rows with equal or null doc_id; with fewer rows than shards some shards stay empty; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SHARDS = 8
ROUNDS = 6
#: Buckets of hashes that ranks and slots are counted by.
BUCKETS = 1024


def profiled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One short row per document: row (its number here), doc_id, size, text_crc32, text_hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return C.written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash")))


def equal_text_edges(rows: DataFrame) -> DataFrame:
    """(a, b): each document and the first with an equal text (equal length, checksum and hash)."""
    key = ["size", "text_crc32", "text_hash"]
    first = rows.groupBy(*key).agg(F.min("row").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(first, key).where("row <> a").select("a", F.col("row").alias("b"))


def _unit(*columns) -> Column:
    """A hash as a bucket number."""
    return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("int")


def propagated(rows: DataFrame, edges: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """row, shard, linked, group (the least neighbour or itself) after label propagation, before the counts are made even."""
    near = C.written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    total = rows.count()
    capacity = -(-total // shards)
    linked = near.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("row"), F.least("a", "least").alias("group"))
    start = F.pmod(F.xxhash64(F.col("doc_id"), F.col("row")), F.lit(shards)).cast("int")
    labels = C.written(rows.select("row", start.alias("shard")).join(linked, "row", "left").select("row", "shard", F.col("group").isNotNull().alias("linked"), F.coalesce("group", "row").alias("group")))
    held = C.written(labels.where("linked").select("row", "shard"))
    for k in range(rounds):
        votes = near.join(held.select(F.col("row").alias("b"), "shard"), "b").groupBy("a", "shard").agg(F.count("*").alias("n"))
        own = held.select(F.col("row").alias("a"), F.col("shard").alias("now"))
        asked = votes.join(own, "a").groupBy("a", "now").agg(F.max(F.struct("n", (-F.col("shard")).alias("to"))).alias("best"), F.max(F.when(F.col("shard") == F.col("now"), F.col("n"))).alias("stay"))
        asked = asked.select(F.col("a").alias("row"), "now", (-F.col("best.to")).cast("int").alias("to"), (F.col("best.n") - F.coalesce("stay", F.lit(0))).alias("gain"))
        asked = C.written(asked.where("gain > 0 and now <> to").join(linked.select("row", "group"), "row").withColumn("unit", _unit("row", F.lit(k))))
        if asked.isEmpty():
            break
        # by turns a random half may move, and all but those whom their neighbours follow
        turn = F.col("row") != F.col("group") if k % 2 else F.pmod(F.xxhash64("row", F.lit(k + 100)), F.lit(2)) == 0
        asked = asked.where(turn)
        counts = {r[0]: r[1] for r in held.groupBy("shard").count().collect()}
        wanted = asked.groupBy("to", "unit").count().collect()
        # how far, by bucket of a hash, each shard admits who asks: up to the room that linked documents leave in it
        limit = []
        for s in range(shards):
            room = capacity - counts.get(s, 0)
            each = np.zeros(BUCKETS, np.int64)
            for r in wanted:
                if r[0] == s:
                    each[r[1]] += r[2]
            limit.append((s, int(np.searchsorted(np.cumsum(each), max(room, 0), side="right"))))
        quota = rows.sparkSession.createDataFrame(limit, "to int, most int")
        moves = asked.join(F.broadcast(quota), "to").where("unit < most").select("row", "to")
        held = C.written(held.join(moves, "row", "left").select("row", F.coalesce("to", "shard").alias("shard")))
    return C.written(labels.join(held.withColumnRenamed("shard", "new"), "row", "left").select("row", F.coalesce("new", "shard").alias("shard"), "linked", "group"))


def _numbered(rows: DataFrame, by: str, bucket: str, order: list[str]) -> DataFrame:
    """Adds `number`: gapless from 0 within `by`, by bucket, then by `order`. Buckets and values of `by` are few."""
    counts = rows.groupBy(by, bucket).count().collect()
    base, at = [], {}
    for k, b, n in sorted((r[0], r[1], r[2]) for r in counts):
        base.append((k, b, at.get(k, 0)))
        at[k] = at.get(k, 0) + n
    table = rows.sparkSession.createDataFrame(base, f"{by} int, {bucket} int, _base long")
    within = F.row_number().over(Window.partitionBy(by, bucket).orderBy(*order)) - 1
    return rows.withColumn("_within", within).join(F.broadcast(table), [by, bucket]).withColumn("number", F.col("_base") + F.col("_within")).drop("_base", "_within")


def evened(placed: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Moves as few rows as needed, unlinked before linked ones, so that row counts differ by one at most."""
    half = BUCKETS // 2
    leave = F.when(F.col("linked"), half + F.pmod(F.xxhash64("group"), F.lit(half))).otherwise(F.pmod(F.xxhash64("row"), F.lit(half))).cast("int")
    placed = placed.withColumn("unit", leave)
    counts: dict[int, int] = {}
    each = np.zeros((shards, BUCKETS), np.int64)
    for s, b, n in placed.groupBy("shard", "unit").count().collect():
        counts[s] = counts.get(s, 0) + n
        each[s, b] += n
    total = sum(counts.values())
    # the largest shards keep the odd rows
    ranked = sorted(range(shards), key=lambda s: (-counts.get(s, 0), s))
    target = {s: total // shards + (k < total % shards) for k, s in enumerate(ranked)}
    excess = {s: max(0, counts.get(s, 0) - target[s]) for s in range(shards)}
    gaps = [(s, target[s] - counts.get(s, 0)) for s in range(shards) if counts.get(s, 0) < target[s]]
    if not gaps:
        return placed.select("row", "shard")
    limit = []
    for s in range(shards):
        sums = np.cumsum(each[s])
        cut = int(np.searchsorted(sums, excess[s], side="right"))
        limit.append((s, cut, int(excess[s] - (sums[cut - 1] if cut else 0))))
    table = placed.sparkSession.createDataFrame(limit, "shard int, _cut int, _some long")
    near = placed.join(F.broadcast(table), "shard")
    split = near.where("unit = _cut and _some > 0").withColumn("_n", F.row_number().over(Window.partitionBy("shard", "unit").orderBy("group", "row")))
    leavers = C.written(near.where("unit < _cut").select("row", "group", "unit").unionByName(split.where("_n <= _some").select("row", "group", "unit")).withColumn("all", F.lit(0)))
    ends = np.cumsum([n for _, n in gaps]).tolist()
    to = F.get(F.array(*[F.lit(s) for s, _ in gaps]), F.size(F.filter(F.array(*[F.lit(int(e)) for e in ends]), lambda e: e <= F.col("number"))))
    moved = _numbered(leavers, "all", "unit", ["group", "row"]).select("row", to.alias("to"))
    return placed.join(moved, "row", "left").select("row", F.coalesce("to", "shard").alias("shard"))


def sharded(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, edges: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Links are equal texts, or edges(a, b) between the row numbers of profiled().
    """
    rows = profiled(docs)
    links = equal_text_edges(rows) if edges is None else edges
    placed = C.written(evened(propagated(rows, links, shards, rounds), shards).withColumn("bucket", _unit("row")))
    slots = _numbered(placed, "shard", "bucket", ["row"]).select("row", "shard", F.col("number").alias("slot"))
    out = rows.join(slots, "row")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "text_hash")
