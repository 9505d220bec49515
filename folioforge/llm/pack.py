"""Packing token sequences as a cutting-stock problem solved by column generation.

A document's ids (with the closing id) are cut into runs of `capacity`; what is left over is its last piece. Full
pieces are sequences by themselves. The lengths of the last pieces, rounded up to `unit` ids, form a histogram of at
most capacity / unit classes whatever the corpus's size. Over it a linear program chooses how often to use each
pattern (a multiset of classes that fits a sequence); a knapsack by dynamic programming over the program's prices
finds the patterns worth adding. Counts are rounded down, the rest is packed first-fit decreasing, and the patterns'
places are dealt to the pieces by their rank within their class, so only the histogram and the patterns ever reach
the driver. Sequence numbers aren't gapless: full pieces take theirs from where they are stored.

Defined results: a null text counts as empty and packs as its closing id alone; every row is packed, also rows with
equal or null doc_id; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

CAPACITY = 2048
UNIT = 8
CLOSING_ID = 1
#: The linear program is solved to within this share of sequences.
TOLERANCE = 1e-3
#: Buckets that ranks within a class are counted by, at least, and pieces a bucket of all classes, about.
BUCKETS, BUCKET_ROWS = 64, 1 << 20


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, and with_ids the ids themselves."""
    rows = C.small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    given = path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from . import pretokens

        model = pretokens.encoder(given or vocabulary())
        for batch in batches:
            data, offsets = C.text_buffers(batch.column(1))
            row, start, length, crc, total, kept = [], [], [], [], [], []
            for i, j in C.chunks(offsets):
                ids, at = model.encode_added(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for k in range(j - i):
                    own = np.append(ids[at[k] : at[k + 1]], np.uint32(CLOSING_ID)).astype("<u4")
                    for s in range(0, len(own), capacity):
                        piece = own[s : s + capacity]
                        row.append(i + k)
                        start.append(s)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece))
                        total.append(len(own))
                        if with_ids:
                            kept.append(piece.view(np.int32))
            if row:
                out = [batch.column(0).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    out.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


def best_pattern(prices: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: the multiset of sizes within `room` of the highest price, by dynamic programming."""
    value = np.zeros(room + 1)
    taken = np.full(room + 1, -1)
    for w in range(1, room + 1):
        n = int(np.searchsorted(sizes, w, side="right"))
        value[w] = value[w - 1]
        if n:
            options = prices[:n] + value[w - sizes[:n]]
            k = int(np.argmax(options))
            if options[k] > value[w] + 1e-12:
                value[w], taken[w] = options[k], k
    pattern, w = np.zeros(len(sizes)), room
    while w > 0:
        if taken[w] < 0:
            w -= 1
        else:
            pattern[taken[w]] += 1
            w -= sizes[taken[w]]
    return float(value[room]), pattern


def patterns(histogram: dict[int, int], room: int) -> list[tuple[int, dict[int, int]]]:
    """How often to use which pattern, so that every class's count is met exactly: [(times, {size: count})]."""
    sizes = np.array(sorted(s for s, n in histogram.items() if n > 0), np.int64)
    if not len(sizes):
        return []
    demand = np.array([histogram[int(s)] for s in sizes], float)
    m = len(sizes)
    # the first basis: patterns filled first-fit decreasing, each used until a class of it is spent (so it is triangular)
    basis, use, rest, open_ = np.zeros((m, m)), np.zeros(m), demand.copy(), np.ones(m, bool)
    for k in range(m):
        space, column = room, np.zeros(m)
        for c in np.flatnonzero(open_)[::-1]:
            column[c] = space // sizes[c]
            space -= int(column[c]) * int(sizes[c])
        held = np.flatnonzero(column)
        spent = held[np.argmin(rest[held] / column[held])]
        use[k] = rest[spent] / column[spent]
        rest = np.maximum(rest - use[k] * column, 0)
        open_[spent] = False
        basis[:, k] = column
    # revised simplex; each basis is feasible, so stopping early costs padding only
    least = float(sizes @ demand) / room
    for _ in range(20 * m + 100):
        if use.sum() <= least * (1 + TOLERANCE):  # no packing needs fewer sequences than the ids fill
            break
        prices = np.linalg.solve(basis.T, np.ones(m))
        gain, column = best_pattern(np.maximum(prices, 0), sizes, room)
        if gain <= 1 + TOLERANCE:  # then the program is within that share of its optimum (Farley's bound)
            break
        step = np.linalg.solve(basis, column)
        rising = step > 1e-9
        if not rising.any():
            break
        ratio = np.where(rising, use / np.where(rising, step, 1), np.inf)
        out = int(np.argmin(ratio))
        use = np.maximum(use - ratio[out] * step, 0)
        use[out] = ratio[out]
        basis[:, out] = column
    left = demand.astype(np.int64)
    found: Counter = Counter()
    for k in np.argsort(-use):
        column = basis[:, k].astype(np.int64)
        if not column.any():
            continue
        times = min(int(np.floor(use[k] + 1e-9)), *(int(left[c] // column[c]) for c in np.flatnonzero(column)))
        if times > 0:
            left -= times * column
            found[tuple((int(sizes[c]), int(column[c])) for c in np.flatnonzero(column))] += times
    # first-fit decreasing over what rounding left: a few sequences for each pattern at most
    while left.any():
        space, own = room, {}
        for c in range(m - 1, -1, -1):
            n = min(int(left[c]), space // int(sizes[c]))
            if n:
                own[int(sizes[c])] = n
                left[c] -= n
                space -= n * int(sizes[c])
        found[tuple(sorted(own.items()))] += 1
    return [(n, dict(p)) for p, n in found.items()]


def packed(pieces: DataFrame, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most `capacity` ids (column length at least)."""
    spark = pieces.sparkSession
    room = capacity // unit
    names = [f"`{c}`" for c in pieces.columns]
    held = C.written(pieces.select(F.struct(*names).alias("_piece"), F.col("length").alias("_length"), F.ceil(F.col("length") / unit).cast("int").alias("_class"), F.monotonically_increasing_id().alias("_row")))
    rest = held.where(F.col("_length") < capacity)
    histogram = Counter({r[0]: r[1] for r in rest.groupBy("_class").count().collect()})
    buckets = max(BUCKETS, sum(histogram.values()) // BUCKET_ROWS)
    runs: dict[int, list] = {}
    done: Counter = Counter()
    sequence = 0
    for times, pattern in patterns(histogram, room):
        for size, each in pattern.items():
            runs.setdefault(size, []).append((done[size], sequence, each))
            done[size] += times * each
        sequence += times
    # for each class the ranks at which a run of one pattern's places begins, its first sequence, its places a sequence
    table = [(c, [r[0] for r in own], [r[1] for r in own], [r[2] for r in own]) for c, own in runs.items()]
    where = spark.createDataFrame(table, "_class int, _from array<long>, _first array<long>, _each array<long>")
    # ranks within a class: by bucket, then within the bucket, so that no task holds a class
    rest = rest.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)).cast("int"))
    upto = Window.partitionBy("_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rest.groupBy("_class", "_bucket").count().select("_class", "_bucket", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("_class", "_bucket").orderBy("_row")) - 1
    ranked = rest.withColumn("_rank", rank).join(base, ["_class", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    run = F.size(F.filter("_from", lambda x: x <= F.col("_rank"))) - 1
    placed = ranked.join(F.broadcast(where), "_class").withColumn("_run", run)
    placed = placed.withColumn("sequence_id", F.get("_first", F.col("_run")) + F.floor((F.col("_rank") - F.get("_from", F.col("_run"))) / F.get("_each", F.col("_run"))))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("_length"), "_class", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    shared = placed.select("_piece.*", F.col("sequence_id").cast("long").alias("sequence_id"), F.coalesce(F.sum("_length").over(before), F.lit(0)).cast("long").alias("offset"))
    # a full piece is a sequence by itself: any number above the shared ones
    full = held.where(F.col("_length") == capacity).select("_piece.*", (F.lit(sequence).cast("long") + F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return shared.unionByName(full)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    return packed(token_pieces(docs, path, capacity), capacity, unit)
