"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

An item's windows are its runs of `window` consecutive words; an item of fewer words is one window.
A window is the set of its word shingles with their positions. A document holds a window only if it holds
all of them, so one shingle, the window's rarest, is the necessary prefix: documents are probed for it alone.
The shingle's place in the window and the document's length bound where the window can lie; what is left is
compared word by word.

The window index is sent to the executors while the items can have at most `broadcast_words` words (a bound
checked on their bytes before anything is collected); beyond that the same probes run as a shuffled join on the
prefix shingle.

Defined results: a null or wordless text has no words and no hits; rows with equal doc_id are judged each by its
own text; null, wordless and repeated items: an item_id with several rows counts once, a null item_id is never
listed, though its words count as hit; empty tables give no rows or no hits. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 10
SHINGLE = 3
BROADCAST_WORDS = 200_000
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def item_windows(items: list[tuple[int | None, str | None]], window: int = WINDOW, shingle: int = SHINGLE) -> dict:
    """The index: each distinct window's words, items, prefix shingle (its rarest), the shingle's size and offset."""
    texts = pa.array([t for _, t in items], pa.string())
    data, offsets = C.text_buffers(texts)
    hashes, starts, ends, words = C.word_hashes(data, offsets, C.LETTER_WORDS)
    low = C.LOWER[data].tobytes()
    spelled = [low[s:e] for s, e in zip(starts, ends, strict=True)]
    held: dict[tuple[bytes, ...], set] = {}
    grams: dict[int, np.ndarray] = {n: C.gram_hashes(hashes, n) for n in range(1, shingle + 1)}
    where: dict[tuple[bytes, ...], int] = {}
    for k, (item, _) in enumerate(items):
        a, b = int(words[k]), int(words[k + 1])
        if a == b:
            continue
        size = min(window, b - a)
        for at in range(a, b - size + 1):
            key = tuple(spelled[at : at + size])
            held.setdefault(key, set()).add(item)
            where[key] = at
    frequency: dict[int, dict[int, int]] = {}
    for n, g in grams.items():
        kept, counts = np.unique(g, return_counts=True)
        frequency[n] = dict(zip(kept.tolist(), counts.tolist(), strict=True))
    out = {n: [] for n in range(1, shingle + 1)}
    for w, (key, at) in enumerate(where.items()):
        n = min(shingle, len(key))
        options = [(frequency[n][h], h, o) for o, h in enumerate(grams[n][at : at + len(key) - n + 1].tolist())]
        _, h, o = min(options)
        out[n].append((h, o, w))
    probes = {}
    for n, rows in out.items():
        if rows:
            rows.sort()
            probes[n] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    return {"words": list(where), "items": [sorted(str(i) for i in held[k] if i is not None) for k in where], "probes": probes}


def find(index: dict, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[set]]:
    """Per text: words, hit words and the numbers of the windows that it holds."""
    n_texts = len(offsets) - 1
    hashes, starts, ends, words = C.word_hashes(data, offsets, C.LETTER_WORDS)
    edge = np.zeros(len(hashes) + 1, np.int64)
    found: list[set] = [set() for _ in range(n_texts)]
    low = None
    for n, (keys, places, numbers) in index["probes"].items():
        at, text = C.gram_rows(words, n)
        if not len(at):
            continue
        grams = C.gram_hashes(hashes, n)[at]
        first = np.searchsorted(keys, grams, "left")
        hit = np.flatnonzero(keys[np.minimum(first, len(keys) - 1)] == grams)
        if not len(hit):
            continue
        last = np.searchsorted(keys, grams[hit], "right")
        low = C.LOWER[data].tobytes() if low is None else low
        for i, a, b in zip(hit.tolist(), first[hit].tolist(), last.tolist(), strict=True):
            k = int(text[i])
            for p in range(a, b):
                begin, key = int(at[i]) - int(places[p]), index["words"][numbers[p]]
                # positional bound and length bound: the window lies within the text's words
                if begin < words[k] or begin + len(key) > words[k + 1]:
                    continue
                if all(low[starts[begin + j] : ends[begin + j]] == w for j, w in enumerate(key)):
                    edge[begin] += 1
                    edge[begin + len(key)] -= 1
                    found[k].add(int(numbers[p]))
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return np.diff(words), covered[words[1:]] - covered[words[:-1]], found


def _digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated, items (sorted ids as strings)."""
    spark = docs.sparkSession
    rows = C.small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = items.select(F.col("item_id"), F.col("text"))
    if not _fits(items, broadcast_words):
        return _shuffled(rows, items, window, shingle)
    index = spark.sparkContext.broadcast(item_windows([(r[0], r[1]) for r in items.collect()], window, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = index.value
        for batch in batches:
            data, offsets = C.text_buffers(batch.column(1))
            n_words, n_hit, found = [], [], []
            for i, j in C.chunks(offsets):
                a, b, c = find(held, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n_words.append(a)
                n_hit.append(b)
                found += [{x for w in ws for x in held["items"][w]} for ws in c]
            n_words = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
            n_hit = np.concatenate(n_hit) if n_hit else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([_digest(x) for x in found], pa.string()), pa.array(n_hit > 0), pa.array([sorted(x) for x in found], pa.list_(pa.string()))],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"],
            )

    return rows.mapInArrow(run, SCHEMA + ", items array<string>")


def _shuffled(rows: DataFrame, items: DataFrame, window: int, shingle: int) -> DataFrame:
    """The same for an index without a size bound: prefix shingles and probes meet in a shuffled join."""
    words = lambda c: F.regexp_extract_all(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), F.lit(0))
    held = C.written(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("words", F.coalesce(words(F.col("text")), F.array().cast("array<string>"))).drop("text"))
    cut = items.withColumn("w", words(F.col("text"))).where(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(window)))
    win = cut.select("item_id", "n", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - F.col("n")), lambda i: F.slice("w", i + 1, F.col("n")))).alias("win"))
    win = win.groupBy("win", "n").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    g = F.least(F.col("n"), F.lit(shingle))
    places = win.select("win", "n", "ids", g.alias("g"), F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - g), lambda i: F.array_join(F.slice("win", i + 1, g), " "))).alias("place", "gram"))
    rarity = places.groupBy("gram").agg(F.count("*").alias("f"))
    prefix = places.join(rarity, "gram").groupBy("win", "n", "ids", "g").agg(F.min_by(F.struct("gram", "place"), F.struct("f", "gram", "place")).alias("p")).select("win", "n", "ids", "g", "p.gram", "p.place")

    def grams(n: int) -> DataFrame:
        return held.where(F.size("words") >= n).select("row", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("words") - n), lambda i: F.array_join(F.slice("words", i + 1, n), " "))).alias("at", "gram"), F.lit(n).alias("g"))

    probes = reduce(DataFrame.unionByName, [grams(n) for n in range(1, shingle + 1)])
    near = probes.join(prefix, ["gram", "g"]).withColumn("begin", F.col("at") - F.col("place")).where("begin >= 0").select("row", "begin", "n", "win", "ids")
    sure = held.join(near, "row").where((F.col("begin") + F.col("n") <= F.size("words")) & (F.slice("words", F.col("begin") + 1, F.col("n")) == F.col("win")))
    each = sure.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_set("ids"))).alias("items"), F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("begin"), F.col("begin") + F.col("n") - 1))))).alias("hit"))
    out = held.join(each, "row", "left")
    ids = F.array_sort(F.coalesce("items", F.array().cast("array<string>")))
    return out.select("doc_id", F.size("words").cast("long").alias("n_words"), F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.coalesce("hit", F.lit(0)) > 0).alias("contaminated"), ids.alias("items"))


def _fits(items: DataFrame, broadcast_words: int) -> bool:
    """Whether the items can't have more words than the bound: a word takes two bytes, but for a text's last."""
    size, n = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).head()
    return size // 2 + n <= broadcast_words


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """The documents without any benchmark window, with all their columns; each row is judged by its own text."""
    items = items.select("item_id", "text")
    if not _fits(items, broadcast_words):
        whole = C.written(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col("text").alias("text")).withColumn("doc_id", F.monotonically_increasing_id()))
        clean = contamination(whole, items, window=window, shingle=shingle, broadcast_words=broadcast_words).where("not contaminated").select("doc_id")
        return whole.join(clean, "doc_id", "left_semi").select("whole.*")
    index = docs.sparkSession.sparkContext.broadcast(item_windows([(r[0], r[1]) for r in items.collect()], window, shingle))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.text_buffers(batch.column(at))
            keep = [find(index.value, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[1] == 0 for i, j in C.chunks(offsets)]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return C.small_batches(docs).mapInArrow(run, docs.schema)
