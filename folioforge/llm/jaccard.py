"""N-gram Jaccard join as a T-occurrence search with DivideSkip, and its components.

A document is the set of its 5-word shingles (64-bit hashes). To be linked with a set of m shingles, a set of n must
hold at least T = ceil(0.8 (n + m) / 1.8) of them. All documents order shingles alike, common ones last. DivideSkip
sets aside the L(n) = ceil(0.8 n) - 1 last, longest inverted lists of a document's shingles; only the n - L(n) short
ones are posted to the inverted index. Two documents that are linked meet in at least T - max(L(n), L(m)) short lists:
whichever's short lists end first in the shared order, at most that document's L more are common behind them.

1. One pass over the texts: each set's size and 128-bit digest (equal sets form a class that its least doc_id stands
   for), and the counts of shingles, by lossy counting over all documents.
2. A second pass posts the short lists of the classes' first documents, dealt out by shingle; lists of one document
   fall away as they are read in order. (The classes with most copies are known to the workers, so that copies don't
   post; a copy that does is a document like any other.)
3. A list of a million copies mustn't give the square of that in candidates: first every document asks for one link,
   with the first document of its lists that it meets most often, if it meets it as often as a link needs. Then the
   lists whose members are still in different components give all their pairs across components, long lists in blocks.
   A pair's first common shingle lies within the first n - T + 1 of either document, so that only those pairs are
   joined whose places in the list allow this: the rarest lists, which keeps a dense group's pairs few. Those that
   meet in too few short lists fall away. No link that could join components is lost.
4. Candidates are verified: each document's candidates come together, the short lists of its shingles among them are
   merged by a heap, the long ones probed by binary search, until the required overlap is reached or out of reach.

The order of shingles only steers the work: with another set of common shingles the links are the same.

Defined results: a null, empty or wordless text has no shingles, is linked with nothing and is its own component;
rows with equal doc_id count as one vertex (each row keeps its own n_shingles); a null doc_id has a null component;
an empty table gives no rows; other columns are ignored; doc_ids that aren't numbers raise an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import graph

WORDS = 5
PERCENT = 80
#: Shingles held as common at most (9 bytes each are sent to the executors), and the least count of one.
COMMON = 1 << 19
COMMON_LEAST = 8
#: Shingles counted at once by lossy counting; what occurs once among them is forgotten.
COUNTED = 500_000
#: Classes of equal sets that the workers know at most (16 bytes each), those with most copies.
KNOWN = 1 << 18
#: Documents of a list that ask at one first document, and of a block of a long list, about.
PART = 1024
#: Documents up to which a bitmap in the workers picks the texts to read again; beyond, a shuffled semi-join does.
PICKED = 1 << 24
#: Candidates that are divided and merged at once.
BLOCK = 64


def needed(n: int, m: int, percent: int = PERCENT) -> int:
    """The least overlap of linked sets of n and m shingles: 100 * I >= percent * (n + m - I)."""
    return -(-percent * (n + m) // (100 + percent))


def aside(n: int, percent: int = PERCENT) -> int:
    """L: lists of a set of n shingles that are set aside."""
    return -(-percent * n // 100) - 1


def _overlap(n: str, m: str, percent: int) -> str:
    return f"(({percent} * (cast({n} as long) + {m}) + {99 + percent}) div {100 + percent})"


def meets_enough(k: str, n: str, m: str, percent: int = PERCENT) -> Column:
    """Whether sets of n and m shingles that meet in k short lists may be linked: k >= T - max(L(n), L(m))."""
    return F.expr(f"{k} >= {_overlap(n, m, percent)} - ((cast({percent} as long) * greatest({n}, {m}) + 99) div 100 - 1)")


def meets_first(i: str, n: str, j: str, m: str, percent: int = PERCENT) -> Column:
    """Whether a shingle, the i-th of n and the j-th of m (from 1), may be the first that linked sets share."""
    return F.expr(f"{i} <= {n} - {_overlap(n, m, percent)} + 1 and {j} <= {m} - {_overlap(n, m, percent)} + 1")


def sizes_allow(n: str, m: str, percent: int = PERCENT) -> Column:
    return F.expr(f"100 * cast(least({n}, {m}) as long) >= {percent} * cast(greatest({n}, {m}) as long)")


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, _, _, at = C.word_hashes(data, offsets, C.SPACE_WORDS)
    first, text = C.gram_rows(at, words)
    grams = C.gram_hashes(hashes, words)[first] if len(first) else np.zeros(0, np.uint64)
    ends = np.searchsorted(text, np.arange(len(offsets)))
    out = []
    for k in range(len(offsets) - 1):
        n = int(at[k + 1] - at[k])
        if n == 0:
            out.append(np.zeros(0, np.uint64))
        elif n < words:
            out.append(C.gram_hashes(hashes[at[k] : at[k + 1]], n))
        else:
            out.append(np.unique(grams[ends[k] : ends[k + 1]]))
    return out


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over the set."""
    if not len(shingles):
        return 0, 0
    a = np.add.reduce(C.mix(shingles + np.uint64(0x51ED270B)))
    b = np.add.reduce(C.mix(shingles ^ np.uint64(0xD6E8FEB86659FD93)))
    return int(a.view(np.int64)), int(b.view(np.int64))


def _sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def _profile(rows: DataFrame, words: int) -> DataFrame:
    """doc rows (kind 0: doc_id, n, a, b) and counts of shingles (kind 1: a is the shingle, b its count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "doc_id", "n", "a", "b"]
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            kept, counts = np.unique(np.concatenate(held), return_counts=True)
            more = counts > 1
            n = int(more.sum())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.int64()), pa.array(np.zeros(n, np.int64)), pa.array(C.signed(kept[more])), pa.array(counts[more].astype(np.int64))], names)

        for batch in batches:
            data, offsets = C.text_buffers(batch.column(1))
            for i, j in C.chunks(offsets):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                pairs = [digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(j - i, np.int32)), batch.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names)
                held += sets
                size += sum(map(len, sets))
                if size >= COUNTED:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()

    return rows.mapInArrow(run, "kind int, doc_id long, n long, a long, b long")


def _common(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, at most COMMON of them, and the logarithms of their counts."""
    summed = C.written(counts.groupBy("a").agg(F.sum("b").alias("b")).where(F.col("b") >= COMMON_LEAST))
    got = C.most_frequent(summed, "b", COMMON).select("a", "level").toArrow()
    C.dropped(summed)
    a, level = got.column(0).to_numpy().astype(np.int64).view(np.uint64), got.column(1).to_numpy().astype(np.int8)
    order = np.argsort(a)
    return a[order], level[order]


def _known(classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Digests and first documents of the classes with most copies, at most KNOWN of them."""
    got = C.most_frequent(classes.where("copies > 1"), "copies", KNOWN).select("a", "first").toArrow()
    a, first = (got.column(k).to_numpy().astype(np.int64) for k in (0, 1))
    order = np.argsort(a)
    return a[order], first[order]


def ordered(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in the order that all documents share, by the level of common ones, then by hash; and their levels."""
    keys, levels = common
    if not len(keys) or not len(shingles):
        return shingles, np.zeros(len(shingles), np.int8)
    at = np.minimum(np.searchsorted(keys, shingles), len(keys) - 1)
    level = np.where(keys[at] == shingles, levels[at], 0).astype(np.int8)
    order = np.lexsort((shingles, level))
    return shingles[order], level[order]


def _posted(rows: DataFrame, common, known, words: int, percent: int) -> DataFrame:
    """Short lists' entries: shingle, part, doc_id, n, at (the shingle's place). A list that is known to be long comes in parts from 1, by its documents; else part is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, firsts = known.value
        part_bits = PART.bit_length() - 1
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = C.text_buffers(batch.column(1))
            for i, j in C.chunks(offsets):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                if len(digests):
                    own = np.array([digest(s)[0] for s in sets], np.int64)
                    at = np.minimum(np.searchsorted(digests, own), len(digests) - 1)
                    copy = (digests[at] == own) & (firsts[at] != ids[i:j])
                    sets = [s[:0] if c else s for s, c in zip(sets, copy.tolist(), strict=True)]
                short = [ordered(s, common.value) for s in sets]
                short = [(s[: len(s) - aside(len(s), percent)], v[: len(s) - aside(len(s), percent)]) if len(s) else (s, v) for s, v in short]
                many = np.array([len(s) for s, _ in short], np.int64)
                every, level = np.concatenate([s for s, _ in short]), np.concatenate([v for _, v in short]).astype(np.int64)
                doc = np.repeat(ids[i:j], many)
                parts = np.int64(1) << np.maximum(level - part_bits, 0)
                part = np.where(parts > 1, 1 + (C.signed(C.mix(doc.astype(np.uint64))) & (parts - 1)), 0)
                n = np.repeat(np.array(list(map(len, sets)), np.int32), many)
                place = C.ragged(many, np.ones(len(many), np.int64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(C.signed(every)), pa.array(part.astype(np.int32)), pa.array(doc), pa.array(n), pa.array(place)], ["shingle", "part", "doc_id", "n", "at"])

    return rows.mapInArrow(run, "shingle long, part int, doc_id long, n int, at int")


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries sorted by shingle, part and doc_id: those of lists of several documents, or in parts, with each
    list's (or part's) first document and its size. Only a list's first entry and a batch are held at once."""
    names = ["shingle", "part", "doc_id", "n", "at", "first", "first_n"]
    alone: list[np.ndarray] | None = None  # a list of one entry so far
    head: tuple | None = None  # shingle, part, first document, its size of the list that the last batch ended in
    for batch in batches:
        shingle, part, doc, n, at = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        if not len(shingle):
            continue
        if alone is not None:
            shingle, part, doc, n, at = (np.concatenate(p) for p in zip(alone, (shingle, part, doc, n, at), strict=True))
        new = np.append(True, (shingle[1:] != shingle[:-1]) | (part[1:] != part[:-1]))
        goes_on = alone is None and head is not None and head[:2] == (shingle[0], part[0])
        starts = np.flatnonzero(new)
        length = np.diff(np.append(starts, len(new)))
        first, first_n = doc[starts], n[starts]
        several = (length > 1) | (part[starts] > 0)
        if goes_on:
            first[0], first_n[0], several[0] = head[2], head[3], True
        head, alone = (shingle[-1], part[-1], first[-1], first_n[-1]), None
        if not several[-1]:
            alone = [c[-1:].copy() for c in (shingle, part, doc, n, at)]
        run = np.cumsum(new) - 1
        keep = several[run]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (shingle[keep], part[keep], doc[keep], n[keep], at[keep], first[run][keep], first_n[run][keep])], names)


def divide_skip(own: np.ndarray, others: list[np.ndarray], percent: int = PERCENT) -> list[int]:
    """Which of the other sorted sets reach the overlap with `own` that a link needs (all are uint64, sorted)."""
    n = len(own)
    least = [needed(n, len(o), percent) for o in others]
    able = [k for k, o in enumerate(others) if least[k] <= min(n, len(o))]
    if not able:
        return []
    # inverted lists of own's shingles over the candidates
    lists: dict[int, list[int]] = {}
    for k in able:
        at = np.searchsorted(own, others[k])
        for p in at[own[np.minimum(at, n - 1)] == others[k]].tolist():
            lists.setdefault(p, []).append(k)
    by_length = sorted(lists.items(), key=lambda x: len(x[1]))
    t = min(least[k] for k in able)
    aside = min(t - 1, len(by_length))
    short, long = by_length[: len(by_length) - aside], by_length[len(by_length) - aside :]
    seen: dict[int, int] = {}
    for k in heapq.merge(*(x[1] for x in short)):
        seen[k] = seen.get(k, 0) + 1
    probes = np.sort(own[[p for p, _ in long]]) if long else np.zeros(0, np.uint64)
    out = []
    for k, count in seen.items():
        if count + len(probes) < least[k]:
            continue
        at = np.searchsorted(others[k], probes)
        if count + int((others[k][np.minimum(at, len(others[k]) - 1)] == probes).sum()) >= least[k]:
            out.append(k)
    return sorted(out)


def _sets_of(rows: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """doc_id, mark (a digest) and shingles of the documents in pairs (a, b). Other texts aren't read into sets."""
    ids = C.written(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct())
    n = ids.count()
    few = n <= PICKED
    rows = rows if few else rows.join(ids, "doc_id", "left_semi")
    picked = rows.sparkSession.sparkContext.broadcast(C.bitmap_of(ids, "doc_id", 1 << max(20, (8 * n).bit_length())) if few else None)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if picked.value is not None:
                bitmap, bits = picked.value
                batch = batch.filter(pa.array(C.in_bitmap(bitmap, batch.column(0).to_numpy(zero_copy_only=False), bits)))
            data, offsets = C.text_buffers(batch.column(1))
            for i, j in C.chunks(offsets):
                own = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                at = np.cumsum([0, *map(len, own)]).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(at), pa.array(C.signed(np.concatenate(own))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([digest(s)[0] for s in own], pa.int64()), flat], ["doc_id", "mark", "shingles"])

    out = C.written(rows.mapInArrow(sets, "doc_id long, mark long, shingles array<long>").where(F.size("shingles") > 0))
    picked.destroy()
    C.dropped(ids)
    return out


def _verified(rows: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of doc_ids that are linked, written. Only the sets of documents in pairs move."""
    pairs = pairs.select("a", "b")
    if pairs.isEmpty():
        return pairs
    held = _sets_of(rows, pairs, words)
    others = pairs.join(held.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    # sorted by a: each document's candidates come together (AQE splits those that very many have to be compared with)
    both = others.join(held.select(F.col("doc_id").alias("a"), F.col("mark").alias("ma"), F.col("shingles").alias("sa")).hint("merge"), "a").select("a", "ma", "sa", "b", "sb")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_set = lambda x: np.asarray(x.values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
        for batch in batches:
            a, mark, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
            own, others = batch.column(2), batch.column(4)
            found: list[int] = []
            cuts = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (mark[1:] != mark[:-1]))) if len(a) else np.zeros(0, np.int64)
            for start, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(a)], strict=True):
                for k in range(start, end, BLOCK):
                    found += [k + x for x in divide_skip(as_set(own[start]), [as_set(others[q]) for q in range(k, min(end, k + BLOCK))], percent)]
            yield pa.RecordBatch.from_arrays([pa.array(a[found]), pa.array(b[found])], ["a", "b"])

    out = C.written(both.mapInArrow(verify, "a long, b long"))
    C.dropped(held)
    return out


def _asked(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each document the first document of its lists that it meets most often, if often enough; a < b."""
    heads = lists.where("part > 0").groupBy("shingle").agg(F.min(F.struct("first", "first_n")).alias("head"))
    kept = ["shingle", "doc_id", "n", "first", "first_n"]
    whole = lists.where("part > 0").select("shingle", "doc_id", "n").join(heads, "shingle").select("shingle", "doc_id", "n", "head.*")
    met = lists.where("part = 0").select(*kept).unionByName(whole).where("doc_id > first").where(sizes_allow("n", "first_n", percent)).groupBy("doc_id", "n", "first", "first_n").agg(F.count("*").alias("k"))
    best = met.where(meets_enough("k", "n", "first_n", percent)).groupBy("doc_id").agg(F.max(F.struct("k", (-F.col("first")).alias("a"))).alias("m"))
    return best.select((-F.col("m.a")).alias("a"), F.col("doc_id").alias("b"))


def _across(lists: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of a list's documents in different components whose first common shingle it may be."""
    own = lists.join(roots.withColumnRenamed("v", "doc_id"), "doc_id", "left").select("shingle", "doc_id", "n", "at", F.coalesce("component", "doc_id").alias("component"))
    open_ = own.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("m")).where("x < y").select("shingle", F.ceil(F.col("m") / PART).cast("int").alias("parts"))
    left = C.written(own.join(open_, "shingle"))
    # a long list in blocks: each document asks in its own block, and is there to be found in all of them
    x = left.select("shingle", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"), F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("at").alias("ia"), F.col("component").alias("ca"))
    y = left.select("shingle", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib"), F.col("component").alias("cb"))
    pairs = x.join(y, ["shingle", "part"]).where("a < b and ca <> cb").where(meets_first("ia", "na", "ib", "nb", percent))
    pairs = C.written(pairs.select("a", "b").distinct())
    # how often they meet: what both have posted, at most n - L(n) shingles a document, is compared before sets move
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    short = C.written(lists.join(ids, "doc_id", "left_semi").groupBy("doc_id", "n").agg(F.collect_set("shingle").alias("s")))
    both = pairs.join(short.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa")), "a").join(short.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb")), "b")
    out = C.written(both.where(meets_enough("size(array_intersect(sa, sb))", "na", "nb", percent)).select("a", "b").distinct())
    C.dropped(left, pairs, short)
    return out


def linked(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    context, rows = spark.sparkContext, _sets(C.small_batches(docs), id_col, text_col)
    profile = C.written(_profile(rows, words))
    own = profile.where("kind = 0").select("doc_id", "n", "a", "b")
    classes = C.written(own.where("n > 0 and doc_id is not null").groupBy("n", "a", "b").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")))
    common, known = context.broadcast(_common(profile.where("kind = 1").select("a", "b"))), context.broadcast(_known(classes))
    rows = rows.where("doc_id is not null")
    dealt = _posted(rows, common, known, words, percent).repartition("shingle", "part").sortWithinPartitions("shingle", "part", "doc_id")
    lists = C.written(dealt.mapInArrow(listed, "shingle long, part int, doc_id long, n int, at int, first long, first_n int"))
    common.destroy()
    known.destroy()

    asked = C.written(_asked(lists, percent))
    links = _verified(rows, asked, words, percent)
    roots = graph.rooted(links.select(F.col("b").alias("v"), F.col("a").alias("p")).distinct())
    across = _across(lists, roots, percent)
    edges = links.unionByName(_verified(rows, across, words, percent))
    # a doc_id of several sets joins their classes
    sets = own.where("n > 0 and doc_id is not null")
    again = C.written(sets.groupBy("doc_id").agg(F.min(F.struct("n", "a", "b")).alias("x"), F.max(F.struct("n", "a", "b")).alias("y")).where("x < y").select("doc_id"))
    if not again.isEmpty():
        edges = edges.unionByName(sets.join(again, "doc_id", "left_semi").join(classes, ["n", "a", "b"]).select(F.col("first").alias("a"), F.col("doc_id").alias("b")))
    parts = graph.components(edges)
    C.dropped(lists, asked, links, across, again)
    # only classes with copies say something new of a row
    first = classes.where("copies > 1").select("n", "a", "b", "first")
    of = own.join(first, ["n", "a", "b"], "left").withColumn("v", F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id")))
    return of.join(parts, "v", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "v").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents that stand for their component (those with its least doc_id), with all their columns.

    Rows with equal doc_id and text are one document: the row whose JSON is least stays. Rows with equal doc_id and other
    texts are documents of their own: the least text has the doc_id, the others come behind all doc_ids in their
    component, so that they stay unless another document stands for them. Rows with a null doc_id stay.
    """
    names = [f"`{c}`" for c in docs.columns]
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if again.isEmpty():
        parts = linked(docs, words, percent)
        gone = C.written(parts.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct())
        return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti").select(*names)
    again = C.written(again.select(F.col("doc_id").alias("_again")))
    texts = docs.join(again, F.col("doc_id") == F.col("_again"), "left_semi").select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text")).distinct()
    texts = texts.withColumn("_place", F.row_number().over(Window.partitionBy("_doc").orderBy(F.col("_text").asc_nulls_first())))
    top = docs.agg(F.max("doc_id")).head()[0]
    others = texts.where("_place > 1").orderBy("_doc", "_place").select("_doc", "_text", (F.lit(top).cast("long") + 1 + F.monotonically_increasing_id()).alias("_id"))
    others = C.written(others)
    rows = docs.join(others, (F.col("doc_id") == F.col("_doc")) & F.col("text").eqNullSafe(F.col("_text")), "left")
    rows = C.written(rows.select(F.struct(*names).alias("_row"), F.coalesce("_id", F.col("doc_id").cast("long")).alias("doc_id"), "text"))
    parts = linked(rows.select("doc_id", "text"), words, percent)
    gone = C.written(parts.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct())
    kept = rows.join(gone, rows["doc_id"] == gone["_gone"], "left_anti")
    many = kept.where("doc_id is not null").groupBy("doc_id").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return kept.where("doc_id is null").select("_row.*").unionByName(many.select("_row.*"))
