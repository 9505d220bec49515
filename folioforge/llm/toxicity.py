"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the embeddings of its byte n-grams (`<word>`, 3 to 6 bytes), so a misspelling never
seen shares most of a known word's vector. Segments of `SEGMENT` words average their words' vectors into a softmax
over clean and toxic; a text is as toxic as its worst segment, wherever in the whole text it lies, so that a few words
in a long text aren't averaged away. The first of an embedding's dimensions starts as the shrunk log odds of the
n-gram's words in toxic and in other texts. From there embeddings and softmax are trained together, by Adam, on the
worst segment of each text, chosen anew as the model changes; the step's floor keeps rare n-grams, which would only be
learnt by heart, near their start. It uses at most `sample` labelled texts, the least by a hash of their id; scoring covers every text.

Defined results: a null or wordless text scores the softmax's bias alone; rows with equal doc_id are scored each by
its text; null labels and labels without a document are not learnt from; without any label the score is 0.5; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .quality import labelled, with_verdict

BITS = 16
SIZES = (3, 4, 5, 6)
DIMENSIONS = 4
SEGMENT = 12
SAMPLE = 8000
STEPS, CHOOSE = 60, 6
RATE, FLOOR = 0.05, 2e-4
#: (Text, word) pairs that count against a log odds.
SHRINK = 8.0
#: How much more a toxic text weighs, as there are fewer.
POSITIVE = 2.0


def grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram numbers of words given as byte spans, joined, and their n + 1 offsets."""
    n = len(starts)
    lengths = ends - starts + 2
    at = np.concatenate([[0], np.cumsum(lengths)])
    joined = np.full(int(at[-1]), 60, np.uint8)  # <
    inner = C.ragged(lengths - 2, at[:-1] + 1)
    joined[inner] = data[C.ragged(lengths - 2, starts)]
    joined[at[1:] - 1] = 62  # >
    values = C.BYTE_VALUES[joined]
    owners, found = [np.arange(n)], [C.span_hashes(values, at[:-1], at[1:])]
    for size in SIZES:
        counts = np.maximum(lengths - size + 1, 0)
        first = C.ragged(counts, at[:-1])
        owners.append(np.repeat(np.arange(n), counts))
        found.append(C.gram_hashes(values, size)[first])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(found)[order] >> np.uint64(64 - bits)).astype(np.int64), np.searchsorted(owner[order], np.arange(n + 1))


def words_of(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words' n-grams with offsets; the words of the texts by number, with offsets."""
    data = C.LOWER[data]
    starts, ends, at = C.word_spans(data, offsets, C.LETTER_WORDS)
    hashes = C.span_hashes(C.BYTE_VALUES[data], starts, ends)
    _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    own, gram_at = grams(data, starts[first], ends[first], bits)
    return own, gram_at, back, at


def words_of_all(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words_of() for many texts: a chunk at a time, only distinct words' bytes and the words' hashes are held."""
    known: dict[int, bytes] = {}
    hashes, counts = [], [np.zeros(1, np.int64)]
    for i, j in C.chunks(offsets):
        low = C.LOWER[data[offsets[i] : offsets[j]]]
        starts, ends, at = C.word_spans(low, offsets[i : j + 1] - offsets[i], C.LETTER_WORDS)
        own = C.span_hashes(C.BYTE_VALUES[low], starts, ends)
        kept, first = np.unique(own, return_index=True)
        whole = low.tobytes()
        for h, a, b in zip(kept.tolist(), starts[first].tolist(), ends[first].tolist(), strict=True):
            if h not in known:
                known[h] = whole[a:b]
        hashes.append(own)
        counts.append(np.diff(at))
    distinct = sorted(known)
    spelled = [known[h] for h in distinct]
    parts, sizes = [], [np.zeros(1, np.int64)]
    for k in range(0, len(spelled), 20_000):
        some = spelled[k : k + 20_000]
        edges = np.cumsum([0, *map(len, some)])
        part, at = grams(np.frombuffer(b"".join(some), np.uint8), edges[:-1], edges[1:], bits)
        parts.append(part.astype(np.int32))
        sizes.append(np.diff(at))
    own = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    gram_at = np.cumsum(np.concatenate(sizes))
    every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return own, gram_at, np.searchsorted(np.array(distinct, np.uint64), every).astype(np.int32), np.cumsum(np.concatenate(counts))


def segments(at: np.ndarray, size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """First words of the texts' segments, and the texts they belong to."""
    counts = np.diff(at)
    each = -(-counts // size)
    text = np.repeat(np.arange(len(counts)), each)
    within = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
    return at[:-1][text] + within * size, text


def means(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Means of the runs values[at[i]:at[i + 1]], none of which is empty."""
    sums = np.add.reduceat(values, at[:-1], axis=0)
    return sums / (np.diff(at)[:, None] if values.ndim > 1 else np.diff(at))


def trained(texts: list[str], labels: np.ndarray, bits: int = BITS, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, float]:
    """Each n-gram's part in the difference of the two logits (embedding times softmax weights), and the bias."""
    data, offsets = C.text_buffers(pa.array(texts, pa.string()))
    own, gram_at, word, at = words_of_all(data, offsets, bits)
    first, owner = segments(at)
    if not len(first):
        return np.zeros(1 << bits, np.float32), 0.0
    random = np.random.default_rng(11)
    table = random.normal(0, 0.02, (1 << bits, dimensions)).astype(np.float32)
    text = np.repeat(np.arange(len(texts)), np.diff(at))
    pairs = np.unique(text * (len(gram_at) - 1) + word.astype(np.int64))
    toxic = labels[pairs // (len(gram_at) - 1)] == 1
    odds = []
    for kind in (toxic, ~toxic):
        each = np.bincount(pairs[kind] % (len(gram_at) - 1), minlength=len(gram_at) - 1)
        odds.append(np.bincount(own, np.repeat(each, np.diff(gram_at)), 1 << bits))
    share = max(float(toxic.mean()), 1e-6)
    table[:, 0] = np.log((odds[0] + SHRINK * share) / (odds[0] + odds[1] + SHRINK) / share)
    softmax = random.normal(0, 0.02, (dimensions, 2)).astype(np.float32)
    softmax[0] = -2.0, 2.0
    bias = np.zeros(2, np.float32)
    last = np.append(first[1:], len(word))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (table, softmax, bias)]
    chosen = np.zeros(0, np.int64)
    for step in range(STEPS):
        if step % CHOOSE == 0:
            scalar = means((table @ (softmax[:, 1] - softmax[:, 0]))[own], gram_at)
            total = np.concatenate([[0.0], np.cumsum(scalar[word], dtype=np.float64)])
            worst = (total[last] - total[first]) / (last - first)
            order = np.lexsort((-worst, owner))
            chosen = order[np.append(True, owner[order][1:] != owner[order][:-1])]
        # the words of the chosen segments, each distinct one once
        size = last[chosen] - first[chosen]
        used, back = np.unique(word[C.ragged(size, first[chosen])], return_inverse=True)
        lengths = gram_at[used + 1] - gram_at[used]
        ids = own[C.ragged(lengths, gram_at[used])]
        edges = np.concatenate([[0], np.cumsum(lengths)])
        vectors = means(table[ids], edges)
        spans = np.concatenate([[0], np.cumsum(size)])
        hidden = means(vectors[back], spans)
        logits = hidden @ softmax + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        y = labels[owner[chosen]].astype(int)
        weight = np.where(y == 1, POSITIVE, 1.0).astype(np.float32)
        slope = (p - np.eye(2, dtype=np.float32)[y]) * (weight / weight.sum())[:, None]
        to_hidden = (slope @ softmax.T) / size[:, None]
        each = np.repeat(to_hidden, size, axis=0)
        to_word = np.stack([np.bincount(back, each[:, k], len(used)) for k in range(dimensions)], 1) / lengths[:, None]
        spread = np.repeat(to_word, lengths, axis=0)
        to_table = np.stack([np.bincount(ids, spread[:, k], 1 << bits) for k in range(dimensions)], 1).astype(np.float32)
        for k, (held, g) in enumerate(zip((table, softmax, bias), (to_table, hidden.T @ slope, slope.sum(0)), strict=True)):
            m, v = state[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            held -= RATE * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.99 ** (step + 1))) + FLOOR)
    return (table @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bias: float, bits: int = BITS) -> np.ndarray:
    own, gram_at, word, at = words_of(data, offsets, bits)
    out = np.full(len(offsets) - 1, bias)
    if len(word):
        scalar = means(weights[own].astype(np.float64), gram_at)[word]
        first, text = segments(at)
        total = np.concatenate([[0.0], np.cumsum(scalar)])
        last = np.append(first[1:], len(word))
        logits = bias + (total[last] - total[first]) / (last - first)
        worst = np.full(len(out), -np.inf)
        np.maximum.at(worst, text, logits)
        out = np.where(np.isfinite(worst), worst, out)
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: int = 2, folds: int = 4, sample: int = SAMPLE, bits: int = BITS) -> tuple[np.ndarray, float]:
    got = labelled(docs, labels, label, fold, folds, sample).toArrow()
    rows = sorted(zip(got.column(0).to_pylist(), (t or "" for t in got.column(1).to_pylist()), strict=True), key=lambda r: (r[0], zlib.crc32(r[1].encode()), r[1]))
    return trained([t for _, t in rows], np.array([y for y, _ in rows]), bits)


def scored(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: int = 2, folds: int = 4, sample: int = SAMPLE, bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, fold, folds, sample, bits))
    rows = C.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.text_buffers(batch.column(1))
            out = [scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], *model.value, bits) for i, j in C.chunks(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], ["doc_id", "score"])

    return with_verdict(rows.mapInArrow(run, "doc_id long, score double"), fold, folds)
