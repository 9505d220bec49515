"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

A text is a row of marks: words, runs of signs, and what repeats the mark before it as one mark. Marks and pairs of
marks are hashed to 2 ** `bits` weights; a text's value of a feature is its share of the text's features, so a score
is a sparse dot product that doesn't grow with length. Weights come from FTRL-Proximal updates, one labelled text at a
time, over a bounded sample of the labelled rows (`sample` texts, the least by a hash of their id); scoring covers
every text.

Defined results: a null or empty text has no features and scores the bias's share; rows with equal doc_id are scored
each by its text; labels of null, or without a document, are not learnt from; conflicting labels of one id are
each learnt; without any label the score is 0.5; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BITS = 18
#: Labelled texts that training uses at most, and the bytes of the longest.
SAMPLE, LONGEST = 6000, 1 << 20
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
#: Feature shares are this much larger, so that weights stay within a few units.
SCALE = 20.0
THRESHOLD = 0.3

_WORD, _SIGN = 1, 2
_KIND = np.array([0 if b == 32 or 9 <= b <= 13 else _WORD if b >= 128 or chr(b).isalnum() else _SIGN for b in range(256)], np.uint8)


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the texts, joined, and their n + 1 offsets."""
    kind = _KIND[data]
    new = np.ones(len(kind), bool)
    if len(kind):
        new[1:] = kind[1:] != kind[:-1]
        cut = offsets[1:-1]
        new[cut[cut < len(kind)]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(kind))
    kept = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[kept], ends[kept]
    at = np.searchsorted(starts, offsets)
    marks = C.span_hashes(C.BYTE_VALUES[data], starts, ends)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    if len(marks) > 1:
        # a word that comes again at once, perhaps with signs between
        again = (marks[1:] == marks[:-1]) & (text[1:] == text[:-1])
        marks = marks.copy()
        marks[1:][again] = np.uint64(1)
    pairs = C.mix(marks[:-1] * np.uint64(C.BASE) + marks[1:]) if len(marks) > 1 else np.zeros(0, np.uint64)
    inner = text[1:] == text[:-1] if len(text) > 1 else np.zeros(0, bool)
    owner = np.concatenate([text, text[1:][inner]])
    order = np.argsort(owner, kind="stable")
    every = np.concatenate([marks, pairs[inner]])[order] >> np.uint64(64 - bits)
    return every.astype(np.int64), np.searchsorted(owner[order], np.arange(len(at)))


def shares(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kept, counts = np.unique(own, return_counts=True)
    return kept, SCALE * counts / max(len(own), 1)


def trained(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias by FTRL-Proximal."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    last = 1 << bits

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        out = -(own - np.sign(own) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(own) <= L1, 0.0, out)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x = rows[k]
            at, x = np.append(at, last), np.append(x, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - labels[k]) * x
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    w = weights(np.arange(last + 1))
    return w[:-1].astype(np.float32), float(w[-1])


def _vectors(rows: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.text_buffers(batch.column(1))
            for i, j in C.chunks(offsets):
                own, at = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], bits)
                both = [shares(own[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([b[0].astype(np.int32) for b in both], pa.list_(pa.int32())), pa.array([b[1].astype(np.float32) for b in both], pa.list_(pa.float32()))], ["label", "at", "x"])

    return rows.mapInArrow(run, "label int, at array<int>, x array<float>")


def labelled(docs: DataFrame, labels: DataFrame, label: str, fold: int, folds: int, sample: int) -> DataFrame:
    """(label, text) of at most `sample` labelled rows outside the held-out fold whose documents are there, the least by a hash of their id.

    Texts of over LONGEST bytes aren't sampled: they would fill the driver.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    known = known.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) != fold)
    text = C.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST)
    order, n = [F.xxhash64("doc_id"), "doc_id", "label"], sample
    while True:
        asked = C.written(known.orderBy(*order).limit(n))
        chosen = C.written(text.select("doc_id").join(F.broadcast(asked), "doc_id").distinct().orderBy(*order).limit(sample))
        if chosen.count() >= sample or asked.count() < n:
            break
        n *= 4  # labels without a document don't use up the sample
    # at most `sample` rows of an id and a label each
    return text.join(F.broadcast(chosen), "doc_id").select("label", "text")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: int = 0, folds: int = 5, sample: int = SAMPLE, bits: int = BITS) -> tuple[np.ndarray, float]:
    got = _vectors(labelled(docs, labels, label, fold, folds, sample), bits).toArrow()
    known = got.column(0).to_numpy()
    at, x = (got.column(k).combine_chunks() for k in (1, 2))
    # slices of Arrow's buffers: as Python numbers they would take eight times the memory
    cut, numbers, values = at.offsets.to_numpy(), at.values.to_numpy(), x.values.to_numpy()
    rows = [(numbers[i:j], values[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
    # rows come in any order; training doesn't depend on it
    order = sorted(range(len(rows)), key=lambda k: (known[k], zlib.crc32(rows[k][0]), len(rows[k][0])))
    return trained([rows[k] for k in order], known[order].astype(float), bits)


def scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bias: float, bits: int = BITS) -> np.ndarray:
    own, at = features(data, offsets, bits)
    total = np.concatenate([[0.0], np.cumsum(weights[own], dtype=np.float64)])
    lengths = np.diff(at)
    return 1 / (1 + np.exp(-np.clip(bias + SCALE * (total[at[1:]] - total[at[:-1]]) / np.maximum(lengths, 1), -30, 30)))


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: int = 0, folds: int = 5, sample: int = SAMPLE, bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, fold, folds, sample, bits))
    rows = C.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.text_buffers(batch.column(1))
            out = [scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], *model.value, bits) for i, j in C.chunks(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], ["doc_id", "score"])

    out = rows.mapInArrow(run, "doc_id long, score double")
    return with_verdict(out, fold, folds)


def with_verdict(out: DataFrame, fold: int, folds: int) -> DataFrame:
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == fold, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns; each row is judged by its own text."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample=sample, bits=bits))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.text_buffers(batch.column(at))
            out = [scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], *model.value, bits) for i, j in C.chunks(offsets)]
            if out:
                yield batch.filter(pa.array(np.concatenate(out) >= THRESHOLD))

    return C.small_batches(docs).mapInArrow(run, docs.schema)
