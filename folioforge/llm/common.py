"""Helpers shared by the corpus operators: shared tables, Arrow text access, vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a Python worker; bounds numpy's temporaries.
CHUNK_BYTES = 1 << 19
#: Bytes of an Arrow batch between an executor and a worker.
BATCH_BYTES = 2 << 20
_WORKER: dict = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset and all run in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = _WORKER.setdefault("own_dir", tempfile.mkdtemp(prefix="folioforge-"))
    return found


def written(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes what written() wrote; nothing that is yet to run may read these tables."""
    for df in tables:
        if hasattr(df, "_folder"):
            deleted(df.sparkSession, df._folder)


def deleted(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def most_frequent(counted: DataFrame, count: str, most: int) -> DataFrame:
    """counted(..., count) with `level` (log2 of the count): the most frequent rows, whole levels, `most` rows at most."""
    leveled = counted.withColumn("level", F.floor(F.log2(count)).cast("int"))
    least, total = None, 0
    for level, n in sorted(((r[0], r[1]) for r in leveled.groupBy("level").count().collect()), reverse=True):
        if total + n > most:
            break
        least, total = level, total + n
    return leveled.where(F.lit(False) if least is None else F.col("level") >= least)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def empty_of(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def small_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches held to BATCH_BYTES (and one row) unless the user has set another size.

    Rows that hold texts and arrays then take a bounded part of an executor's and a worker's memory.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == f"{64 << 20}b":
        spark.conf.set(key, f"{BATCH_BYTES}b")
    return df


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts come to about `most` bytes; one row at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: An odd factor between the words of a gram.
BASE = 0x9E3779B97F4A7C15
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: a-z for A-Z, every other byte as it is.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def places(n: int) -> np.ndarray:
    """An odd pseudo-random factor for each place below n: unlike powers of a base, no structure of a text cancels them out."""
    held = _WORKER.get("places")
    if held is None or len(held) < n:
        size = max(n, 1 << 10)
        held = _WORKER["places"] = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    return held


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice values[start:end] (uint64 values; slices neither empty nor overlapping): the sum of value times place factor."""
    lengths = ends - starts
    if not len(lengths):
        return np.zeros(0, np.uint64)
    at = ragged(lengths, starts)
    place = at - np.repeat(starts, lengths)
    products = values[at] * places(int(lengths.max()))[place]
    sums = np.add.reduceat(products, np.cumsum(lengths) - lengths)
    return mix(sums + lengths.astype(np.uint64))


#: The first n of eight little-endian bytes, for n = 0 to 8.
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice data[start:end] of bytes (none empty): as span_hashes, but of eight bytes at a time."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint64)
    held = np.zeros(len(data) + 8, np.uint8)
    held[: len(data)] = data
    eights = np.ndarray((len(data) + 1,), np.dtype("<u8"), held, 0, (1,))  # from every byte on

    def values(at: np.ndarray, until: np.ndarray) -> np.ndarray:
        return mix((eights[at] & FIRST_BYTES[np.minimum(until - at, 8)]) + np.uint64(BASE))

    lengths, sums = ends - starts, values(starts, ends)
    long = np.flatnonzero(lengths > 8)
    if len(long):
        more = (lengths[long] - 1) // 8
        first = np.cumsum(more) - more
        place = np.arange(1, int(more.sum()) + 1) - np.repeat(first, more)
        parts = values(np.repeat(starts[long], more) + 8 * place, np.repeat(ends[long], more))
        sums[long] += np.add.reduceat(parts * places(int(more.max()) + 1)[place], first)
    return mix(sums + lengths.astype(np.uint64))


def byte_table(is_word) -> np.ndarray:
    return np.array([bool(is_word(b)) for b in range(256)])


#: Words of [^\x20\x09-\x0D]+ and of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
SPACE_WORDS = byte_table(lambda b: b != 0x20 and not 9 <= b <= 13)
LETTER_WORDS = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of words, and the n + 1 word offsets of the texts. No word crosses a text's end."""
    inside = table[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
        after[-1] = False
        after[:-1] = inside[1:]
        cut = offsets[1:-1]
        before[cut[cut < len(data)]] = False
        after[cut[cut > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of lower-cased texts: hashes, starts, ends, word offsets of the texts."""
    data = LOWER[data]
    starts, ends, words = word_spans(data, offsets, table)
    return byte_hashes(data, starts, ends), starts, ends, words


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive word hashes, for each start with n - 1 followers; texts are not heeded."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    last = len(hashes) - n + 1
    out = np.zeros(last, np.uint64)
    for k in range(n):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(BASE) + hashes[k : k + last]
    return mix(out + np.uint64(n))


def gram_rows(words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start words of the n-grams that lie within one text, and their text."""
    counts = np.maximum(np.diff(words) - n + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.repeat(words[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return np.arange(len(text)) + first, text


#: An odd factor below 2 ** 31, applied to numbers folded to 32 bits so that ANSI arithmetic can't overflow.
BIT_FACTOR = 0x9E3779B1


def _folded(values, bits: int):
    """(high half ^ low half) * factor, cut to `bits` bits; all within a signed long."""
    if isinstance(values, str):
        low = F.col(values).bitwiseAND(F.lit(0x7FFFFFFF))
        high = F.shiftrightunsigned(F.col(values), 33)
        return F.shiftright((low.bitwiseXOR(high) * F.lit(BIT_FACTOR & 0x7FFFFFFF)).bitwiseAND(F.lit((1 << 40) - 1)), 41 - bits.bit_length())
    v = values.astype(np.int64).view(np.uint64)
    x = (v & np.uint64(0x7FFFFFFF)) ^ (v >> np.uint64(33))
    return (((x * np.uint64(BIT_FACTOR & 0x7FFFFFFF)) & np.uint64((1 << 40) - 1)) >> np.uint64(41 - bits.bit_length())).astype(np.int64)


def _turned(values):
    """The halves turned to other places: the second probe of a hash."""
    if isinstance(values, str):
        return F.shiftleft(F.col(values), 31).bitwiseOR(F.shiftrightunsigned(F.col(values), 33))
    v = values.astype(np.int64).view(np.uint64)
    return ((v << np.uint64(31)) | (v >> np.uint64(33))).view(np.int64)


def bits_for(n: int, most: int = 1 << 28) -> int:
    """Bits of a bitmap for n values, 32 or more a value up to `most` bits; beyond, more values pass in vain."""
    return min(max(1 << 23, 1 << (32 * n).bit_length()), most)


def bitmap_of(df: DataFrame, column: str, bits: int = 1 << 23, probes: int = 1) -> tuple[np.ndarray, int]:
    """A bitmap of bits / 8 bytes (bits: a power of two) of a column's longs: a prefilter with false positives only.

    Two probes a value ask for longs that are hashes.
    """
    held = df.select(_folded(column, bits).alias("h"))
    if probes == 2:
        held = held.unionByName(df.select(_turned(column).alias("t")).select(_folded("t", bits).alias("h")))
    rows = held.groupBy(F.shiftright("h", 15).alias("k")).agg(F.bitmap_construct_agg(F.col("h").bitwiseAND(F.lit(32767))).alias("b")).toLocalIterator()
    out = np.zeros(max(bits // 8, 4096), np.uint8)
    for k, b in rows:
        out[k * 4096 : k * 4096 + len(b)] |= np.frombuffer(bytes(b), np.uint8)
    return out, bits


def in_bitmap(bitmap: np.ndarray, values: np.ndarray, bits: int, probes: int = 1) -> np.ndarray:
    h = _folded(values, bits)
    found = (bitmap[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1
    if probes == 2:
        at = np.flatnonzero(found)
        found[at] = in_bitmap(bitmap, _turned(values[at]), bits)
    return found


def ragged(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices of the slices [start, start + length), one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return np.arange(total) + np.repeat(starts - first, lengths)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
