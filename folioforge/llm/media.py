"""Telephony audio columns: WAV containers of mu-law, A-law and IMA ADPCM, decoded in numpy and resampled.

Mu-law and A-law bytes are expanded by tables of 256 entries that are built from their companding rule; ADPCM blocks
start from their own header and are decoded one nibble at a time across all blocks of a batch at once. Decoded audio
is resampled linearly and stored as 16-bit PCM. The container holds the given bytes as they are, so reading it back
is exact.

Defined results: a null payload or text counts as empty; bytes that are no readable container give a null; a last
ADPCM block that is cut short is decoded as far as it goes; a step index beyond its table counts as its last; rows
with equal ids are decoded each by itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MULAW, ALAW, ADPCM, PCM = 7, 6, 0x11, 1
NAMES = {MULAW: "mulaw", ALAW: "alaw", ADPCM: "adpcm"}
RATE, RESAMPLED = 8000, 16000
#: Bytes of an ADPCM block: 4 of header and 376 nibbles.
BLOCK = 192
#: Text payloads are filled up with blanks to a positive multiple of this many bytes.
FILL = 192
#: The step index's change for the low three bits of a nibble.
INDEX_STEPS = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int64)


def step_sizes() -> np.ndarray:
    """The 89 steps of IMA ADPCM, each about 1.1 times the one before it."""
    fixed = [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767]
    return np.array(fixed, np.int64)


def mulaw_table() -> np.ndarray:
    """16-bit samples of G.711 mu-law bytes."""
    code = ~np.arange(256) & 0xFF
    size = ((((code & 0x0F) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit samples of G.711 A-law bytes."""
    code = np.arange(256) ^ 0x55
    segment, low = (code >> 4) & 7, (code & 0x0F) << 4
    size = np.where(segment == 0, low + 8, (low + 0x108) << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW_TABLE, ALAW_TABLE, STEPS = mulaw_table(), alaw_table(), step_sizes()


def adpcm_blocks(blocks: np.ndarray) -> np.ndarray:
    """Samples of mono IMA ADPCM blocks (n, bytes a block): all blocks take each step together."""
    n, size = blocks.shape
    out = np.zeros((n, 1 + 2 * (size - 4)), np.int16)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int64)
    index = np.minimum(blocks[:, 2], 88).astype(np.int64)
    out[:, 0] = value
    for k in range(2 * (size - 4)):
        nibble = (blocks[:, 4 + k // 2] >> (4 * (k % 2))) & 15
        step = STEPS[index]
        change = (step >> 3) + np.where(nibble & 1, step >> 2, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 4, step, 0)
        value = np.clip(value + np.where(nibble & 8, -change, change), -32768, 32767)
        index = np.clip(index + INDEX_STEPS[nibble & 7], 0, 88)
        out[:, 1 + k] = value
    return out


def adpcm(payload: np.ndarray, block: int = BLOCK) -> np.ndarray:
    whole = len(payload) // block * block
    parts = [adpcm_blocks(payload[:whole].reshape(-1, block)).ravel()] if whole else []
    if len(payload) - whole > 4:
        parts.append(adpcm_blocks(payload[whole:].reshape(1, -1)).ravel())
    return np.concatenate(parts) if parts else np.zeros(0, np.int16)


def resample(samples: np.ndarray, rate: int = RATE, to: int = RESAMPLED) -> np.ndarray:
    """Linear interpolation at the new rate; the last sample is held."""
    n = len(samples)
    if not n or rate == to:
        return samples.astype(np.int16)
    at = np.arange(n * to // rate, dtype=np.int64) * rate
    low, rest = at // to, at % to
    x = samples.astype(np.int64)
    return ((x[low] * (to - rest) + x[np.minimum(low + 1, n - 1)] * rest) // to).astype(np.int16)


def container(payload: bytes, kind: int, rate: int = RATE, block: int = BLOCK) -> bytes:
    """A mono WAV file."""
    if kind == ADPCM:
        form = struct.pack("<HHIIHHHH", kind, 1, rate, rate * block // (2 * block - 7), block, 4, 2, 2 * block - 7)
    elif kind == PCM:
        form = struct.pack("<HHIIHH", kind, 1, rate, rate * 2, 2, 16)
    else:
        form = struct.pack("<HHIIHHH", kind, 1, rate, rate, 1, 8, 0)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def opened(media: bytes | None) -> tuple[int, int, int, bytes] | None:
    """(format, rate, block, payload) of a mono WAV file; None for anything else."""
    if media is None or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt " and size >= 16:
            form = struct.unpack_from("<HHIIH", media, at + 8)
        elif name == b"data":
            return (form[0], form[2], form[4], media[at + 8 : at + 8 + size]) if form and form[1] == 1 else None
        at += 8 + size + size % 2
    return None


def decode(media: bytes | None) -> tuple[np.ndarray, int] | None:
    """Samples and rate of one file."""
    got = opened(media)
    if got is None:
        return None
    kind, rate, block, payload = got
    data = np.frombuffer(payload, np.uint8)
    if kind == MULAW:
        return MULAW_TABLE[data], rate
    if kind == ALAW:
        return ALAW_TABLE[data], rate
    if kind == PCM:
        return np.frombuffer(payload[: len(payload) // 2 * 2], "<i2"), rate
    return (adpcm(data, block), rate) if kind == ADPCM and block > 4 else None


def pcm_column(media: DataFrame, id_col: str = "id", media_col: str = "media", to: int = RESAMPLED) -> DataFrame:
    """id and pcm: each file decoded, resampled and stored as a 16-bit WAV file, null if it can't be read."""
    rows = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))

    def one(x: bytes | None) -> bytes | None:
        got = decode(x)
        return None if got is None else container(resample(*got, to).astype("<i2").tobytes(), PCM, to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one(x.as_py()) for x in batch.column(1)], pa.binary())], ["id", "pcm"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, pcm binary")


def feature(kind: int, samples: np.ndarray) -> str:
    """The codec, samples, mean square, peak and sign changes of resampled audio."""
    x = samples.astype(np.int64)
    n = max(len(x), 1)
    signs = samples >= 0
    return f"{NAMES[kind]}:{len(x)}:{int(x @ x) // n}:{int(np.abs(x).max(initial=0))}:{int(np.count_nonzero(signs[1:] != signs[:-1]))}"


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Each text's bytes stored as telephony audio, read back and measured. Equal texts get the same codec.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature,
    pcm_sha256 (of the resampled audio as a 16-bit WAV file), and with_media both stored files.
    """
    rows = C.small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_sha256"] + ["media", "pcm"] * with_media

    def some(texts: list[bytes]) -> list[tuple]:
        files = []
        for t in texts:
            payload = t + b" " * (-len(t) % FILL or (FILL if not t else 0))
            files.append(container(payload, (MULAW, ALAW, ADPCM)[zlib.crc32(t) % 3]))
        back = [opened(f) for f in files]
        blocked = [k for k, b in enumerate(back) if b[0] == ADPCM]
        audio: dict[int, np.ndarray] = {}
        if blocked:
            every = adpcm_blocks(np.frombuffer(b"".join(back[k][3] for k in blocked), np.uint8).reshape(-1, BLOCK))
            at = 0
            for k in blocked:
                n = len(back[k][3]) // BLOCK
                audio[k] = every[at : at + n].ravel()
                at += n
        out = []
        for k, (t, f, (kind, rate, _, payload)) in enumerate(zip(texts, files, back, strict=True)):
            samples = audio[k] if k in audio else (MULAW_TABLE if kind == MULAW else ALAW_TABLE)[np.frombuffer(payload, np.uint8)]
            again = resample(samples, rate)
            pcm = container(again.astype("<i2").tobytes(), PCM, RESAMPLED)
            out.append((len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(f), hashlib.sha256(f).hexdigest(), feature(kind, again), hashlib.sha256(pcm).hexdigest(), *[f, pcm] * with_media))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.text_buffers(batch.column(1))
            whole = data.tobytes()
            for i, j in C.chunks(offsets):
                got = list(zip(*some([whole[offsets[k] : offsets[k + 1]] for k in range(i, j)]), strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()] + [pa.binary()] * 2 * with_media
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(x, t) for x, t in zip(got, kinds, strict=True))], names)

    return rows.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_sha256 string" + ", media binary, pcm binary" * with_media)
