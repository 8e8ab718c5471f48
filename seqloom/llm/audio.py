"""Telephony audio in media columns.

store() keeps bytes as the samples of a WAV file with one of the 8-bit telephone laws; read_audio() takes such files
(mu-law, A-law, or IMA ADPCM in blocks) back to their bytes, expands them to 16-bit PCM and resamples that. The laws are
lookup tables; ADPCM is decoded one nibble at a time for all blocks of a batch at once. The resampling filter works on
integers, so that equal bytes give equal PCM on every machine.

Defined results: null bytes are stored as null; a null or damaged file is read as null payload and PCM with an empty
feature; texts of any length are one file; further columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from math import gcd

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices

RATE = 8000
PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 0x11
#: Bytes of an ADPCM block, and what a payload is padded to.
BLOCK = 192
#: Taps of the resampling filter for each output phase; its unit is 2 ** 14.
TAPS, UNIT = 24, 1 << 14
# Fixed values of IMA ADPCM: step sizes, and how a nibble moves the step index.
STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
MOVES = [-1, -1, -1, -1, 2, 4, 6, 8]


def mulaw_table() -> np.ndarray:
    u = ~np.arange(256) & 255
    size = (((u & 15) << 3) + 132 << ((u >> 4) & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    exp, size = (a >> 4) & 7, ((a & 15) << 4) + 8
    size = np.where(exp > 0, (size + 256) << np.maximum(exp - 1, 0), size)
    return np.where(a & 128, size, -size).astype(np.int16)


def adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """By step index * 16 + nibble: the change of the sample and the next step index times 16."""
    step, nibble = np.array(STEPS)[:, None], np.arange(16)[None, :]
    size = (step >> 3) + (step >> 2) * (nibble & 1) + (step >> 1) * (nibble >> 1 & 1) + step * (nibble >> 2 & 1)
    index = np.clip(np.arange(len(STEPS))[:, None] + np.array(MOVES)[nibble & 7], 0, len(STEPS) - 1)
    return np.where(nibble & 8, -size, size).astype(np.int32).ravel(), (index * 16).astype(np.int32).ravel()


def adpcm_decode(blocks: np.ndarray) -> np.ndarray:
    """blocks: n x bytes of a block, mono. n x samples, int16: the header's sample, then two from each byte, low nibble first."""
    change, follow = adpcm_tables()
    n, width = blocks.shape
    codes = blocks[:, 4:].T
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    sample = blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int8).astype(np.int32) << 8
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1) * 16
    out[0] = sample
    for k in range(2 * (width - 4)):
        at = index + (codes[k >> 1] >> 4 * (k & 1) & 15)
        sample = np.clip(sample + change[at], -32768, 32767)
        index = follow[at]
        out[k + 1] = sample
    return out.T


def resample(pcm: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rate: int, to: int) -> list[np.ndarray]:
    """Each run of samples at another rate: a windowed sinc in integer taps, one set for each output phase."""
    up, down = to // gcd(rate, to), rate // gcd(rate, to)
    if up == down:
        return [pcm[a : a + n] for a, n in zip(starts, lengths, strict=True)]
    half = TAPS // 2
    t = (np.arange(TAPS * up) - half * up) / up
    low = min(1.0, up / down)
    h = np.sinc(t * low) * low * (0.5 + 0.5 * np.cos(np.pi * t / half))
    padded = np.zeros(len(pcm) + TAPS * (len(starts) + 1), np.int32)
    at = starts + TAPS * np.arange(1, len(starts) + 1)
    for a, b, n in zip(starts, at, lengths, strict=True):
        padded[b : b + n] = pcm[a : a + n]
    phases = np.empty((len(padded), up), np.int16)
    for p in range(up):
        taps = np.rint(h[p::up] * UNIT).astype(np.int32)
        total = np.full(len(padded), UNIT // 2, np.int32)
        for k in np.flatnonzero(taps):  # sample i - (k - half) stands at tap k
            move = k - half
            if move >= 0:
                total[move:] += taps[k] * padded[: len(padded) - move]
            else:
                total[:move] += taps[k] * padded[-move:]
        phases[:, p] = np.clip(total >> 14, -32768, 32767)
    flat = phases.ravel()
    return [flat[b * up : (b + n) * up : down] for b, n in zip(at, lengths, strict=True)]


def wav(samples: bytes, law: int, count: int) -> bytes:
    """A WAV file of one channel at 8 kHz; count, the samples that matter, stands in its fact chunk."""
    fmt = struct.pack("<HHIIHHH", law, 1, RATE, RATE, 1, 8, 0)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, count) + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def chunks(media: bytes | None) -> dict[bytes, memoryview]:
    """The chunks of a WAV file by name; nothing if it isn't whole."""
    view = memoryview(media or b"")
    if len(view) < 12 or bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        return {}
    found, at = {}, 12
    while at + 8 <= len(view):
        (size,) = struct.unpack_from("<I", view, at + 4)
        if at + 8 + size > len(view):
            return {}
        found.setdefault(bytes(view[at : at + 4]), view[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    return found if len(found.get(b"fmt ", b"")) >= 16 and b"data" in found else {}


def store(docs: DataFrame, key: str = "doc_id", content: str = "text", law: int = MULAW, unit: int = BLOCK) -> DataFrame:
    """key, media: the UTF-8 bytes, padded with spaces to a positive multiple of unit, as the samples of a WAV file."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "content"):
            media = [None if x is None else wav(x + b" " * (-len(x) % unit if x else unit), law, len(x)) for x in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(media, pa.binary())], ["key", "media"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(content).cast("binary").alias("content")).mapInArrow(run, f"key {kind}, media binary").withColumnRenamed("key", key)


def _told(name: str, pcm: np.ndarray) -> str:
    """Root mean square, peak and zero crossings, from integer sums."""
    x = pcm.astype(np.int64)
    if not len(x):
        return f"{name} rms=0.00 peak=0 zc=0"
    return f"{name} rms={(float(np.dot(x, x)) / len(x)) ** 0.5:.2f} peak={int(np.abs(x).max())} zc={int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))}"


def read_audio(files: DataFrame, key: str = "doc_id", media: str = "media", to_rate: int = 16000) -> DataFrame:
    """key, n_samples, payload, pcm (16-bit, little end first, at to_rate), feature.

    feature tells of the resampled PCM, and of the payload read as the other law and as ADPCM blocks where it has whole ones.
    """
    tables = {MULAW: mulaw_table(), ALAW: alaw_table()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", 2 << 20):
            rows = [chunks(x) for x in batch.column("media").to_pylist()]
            laws = [struct.unpack_from("<H", r[b"fmt "])[0] if r else 0 for r in rows]
            out: list[tuple] = [(None, None, None, "")] * len(rows)
            for law in {*laws} & {MULAW, ALAW, ADPCM}:
                own = [i for i, x in enumerate(laws) if x == law]
                if law == ADPCM:
                    own = [i for i in own if len(rows[i][b"data"]) % BLOCK == 0]
                if not own:
                    continue
                data = [rows[i][b"data"] for i in own]
                raw = np.frombuffer(b"".join(data), np.uint8)
                sizes = np.array([len(d) for d in data])
                ends = np.cumsum(sizes)
                per = 1 + 2 * (BLOCK - 4)
                whole = sizes % BLOCK == 0  # each file by itself
                blocks = adpcm_decode(np.frombuffer(b"".join(d for d, w in zip(data, whole, strict=True) if w), np.uint8).reshape(-1, BLOCK))
                upto = np.cumsum(np.where(whole, sizes // BLOCK, 0))
                if law == ADPCM:
                    pcm, lengths = blocks.ravel(), sizes // BLOCK * per
                else:
                    pcm, lengths = tables[law][raw], sizes
                starts = np.cumsum(lengths) - lengths
                slow = resample(pcm, starts, lengths, RATE, to_rate)
                for i, d, s, a, b, w, z in zip(own, data, slow, ends - sizes, ends, whole, upto, strict=True):
                    feature = [_told(f"pcm{to_rate}", s)]
                    if law != ADPCM:
                        feature.append(_told("other", tables[ALAW + MULAW - law][raw[a:b]]))
                    if w:
                        feature.append(_told("adpcm", blocks[z - len(d) // BLOCK : z].ravel()))
                    fact = rows[i].get(b"fact")
                    count = struct.unpack_from("<I", fact)[0] if fact is not None and len(fact) >= 4 else len(d)
                    out[i] = (count, bytes(d), s.astype("<i2").tobytes(), "; ".join(feature))
            n, payload, pcms, feature = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n, pa.int64()), pa.array(payload, pa.binary()), pa.array(pcms, pa.binary()), pa.array(feature, pa.string())], ["key", "n_samples", "payload", "pcm", "feature"])

    kind = files.schema[key].dataType.simpleString()
    rows = files.select(F.col(key).alias("key"), F.col(media).alias("media"))
    return rows.mapInArrow(run, f"key {kind}, n_samples long, payload binary, pcm binary, feature string").withColumnRenamed("key", key)
