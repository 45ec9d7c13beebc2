"""Chroma fingerprints of audio in a media column, and recordings that align.

A recording (WAV bytes) is decoded, mixed to one channel and brought to RATE. The magnitudes of overlapping frames are
summed by pitch class; over this image of 12 columns an integral image gives the sum of any rectangle at once. Each of 16
filters compares two areas of a window of frames, and its value is cut into four steps, coded so that neighbours differ
in one bit. The 32 bits of a window are one packed integer; a recording's fingerprint is the sequence of its integers.

Two recordings are aligned by the offset that most equal integers have in common (an offset histogram, bins of BIN
windows); they are alike if at that offset they overlap by OVERLAP of the shorter one and at most ERRORS of the bits
differ. Candidates share three minimal integers in their order, as in omh.py; for that the integers are reduced to their
filters' signs, which small changes of the sound mostly spare. The classes of omh.py are used: recordings of equal
fingerprints are one node, no bucket is expanded into all pairs, and classes are the components of links.

Defined results: null or broken media, and recordings shorter than a window, have no integers; those of equal (also of no)
fingerprint are one node, whatever their ids. A node is a fingerprint's 64-bit hash, so recordings under a null id, or under
one repeated id, are told apart by their sound. class_id is the least id of the class, a null one counts as greater than all
others. Each row gives one row, repeated rows too. Further columns are ignored. Whole recordings are read.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import omh
from evidentia.llm.runtime import cut, map_arrow, small
from evidentia.llm.words import mix

RATE, FRAME, HOP, LOWEST = 4_000, 1_024, 256, 110.0
WIDTH = 16  # frames of a filter's window
STEP = 0.12  # between the outer thresholds of a filter's value and 0
BIN, OVERLAP, ERRORS, SKETCHES, LEVELS = 2, 0.5, 0.15, 72, (3, 4, 8)
LEAST = LEVELS[0]  # minima of a value
FFT_FROM, PAIRS = 32, 1 << 22  # pairs of one integer's places, by windows, from which they are correlated; pairs at once
SIGNS = np.uint32(0xAAAAAAAA)  # of each filter's two bits the one that tells its value's sign


def decode_wav(media: bytes | None) -> np.ndarray:
    """Samples at RATE in one channel, or none where the bytes are no PCM WAV."""
    try:
        with wave.open(io.BytesIO(media or b"")) as f:
            width, channels, rate, raw = f.getsampwidth(), f.getnchannels(), f.getframerate(), f.readframes(f.getnframes())
    except (wave.Error, EOFError, ValueError, OverflowError):
        return np.zeros(0, np.float32)
    if width not in (1, 2, 4) or not rate:
        return np.zeros(0, np.float32)
    raw = raw[: len(raw) // (width * channels) * width * channels]
    x = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.float32)
    x = ((x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))).reshape(-1, channels).mean(axis=1)
    if rate != RATE and len(x):
        x = np.interp(np.arange(int(len(x) * RATE / rate)) * rate / RATE, np.arange(len(x)), x).astype(np.float32)
    return x


def pitch_classes() -> np.ndarray:
    """Which bin of a frame's spectrum counts for which pitch class: bins by 12."""
    f = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(f), 12), np.float32)
    for k, x in enumerate(f):
        if LOWEST <= x <= RATE * 0.45:
            out[k, int(round(12 * np.log2(x / LOWEST))) % 12] = 1
    return out


CLASSES, HANN = pitch_classes(), np.hanning(FRAME).astype(np.float32)


def chroma(x: np.ndarray) -> np.ndarray:
    """Frames by 12 pitch classes, each frame of length 1 (silence: all 0)."""
    n = (len(x) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:n]
    image = np.concatenate([np.abs(np.fft.rfft(frames[k : k + 512] * HANN)).astype(np.float32) @ CLASSES for k in range(0, n, 512)])
    size = np.sqrt((image**2).sum(axis=1, keepdims=True))
    return np.where(size > 1e-3, image / np.maximum(size, 1e-9), 0)


def filters() -> list[tuple[int, int, int, int]]:
    """16 filters by rule: kind (halves in pitch, halves in time, quarters crosswise, middle in pitch), first class, classes, frames."""
    return [(k % 4, (5 * k) % 12, 2 + 2 * (k // 4), (WIDTH, WIDTH // 2, WIDTH, WIDTH - 4)[k % 4]) for k in range(16)]


def fingerprint(x: np.ndarray) -> np.ndarray:
    """A packed integer for each window of WIDTH frames."""
    image = chroma(x)
    n = len(image) - WIDTH + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, 25))  # pitch classes twice, so that an area may pass the octave
    total[1:, 1:] = np.cumsum(np.cumsum(np.concatenate([image, image], axis=1), axis=0), axis=1)
    t = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return total[t + t1, p1] - total[t + t0, p1] - total[t + t1, p0] + total[t + t0, p0]

    out = np.zeros(n, np.uint32)
    for kind, p, high, wide in filters():
        mp, mt = p + high // 2, wide // 2
        if kind == 0:
            a, b = area(0, wide, p, mp), area(0, wide, mp, p + high)
        elif kind == 1:
            a, b = area(0, mt, p, p + high), area(mt, wide, p, p + high)
        elif kind == 2:
            a, b = area(0, mt, p, mp) + area(mt, wide, mp, p + high), area(0, mt, mp, p + high) + area(mt, wide, p, mp)
        else:
            q = max(1, high // 4)
            a = area(0, wide, p + q, p + high - q) if high > 2 else area(0, wide, p, p + 1)
            b = area(0, wide, p, p + high) - a
        value = np.log((1 + a) / (1 + b))
        level = (value > -STEP).astype(np.uint32) + (value > 0) + (value > STEP)
        out = out << np.uint32(2) | np.array([0, 1, 3, 2], np.uint32)[level]
    return out


def offsets(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many equal integers a and b have at each offset, from -len(b) on."""
    size = len(a) + len(b)
    places = np.zeros(size + 1, np.int64)
    order = np.argsort(b, kind="stable")
    left = np.searchsorted(b[order], a, "left")
    n = np.searchsorted(b[order], a, "right") - left
    _, which, times = np.unique(a, return_inverse=True, return_counts=True)
    many = n * times[which] > FFT_FROM * size  # a sustained sound: cheaper as a correlation than pair by pair
    for value in np.unique(a[many]):
        two = np.fft.rfft(a == value, 2 * size) * np.fft.rfft((b == value)[::-1], 2 * size)
        places[1:size] += np.rint(np.fft.irfft(two, 2 * size)[: size - 1]).astype(np.int64)
    rest = np.flatnonzero(~many & (n > 0))
    ends = np.cumsum(n[rest])
    for part in np.split(rest, np.searchsorted(ends, np.arange(PAIRS, ends[-1], PAIRS))) if len(rest) else ():
        m = n[part]
        i = np.repeat(part, m)
        j = order[np.repeat(left[part], m) + np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)]
        places += np.bincount(i - j + len(b), minlength=size + 1)
    return places


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float]:
    """Offset of b's place in a, windows that overlap there, and the share of different bits; offset 0 if no integer is common."""
    if not len(a) or not len(b):
        return 0, 0, 1.0
    places = offsets(a, b)
    offset = 0
    if places.any():
        top = np.add.reduceat(places, np.arange(0, len(places), BIN)).argmax() * BIN
        offset = int(top + places[top : top + BIN].argmax()) - len(b)
    start = max(0, offset)
    size = min(len(a), len(b) + offset) - start
    if size < 1:
        return offset, 0, 1.0
    bits = np.bitwise_count(a[start : start + size] ^ b[start - offset : start - offset + size])
    return offset, size, float(bits.mean() / 32)


def alike(a: pa.Array, b: pa.Array) -> list[bool]:
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
        x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
        _, size, errors = align(x, y)
        out.append(size >= OVERLAP * min(len(x), len(y)) and size > 0 and errors <= ERRORS)
    return out


def fingerprints(media: DataFrame, id_column: str, media_column: str) -> DataFrame:
    """id (a null one as the greatest integer), print (packed little-endian integers), node (its hash), sketch of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, 500) for whole in batches for k in range(0, whole.num_rows, 500)):
            prints = [fingerprint(decode_wav(x.as_py())) for x in batch.column(1)]
            raw = [p.astype("<u4").tobytes() for p in prints]
            node = np.array([xxhash.xxh3_64_intdigest(r) for r in raw], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array(node), values_of(prints, LEAST)], ["id", "print", "node", "sketch"])

    rows = media.select(F.coalesce(F.col(id_column).cast("bigint"), F.lit(omh.NO_ID)).alias("id"), F.col(media_column).alias("media"))
    return map_arrow(rows, run, "id bigint, print binary, node bigint, sketch array<bigint>")


def values_of(prints: list[np.ndarray], minima: int) -> pa.ListArray:
    """Sketch values of fingerprints; nothing for an empty one."""
    first = np.concatenate([[0], np.cumsum([len(p) for p in prints])]).astype(np.int64)
    values = omh.sketch(*omh.kmers(mix((np.concatenate(prints) & SIGNS).astype(np.uint64)), first, 1), SKETCHES, minima).view(np.int64)
    ends = np.concatenate([[0], np.cumsum((np.diff(first) > 0) * SKETCHES)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))


def deeper(payloads: DataFrame, minima: int) -> DataFrame:
    """node, sketch of fingerprints (node, payload) with more minima a value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), values_of([np.frombuffer(p, "<u4") for p in batch.column(1).to_pylist()], minima)], ["node", "sketch"])

    return map_arrow(payloads.select("node", "payload"), run, "node bigint, sketch array<bigint>")


def classes(media: DataFrame, id_column: str, media_column: str) -> DataFrame:
    """id_column, n_windows, class_id, class_size, n_links of every recording."""
    prints = cut(fingerprints(media, id_column, media_column))
    least = prints.groupBy("node").agg(F.min("id").alias("least_id"))
    rows = cut(prints.join(least, "node").select("id", "node", (F.octet_length("print") / 4).cast("bigint").alias("n_windows"), F.when(F.col("id") == F.col("least_id"), F.col("sketch")).alias("sketch")))
    payloads = lambda nodes: prints.join(small(nodes), "node", "left_semi").groupBy("node").agg(F.max("print").alias("payload"))
    return omh.classes_of(rows, omh.Kind(SKETCHES, LEVELS, payloads, alike, deeper), "n_windows").withColumnRenamed("id", id_column)


STEPS, STEP_SAMPLES = 32, RATE // 4


@lru_cache(maxsize=1)
def tones() -> np.ndarray:
    """Steps by pitch classes by samples: an octave of sines."""
    t = np.arange(STEPS * STEP_SAMPLES) / RATE
    return np.sin(2 * np.pi * LOWEST * 2 ** (1 + np.arange(12)[:, None] / 12) * t).astype(np.float32).reshape(12, STEPS, STEP_SAMPLES).transpose(1, 0, 2).copy()


def render(vector: list[float] | None) -> bytes | None:
    """A WAV recording of STEPS chords; a chord's loudness by pitch class is a stretch of the vector. For tables without media."""
    v = np.array([x or 0.0 for x in vector or []], np.float32)
    if not len(v):
        return None
    loud = np.maximum(v[(5 * np.arange(STEPS)[None, :] + np.arange(12)[:, None]) % len(v)], 0)
    x = np.matmul(loud.T[:, None, :], tones())[:, 0, :].ravel()
    peak = np.abs(x).max()
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(RATE)
        f.writeframes((x / peak * 30_000 if peak > 0 else x).astype("<i2").tobytes())
    return out.getvalue()


def rendered(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id_column and a media column of recordings made from a table of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                part = batch.slice(start, 100)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([render(v) for v in part.column(1).to_pylist()], pa.binary())], [id_column, "media"])

    rows = vectors.select(F.col(id_column).cast("bigint").alias(id_column), F.col(vector_column).cast("array<double>").alias("v"))
    return map_arrow(rows, run, f"{id_column} bigint, media binary")
