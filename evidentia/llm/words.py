"""Words of many texts at once, as 64-bit hashes, from the bytes of an Arrow column.

A word is a run of other characters than space, tab, line feed, vertical tab, form feed and carriage return; A-Z count as
a-z. Null texts count as empty. All work is on whole arrays: a word's hash is taken eight bytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
#: Words longer than this are hashed one by one.
LONG = 256
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * B
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes one behind another, and where each begins and the last one ends."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def hash_words(data: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes in order, and for each text the index of its first word (one entry more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    low = np.empty(n + 8, np.uint8)
    low[:n], low[n:] = LOWER[data], 0
    word = ~BLANK[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = texts[:-1][texts[:-1] < n]
    first[edges] = word[edges]
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    begin = np.flatnonzero(first)
    size = np.flatnonzero(last) + 1 - begin
    eight = np.ndarray((n + 1,), "<u8", buffer=low.data, strides=(1,))
    keep = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
    with np.errstate(over="ignore"):
        h = size.astype(np.uint64) * A
        at, done = np.flatnonzero(size <= LONG), 0
        while len(at):
            left = size[at] - done
            h[at] = mix(h[at] ^ (eight[begin[at] + done] & keep[np.minimum(left, 8)]) * A) + A
            done += 8
            at = at[left > 8]
    for k in np.flatnonzero(size > LONG):
        h[k] = xxhash.xxh3_64_intdigest(low[begin[k] : begin[k] + size[k]].tobytes())
    return h, np.searchsorted(begin, texts)


def blocks(batch: pa.RecordBatch, column: int, most: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of about `most` text bytes (one text at least), each with its words' hashes and their bounds."""
    data, texts = column_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(texts, texts[start] + most, side="right")) - 1)
        part = texts[start : stop + 1]
        yield batch.slice(start, stop - start), *hash_words(data[part[0] : part[-1]], part - part[0])
        start = stop
