"""Arrow batches of texts as flat numpy arrays: slices of bounded size, words, hashes, shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def slices(batch: pa.RecordBatch, text_col: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about ``most`` bytes of text, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, null as empty, and the bounds of each."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[bounds[0] : bounds[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_spans(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray | None = None):
    """Starts and ends of the words, and the number of words of each text.

    ``inside`` marks the bytes that belong to words, by default all but ASCII white space.
    """
    if inside is None:
        inside = ~SPACE[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    firsts = bounds[:-1][bounds[:-1] < bounds[1:]]  # of texts that are not empty
    lasts = bounds[1:][bounds[:-1] < bounds[1:]] - 1
    opens[firsts] = inside[firsts]
    closes[lasts] = inside[lasts]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    counts = np.diff(np.searchsorted(starts, bounds))
    return starts, ends, counts


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans do not overlap and are in order."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(first, lengths)
    powers = np.cumprod(np.full(lengths.max() + 1, _BASE, np.uint64), dtype=np.uint64)
    values = (data[place + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)) * powers[place]
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words per text, and their number per text.

    A text with fewer words has its whole sequence as one shingle, a text without words none.
    """
    first = np.cumsum(counts) - counts
    per_text = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    at = np.arange(per_text.sum()) - np.repeat(np.cumsum(per_text) - per_text, per_text) + np.repeat(first, per_text)
    length = np.repeat(np.minimum(counts, size), per_text)
    value = length.astype(np.uint64)
    for k in range(size):
        there = k < length
        step = value * _BASE + words[np.where(there, at + k, 0)] if len(words) else value
        value = np.where(there, step, value)
    return mix(value), per_text


def text_shingles(texts: pa.Array, size: int = 5, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts and their number per text, repeats included."""
    data, bounds = flat(texts)
    if lower:
        data = LOWER[data]
    starts, ends, counts = word_spans(data, bounds)
    return shingle_hashes(span_hashes(data, starts, ends), counts, size)


def code_points(data: np.ndarray) -> np.ndarray:
    """For each byte, and the end, the number of code points that begin before it."""
    begins = (data & 0xC0) != 0x80
    return np.concatenate([[0], np.cumsum(begins)])
