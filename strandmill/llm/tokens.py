"""Words and word shingles of many texts at once, as numpy arrays.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z in lower case.  Hashes are 64 bits: the words'
eight-byte lanes are chained through a mixer that is not linear (a polynomial modulo 2^64 has known
collisions), and words longer than ``LONG`` bytes are hashed by keyed BLAKE2b.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240601)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []
_SEED, _LANE = U(0x6A09E667F3BCC909), U(0xD6E8FEB86659FD93)
_KEY = b"strandmill word"
#: Bytes above which a word is hashed by itself.
LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixer."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 21)
        out = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=np.uint64))
        _powers[:] = out
    return _powers[0], _powers[1]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets of the texts); a null is an empty text."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each; a longer text is a part of its own."""
    _, offsets = text_bytes(batch.column(column))
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each text and in all) of the words; none crosses texts."""
    solid = ~_SPACE[data]
    begin, stop = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    stop[:-1] &= ~solid[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    begin[edge] = solid[edge]
    stop[edge - 1] = solid[edge - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the bytes from ``starts`` to ``ends``."""
    data = _LOWER[data] if lower else data
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    lanes = np.lib.stride_tricks.sliding_window_view(padded, 8)
    size = ends - starts
    out = np.full(len(starts), _SEED, np.uint64)
    at = np.flatnonzero(size <= LONG)
    step = 0
    while len(at):
        lane = np.ascontiguousarray(lanes[starts[at] + step]).view("<u8").ravel()
        left = np.minimum(size[at] - step, 8).astype(np.uint64)
        out[at] = mix((out[at] ^ (lane & (U(2**64 - 1) >> (U(64) - left * U(8))))) * _LANE + U(step))
        step += 8
        at = at[size[at] > step]
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8, key=_KEY).digest(), "little")
    return mix(out ^ (size.astype(np.uint64) * U(_BASE)))


def shingles(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets by text) of all runs of ``width`` words, in order, repeats kept.

    A text with fewer words, but at least one, has its whole sequence as its only shingle.
    """
    data, offsets = text_bytes(texts)
    starts, ends, before = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    counts = np.diff(before)
    number = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out_offsets = np.concatenate(([0], np.cumsum(number)))
    text_of = np.repeat(np.arange(len(counts)), number)
    first = before[text_of] + np.arange(out_offsets[-1]) - out_offsets[text_of]
    length = np.minimum(counts, width)[text_of]
    padded = np.append(hashes, np.zeros(width, np.uint64))
    out = np.zeros(len(first), np.uint64)
    for k in range(width):
        step = mix(out ^ padded[first + k]) + U((k + 1) * _BASE % 2**64)
        out = step if (length > k).all() else np.where(length > k, step, out)
    return mix(out + length.astype(np.uint64)), out_offsets


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and their offsets."""
    parts = [np.unique(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return np.concatenate(parts) if parts else values[:0], np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))


def multipliers(n: int, seed: int) -> np.ndarray:
    """Odd factors of ``n`` random orders of the 64-bit hashes."""
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * U(2) + U(1)


def min_by_run(values: np.ndarray, factor: np.uint64, starts: np.ndarray) -> np.ndarray:
    """Smallest value times factor in each run; runs are not empty."""
    return np.minimum.reduceat(values * factor, starts)
