"""Word-shingle hashing, vectorised over the bytes of many texts at once.

A word's 64-bit hash is a difference of prefix sums over its bytes: one random
constant per byte value times a power of an odd multiplier, modulo 2**64, and
brought back to position 0, so equal words hash alike wherever they stand.  A
shingle's hash mixes its words' hashes.  Sets are compared by these hashes;
that two different shingles of one pair share one has odds of about
n * n / 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_RANDOM = np.random.default_rng(20240229)
_BYTE_VALUES = _RANDOM.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE_VALUES = _RANDOM.integers(1, 1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes handled at once, unless one text is longer.
CHUNK_BYTES = 1_000_000

#: A-Z to a-z, white space to a space.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32

_powers: dict[int, np.ndarray] = {}


def _powers_of(multiplier: int, n: int) -> np.ndarray:
    table = _powers.get(multiplier)
    if table is None or len(table) < n:
        table = np.full(max(n, CHUNK_BYTES), multiplier, dtype=np.uint64)
        table[0] = 1
        table = np.multiply.accumulate(table)
        _powers[multiplier] = table
    return table[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise hashes so that their order is as good as random."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


def word_hashes(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of bytes folded by _FOLD; breaks: where texts start, and the end."""
    solid = data != 32
    opens, closes = np.empty(len(data), dtype=bool), np.empty(len(data), dtype=bool)
    opens[:1], closes[-1:] = True, True
    np.logical_not(solid[:-1], out=opens[1:])
    np.logical_not(solid[1:], out=closes[:-1])
    inner = breaks[(breaks > 0) & (breaks < len(data))]
    opens[inner] = True
    closes[inner - 1] = True
    starts, ends = np.flatnonzero(opens & solid), np.flatnonzero(closes & solid) + 1
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _powers_of(_MULTIPLIER, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers_of(_INVERSE, len(data))[starts]), starts, ends


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """first, last, folded bytes and breaks of consecutive texts of a string column; null counts as empty."""
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    raw = column.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64, count=raw.offset + len(raw) + 1)[raw.offset :]
    body = np.frombuffer(raw.buffers()[2], dtype=np.uint8) if raw.buffers()[2] is not None else np.empty(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, side="right")) - 1)
        yield first, last, _FOLD[body[offsets[first] : offsets[last]]], offsets[first : last + 1] - offsets[first]
        first = last


def shingles_of(hashes: np.ndarray, text: np.ndarray, k: int, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of each run of k words within one text; texts with fewer words give one run of all.

    text: the number of the text that a word belongs to, ascending.
    """
    places = _PLACE_VALUES[:k]
    n = max(0, len(hashes) - k + 1)
    whole = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        whole += hashes[j : j + n] * places[j]
    within = np.flatnonzero(text[:n] == text[k - 1 : k - 1 + n]) if n else np.empty(0, dtype=np.int64)
    values, firsts = mix(whole[within]), within
    counts = np.bincount(text, minlength=texts)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        ends = np.cumsum(counts)
        more = [mix(np.array([(hashes[ends[i] - counts[i] : ends[i]] * places[: counts[i]]).sum(dtype=np.uint64) + np.uint64(counts[i])], dtype=np.uint64))[0] for i in short]
        values = np.concatenate((values, np.array(more, dtype=np.uint64)))
        firsts = np.concatenate((firsts, ends[short] - counts[short]))
        order = np.argsort(firsts, kind="stable")
        values, firsts = values[order], firsts[order]
    return values, firsts


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text of a column, in order."""
    for first, last, data, breaks in chunks(column):
        hashes, starts, _ = word_hashes(data, breaks)
        text = np.searchsorted(breaks, starts, side="right") - 1
        values, firsts = shingles_of(hashes, text, k, last - first)
        ends = np.cumsum(np.bincount(text[firsts], minlength=last - first)) if len(firsts) else np.zeros(last - first, dtype=np.int64)
        begin = 0
        for end in ends:
            own = np.sort(values[begin:end])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) else own
            begin = end


def parity_bits(values: np.ndarray, size: int) -> np.ndarray:
    """Parity bitmap of ``size`` bits (a power of two): bit i is the parity of the members hashed to i."""
    counts = np.bincount((values & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8))


def fold_bits(bits: np.ndarray, size: int) -> np.ndarray:
    """Fold bitmaps (rows of bytes) to ``size`` bits; as positions are hashes modulo the size, halves are xored."""
    while bits.shape[-1] * 8 > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits
