"""Word spans, word hashes and shingle hashes of many texts at once, as numpy arrays.

Words are runs of bytes other than blank and 0x09-0x0D; UTF-8 never has those bytes inside a
character, so bytes give the same words as code points. Hashes have 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)
_PART = 1 << 20
HASH_BITS = 54
MAX_TEXTS = 1 << (64 - HASH_BITS)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE)]))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the offsets of its texts; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each text the number of words before it."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begin = offsets[:-1][offsets[:-1] < len(data)]
    first[begin] = inside[begin]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """One 64-bit hash per word, from polynomials over its bytes; long words cost no more per byte."""
    out = np.zeros(len(start), np.uint64)
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(end, start[at] + _PART, side="right")))
        piece = data[start[at] : end[stop - 1]]
        values = _BYTE[_LOWER[piece] if lower else piece]
        power = _powers(len(piece))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[:-1], dtype=np.uint64)])
        s, e = start[at:stop] - start[at], end[at:stop] - start[at]
        out[at:stop] = (sums[e] - sums[s]) * power[len(piece) - s]
        # every sum is now scaled by the same power of the part's length, so divide it out
        inverse = pow(int(power[len(piece)]), -1, 1 << 64)
        out[at:stop] = mix(out[at:stop] * np.uint64(inverse) + (e - s).astype(np.uint64))
        at = stop
    return out


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every run of ``width`` words; a shorter text is one shingle, an empty one none."""
    counts = np.diff(bounds)
    take = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), take)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(take) - take, take) + np.repeat(bounds[:-1], take)
    size = np.minimum(counts, width)[owner]
    total = np.zeros(len(owner), np.uint64)
    for k in range(width):
        inside = size > k
        total[inside] = mix(total[inside] * np.uint64(0x9E3779B97F4A7C15) + words[place[inside] + k])
    return mix(total + size.astype(np.uint64)), owner


def distinct_sets(hashes: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes once, ascending, and the bounds of the texts in them.

    Only the upper ``HASH_BITS`` bits are kept, so that one number holds text and hash and a
    plain sort does; call it with at most ``MAX_TEXTS`` texts.
    """
    both = np.sort((owner.astype(np.uint64) << np.uint64(HASH_BITS)) | (hashes >> np.uint64(64 - HASH_BITS)))
    keep = np.ones(len(both), dtype=bool)
    keep[1:] = both[1:] != both[:-1]
    both = both[keep]
    bounds = np.searchsorted(both, np.arange(texts, dtype=np.uint64) << np.uint64(HASH_BITS))
    return both & np.uint64((1 << HASH_BITS) - 1), np.append(bounds, len(both))


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles, A-Z lower-cased: hashes ascending, and the texts' bounds."""
    data, offsets = text_bytes(texts)
    start, end, bounds = word_spans(data, offsets)
    hashes, owner = shingle_hashes(word_hashes(data, start, end), bounds, width)
    return distinct_sets(hashes, owner, len(offsets) - 1)
