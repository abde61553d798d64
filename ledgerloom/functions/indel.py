"""Insert/delete similarity of text pairs, scored in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _lcs_long(a: str, b: str) -> int:
    """Longest common subsequence on arbitrary-length bit sets."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & masks.get(ch, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def _code_points(texts: list[str], width: int, pad: int) -> np.ndarray:
    out = np.full((len(texts), width), pad, dtype=np.int32)
    for row, text in enumerate(texts):
        out[row, : len(text)] = np.frombuffer(text.encode("utf-32-le"), dtype=np.int32)
    return out


def lcs_lengths(left: list[str], right: list[str]) -> np.ndarray:
    """LCS length per pair; pairs that fit 64 bits advance together, one character per step."""
    result = np.zeros(len(left), dtype=np.int64)
    fits = np.array([0 < len(a) <= 64 and len(b) > 0 for a, b in zip(left, right, strict=True)], dtype=bool)
    for i in np.flatnonzero(~fits):
        result[i] = _lcs_long(left[i], right[i])
    rows = np.flatnonzero(fits)
    if not len(rows):
        return result
    a_texts, b_texts = [left[i] for i in rows], [right[i] for i in rows]
    a = _code_points(a_texts, 64, -1)
    b = _code_points(b_texts, max(map(len, b_texts)), -2)
    state = np.full(len(rows), np.iinfo(np.uint64).max, dtype=np.uint64)
    for step in range(b.shape[1]):
        bits = np.packbits(a == b[:, step : step + 1], axis=1, bitorder="little")
        hit = state & bits.view(np.uint64).ravel()
        state = (state + hit) | (state - hit)
    lengths = np.array([len(t) for t in a_texts], dtype=np.uint64)
    used = np.where(lengths == 64, np.iinfo(np.uint64).max, (np.uint64(1) << (lengths % 64)) - np.uint64(1))
    result[rows] = np.bitwise_count(~state & used)
    return result


def _score_batch(left: pd.Series, right: pd.Series) -> pd.Series:
    a, b = left.tolist(), right.tolist()
    total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], dtype=np.float64)
    distance = total - 2 * lcs_lengths(a, b)
    share = np.divide(distance, total, out=np.zeros_like(total), where=total > 0)
    return pd.Series((1.0 - share) * 100.0)


def indel_score(left: Column, right: Column) -> Column:
    """100 x (1 - insertions and deletions / both lengths); two empty texts are equal."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield _score_batch(a, b)

    return score(left, right)
