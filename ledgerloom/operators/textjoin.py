"""Exact join of similar texts through an index of their segments.

A score of T leaves two texts of lengths ``l`` and ``b`` at most ``D = (100 - T)(l + b) / 100`` insertions and deletions.
The longer text of a pair is cut into a grid of segments of ``q`` characters, the largest ``q`` that gives over D of them.
An edit spoils one segment at most, so one is left, whole and in order, in the shorter text; what stands before and
after it has been edited too, so its place is off by so much at most. The longer text enters the index with its
segments and their places, the shorter one asks with all runs of ``q`` characters and the places they may come from: an
equi-join, however many texts there are. A segment that many texts share is skewed, not grouped: the join may be split.
A segment and its place are one number in the join; texts of one length are cut together in tasks. Of the side with more texts only
entries go on that fall into a bucket of the other side's entries, of which there is a fixed number, one bit each.

Pairs that meet are tested on lengths, places and character counts before anything is scored. The
counts are unary, four numbers of 64 bits that say which character classes occur once, twice, three and
four times or more; every edit changes one bit. Each distinct text takes part once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import settings as s
from ledgerloom.functions.indel import lcs_lengths
from ledgerloom.runtime import cut

CLASSES = 64
BUCKET_BITS = 22
AT_ONCE = 1 << 20
_COUNTS = ("once", "twice", "thrice", "often")
_FACTS = ", ".join(["key string", "n int", *[f"{c} long" for c in _COUNTS]])


def _edits(one: Column | int, other: Column | int, threshold: int) -> Column | int:
    """Most insertions and deletions that the threshold allows two lengths."""
    if isinstance(one, int):
        return (one + other) * (100 - threshold) // 100
    return F.floor((one + other) * (100 - threshold) / 100).cast("int")


def _segment(length: int, threshold: int) -> int:
    """Characters of a segment of a text that is the longer one; 0 if it is too short to be cut."""
    return length // (_edits(length, length, threshold) + 1)


def _same_lengths(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one length at a time, with the matrix of their code points."""
    lengths = np.array([len(t) for t in texts], np.int64)
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        step = max(1, AT_ONCE // max(1, n))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            letters = np.frombuffer("".join(texts[i] for i in part).encode("utf-32-le"), np.uint32)
            yield part, letters.reshape(len(part), n)


def _unary_counts(letters: np.ndarray) -> list[np.ndarray]:
    rows = np.arange(len(letters))[:, None] * CLASSES
    seen = np.bincount((rows + letters % CLASSES).ravel(), minlength=len(letters) * CLASSES).reshape(-1, CLASSES)
    return [np.packbits(seen > i, axis=1, bitorder="little").view(np.int64).ravel() for i in range(len(_COUNTS))]


def _texts(texts: DataFrame) -> DataFrame:
    """Distinct texts with their length ``n`` and unary counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, letters in _same_lengths(batch.column(0).to_pylist()):
                n = np.full(len(rows), letters.shape[1], np.int32)
                columns = [batch.column(0).take(pa.array(rows)), pa.array(n), *map(pa.array, _unary_counts(letters))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n", *_COUNTS])

    return cut(texts.where("key is not null").select("key").distinct().mapInArrow(run, _FACTS))


def _codes(letters: np.ndarray, q: int, starts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A number for each text and each run of ``q`` characters from ``starts`` that stands at ``places`` of the longer text."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    runs = np.zeros((len(letters), letters.shape[1] - q + 1), np.uint64)
    for i in range(q):
        runs = (runs + letters[:, i : i + runs.shape[1]] + np.uint64(1)) * odd
        runs ^= runs >> np.uint64(29)
    codes = (runs[:, starts] + (places * (1 << 20) + q).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    codes ^= codes >> np.uint64(32)
    return (codes * odd) ^ (codes >> np.uint64(17))


def _cuts(n: int, threshold: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(q, starts, places) of the segments of a text of ``n`` characters as the longer one."""
    q = _segment(n, threshold)
    places = np.arange(n // q, dtype=np.int64) * q if q else np.zeros(1, np.int64)
    return [(q, places, places)]


def _runs(n: int, threshold: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(q, starts, places) of the segments of longer texts that one of ``n`` characters may hold, with their places there."""
    # of the longest partner all edits are needed for the lengths: l - b = D
    longest = n * (200 - threshold) // threshold
    # the longer text has lost up to (D + g) / 2 characters before the segment, g = l - b, or gained (D - g) / 2
    before = (_edits(longest, n, threshold) + longest - n) // 2
    after = _edits(n, n, threshold) // 2
    some = []
    for q in sorted({_segment(length, threshold) for length in range(n, longest + 1)}):
        if not q:
            some.append((0, np.zeros(1, np.int64), np.zeros(1, np.int64)))
        elif q <= n:
            starts = np.arange(n - q + 1, dtype=np.int64)
            first = -(-np.maximum(starts - after, 0) // q)
            size = np.maximum(np.minimum(starts + before, longest) // q - first + 1, 0)
            places = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - first, size)
            some.append((q, np.repeat(starts, size), places * q))
    return some


def _buckets(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bucket = codes & np.uint64((1 << BUCKET_BITS) - 1)
    return (bucket >> np.uint64(6)).astype(np.int64), bucket & np.uint64(63)


def _entries(texts: DataFrame, threshold: int, longer: bool, flags: np.ndarray | None = None) -> DataFrame:
    """Each text with its entries: ``code``, ``q``, ``place`` in the longer text, ``start`` here; only those in ``flags``."""
    sent = None if flags is None else texts.sparkSession.sparkContext.broadcast(flags)
    own = _cuts if longer else _runs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, letters in _same_lengths(batch.column(0).to_pylist()):
                for q, starts, places in own(letters.shape[1], threshold):
                    step = max(1, AT_ONCE // max(1, len(starts)))
                    for at in range(0, len(rows), step):
                        codes = _codes(letters[at : at + step], q, starts, places)
                        found = np.ones(codes.shape, bool)
                        if sent is not None:
                            word, bit = _buckets(codes)
                            found = (sent.value[word] >> bit & np.uint64(1)).astype(bool)
                        i, j = np.nonzero(found)
                        facts = batch.take(pa.array(rows[at + i]))
                        numbers = [codes[i, j].view(np.int64), np.full(len(i), q, np.int32), places[j].astype(np.int32), starts[j].astype(np.int32)]
                        yield pa.RecordBatch.from_arrays(
                            [*facts.columns, *map(pa.array, numbers)], names=[*batch.schema.names, "code", "q", "place", "start"]
                        )

    return texts.select("key", "n", *_COUNTS).mapInArrow(run, f"{_FACTS}, code long, q int, place int, start int")


def _flags(entries: DataFrame) -> np.ndarray:
    """Which of a fixed number of buckets hold an entry; at most as many words as there are go through the driver."""
    bucket = F.col("code").bitwiseAND(F.lit((1 << BUCKET_BITS) - 1))
    bit = F.expr("shiftleft(1L, int(bucket & 63))")
    words = entries.select(bucket.alias("bucket")).groupBy((F.shiftright("bucket", 6)).alias("word")).agg(F.bit_or(bit).alias("bits"))
    out = np.zeros(1 << (BUCKET_BITS - 6), np.int64)
    for row in words.collect():
        out[row["word"]] = row["bits"]
    return out.view(np.uint64)


def _meeting(longer: DataFrame, shorter: DataFrame, threshold: int, strictly: bool) -> DataFrame:
    """(long_key, short_key) that agree on a segment and on all that is known without reading them."""
    if longer.count() <= shorter.count():
        index = _entries(longer, threshold, True)
        asking = _entries(shorter, threshold, False, _flags(index))
    else:
        asking = _entries(shorter, threshold, False)
        index = _entries(longer, threshold, True, _flags(asking))
    a, b = index.alias("a"), asking.alias("b")
    edits, gap = _edits(F.col("a.n"), F.col("b.n"), threshold), F.col("a.n") - F.col("b.n")
    moved = F.col("b.start") - F.col("a.place")
    apart = sum((F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in _COUNTS), F.lit(0))
    near = (gap > 0 if strictly else gap >= 0) & (gap <= edits) & (apart <= edits)
    near &= (F.col("a.q") == 0) | (F.abs(moved) + F.abs(gap + moved) <= edits)
    near &= (F.col("a.q") == F.col("b.q")) & (F.col("a.place") == F.col("b.place"))
    return a.join(b, [F.col("a.code") == F.col("b.code"), near]).select(F.col("a.key").alias("long_key"), F.col("b.key").alias("short_key"))


def candidates(left: DataFrame, right: DataFrame, threshold: int) -> DataFrame:
    """(left_key, right_key) that may be similar, each pair once; inputs as ``_texts`` gives them."""
    one = _meeting(left, right, threshold, strictly=False)
    other = _meeting(right, left, threshold, strictly=True)
    return (
        one.select(F.col("long_key").alias("left_key"), F.col("short_key").alias("right_key"))
        .unionByName(other.select(F.col("short_key").alias("left_key"), F.col("long_key").alias("right_key")))
        .distinct()
    )


def similar_texts(left: DataFrame, right: DataFrame, threshold: int = s.DEFAULTS.text_threshold) -> DataFrame:
    """All (left_key, right_key, score) with an indel score of at least ``threshold`` (1 to 100).

    Both inputs have a text column ``key``; null keys take no part. Two empty texts are equal.
    """
    if not 0 < threshold <= 100:
        raise ValueError("the threshold is a score from 1 to 100")

    def scored(batches):
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in range(2))
            both = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.float64)
            common = lcs_lengths(a, b)
            keep = 200 * common >= threshold * both
            share = np.divide(both - 2 * common, both, out=np.zeros_like(both), where=both > 0)
            part = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array((1.0 - share[keep]) * 100.0, pa.float64())], names=["left_key", "right_key", "score"]
            )

    met = candidates(_texts(left), _texts(right), threshold)
    return met.mapInArrow(scored, "left_key string, right_key string, score double")
