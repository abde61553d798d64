"""Counts of a fixed number of hash buckets: summed on the executors, small enough to broadcast."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

_CHUNK_BITS = 14
_FLAG_BITS = 17


def _smallest(counts: np.ndarray) -> np.dtype:
    """The narrowest unsigned type that holds the counts: they are shuffled once per task."""
    return np.min_scalar_type(int(counts.max()))


def bucket_counts(df: DataFrame, buckets_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> np.ndarray:
    """How often each of ``2 ** bits`` buckets occurs in what ``buckets_of`` makes of the rows.

    Every task sums into one array; chunks of the arrays are summed by key on the executors.
    The driver receives ``2 ** bits`` numbers, whatever the input's size.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for buckets in buckets_of(batch):
                if len(buckets) << 3 > len(total):
                    total += np.bincount(buckets, minlength=1 << bits)
                else:
                    at, count = np.unique(buckets, return_counts=True)
                    total[at] += count
        for chunk in range(1 << max(0, bits - _CHUNK_BITS)):
            part = total[chunk << _CHUNK_BITS : (chunk + 1) << _CHUNK_BITS]
            if part.any():
                at = np.flatnonzero(part)
                yield pa.RecordBatch.from_pydict(
                    {
                        "chunk": pa.array([chunk], pa.int32()),
                        "places": pa.array([at.astype(np.uint16).tobytes()], pa.binary()),
                        "counts": pa.array([part[at].astype(_smallest(part)).tobytes()], pa.binary()),
                        "width": pa.array([_smallest(part).itemsize], pa.int32()),
                    }
                )

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << _CHUNK_BITS, np.int64)
        for places, counts, width in zip(rows["places"], rows["counts"], rows["width"], strict=True):
            total[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, f"u{width}").astype(np.int64)
        return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "counts": [total.tobytes()]})

    parts = df.mapInArrow(partial, "chunk int, places binary, counts binary, width int")
    rows = parts.groupBy("chunk").applyInPandas(summed, "chunk int, counts binary").collect()
    out = np.zeros(1 << max(bits, _CHUNK_BITS), np.int64)
    for row in rows:
        out[row["chunk"] << _CHUNK_BITS : (row["chunk"] + 1) << _CHUNK_BITS] = np.frombuffer(row["counts"], np.int64)
    return out[: 1 << bits]


def bucket_flags(df: DataFrame, buckets_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> np.ndarray:
    """Which of ``2 ** bits`` buckets occur in what ``buckets_of`` makes of the rows.

    As ``bucket_counts``, with one bit a bucket from the tasks to the driver.
    """
    low = min(bits, _FLAG_BITS)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        for batch in batches:
            for buckets in buckets_of(batch):
                seen[buckets] = True
        for chunk in range(1 << (bits - low)):
            part = seen[chunk << low : (chunk + 1) << low]
            if part.any():
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "flags": pa.array([np.packbits(part).tobytes()], pa.binary())})

    def united(rows: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(-(-(1 << low) // 8), np.uint8)
        for part in rows["flags"]:
            flags |= np.frombuffer(part, np.uint8)
        return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "flags": [flags.tobytes()]})

    parts = df.mapInArrow(partial, "chunk int, flags binary")
    out = np.zeros(1 << bits, bool)
    for row in parts.groupBy("chunk").applyInPandas(united, "chunk int, flags binary").collect():
        out[row["chunk"] << low : (row["chunk"] + 1) << low] = np.unpackbits(np.frombuffer(row["flags"], np.uint8))[: 1 << low].astype(bool)
    return out


def text_slices(batch: pa.RecordBatch, column: str, rows: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most ``rows`` rows and about ``size`` bytes of text; one text is never cut."""
    lengths = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(lengths.buffers()[1], np.int64)[lengths.offset : lengths.offset + len(lengths) + 1] if len(lengths) else np.zeros(1, np.int64)
    at = 0
    while at < batch.num_rows:
        stop = int(np.searchsorted(ends, ends[at] + size, side="right")) - 1
        stop = min(max(stop, at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, stop - at)
        at = stop
