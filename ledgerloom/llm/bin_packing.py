"""Packing documents into sequences by minimum bin slack.

``pack`` cuts documents into pieces of at most ``capacity`` tokens and fills sequences so that little
room is left. A sequence is made from the longest piece left and, by subset sums over the lengths
that are still available (one bit per sum), from the fullest combination for the rest of the room;
longer pieces are preferred among equally full ones. What it takes is removed, and so on.

All pieces of one length are alike, so only their number per length counts: at most ``capacity``
numbers, whatever the corpus. A combination is taken as often as the numbers allow before the next
is sought, so a plan has a few thousand entries for any number of sequences. Pieces are then numbered
within their length, first within the task that cut them and then by sums over tasks, and each looks up
its place in the plan. No group is gathered, and a length that a third of all pieces have is no key.

A null or empty text is the end token alone. Rows that repeat an id are packed each for itself. A null
id stays null. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import tokens
from ledgerloom.runtime import cut

CAPACITY = 1024
END = 2
_BATCH = 4000


def pieces(docs: DataFrame, capacity: int, paths: tuple[str, str | None], with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth[, ids]): ``nth`` counts a task's pieces of one length."""
    columns = {
        "doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(),
        "ids_crc32": pa.int64(), "task": pa.int32(), "nth": pa.int64(),
    } | ({"ids": pa.list_(pa.int32())} if with_ids else {})
    schema = pa.schema(list(columns.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        encode = tokens.encoder(*paths)
        seen = np.zeros(capacity + 1, np.int64)
        out: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            arrays = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END)).astype("<u4")
                first = len(ids) % capacity or capacity
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    own = (ids[a:b].astype(np.int32),) if with_ids else ()
                    out.append((doc_id.as_py(), piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), task, int(seen[b - a]), *own))
                    seen[b - a] += 1
                if len(out) >= _BATCH:
                    yield batch_of()
        if out:
            yield batch_of()

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(run, kinds + (", ids array<int>" if with_ids else ""))


def fullest(available: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to ``room``, as length -> count."""
    mask = (1 << (room + 1)) - 1
    sums, steps = 1, []
    for length in sorted((n for n in available if n <= room), reverse=True):
        before, left, part = sums, min(available[length], room // length), 1
        while left > 0:
            part = min(part, left)
            sums |= (sums << (part * length)) & mask
            left -= part
            part *= 2
        steps.append((length, before))
        if sums >> room & 1:
            break
    goal = sums.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, before in reversed(steps):
        used = 0
        while not before >> goal & 1:
            goal -= length
            used += 1
        if used:
            chosen[length] = used
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths, each with the number of sequences made from it."""
    left = {n: c for n, c in counts.items() if c}
    out = []
    while left:
        longest = max(left)
        available = {n: c - (n == longest) for n, c in left.items() if c > (n == longest)}
        chosen = fullest(available, capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[n] // used for n, used in chosen.items())
        out.append((dict(sorted(chosen.items(), reverse=True)), times))
        for n, used in chosen.items():
            left[n] -= used * times
            if not left[n]:
                del left[n]
    return out


def _places(made: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, count per sequence, first sequence, offset), sorted by length and rank."""
    rows, taken, sequence = [], {}, 0
    for chosen, times in made:
        offset = 0
        for length, used in chosen.items():
            rank = taken.get(length, 0)
            rows.append((length, rank, used, sequence, offset))
            taken[length] = rank + used * times
            offset += length * used
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(
    docs: DataFrame, capacity: int = CAPACITY, paths: tuple[str, str | None] | None = None, with_ids: bool = False
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) for every piece of ``docs`` (doc_id, text)."""
    cuts = cut(pieces(docs, capacity, paths or tokens.default_paths(), with_ids))
    per_task = cut(cuts.groupBy("task", "length").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = docs.sparkSession.sparkContext.broadcast(_places(plan(counts, capacity)))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = cuts.join(base, ["task", "length"]).withColumn("rank", F.col("nth") + F.col("base")).drop("task", "nth", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        keys = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            row = table[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            copy, slot = np.divmod(rank - row[:, 1], row[:, 2])
            extra = [pa.array(row[:, 3] + copy), pa.array(row[:, 4] + slot * length)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *extra], names=[*batch.schema.names, "sequence_id", "offset"]
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema)
    out = ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")
    return out.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])
    )
