"""Hard negatives by exact scores, looked up in subset-sum tables (the Four-Russians method).

``mine`` scores anchors against all rows by the integer inner product of their components, each taken as
``floor(scale * x)``. For a slice of anchors and each group of eight dimensions, a table holds the
sums of all 256 subsets of the eight anchor components. A candidate is stored as packed bit planes in two's
complement: the byte of a group and a plane says which of the eight components have that bit, so it is
the index of the subset to add up. Running over the planes from the sign downwards, shift and add, gives the full score,
without a multiplication and without an approximation.

1. Rows become bit planes; equal rows count once. The number of planes follows from the largest component.
2. Anchors and candidates are dealt into blocks by hash; a cell is one block of each, a task goes through its
   candidates in slices and keeps ``positives`` places per anchor. Rows meet anchors of their own label only.
3. The same cells again, for rows of other labels: per anchor and positive the first ``negatives`` rows
   whose score lies between ``low`` and ``high`` percent of the positive's.

Every anchor is scored against every row, so the work is anchors x rows by definition; nothing is sampled and
no list is cut but for the places asked for. A task holds at most ``ANCHORS`` anchors and one slice of rows.

Odd rows: a null ``vec_id``, label or vector, or a null or non-finite component, takes no part, and neither do
components whose integer has over ``MAX_BITS`` bits or vectors of over ``MAX_DIMS`` components, as scores would leave the
range of long. An empty or zero vector scores 0. Of vectors of different lengths the shorter counts as
filled with zeros. Rows that repeat an id with another label or vector count as rows of their own, but never as
candidates of an anchor of that id. Higher scores come first, ties by the smaller id. Other
columns are not read. An empty table, or one without anchors, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.runtime import cut

MAX_BITS = 20
MAX_DIMS = 4096
ANCHORS = 4096
ROWS = 1 << 18
TASKS = 20_000
SLICE = 256
CHUNK = 1024
NONE = -(1 << 62)


def _integers(batch: pa.RecordBatch, column: int, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, integers) of the usable vectors of a batch, those of one length at a time."""
    vectors = batch.column(column)
    if isinstance(vectors, pa.ListArray | pa.LargeListArray):
        lengths = np.asarray(vectors.value_lengths().fill_null(-1))
        values = vectors.values
        starts = np.asarray(vectors.offsets)[:-1]
    else:
        raise TypeError("vectors are arrays")
    numbers = np.floor(scale * np.asarray(values.cast(pa.float64()).fill_null(float("nan"))))
    for length in np.unique(lengths[(lengths >= 0) & (lengths <= MAX_DIMS)]):
        rows = np.flatnonzero(lengths == length)
        block = numbers[starts[rows][:, None] + np.arange(length)]
        with np.errstate(invalid="ignore"):
            fine = (np.abs(block) < 1 << MAX_BITS).all(axis=1)
        yield rows[fine], block[fine].astype(np.int64)


def _planes_of(integers: np.ndarray, planes: int) -> np.ndarray:
    """(rows, groups, planes) bytes: bit j of a byte is the plane's bit of the group's component j."""
    rows, dims = integers.shape
    groups = -(-dims // 8)
    padded = np.zeros((rows, groups * 8), np.int64)
    padded[:, :dims] = integers
    bits = (padded.reshape(rows, groups, 8, 1) >> np.arange(planes)) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").reshape(rows, groups, planes)


def _integers_of(codes: np.ndarray) -> np.ndarray:
    """The integers (rows, dimensions) that ``_planes_of`` has packed."""
    rows, groups, planes = codes.shape
    bits = np.unpackbits(codes[:, :, None, :], axis=2, bitorder="little").astype(np.int64)
    weights = 1 << np.arange(planes)
    weights[-1] = -weights[-1]
    return (bits @ weights).reshape(rows, groups * 8)


def _codes(packed: list[bytes], planes: int) -> np.ndarray:
    """Packed rows as one array; shorter vectors are filled with zero groups."""
    groups = max((len(p) for p in packed), default=0) // planes
    whole = b"".join(p if len(p) == groups * planes else p + bytes(groups * planes - len(p)) for p in packed)
    return np.frombuffer(whole, np.uint8).reshape(len(packed), groups, planes)


class Tables:
    """Subset sums of a slice of anchors, per group of eight dimensions."""

    def __init__(self, codes: np.ndarray) -> None:
        integers = _integers_of(codes)
        self.planes = codes.shape[2]
        largest = int(np.abs(integers).max(initial=0)) << self.planes
        kind = np.int32 if largest * max(1, integers.shape[1]) < 1 << 30 else np.int64
        self._tables = []
        for at in range(0, integers.shape[1], 8):
            table = np.zeros((256, len(integers)), kind)
            for j in range(8):
                table[1 << j : 2 << j] = table[: 1 << j] + integers[:, at + j].astype(kind)
            self._tables.append(table)
        self._shape = (len(integers), kind)

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """(anchors, candidates) inner products."""
        anchors, kind = self._shape
        total = np.zeros((len(codes), anchors), kind)
        part = np.empty_like(total)
        groups = min(codes.shape[1], len(self._tables))
        for plane in range(self.planes - 1, -1, -1):
            total <<= 1
            for group in range(groups):
                np.take(self._tables[group], codes[:, group, plane], axis=0, out=part, mode="clip")
                if plane == self.planes - 1:
                    total -= part
                else:
                    total += part
        return total.T.astype(np.int64)


class Best:
    """The first ``places`` candidates of each line, by score and then by id."""

    def __init__(self, lines: int, places: int) -> None:
        self.scores = np.full((lines, places), NONE, np.int64)
        self.ids = np.zeros((lines, places), np.int64)

    def add(self, lines: np.ndarray, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` of ``lines`` (line, candidate) where ``allowed``; ``ids`` ascend and name the candidates."""
        allowed = allowed & (scores >= self.scores[lines, -1][:, None])
        some = allowed.any(axis=1)
        if not some.any():
            return
        lines, scores, allowed = lines[some], scores[some], allowed[some]
        n, places = len(ids), self.scores.shape[1]
        key = np.where(allowed, scores * n + np.arange(n - 1, -1, -1), NONE)
        if n > places:
            key = np.partition(key, n - places, axis=1)[:, n - places :]
        found = np.where(key > NONE, key // n, NONE)
        names = ids[n - 1 - key % n]
        both, named = np.hstack([self.scores[lines], found]), np.hstack([self.ids[lines], names])
        order = np.lexsort((named, -both), axis=-1)[:, :places]
        self.scores[lines] = np.take_along_axis(both, order, axis=1)
        self.ids[lines] = np.take_along_axis(named, order, axis=1)

    def rows(self) -> Iterator[tuple[int, int, int]]:
        """(line, id, score) of every place taken."""
        for line, place in zip(*np.nonzero(self.scores > NONE), strict=True):
            yield int(line), int(self.ids[line, place]), int(self.scores[line, place])


def _packed(vectors: DataFrame, scale: float) -> tuple[DataFrame, int]:
    """Usable distinct rows (node, vec_id, label, codes) and their number of planes."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), "embedding")
    rows = rows.where("vec_id is not null and label is not null and embedding is not null")

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 0
        for batch in batches:
            for _, integers in _integers(batch, 0, scale):
                # a negative number needs as many bits as the one before its absolute value
                most = max(most, int(np.where(integers < 0, -1 - integers, integers).max(initial=0)))
        yield pa.RecordBatch.from_pydict({"most": pa.array([most], pa.int64())})

    most = rows.select("embedding").mapInArrow(largest, "most long").agg(F.max("most")).first()[0] or 0
    planes = int(most).bit_length() + 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, integers in _integers(batch, 2, scale):
                codes = _planes_of(integers, planes)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(pa.array(at)) for i in range(2)), pa.array([c.tobytes() for c in codes], pa.binary())],
                    names=["vec_id", "label", "codes"],
                )

    packed = rows.mapInArrow(pack, "vec_id long, label string, codes binary").distinct()
    return cut(packed.select(F.xxhash64("vec_id", "label", "codes").alias("node"), "*")), planes


def _dealt(anchors: DataFrame, rows: DataFrame, blocks: int, parts: int) -> DataFrame:
    """Anchors (kind 0) and rows (kind 1) by cell: ``blocks`` blocks of anchors, ``parts`` blocks of rows."""
    cells = blocks * parts
    tasks = min(cells, TASKS)
    block = F.pmod(F.xxhash64("node"), F.lit(blocks))
    part = F.pmod(F.hash("node"), F.lit(parts)).cast("long")
    left = anchors.select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), block.alias("block"), "node", "vec_id", "label", "codes", "wanted"
    )
    right = rows.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), part.alias("part"), "node", "vec_id", "label", "codes",
        F.lit(None).cast("array<struct<id:long,score:long>>").alias("wanted"),
    )
    cell = (F.col("block").cast("long") * parts + F.col("part")).alias("cell")
    names = ["node", "vec_id", "label", "codes", "wanted"]
    both = left.select(cell, F.lit(0).alias("kind"), *names).unionByName(right.select(cell, F.lit(1).alias("kind"), *names))
    return both.repartitionById(tasks, F.pmod("cell", F.lit(tasks)).cast("int")).sortWithinPartitions("cell", "kind")


def _cells(dealt: DataFrame, planes: int, start, schema: str) -> DataFrame:
    """Runs ``start(anchors)``, which gives ``(add, rows)``, over each cell: ``add`` gets its rows in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        current, waiting, state = None, [], None

        def result() -> pa.RecordBatch:
            found = list(state[1]()) if state else []
            columns = list(zip(*found, strict=True)) if found else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in batches:
            cell, kind = (np.asarray(batch.column(i)) for i in range(2))
            edges = np.flatnonzero((cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip(np.append(0, edges), np.append(edges, len(cell)), strict=True):
                if a == b:
                    continue
                if cell[a] != current:
                    yield result()
                    current, waiting, state = cell[a], [], None
                if kind[a] == 0:
                    waiting += batch.slice(a, b - a).to_pylist()
                    continue
                if state is None:
                    # a cell without anchors has nothing to score
                    state = start(waiting) if waiting else (lambda *_: None, lambda: ())
                    waiting = []
                for at in range(a, b, CHUNK):
                    piece = batch.slice(at, min(CHUNK, b - at))
                    ids = np.asarray(piece.column(3))
                    order = np.argsort(ids, kind="stable")
                    labels = np.array(piece.column(4).to_pylist(), object)[order]
                    state[0](ids[order], labels, _codes(piece.column(5).to_pylist(), planes)[order])
        yield result()

    return dealt.mapInArrow(run, schema)


def _slices(anchors: list[dict]) -> Iterator[list[dict]]:
    for at in range(0, len(anchors), SLICE):
        yield anchors[at : at + SLICE]


def _positives(dealt: DataFrame, planes: int, places: int) -> DataFrame:
    def start(anchors: list[dict]):
        by_label: dict[str, list[dict]] = {}
        for row in anchors:
            by_label.setdefault(row["label"], []).append(row)
        slices: dict[str, list[tuple]] = {}
        for label, rows in by_label.items():
            for part in _slices(rows):
                own = np.array([r["vec_id"] for r in part], np.int64)
                slices.setdefault(label, []).append((part, own, Tables(_codes([r["codes"] for r in part], planes)), Best(len(part), places)))

        def add(ids: np.ndarray, labels: np.ndarray, codes: np.ndarray) -> None:
            for label in set(labels.tolist()) & slices.keys():
                mine = labels == label
                for part, own, tables, best in slices[label]:
                    best.add(np.arange(len(part)), tables.scores(codes[mine]), own[:, None] != ids[mine], ids[mine])

        def rows() -> Iterator[tuple]:
            for listed in slices.values():
                for part, _, _, best in listed:
                    for line, other, score in best.rows():
                        yield part[line]["node"], other, score

        return add, rows

    return _cells(dealt, planes, start, "node long, positive_id long, positive_score long")


def _negatives(dealt: DataFrame, planes: int, places: int, low: int, high: int) -> DataFrame:
    def start(anchors: list[dict]):
        slices = []
        for part in _slices(anchors):
            lines = [(i, w["id"], w["score"]) for i, r in enumerate(part) for w in r["wanted"]]
            at, positive, score = (np.array(x, np.int64) for x in zip(*lines, strict=True))
            tables = Tables(_codes([r["codes"] for r in part], planes))
            label, own = np.array([r["label"] for r in part], object), np.array([r["vec_id"] for r in part], np.int64)
            # low * positive <= 100 * negative <= high * positive, in whole numbers
            limits = (-(-low * score // 100), high * score // 100)
            slices.append((part, at, positive, score, tables, label, own, limits, Best(len(at), places)))

        def add(ids: np.ndarray, labels: np.ndarray, codes: np.ndarray) -> None:
            for _, at, _, _, tables, label, own, (least, most), best in slices:
                scores = tables.scores(codes)
                other = (label[:, None] != labels[None, :]) & (own[:, None] != ids[None, :])
                # one line per anchor at a time, so that no array is larger than the scores
                rank = np.arange(len(at)) - np.searchsorted(at, at)
                for k in range(int(rank.max(initial=-1)) + 1):
                    lines = np.flatnonzero(rank == k)
                    seen = scores[at[lines]]
                    within = (seen >= least[lines][:, None]) & (seen <= most[lines][:, None]) & other[at[lines]]
                    best.add(lines, seen, within, ids)

        def rows() -> Iterator[tuple]:
            for part, at, positive, score, _, _, _, _, best in slices:
                for line, other, found in best.rows():
                    yield part[at[line]]["node"], part[at[line]]["vec_id"], int(positive[line]), int(score[line]), other, found

        return add, rows

    schema = "node long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    return _cells(dealt, planes, start, schema)


def mine(
    vectors: DataFrame, is_anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``vectors`` (vec_id, label, embedding).

    ``is_anchor`` is a condition on ``vec_id``. Of each anchor the first ``positives`` rows of its label are taken, and for
    each of them the first ``negatives`` rows of other labels that score ``low`` to ``high`` percent of it.
    """
    rows, planes = _packed(vectors, scale)
    anchors = rows.where(is_anchor).withColumn("wanted", F.lit(None).cast("array<struct<id:long,score:long>>"))
    sizes = rows.agg(F.count("*"), F.count(F.when(is_anchor, 1))).first()
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-sizes[1] // ANCHORS))
    parts = max(-(-sizes[0] // ROWS), -(-spread // blocks), 1)

    found = _positives(_dealt(anchors, rows, blocks, parts), planes, positives)
    first = Window.partitionBy("node").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    wanted = found.groupBy("node").agg(
        F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("wanted")
    )
    anchors = cut(anchors.drop("wanted").join(wanted, "node"))

    found = _negatives(_dealt(anchors, rows, blocks, parts), planes, negatives, low, high)
    first = Window.partitionBy("node", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
