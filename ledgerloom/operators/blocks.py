"""Join of points within reach of each other, exact, in blocks.

Points are assigned to the nearest of a few pivots; the triangle inequality tells which cells
can hold a partner of which, so the other cell pairs are never compared. Neighbouring cells share a
block and larger ones are split by hash, hence a hot cell is many tasks. A task sees two blocks of bounded
size and compares the cell pairs within reach, tile by tile; a point travels once per block that it may meet, not once
per cell. What a task emits is up to its kernel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.runtime import cut

BLOCK_ROWS = 65536
SMALL_BLOCK_ROWS = 2048
# Blocks of a side that is too small for full ones: enough tasks for a cluster, few copies of a point.
BLOCKS_PER_SIDE = 8
TILE = 1 << 22
ROWS_PER_PIVOT = 512
MAX_PIVOTS = 256
MAX_TASKS = 8192
SLACK = 1e-6

Tiles = Iterator[tuple[np.ndarray, np.ndarray]]
Kernel = Callable[[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray, Tiles], pd.DataFrame | Iterator[pd.DataFrame]]


@dataclass(frozen=True)
class Cells:
    """Facts about the cells of one side, indexed by pivot."""

    sizes: np.ndarray
    radius: np.ndarray
    largest: np.ndarray
    closest: np.ndarray


def points_of(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["point"].to_numpy())


def _pivots(index: DataFrame, wanted: int) -> np.ndarray:
    """At most MAX_PIVOTS points in hash order: bounded, and the same on every run."""
    sample = index.orderBy(F.xxhash64("rep"), "rep").limit(wanted).select("point").collect()
    return np.array([r["point"] for r in sample], dtype=np.float64)


def _assign(side: DataFrame, pivots: np.ndarray, distance) -> DataFrame:
    """Adds the nearest pivot (``cell``) and the distance to it (``away``)."""

    def nearest(batches):
        for pdf in batches:
            if len(pdf):
                gaps = distance(points_of(pdf), pivots)
                cell = gaps.argmin(axis=1)
                yield pdf.assign(cell=cell.astype("int32"), away=gaps[np.arange(len(cell)), cell])

    extra = [T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())]
    return side.mapInPandas(nearest, T.StructType([*side.schema.fields, *extra]))


def _cells(assigned: DataFrame, n: int, k: int) -> Cells:
    """Per cell: rows, radius, largest ``size`` and the k smallest pivot distances (n x k values)."""
    sizes, radius, largest = np.zeros(n, dtype=np.int64), np.full(n, -1.0), np.zeros(n)
    facts = assigned.groupBy("cell").agg(
        F.count("*").alias("rows"), F.max("away").alias("radius"), F.max("size").alias("largest")
    )
    for row in facts.collect():
        sizes[row["cell"]], radius[row["cell"]], largest[row["cell"]] = row["rows"], row["radius"], row["largest"]
    closest = np.full((n, max(k, 1)), np.inf)
    if k:
        ranked = assigned.selectExpr("cell", "away", "row_number() OVER (PARTITION BY cell ORDER BY away) AS place")
        for row in ranked.where(F.col("place") <= k).collect():
            closest[row["cell"], row["place"] - 1] = row["away"]
    return Cells(sizes, radius, largest, closest)


def _chain(apart: np.ndarray) -> np.ndarray:
    """The pivots one after the other, each followed by the nearest one left."""
    order, left = [0], set(range(1, len(apart)))
    while left:
        order.append(min(left, key=lambda p: (apart[order[-1], p], p)))
        left.remove(order[-1])
    return np.array(order)


def _dealt(sizes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Per cell its first block and the number of blocks that it is split into; the number of blocks."""
    rows = min(BLOCK_ROWS, max(SMALL_BLOCK_ROWS, -(-int(sizes.sum()) // BLOCKS_PER_SIDE)))
    first, parts = np.zeros(len(sizes), dtype=np.int64), np.ones(len(sizes), dtype=np.int64)
    block, filled = 0, 0
    for cell in order:
        if filled and filled + sizes[cell] > rows:
            block, filled = block + 1, 0
        first[cell], parts[cell] = block, max(1, -(-int(sizes[cell]) // rows))
        if parts[cell] > 1:
            block += int(parts[cell])
        else:
            filled += int(sizes[cell])
    return first, parts, block + 1


def _tiles(l_cells: np.ndarray, r_cells: np.ndarray, wanted: np.ndarray) -> Tiles:
    """Rows and columns to compare, each row in one tile with all its columns."""
    for cell in np.unique(l_cells):
        rows, cols = np.flatnonzero(l_cells == cell), np.flatnonzero(wanted[cell][r_cells])
        step = max(1, TILE // max(1, len(cols)))
        for at in range(0, len(rows) if len(cols) else 0, step):
            yield rows[at : at + step], cols


def _met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one pair of blocks at a time, from rows sorted by it."""
    held, of = [], None
    for pdf in batches:
        for pair, part in pdf.groupby(["q_block", "i_block"], sort=False):
            if held and pair != of:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
            of = pair
    if held:
        yield pd.concat(held, ignore_index=True)


def block_join(
    queries: DataFrame,
    index: DataFrame,
    distance: Callable[[np.ndarray, np.ndarray], np.ndarray],
    reach: Callable[[Cells, Cells, np.ndarray], np.ndarray],
    kernel: Kernel,
    schema: str,
    k: int = 0,
    pairs: str = "all",
) -> DataFrame:
    """Run ``kernel`` on every pair of blocks that can hold a pair within reach.

    Both sides have ``rep`` (unique), ``point`` (numeric array) and ``size`` (double) and
    should be materialised, they are read several times. ``distance`` is a metric;
    ``reach`` gives the largest distance of interest per pair of cells. The kernel gets both blocks, their points
    and the tiles to compare; one that makes many rows yields them by the tile.

    ``pairs`` other than "all" are for a frame joined with itself: "half" compares two blocks once, not in either order, "own" only
    the rows of a block with each other.
    """
    spark = queries.sparkSession
    q_rows, i_rows = queries.count(), index.count()
    if not q_rows or not i_rows:
        return spark.createDataFrame([], schema)
    n = int(np.clip(i_rows // ROWS_PER_PIVOT, 1, MAX_PIVOTS))
    if n == 1:
        q, i = (side.withColumn("cell", F.lit(0)) for side in (queries, index))
        q_sizes, i_sizes, order = np.array([q_rows]), np.array([i_rows]), np.array([0])
        wanted = np.ones((1, 1), dtype=bool)
    else:
        pivots = _pivots(index, n)
        i = _assign(index, pivots, distance)
        # Stored where both sides are one: each row must have the same block on either.
        q, i = (_assign(queries, pivots, distance), i) if pairs == "all" else (cut(i),) * 2
        q_cells, i_cells = _cells(q, n, 0), _cells(i, n, k)
        apart = distance(pivots, pivots)
        limit = reach(q_cells, i_cells, apart)
        gap = apart - q_cells.radius[:, None] - i_cells.radius[None, :]
        wanted = (gap <= limit + SLACK) & (q_cells.sizes[:, None] > 0) & (i_cells.sizes[None, :] > 0)
        q_sizes, i_sizes, order = q_cells.sizes, i_cells.sizes, _chain(apart)
        q, i = q.drop("away"), i.drop("away")
    q_first, q_parts, q_blocks = _dealt(q_sizes, order)
    i_first, i_parts, i_blocks = _dealt(i_sizes, order)
    meet = np.zeros((q_blocks, i_blocks), dtype=bool)
    for a, b in zip(*np.nonzero(wanted), strict=True):
        meet[q_first[a] : q_first[a] + q_parts[a], i_first[b] : i_first[b] + i_parts[b]] = True
    if pairs != "all":
        meet &= np.triu(np.ones_like(meet)) if pairs == "half" else np.eye(len(meet), dtype=bool)
    if not meet.any():
        return spark.createDataFrame([], schema)
    # Fixed: the tasks are heavy for their bytes, adaptive coalescing would merge them.
    tasks = min(MAX_TASKS, int(meet.sum()))

    def blocks(side: DataFrame, own: str, other: str, first: np.ndarray, parts: np.ndarray, met: np.ndarray) -> DataFrame:
        # At most MAX_PIVOTS small rows, and one per block.
        cells = [(c, int(first[c]), int(parts[c])) for c in range(len(first))]
        homes = F.broadcast(spark.createDataFrame(cells, "cell int, first int, parts int"))
        partners = [(b, np.flatnonzero(met[b]).tolist()) for b in range(len(met))]
        partners = F.broadcast(spark.createDataFrame(partners, f"{own}_block int, others array<int>"))
        home = F.col("first") + F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
        placed = side.join(homes, "cell").withColumn(f"{own}_block", home).drop("first", "parts")
        placed = placed.join(partners, f"{own}_block").withColumn(f"{other}_block", F.explode("others")).drop("others")
        return placed.withColumn("asks", F.lit(own == "q"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for both in _met(batches):
            asks = both.pop("asks").to_numpy()
            left, right = both[asks].reset_index(drop=True), both[~asks].reset_index(drop=True)
            if len(left) and len(right):
                tiles = _tiles(left["cell"].to_numpy(), right["cell"].to_numpy(), wanted)
                found = kernel(left, right, points_of(left), points_of(right), tiles)
                yield from (found,) if isinstance(found, pd.DataFrame) else found

    left, right = blocks(q, "q", "i", q_first, q_parts, meet), blocks(i, "i", "q", i_first, i_parts, meet.T)
    both = left.unionByName(right, allowMissingColumns=True).repartition(tasks, "q_block", "i_block")
    return both.sortWithinPartitions("q_block", "i_block").mapInPandas(run, schema)
