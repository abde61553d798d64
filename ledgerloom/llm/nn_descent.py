"""Near-duplicate embeddings by NN-descent.

``near_duplicates`` links vectors of one label whose cosine, in double precision, is at least ``threshold``.

1. Equal vectors of a label become one class with a count; only classes are searched.
2. Every class gets a list of ``LIST`` neighbours: the best of ``CHUNK`` classes that stand together when
   sorted by the signs of random projections, from ``TABLES`` such orders.
3. Rounds of neighbours-of-neighbours joins refine the lists: around each class meet its neighbours and
   a sample of those that list it, and every pair of them of which one is new is compared. Rounds end
   when few lists change.
4. Links are list entries over the threshold. A list that has nothing else is saturated, so there may be
   more: it is enlarged to everything that links reach, the whole component, and the ``LIST`` best
   outside of it. These are searched among the saturated classes (a link that no list has is saturated at both
   ends); what they link is joined, and so on until each list holds an entry below the threshold or
   all of its space. Components are compared in blocks of ``BLOCK`` by ``BLOCK`` that return sums per
   vector, never pairs.
5. An audit draws classes by a hash, one in ``SHARE`` at least and on until ``AUDIT`` of them have links or none is left,
   and compares them with all vectors of their labels, in blocks. The share of the links found is averaged over
   the classes that have some, so a small group counts like a large one. Below ``RECALL`` the search
   goes on with other projections and more rounds; it fails loudly if ``MAX_SEARCHES`` do not reach it.
   Recall and numbers of classes are logged.

Links never lie below the threshold; a missed link can only be one between components that no list
joins. Vectors that are null, empty or zero, or have null or non-finite components, and rows without
label or id link with nothing; each is its own component, kept. Repeated rows count as further
vectors. Vectors of different lengths never link. Other columns are not read. An empty table gives
an empty result. Classes are named by 64-bit hashes of label and vector.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.components import connected_components
from ledgerloom.runtime import cut

LIST = 8
CHUNK = 64
TABLES = 6
BLOCK = 512
ROUNDS = 4
CHANGED = 0.002
AUDIT = 64
SHARE = 64
DRAWN = 1024
RECALL = 0.99
MAX_SEARCHES = 4
MAX_ENLARGED = 40
MAX_IDLE = 2
SEED = 9

_log = logging.getLogger(__name__)
_PAIRS = "node long, other long, sim double, own boolean"


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, node) with a null node for those that link with nothing, and classes (node, space, vec, n)."""
    values = F.col("embedding").cast("array<double>")
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), values.alias("v"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    # adding zero makes the two zeros one
    plain = F.transform("v", lambda x: x + 0.0)
    rows = rows.withColumn("v", F.when(fine & F.coalesce(usable, F.lit(False)), plain))
    space = F.concat_ws(":", F.col("label"), F.size("v").cast("string"))
    node = F.when(F.col("v").isNotNull(), F.xxhash64("label", "v"))
    rows = cut(rows.select("vec_id", node.alias("node"), space.alias("space"), "v"))
    groups = rows.where("node is not null").groupBy("node").agg(
        F.first("space").alias("space"), F.first("v").alias("v"), F.count("*").alias("n")
    )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = [np.array(v, np.float64).tobytes() for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(vec, pa.binary()), batch.column(3)], names=["node", "space", "vec", "n"]
            )

    return rows.select("vec_id", "node"), cut(groups.mapInArrow(packed, "node long, space string, vec binary, n long"))


def _matrix(vecs: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(v, np.float64) for v in vecs])
    # two steps, so that neither huge nor tiny components leave the range of doubles
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


_PAIR_KINDS = {"node": pa.int64(), "other": pa.int64(), "sim": pa.float64(), "own": pa.bool_()}


def _best(nodes: np.ndarray, parts: np.ndarray, sims: np.ndarray, most: int) -> list[tuple]:
    """For each row of ``sims`` its ``most`` best columns within and outside of its part, as (node, other, sim, own).

    -2 marks no pair.
    """
    out = []
    take = min(most, sims.shape[1])
    same = parts[:, None] == parts[None, :]
    for own in (False, True) if same.sum() > len(parts) else (False,):
        seen = np.where(same == own, sims, -3)
        order = np.argsort(-seen, axis=1, kind="stable")[:, :take]
        for i, columns in enumerate(order):
            out += [(int(nodes[i]), int(nodes[j]), float(seen[i, j]), own) for j in columns if seen[i, j] > -2]
    return out


def _started(classes: DataFrame, search: int) -> DataFrame:
    """First lists, from chunks of ``TABLES`` orders by signs of random projections."""
    largest = classes.groupBy("space").count().agg(F.max("count")).first()[0] or 0
    bits = max(1, math.ceil(math.log2(max(2, largest / CHUNK * 2))))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = []
            for node, part, space, vec in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                x = _matrix([vec])[0]
                if len(x) not in planes:
                    rng = np.random.default_rng([SEED, search, len(x)])
                    planes[len(x)] = rng.standard_normal((TABLES, bits + 1, len(x)))
                seen = planes[len(x)] @ x
                for table in range(TABLES):
                    code = int(((seen[table, :bits] > 0) << np.arange(bits)).sum())
                    rows.append((table, space, code, float(seen[table, bits]), node, part, vec))
            kinds = {
                "table": pa.int32(), "space": pa.string(), "code": pa.int64(), "place": pa.float64(),
                "node": pa.int64(), "part": pa.int64(), "vec": pa.binary(),
            }
            yield _batch(rows, kinds)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def lists() -> pa.RecordBatch:
            nodes = np.array([h[1] for h in held], np.int64)
            x = _matrix([h[3] for h in held])
            sims = x @ x.T
            np.fill_diagonal(sims, -3)
            out = _batch(_best(nodes, np.array([h[2] for h in held], np.int64), sims, LIST), _PAIR_KINDS)
            held.clear()
            return out

        for batch in batches:
            for table, space, node, part, vec in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4, 5, 6)), strict=True):
                if held and (held[0][0] != (table, space) or len(held) == CHUNK):
                    yield lists()
                held.append(((table, space), node, part, vec))
        if held:
            yield lists()

    codes = classes.select("node", "part", "space", "vec").mapInArrow(
        coded, "table int, space string, code long, place double, node long, part long, vec binary"
    )
    order = ["table", "space", "code", "place"]
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = codes.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return chunks.mapInArrow(compared, _PAIRS)


def _listed(pairs: DataFrame) -> DataFrame:
    """The ``LIST`` best of each node within and outside of its part, from pairs that may repeat."""
    best = Window.partitionBy("node", "own").orderBy(F.desc("sim"), "other")
    once = pairs.groupBy("node", "other", "own").agg(F.max("sim").alias("sim"), F.min("old").alias("old"))
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= LIST).drop("rank")


def _joined(lists: DataFrame, classes: DataFrame, turn: int) -> DataFrame:
    """Pairs found where neighbours of a node meet."""
    into = lists.groupBy("other", "own").agg(F.count("*").alias("listed"))
    back = lists.join(into, ["other", "own"]).where(
        F.pmod(F.xxhash64("node", "other", F.lit(turn)), F.col("listed")) < LIST
    )
    members = lists.select(F.col("node").alias("center"), F.col("other").alias("node"), "old").unionByName(
        back.select(F.col("other").alias("center"), "node", "old")
    )
    members = members.groupBy("center", "node").agg(F.min("old").alias("old"))
    met = members.join(classes.select("node", "part", "vec"), "node").select("center", "node", "old", "part", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def pairs() -> list[tuple]:
            nodes = np.array([h[1] for h in held], np.int64)
            old = np.array([h[2] for h in held], bool)
            if len(held) < 2 or old.all():
                return []
            x = _matrix([h[4] for h in held])
            sims = x @ x.T
            sims[old[:, None] & old[None, :]] = -3
            np.fill_diagonal(sims, -3)
            return _best(nodes, np.array([h[3] for h in held], np.int64), sims, LIST)

        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if held and held[0][0] != row[0]:
                    out += pairs()
                    held.clear()
                held.append(row)
            yield _batch(out, _PAIR_KINDS)
        if held:
            yield _batch(pairs(), _PAIR_KINDS)

    return met.repartition("center").sortWithinPartitions("center").mapInArrow(run, _PAIRS)


def _search(classes: DataFrame, lists: DataFrame | None, search: int, heads: bool = False) -> DataFrame:
    """Lists (node, other, sim, own, old) of ``classes`` (node, part, space, vec), going on from ``lists`` if there are some."""
    fresh = _started(classes, search)
    if heads:
        # one class of each part besides: a chunk within a large part shows nothing outside of it
        first = classes.groupBy("part").agg(F.min_by(F.struct("node", "space", "vec"), F.xxhash64("node", F.lit(search))).alias("head"))
        fresh = fresh.unionByName(_started(first.select("head.node", "part", "head.space", "head.vec"), search))
    if lists is not None:
        parts = classes.select("node", "part")
        known = lists.select("node", "other", "sim").join(parts, "node")
        known = known.join(parts.select(F.col("node").alias("other"), F.col("part").alias("its")), "other")
        fresh = fresh.unionByName(known.select("node", "other", "sim", (F.col("part") == F.col("its")).alias("own")))
    now = cut(_listed(fresh.withColumn("old", F.lit(False))))
    size = now.count()
    for turn in range(ROUNDS):
        found = _joined(now, classes, search * ROUNDS + turn).withColumn("old", F.lit(False))
        # what was listed before is old from now on; what is met again stays old
        known = now.select("node", "other", "sim", "own", F.lit(True).alias("old"))
        merged = known.unionByName(found).groupBy("node", "other", "own").agg(F.max("sim").alias("sim"), F.max("old").alias("old"))
        now = cut(_listed(merged))
        if now.where("not old").count() <= CHANGED * size:
            break
    return now


def _enlarged(classes: DataFrame, lists: DataFrame, threshold: float, search: int) -> DataFrame:
    """(node, component) by the links of ``lists``, after saturated lists were enlarged until none is.

    Every round in which a saturated list shows only links joins its component to another one, so
    rounds grow with the logarithm of the number of components.
    """
    spaces = classes.groupBy("space").agg(F.count("*").alias("held"))
    links = lists.where(F.col("sim") >= threshold).select(F.col("node").alias("a"), F.col("other").alias("b"))
    components = cut(connected_components(links))
    # the first lists have no parts yet, so all of their entries lie outside
    open_, idle = classes.withColumn("part", F.col("node")), 0
    for turn in range(MAX_ENLARGED):
        ends = lists.where("not own").groupBy("node").agg(F.min("sim").alias("least"))
        named = classes.join(components, "node", "left").select("node", F.coalesce("component", "node").alias("part"), "space", "vec")
        # a list is settled by an entry below the threshold, or if its component is all of its space
        sizes = named.groupBy("part", "space").agg(F.count("*").alias("size")).join(spaces, "space").where("size < held")
        open_ = named.join(open_.select("node"), "node", "left_semi").join(ends, "node", "left")
        open_ = open_.where(F.coalesce("least", F.lit(1.0)) >= threshold).join(sizes.select("part"), "part", "left_semi")
        # a space with one part that is open has nothing left to find
        several = open_.groupBy("space").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b")
        open_ = cut(open_.join(several.select("space"), "space", "left_semi").select("node", "part", "space", "vec"))
        if open_.isEmpty():
            return components
        lists = _search(open_, lists, search * MAX_ENLARGED + turn + MAX_SEARCHES, heads=True)
        more = cut(lists.where(~F.col("own") & (F.col("sim") >= threshold)).select(F.col("node").alias("a"), F.col("other").alias("b")))
        idle = idle + 1 if more.isEmpty() else 0
        if idle == MAX_IDLE:
            # lists that meet nothing outside at all: the audit judges them
            return components
        if not idle:
            stars = components.select(F.col("node").alias("a"), F.col("component").alias("b"))
            components = cut(connected_components(stars.unionByName(more)))
    raise RuntimeError(f"saturated lists were left after {MAX_ENLARGED} rounds")


def _linked(classes: DataFrame, components: DataFrame, threshold: float) -> DataFrame:
    """(node, links): other vectors linked to each node of ``components`` (node, component), by blocks."""
    sizes = components.groupBy("component").agg(F.count("*").alias("size"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = components.join(sizes, "component").select(
        "node", "component", blocks.alias("blocks"), F.pmod(F.xxhash64("node", F.lit(SEED)), blocks).cast("int").alias("own")
    )
    # every block meets every other of its component once, and itself
    turns = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("turn")
    placed = placed.select("node", "component", "own", turns).select(
        "node", "component", "own", F.least("own", "turn").alias("a"), F.greatest("own", "turn").alias("b")
    )
    met = placed.join(classes.select("node", "vec", "n"), "node").select("component", "a", "b", "own", "node", "n", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"node": pa.int64(), "links": pa.int64()}
        held: list[tuple] = []

        def sums() -> list[tuple]:
            a, b = held[0][1], held[0][2]
            sides = [[h for h in held if h[3] == s] for s in ((a, b) if a != b else (a,))]
            x = [_matrix([h[6] for h in s]) for s in sides if s]
            if a != b:
                if len(x) < 2:
                    return []
                near = x[0] @ x[1].T >= threshold
                counts = [near @ np.array([h[5] for h in sides[1]]), near.T @ np.array([h[5] for h in sides[0]])]
            else:
                near = x[0] @ x[0].T >= threshold
                np.fill_diagonal(near, False)
                counts = [near @ np.array([h[5] for h in sides[0]])]
            return [(h[4], int(c)) for side, count in zip(sides, counts, strict=True) for h, c in zip(side, count, strict=True)]

        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if held and held[0][:3] != row[:3]:
                    out += sums()
                    held.clear()
                held.append(row)
            yield _batch(out, kinds)
        if held:
            yield _batch(sums(), kinds)

    key = ["component", "a", "b"]
    dealt = met.repartition(*key).sortWithinPartitions(*key, "own")
    return dealt.mapInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def _truth(classes: DataFrame, drawn: DataFrame, threshold: float) -> DataFrame:
    """(node, truth): other vectors linked to each class of ``drawn``, some ``DRAWN`` of ``classes``."""
    queries: dict[str, list[tuple[int, bytes]]] = {}
    for r in drawn.select("node", "space", "vec").collect():
        queries.setdefault(r["space"], []).append((r["node"], bytes(r["vec"])))
    sent = classes.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, int] = {}
        asked = {space: (np.array([q[0] for q in of]), _matrix([q[1] for q in of])) for space, of in sent.value.items()}
        for batch in batches:
            by_space: dict[str, list[tuple]] = {}
            for node, space, vec, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if space in asked:
                    by_space.setdefault(space, []).append((node, vec, n))
            for space, held in by_space.items():
                names, x = asked[space]
                for rows in (held[i : i + BLOCK] for i in range(0, len(held), BLOCK)):
                    near = x @ _matrix([r[1] for r in rows]).T >= threshold
                    near &= names[:, None] != np.array([r[0] for r in rows])[None, :]
                    counts = near @ np.array([r[2] for r in rows])
                    for i in np.flatnonzero(counts):
                        totals[int(names[i])] = totals.get(int(names[i]), 0) + int(counts[i])
        yield _batch(list(totals.items()), {"node": pa.int64(), "truth": pa.int64()})

    found = classes.select("node", "space", "vec", "n").mapInArrow(run, "node long, truth long")
    return found.groupBy("node").agg(F.sum("truth").alias("truth"))


def audit(classes: DataFrame, linked: DataFrame, threshold: float) -> float:
    """Recall of ``linked`` (node, links), averaged over the drawn classes that have links; 1 if no class has any."""
    size = classes.count()
    turns = max(1, math.ceil(size / DRAWN))
    turn = F.pmod(F.xxhash64("node", F.lit(SEED)), F.lit(turns))
    recall, seen, done = 0.0, 0, 0
    while done < turns and (seen < AUDIT or done * SHARE < turns):
        truth = _truth(classes, classes.where(turn == done), threshold)
        own = F.least(F.coalesce("links", F.lit(0)), F.col("truth")) / F.col("truth")
        row = truth.join(linked, "node", "left").agg(F.sum(own).alias("recall"), F.count("*").alias("seen")).first()
        recall, seen, done = recall + (row["recall"] or 0.0), seen + row["seen"], done + 1
    share = recall / seen if seen else 1.0
    _log.warning("audit: recall %.4f over %d classes with links, %d of %d draws from %d classes", share, seen, done, turns, size)
    return share


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label)."""
    rows, classes = _classes(vectors)
    lists = None
    for search in range(MAX_SEARCHES):
        lists = _search(classes.withColumn("part", F.col("node")), lists, search)
        components = _enlarged(classes, lists, threshold, search)
        linked = cut(_linked(classes, components, threshold))
        if audit(classes, linked, threshold) >= RECALL:
            break
    else:
        raise RuntimeError(f"NN-descent did not find {RECALL:.0%} of the links in {MAX_SEARCHES} searches")
    members = rows.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    named = members.join(components, "node", "left").join(linked, "node", "left")
    named = cut(named.select("node", "first", "n", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links")))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "component").select("node", "component_id", (F.col("links") + F.col("n") - 1).alias("n_links"))
    out = rows.join(named, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
