"""Nearest neighbours and similar groups of vectors, exact.

Equal vectors are searched once. Blocks of distinct vectors within reach of each other are
multiplied (see :mod:`ledgerloom.operators.blocks`); a task emits at most ``k`` rows per query,
a spanning set of links, or the pairs asked for, a tile at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import settings as s
from ledgerloom.operators import blocks
from ledgerloom.operators.blocks import SLACK, block_join
from ledgerloom.operators.components import connected_components
from ledgerloom.runtime import cut, unsent

# Two ways to compute a cosine differ by far less.
ROUNDING = 1e-12
# Of the pairs of a tile; more of them are scored by a product of the whole tile.
FEW = 1 / 64
AT_ONCE = 1 << 14
COPIES_AT_ONCE = 1024


def unit_vector(vector: Column) -> Column:
    as_double = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(as_double, F.lit(0.0), lambda acc, x: acc + x * x))
    # bound to a variable, the norm is computed once per vector, not once per component
    return F.get(F.transform(F.array(norm), lambda n: F.transform(as_double, lambda x: x / n)), F.lit(0))


def _has_direction(vector: Column) -> Column:
    return F.exists(vector, lambda x: x != 0)


def distinct_vectors(rows: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """(rep, members, point, size, vector, extra): one row per distinct vector, named by its smallest id."""
    keys = ["vector", *(extra or [])]
    groups = rows.where(_has_direction(F.col("vector"))).groupBy(*keys)
    return groups.agg(F.min("id").alias("rep"), F.count("*").alias("members")).withColumns(
        {"point": unit_vector(F.col("vector")), "size": F.lit(1.0)}
    )


def vector_hash(vector: Column) -> Column:
    """Stands before a vector among the keys of a join, so that rows are sorted by a number and vectors are read only where it is equal."""
    return F.xxhash64(vector)


def _first_copies(rows: DataFrame, most: int) -> DataFrame:
    """(id, vector, rep, copy): at most ``most`` rows of each vector, the smallest ids, ``rep`` being the very smallest.

    Rows are dealt and sorted by the hash of their vector, together with the vector itself only where unlike vectors share a hash.
    """
    directed = rows.where(_has_direction(F.col("vector"))).select("id", "vector").withColumn("hash", vector_hash(F.col("vector")))
    shared = directed.select("hash", "vector").distinct().groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    marked = directed.join(cut(shared), "hash", "left").withColumn("apart", F.when(F.col("n").isNotNull(), F.col("vector")))
    window = "(PARTITION BY hash, apart ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    placed = marked.selectExpr("id", "vector", f"min(id) OVER {window} AS rep", f"row_number() OVER {window} AS copy")
    return placed.where(F.col("copy") <= most)


def chord(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of unit vectors; it orders pairs like the cosine does."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def _score_reach(min_score: float):
    """Pairs below the score are of no interest."""
    limit = float(np.sqrt(max(0.0, 2.0 - 2.0 * min_score)))
    return lambda q, i, apart: np.full(apart.shape, limit)


def _top_reach(k: int, min_score: float | None):
    """Per query cell, a distance within which k index vectors are certain to lie."""

    def reach(q, i, apart):
        upper = (q.radius[:, None, None] + apart[:, :, None] + i.closest[None, :, :]).reshape(len(apart), -1)
        limit = np.sort(upper, axis=1)[:, k - 1] if upper.shape[1] >= k else np.full(len(apart), np.inf)
        if min_score is not None:
            limit = np.minimum(limit, np.sqrt(max(0.0, 2.0 - 2.0 * min_score)))
        return np.repeat(limit[:, None], len(apart), axis=1)

    return reach


def _margin(a: np.ndarray) -> float:
    """How far a score of unit vectors in single precision may be off."""
    return (a.shape[1] + 8) * 2.0**-23


def _exact(a: np.ndarray, b: np.ndarray, l_rows: np.ndarray, r_rows: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Scores in double precision of some pairs of a tile."""
    if len(rows) > FEW * len(l_rows) * len(r_rows):
        return (a[l_rows] @ b[r_rows].T)[rows, cols]
    out = np.empty(len(rows))
    for at in range(0, len(rows), AT_ONCE):
        part = slice(at, at + AT_ONCE)
        out[part] = np.einsum("ij,ij->i", a[l_rows[rows[part]]], b[r_rows[cols[part]]])
    return out


def _at_least(a: np.ndarray, b: np.ndarray, tiles, least: float):
    """Per tile (its rows, its columns, rows and cols in it, score) of the pairs with a score of ``least`` or more.

    A product in single precision leaves few pairs to be scored in double.
    """
    a_single, b_single, below = a.astype(np.float32), b.astype(np.float32), np.float32(least - 2 * _margin(a))
    for l_rows, r_rows in tiles:
        found = np.flatnonzero(a_single[l_rows] @ b_single[r_rows].T >= below)
        rows, cols = np.divmod(found, len(r_rows))
        scores = _exact(a, b, l_rows, r_rows, rows, cols)
        hit = scores >= least
        yield l_rows, r_rows, rows[hit], cols[hit], scores[hit]


def _top_kernel(k: int, min_score: float | None):
    def best(a, b, l_rows, r_rows, width):
        scores = a[l_rows] @ b[r_rows].T
        cutoff = np.partition(scores, scores.shape[1] - width, axis=1)[:, scores.shape[1] - width]
        if min_score is not None:
            cutoff = np.maximum(cutoff, min_score - SLACK)
        rows, cols = np.nonzero(scores >= cutoff[:, None])
        return rows, cols, scores[rows, cols]

    def kernel(left, right, a, b, tiles) -> pd.DataFrame:
        l_rep, r_rep = left["rep"].to_numpy(), right["rep"].to_numpy()
        found = [(l_rep[:0], r_rep[:0], np.zeros(0))]
        a_single, b_single = a.astype(np.float32), b.astype(np.float32)
        for l_rows, r_rows in tiles:
            width, few = min(k, len(r_rows)), None
            if min_score is not None:
                # where few pairs reach the score there is no need to rank the others
                below = np.float32(min_score - SLACK - 2 * _margin(a))
                few = np.flatnonzero(a_single[l_rows] @ b_single[r_rows].T >= below)
            if few is None or len(few) > FEW * len(l_rows) * len(r_rows):
                rows, cols, scores = best(a, b, l_rows, r_rows, width)
            else:
                rows, cols = np.divmod(few, len(r_rows))
                scores = _exact(a, b, l_rows, r_rows, rows, cols)
                hit = scores >= min_score - SLACK
                rows, cols, scores = rows[hit], cols[hit], scores[hit]
            reps = r_rep[r_rows]
            order = np.lexsort((reps[cols], -scores, rows))
            rows, cols, scores = rows[order], cols[order], scores[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            near = place < width
            found.append((l_rep[l_rows[rows[near]]], reps[cols[near]], scores[near]))
        return pd.DataFrame(dict(zip(("q_rep", "i_rep", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    return kernel


def nearest_neighbours(
    queries: DataFrame,
    index: DataFrame,
    k: int = s.DEFAULTS.vector_top_k,
    min_score: float | None = None,
) -> DataFrame:
    """(query_id, neighbour_id, score, place): the ``k`` best by cosine, never the query itself.

    Inputs have ``id`` (long) and ``vector``; ties go to the smaller id. With ``min_score``
    lower scores are left out, which also narrows the search. Vectors without a direction
    (all zero) take no part.
    """
    more = k + 1
    q_reps = cut(distinct_vectors(queries))
    # Of equal index vectors only the k + 1 smallest ids can ever be among the answers; the others stay where they are.
    copies = cut(_first_copies(index, more))
    i_reps = cut(
        copies.where("copy = 1").select("rep", unit_vector(F.col("vector")).alias("point"), F.lit(1.0).alias("size"))
    )
    blocks = block_join(
        q_reps.select("rep", "point", "size"),
        i_reps.select("rep", "point", "size"),
        chord,
        _top_reach(more, min_score),
        _top_kernel(more, min_score),
        "q_rep long, i_rep long, score double",
        more,
    )
    ranked = blocks.selectExpr(
        "*", "row_number() OVER (PARTITION BY q_rep ORDER BY score DESC, i_rep) AS place"
    ).where(F.col("place") <= more)
    shortlist = (
        ranked.drop("place")
        .join(copies.select(F.col("rep").alias("i_rep"), "id"), "i_rep")
        .selectExpr("q_rep", "id", "score", "row_number() OVER (PARTITION BY q_rep ORDER BY score DESC, id) AS place")
        .where(F.col("place") <= more)
        .groupBy("q_rep")
        .agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("best"))
    )
    hashed = vector_hash(F.col("vector")).alias("hash")
    members = queries.select(F.col("id").alias("query_id"), "vector", hashed).join(
        q_reps.select("vector", hashed, F.col("rep").alias("q_rep")), ["hash", "vector"]
    )
    others = F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k)
    return (
        members.join(shortlist, "q_rep")
        .select("query_id", F.posexplode(others).alias("pos", "hit"))
        .select("query_id", F.col("hit.id").alias("neighbour_id"), "hit.score", (F.col("pos") + 1).alias("place"))
    )


def _pair_kernel(min_score: float):
    def kernel(left, right, a, b, tiles):
        l_rep, r_rep = left["rep"].to_numpy(), right["rep"].to_numpy()
        for l_rows, r_rows, rows, cols, scores in _at_least(a, b, tiles, min_score - SLACK):
            yield pd.DataFrame({"l_rep": l_rep[l_rows[rows]], "r_rep": r_rep[r_rows[cols]], "score": scores})

    return kernel


def similar_vectors(left: DataFrame, right: DataFrame, min_score: float) -> DataFrame:
    """(l_rep, r_rep, score) of the distinct vectors of both sides, as ``distinct_vectors`` names them, at ``min_score`` or more."""
    columns = ["rep", "point", "size"]
    found = block_join(
        left.select(*columns), right.select(*columns), chord, _score_reach(min_score), _pair_kernel(min_score),
        "l_rep long, r_rep long, score double",
    )
    return found.withColumn("score", F.least("score", F.lit(1.0)))


def _agreement(left: pd.DataFrame, right: pd.DataFrame):
    """Whether the model label of one of a pair is the category of the other, by their rows in both blocks."""
    labels = pd.concat([left["category"], right["category"], left["llm_category"], right["llm_category"]])
    codes = pd.factorize(labels.where(labels != s.UNSURE))[0].astype(np.int32)
    n, m = len(left), len(right)
    l_cat, r_cat = codes[:n], codes[n : n + m]
    l_llm, r_llm = codes[n + m : 2 * n + m], codes[2 * n + m :]

    def agree(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        one, other = l_llm[rows], r_llm[cols]
        return ((one == r_cat[cols]) & (one >= 0)) | ((other == l_cat[rows]) & (other >= 0))

    return agree


def _partner_kernel(threshold: float, boost: float):
    """Pairs at the threshold, also those that rounding may have put below it."""

    def kernel(left, right, a, b, tiles):
        agree, least = _agreement(left, right), threshold - ROUNDING
        l_rep, r_rep = left["rep"].to_numpy(), right["rep"].to_numpy()
        l_n, r_n = left["members"].to_numpy(), right["members"].to_numpy()
        same = left["q_block"].iat[0] == left["i_block"].iat[0]
        for l_rows, r_rows, rows, cols, scores in _at_least(a, b, tiles, least - boost):
            rows, cols = l_rows[rows], r_rows[cols]
            agrees = agree(rows, cols)
            scores = np.where(agrees, np.minimum(1.0, scores + boost), scores)
            hit = (scores >= least) & (l_rep[rows] < r_rep[cols] if same else l_rep[rows] != r_rep[cols])
            rows, cols = rows[hit], cols[hit]
            yield pd.DataFrame(
                {"one": l_rep[rows], "other": r_rep[cols], "score": scores[hit], "agrees": agrees[hit], "one_n": l_n[rows], "other_n": r_n[cols]}
            )

    return kernel


def _unite(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``root`` (per node the smallest node that it is known to be linked with) after the links of ``x`` and ``y``."""
    while True:
        x, y = root[x], root[y]
        apart = x != y
        if not apart.any():
            return root
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up


def _link_kernel(threshold: float, boost: float):
    """Links that connect what the pairs of both blocks connect; pairs that rounding may have put on either side are told as they are."""

    def kernel(left, right, a, b, tiles) -> pd.DataFrame:
        agree, margin = _agreement(left, right), 2 * _margin(a)
        a_single, b_single = a.astype(np.float32), b.astype(np.float32)
        nodes, at = np.unique(np.concatenate([left["rep"], right["rep"]]).astype(np.int64), return_inverse=True)
        l_at, r_at = at[: len(left)], at[len(left) :]
        root = np.arange(len(nodes))
        open_one, open_other, open_agrees = [nodes[:0]], [nodes[:0]], [np.zeros(0, bool)]
        for l_rows, r_rows in tiles:
            single = a_single[l_rows] @ b_single[r_rows].T
            found = np.flatnonzero(single >= np.float32(threshold - boost - margin))
            score = single.ravel()[found].astype(np.float64)
            rows, cols = np.divmod(found, len(r_rows))
            # a pair that links nothing new needs no more thought
            fresh = root[l_at[l_rows[rows]]] != root[r_at[r_rows[cols]]]
            rows, cols, score = rows[fresh], cols[fresh], score[fresh]
            agrees = agree(l_rows[rows], r_rows[cols])
            score = np.where(agrees, np.minimum(1.0, score + boost), score)
            close = np.flatnonzero(np.abs(score - threshold) <= margin)
            if len(close):
                exact = _exact(a, b, l_rows, r_rows, rows[close], cols[close])
                score[close] = np.where(agrees[close], np.minimum(1.0, exact + boost), exact)
            one, other = l_at[l_rows[rows]], r_at[r_rows[cols]]
            sure = score > threshold + ROUNDING
            root = _unite(root, one[sure], other[sure])
            unsure = np.abs(score - threshold) <= ROUNDING
            open_one.append(nodes[one[unsure]])
            open_other.append(nodes[other[unsure]])
            open_agrees.append(agrees[unsure])
        moved = nodes != nodes[root]
        sure = pd.DataFrame({"a": nodes[moved], "b": nodes[root[moved]], "sure": True, "agrees": False})
        unsure = {"a": np.concatenate(open_one), "b": np.concatenate(open_other), "sure": False, "agrees": np.concatenate(open_agrees)}
        return pd.concat([sure, pd.DataFrame(unsure)])

    return kernel


def _labelled_reps(groups: DataFrame) -> DataFrame:
    """Distinct vectors and labels; ``usable`` are those with an id that have a direction in every component."""
    reps = distinct_vectors(groups, ["category", "llm_category"])
    number = F.forall("point", lambda x: x.isNotNull() & ~F.isnan(x))
    return cut(reps.withColumn("usable", F.col("rep").isNotNull() & number))


REP_COLUMNS = ("rep", "members", "point", "size", "category", "llm_category")


def _dot(a: str, b: str) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def _settled(pairs: DataFrame, one: str, other: str, reps: DataFrame, threshold: float, boost: float) -> DataFrame:
    """Those of the ``pairs`` (names of two vectors, ``agrees``) whose vectors themselves, not divided by their lengths, meet the threshold."""
    vectors = reps.select("rep", "vector")
    joined = pairs.join(vectors.toDF(one, "u"), one).join(vectors.toDF(other, "v"), other)
    cosine = F.least(F.lit(1.0), _dot("u", "v") / F.sqrt(_dot("u", "u") * _dot("v", "v")))
    score = F.when(F.col("agrees"), F.least(F.lit(1.0), cosine + F.lit(boost))).otherwise(cosine)
    return joined.withColumn("score", score).where(F.col("score") >= threshold).drop("u", "v")


def similar_partners(
    groups: DataFrame, threshold: float = s.DEFAULTS.vector_threshold, boost: float = s.DEFAULTS.llm_boost
) -> DataFrame:
    """(id, n_similar, best_score, partner, score): a row for each group at or above the threshold from a group, with their number
    and the best of their scores; one row without a partner for a group that has none.

    ``groups``: id, vector, category, llm_category. A model label that equals the other's category raises the score. Pairs grow
    quadratically: they are found once per pair of distinct vectors and labels, leave a task by the tile, and are told for the ids of
    either side by bounded numbers of them at a time.
    """
    same = ["vector", "category", "llm_category"]
    reps = _labelled_reps(groups)
    points = reps.where("usable").select(*REP_COLUMNS)
    found = cut(
        block_join(
            points, points, chord, _score_reach(threshold - boost), _partner_kernel(threshold, boost),
            "one long, other long, score double, agrees boolean, one_n long, other_n long", pairs="half",
        )
    )
    pairs, open_pairs = (found.where(f"{sign} (score <= {threshold + ROUNDING!r})") for sign in ("NOT", ""))
    if not open_pairs.isEmpty():
        pairs = pairs.unionByName(_settled(open_pairs, "one", "other", reps, threshold, boost))
    either = [f"named_struct('rep', {a}, 'near', {b}, 'score', score, 'own_n', {a}_n, 'near_n', {b}_n)" for a, b in (("one", "other"), ("other", "one"))]
    near = pairs.selectExpr(f"inline(array({', '.join(either)}))")
    twins = reps.where("members > 1").selectExpr("rep", "rep AS near", "1.0D AS score", "members AS own_n", "members AS near_n")
    near = near.withColumn("score", F.least("score", F.lit(1.0))).unionByName(twins)
    weight = F.sum(F.col("near_n") - (F.col("rep") == F.col("near")).cast("long"))
    counted = near.groupBy("rep").agg(weight.alias("n_similar"), F.max("score").alias("best_score"))

    # the ids of a vector in parts of bounded size, so that many copies of it meet in many tasks
    parts = f"CAST(ceil({{}} / {COPIES_AT_ONCE}D) AS INT)"
    named = reps.select("rep", "members", vector_hash(F.col("vector")).alias("hash"), *[F.col(c).alias(f"of_{c}") for c in same])
    own = groups.select("id", *same).withColumn("own_hash", vector_hash(F.col("vector")))
    is_named = (F.col("own_hash") == F.col("hash")) & (F.col("vector") == F.col("of_vector"))
    for label in same[1:]:
        is_named &= F.col(label).eqNullSafe(F.col(f"of_{label}"))
    own = unsent(own).join(named, is_named).join(unsent(counted), "rep", "left").withColumn("row", F.monotonically_increasing_id())
    own = cut(own.selectExpr("rep", "id", "row", f"pmod(xxhash64(row), {parts.format('members')}) AS part", "coalesce(n_similar, 0L) AS n_similar", "best_score"))
    asks = near.selectExpr("rep", "near", "score", f"explode(sequence(0, {parts.format('own_n')} - 1)) AS part", "near_n")
    asks = asks.selectExpr("rep", "near", "score", "part", f"explode(sequence(0, {parts.format('near_n')} - 1)) AS near_part")
    their = own.selectExpr("rep AS near", "part AS near_part", "id AS partner", "row AS near_row")
    listed = asks.join(own, ["rep", "part"]).join(their, ["near", "near_part"]).where("row <> near_row")
    columns = ["id", "n_similar", "best_score", "partner", "score"]
    alone = own.where("n_similar = 0").withColumns({"partner": F.lit(None).cast("long"), "score": F.lit(None).cast("double")})
    return listed.select(*columns).unionByName(alone.select(*columns))


def similar_links(
    groups: DataFrame, threshold: float = s.DEFAULTS.vector_threshold, boost: float = s.DEFAULTS.llm_boost
) -> DataFrame:
    """(a, b): links that connect exactly the groups which a chain of similar pairs connects.

    Many vectors are compared with those of their own block and with a few of all first. Two that this connects need not be
    compared, so what is left is to compare the vectors outside of the largest component with all others.
    """
    same = ["vector", "category", "llm_category"]
    reps = _labelled_reps(groups)
    points = reps.where("usable").select(*REP_COLUMNS)

    def linked(some: DataFrame, others: DataFrame, pairs: str) -> DataFrame:
        found = cut(
            block_join(
                some, others, chord, _score_reach(threshold - boost), _link_kernel(threshold, boost),
                "a long, b long, sure boolean, agrees boolean", pairs=pairs,
            )
        )
        links, open_links = found.where("sure"), found.where("NOT sure")
        if not open_links.isEmpty():
            links = links.unionByName(_settled(open_links, "a", "b", reps, threshold, boost).select(found.columns))
        return links.select("a", "b")

    n = points.count()
    if n <= blocks.SMALL_BLOCK_ROWS * blocks.BLOCKS_PER_SIDE:
        across = linked(points, points, "half")
    else:
        few = cut(points.orderBy(F.xxhash64("rep"), "rep").limit(blocks.SMALL_BLOCK_ROWS))
        first = connected_components(linked(points, points, "own").unionByName(linked(few, points, "all")))
        largest = first.groupBy("component").count().orderBy(F.desc("count"), "component").first()
        inside = first.where(F.col("component") == (largest["component"] if largest else None))
        outside = cut(points.join(inside.select(F.col("node").alias("rep")), "rep", "left_anti"))
        across = linked(outside, points, "all") if 2 * outside.count() < n else linked(points, points, "half")
        across = across.unionByName(first.select(F.col("node").alias("a"), F.col("component").alias("b")))
    hashed = vector_hash(F.col("vector")).alias("hash")
    within = (
        unsent(groups.select("id", *same, hashed)).join(reps.select(*same, "rep", hashed), ["hash", *same])
        .where(F.col("id") != F.col("rep")).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    )
    return across.unionByName(within).distinct()
