"""Block joins and group look-ups against brute force, with hot groups and forced splits."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.indel import lcs_lengths
from ledgerloom.operators import blocks, components, neighbours, rangefirst, training
from ledgerloom.operators.rangefirst import first_in_range
from ledgerloom.operators.textjoin import similar_texts


@pytest.fixture()
def small_blocks(monkeypatch):
    """Many cells and many parts even for a few hundred points."""
    monkeypatch.setattr(blocks, "ROWS_PER_PIVOT", 12)
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 9)


def texts(seed, n):
    rng = random.Random(seed)
    stems = ["ACME PTE LTD", "NORTH STAR COFFEE", "GREEN GROCER 24H", "é CAFÉ ROYAL", "X", "", "RAIL & BUS CARD TOPUP"]
    out = set()
    while len(out) < n:
        chars = list(rng.choice(stems))
        for _ in range(rng.randint(0, 4)):
            where = rng.randint(0, len(chars))
            if chars and rng.random() < 0.5:
                chars.pop(min(where, len(chars) - 1))
            else:
                chars.insert(where, rng.choice("ABC 1é"))
        out.add("".join(chars))
    return sorted(out)


@pytest.mark.parametrize(("threshold", "least"), [(85, 500), (97, 25), (60, 2000), (100, 10), (30, 4000)])
def test_similar_texts_equals_all_pairs(spark, threshold, least):
    left, right = [*texts(1, 150), "😀" * 9, "😀" * 8 + "a", "ab", "a"], [*texts(2, 120), "😀" * 9 + "b", "b", "abc" * 30, "abc" * 29 + "x"]
    got = similar_texts(
        spark.createDataFrame([(t,) for t in [*left, None, left[0]]], "key string"),
        spark.createDataFrame([(t,) for t in [None, *right]], "key string"),
        threshold,
    ).collect()
    a, b = [x for x in left for _ in right], right * len(left)
    want = {
        (x, y)
        for x, y, n in zip(a, b, lcs_lengths(a, b), strict=True)
        if 200 * n >= threshold * (len(x) + len(y))
    }
    assert len(want) > least
    assert {(r["left_key"], r["right_key"]) for r in got} == want
    assert len(got) == len(want)


def test_one_edit_spoils_one_segment_at_most():
    """The grid of the longer text has over D segments, one of them whole within the places asked for."""
    rng = random.Random(8)
    for threshold in (30, 60, 85, 97):
        for _ in range(300):
            b = "".join(rng.choice("abc") for _ in range(rng.randint(1, 40)))
            a = list(b)
            for _ in range(rng.randint(0, 6)):
                a.insert(rng.randrange(len(a) + 1), rng.choice("abc")) if rng.random() < 0.6 or not a else a.pop(rng.randrange(len(a)))
            a, b = sorted(("".join(a), b), key=len, reverse=True)
            edits = (100 - threshold) * (len(a) + len(b)) // 100
            if len(a) + len(b) - 2 * lcs_lengths([a], [b])[0] > edits:
                continue
            q = len(a) // ((100 - threshold) * 2 * len(a) // 100 + 1)
            gap = len(a) - len(b)
            hits = [
                (p, p + d) for p in range(0, len(a) - q + 1, q or 1) for d in range(-len(a), len(b) + 1)
                if q and 0 <= p + d <= len(b) - q and abs(d) + abs(gap + d) <= edits and a[p : p + q] == b[p + d : p + d + q]
            ]
            assert hits or not q


def test_candidates_do_not_grow_with_the_register(spark):
    """More rows of the same merchants, ten times and ten times again, make no more candidates a text."""
    from ledgerloom.catalog.inputs import ledger
    from ledgerloom.operators import textjoin
    from ledgerloom.operators.similarity import match_key

    shares = []
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        keys = textjoin._texts(ledger(spark, f"/root/testdata/{sf}").select(match_key(F.col("description")).alias("key")))
        n = keys.count()
        found = textjoin.candidates(keys, keys, 85).count()
        assert found < 0.15 * n * n
        shares.append(found / n)
    assert max(shares) < 1.4 * min(shares)


def test_texts_unlike_the_register_make_no_entries(spark):
    """Entries of the larger side are left out where the smaller side has none."""
    from ledgerloom.operators import textjoin

    few = textjoin._texts(spark.createDataFrame([("NORTH STAR COFFEE #1000",), ("GREEN GROCER #1000",)], "key string"))
    rows = [(f"{i:07d} " + "".join(chr(192 + i * 7 % 50 + k) for k in range(20)),) for i in range(500)] + [("GREEN GROCER #100123",)]
    many = textjoin._texts(spark.createDataFrame(rows, "key string"))
    for longer in (True, False):
        flags = textjoin._flags(textjoin._entries(few, 85, not longer))
        kept = textjoin._entries(many, 85, longer, flags)
        assert kept.where("key like 'GREEN%'").count() and kept.where("key not like 'GREEN%'").count() < 50
    assert [(r.left_key, r.right_key) for r in similar_texts(many, few).collect()] == [("GREEN GROCER #100123", "GREEN GROCER #1000")]


def test_similar_texts_of_long_texts(spark):
    base = "lorem ipsum dolor sit amet " * 12
    near, far = base[:-20] + "changed a little", base[::-1]
    frame = spark.createDataFrame([(base,), (near,), (far,)], "key string")
    found = {(r["left_key"], r["right_key"]) for r in similar_texts(frame, frame).collect()}
    assert (base, near) in found and (base, base) in found and (base, far) not in found


@pytest.mark.parametrize("head", [1, 8])
def test_first_in_range_equals_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(rangefirst, "HEAD", head)
    rng = random.Random(head)
    # One key holds most items, some amounts repeat.
    items = [(("hot" if i % 3 else "cold"), rng.choice([5, 700, 700, rng.randint(1, 10**7)]), i) for i in range(600)]
    queries = []
    for q in range(300):
        middle = rng.randint(1, 10**7)
        queries.append((q, rng.choice(["hot", "cold", "none"]), max(0, middle // 4 - 3), middle * 4))
    got = first_in_range(
        spark.createDataFrame(queries, "q int, k string, low bigint, high bigint"),
        spark.createDataFrame(items, "k string, cents bigint, id int").withColumn("reach", F.col("cents") * 16 + 100),
        ["k"], "id", [],
    )
    want = {}
    for q, key, low, high in queries:
        hits = [i for k, c, i in items if k == key and low <= c <= high]
        if hits:
            want[q] = min(hits)
    rows = got.collect()
    assert {r["q"]: r["item"]["order"] for r in rows} == want
    assert len(rows) == len(want)


def vectors(seed, n, copies):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 5))
    rows = [centres[i % 6] + 0.3 * rng.normal(size=5) for i in range(n)]
    rows += [rows[0]] * copies
    return [(i, [float(x) for x in v]) for i, v in enumerate(rows)]


def cosine(rows):
    m = np.array([v for _, v in rows], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return m @ m.T


@pytest.mark.parametrize("min_score", [None, 0.9])
def test_nearest_neighbours_equal_brute_force(spark, small_blocks, min_score):
    rows = vectors(7, 160, 80)
    frame = spark.createDataFrame(rows, "id bigint, vector array<double>")
    got = {}
    for r in neighbours.nearest_neighbours(frame, frame, 5, min_score).collect():
        got.setdefault(r["query_id"], []).append((r["place"], r["neighbour_id"], r["score"]))
    scores = cosine(rows).round(9)
    for q in range(len(rows)):
        order = sorted((j for j in range(len(rows)) if j != q), key=lambda j: (-scores[q, j], j))
        want = [j for j in order if min_score is None or scores[q, j] >= min_score][:5]
        assert [n for _, n, _ in sorted(got.get(q, []))] == want


def test_partners_and_links_equal_brute_force(spark, small_blocks):
    rng = np.random.default_rng(11)
    rows = [
        (i, v, f"c{rng.integers(3)}", ["UNSURE", "c0", "c1"][rng.integers(3)]) for i, v in vectors(9, 120, 30)
    ]
    frame = spark.createDataFrame(rows, "id bigint, vector array<double>, category string, llm_category string")
    scores = cosine([(i, v) for i, v, *_ in rows])
    n = len(rows)
    near = [[False] * n for _ in range(n)]
    for a in range(n):
        for b in range(n):
            same = (rows[a][3] != "UNSURE" and rows[a][3] == rows[b][2]) or (
                rows[b][3] != "UNSURE" and rows[b][3] == rows[a][2]
            )
            near[a][b] = a != b and min(1.0, scores[a, b] + (0.05 if same else 0.0)) >= 0.97 - 1e-12
    partners = {r["id"]: r["n_similar"] for r in neighbours.similar_partners(frame, 0.97).collect()}
    assert partners == {a: sum(near[a]) for a in range(n)}
    label = list(range(n))
    for _ in range(n):
        for a in range(n):
            for b in range(n):
                if near[a][b]:
                    label[a] = label[b] = min(label[a], label[b])
    found = {r["node"]: r["component"] for r in components.connected_components(neighbours.similar_links(frame, 0.97)).collect()}
    assert found == {a: label[a] for a in range(n) if any(near[a])}


def test_components_of_a_long_chain_and_a_hot_node(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1001 + i) for i in range(300)]
    links = spark.createDataFrame(chain + star + [(5000, 5000)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components.connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, **{1001 + i: 1000 for i in range(300)}}


def test_kth_smallest_narrows_without_ordering_everything(spark):
    rng = random.Random(3)
    values = [rng.choice([7, 7, 7, rng.randint(0, 10**6)]) for _ in range(3000)]
    frame = spark.createDataFrame([(v,) for v in values], "v bigint")
    for k in (1, 1500, 2999, 3000):
        assert training.kth_smallest(frame, "v", k) == sorted(values)[k - 1]
    texts_frame = frame.select(F.format_string("%09d", "v").alias("v"))
    assert training.kth_smallest(texts_frame, "v", 2000) == f"{sorted(values)[1999]:09d}"
    with pytest.raises(ValueError):
        training.kth_smallest(frame, "v", 3001)


def test_points_travel_once_per_block_not_once_per_cell(spark, monkeypatch):
    """Unlike points are out of nobody's reach, so every cell meets every other one."""
    monkeypatch.setattr(blocks, "ROWS_PER_PIVOT", 12)
    monkeypatch.setattr(blocks, "SMALL_BLOCK_ROWS", 100)
    rng = np.random.default_rng(5)
    points = [(i, [float(x) for x in v / np.linalg.norm(v)], 1.0) for i, v in enumerate(rng.normal(size=(900, 24)))]
    frame = spark.createDataFrame(points, "rep bigint, point array<double>, size double")

    def kernel(left, right, a, b, tiles):
        return pd.DataFrame({"sent": [len(left) + len(right)], "compared": [sum(len(x) * len(y) for x, y in tiles)]})

    reach = neighbours._score_reach(-1.0)
    tasks = blocks.block_join(frame, frame, neighbours.chord, reach, kernel, "sent long, compared long").collect()
    assert sum(t["compared"] for t in tasks) == 900 * 900
    assert sum(t["sent"] for t in tasks) <= 900 * 4 * blocks.BLOCKS_PER_SIDE


@pytest.mark.parametrize("alike", [False, True])
def test_index_rows_are_sorted_by_the_hash_of_their_vector(spark, monkeypatch, alike):
    if alike:
        monkeypatch.setattr(neighbours, "vector_hash", lambda vector: F.lit(7).cast("long"))
    rng = np.random.default_rng(5)
    kinds = [*rng.normal(size=(5, 3)).tolist(), [0.0, 1.0, 0.5], [-0.0, 1.0, 0.5], [0.0, 0.0, 0.0]]
    rows = [(i, kinds[int(rng.integers(len(kinds)))]) for i in range(200)]
    frame = spark.createDataFrame(rows, "id long, vector array<float>")
    found = neighbours._first_copies(frame, 4)
    windows = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x]
    assert windows and not any("vector#" in x.split("], [")[1] for x in windows)
    want = set()
    for kind in {tuple(k) for k in kinds if any(k)}:
        ids = [i for i, v in rows if tuple(v) == kind]
        want |= {(i, ids[0], n) for n, i in enumerate(ids[:4], 1)}
    assert {(r["id"], r["rep"], r["copy"]) for r in found.collect()} == want


PAIRED = "id bigint, vector array<double>, category string, llm_category string"


def listed(frame, threshold):
    """(id, partner or -1, n_similar)."""
    found = neighbours.similar_partners(frame, threshold).fillna(-1, ["partner"]).collect()
    return sorted((r["id"], r["partner"], r["n_similar"]) for r in found)


def test_all_pairs_are_listed_whatever_their_labels(spark, small_blocks, monkeypatch):
    monkeypatch.setattr(neighbours, "COPIES_AT_ONCE", 4)
    rng = np.random.default_rng(12)
    kinds = [None, "UNSURE", "c0", "c1"]
    rows = [(i, v, kinds[rng.integers(4)], kinds[rng.integers(4)]) for i, v in vectors(9, 120, 30)]
    scores = cosine([(i, v) for i, v, *_ in rows])
    want = []
    for a in range(len(rows)):
        near = []
        for b in range(len(rows)):
            same = any(rows[x][3] not in (None, "UNSURE") and rows[x][3] == rows[y][2] for x, y in ((a, b), (b, a)))
            if a != b and min(1.0, scores[a, b] + (0.05 if same else 0.0)) >= 0.97 - 1e-12:
                near.append(b)
        want += [(a, b, len(near)) for b in near or [-1]]
    assert listed(spark.createDataFrame(rows, PAIRED), 0.97) == sorted(want)


def test_a_pair_at_the_threshold_itself_is_a_pair(spark):
    # cosine 1/2 either time; divided by their lengths first, the vectors come to less
    rows = [(1, [1.0, 0.0, 0.0, 1.0], "a", "a"), (2, [1.0, 1.0, 0.0, 0.0], "b", "b"), (3, [0.0, 0.0, 2.0, 0.0], "b", "b")]
    frame = spark.createDataFrame(rows, PAIRED)
    assert listed(frame, 0.5) == [(1, 2, 1), (2, 1, 1), (3, -1, 0)]
    assert {tuple(sorted(r)) for r in neighbours.similar_links(frame, 0.5).collect()} == {(1, 2)}


def test_a_vector_that_is_no_number_hides_no_pair(spark, small_blocks):
    rows = [(i, v, "c", "UNSURE") for i, v in vectors(9, 120, 0)]
    odd = [(1000, [float("nan"), 1.0, 1.0, 1.0, 1.0], "c", "UNSURE")]
    plain = listed(spark.createDataFrame(rows, PAIRED), 0.97)
    assert listed(spark.createDataFrame(rows + odd, PAIRED), 0.97) == [*plain, (1000, -1, 0)]


def test_links_of_many_vectors_in_two_rounds(spark, small_blocks, monkeypatch):
    monkeypatch.setattr(blocks, "SMALL_BLOCK_ROWS", 20)
    rng = np.random.default_rng(3)
    for spread, share in ((0.02, 1.0), (0.3, 0.0), (0.02, 0.8)):
        dense = rng.random(240) < share
        points = [(np.array([1.0, 0, 0, 0, 0]) if d else rng.normal(size=5)) + spread * rng.normal(size=5) for d in dense]
        rows = [(i, v.tolist(), "c", "UNSURE") for i, v in enumerate(points)]
        near = cosine([(i, v) for i, v, *_ in rows]) >= 0.97
        label = np.arange(len(rows))
        while (now := np.where(near, label[None, :], len(rows)).min(axis=1)).tolist() != label.tolist():
            label = now
        frame = spark.createDataFrame(rows, PAIRED)
        found = {r["node"]: r["component"] for r in components.connected_components(neighbours.similar_links(frame, 0.97)).collect()}
        assert found == {a: label[a] for a in range(len(rows)) if near[a].sum() > 1}


@pytest.mark.parametrize("few", [0.0, 1.0])
def test_the_best_of_a_tile_are_the_same_with_few_and_many_hits(monkeypatch, few):
    monkeypatch.setattr(neighbours, "FEW", few)
    rng = np.random.default_rng(8)
    points = rng.normal(size=(300, 8))
    points = np.concatenate([points, 2 * points[:40]])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    side = pd.DataFrame({"rep": np.arange(len(points))})
    tiles = iter([(np.arange(100), np.arange(340)), (np.arange(100, 340), np.arange(50, 300))])
    found = neighbours._top_kernel(3, 0.8)(side, side, points, points, tiles)
    want = []
    for rows, cols in ((range(100), range(340)), (range(100, 340), range(50, 300))):
        for i in rows:
            near = sorted((-round(float(points[i] @ points[j]), 12), j) for j in cols if points[i] @ points[j] >= 0.8)
            want += [(i, j) for _, j in near[:3]]
    assert sorted(zip(found["q_rep"], found["i_rep"], strict=True)) == sorted(want)
