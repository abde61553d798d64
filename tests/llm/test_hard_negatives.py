"""Hard negatives against integer products in plain Python."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, every=10, scale=256):
    """Sorted result tuples; rows are (vec_id, label, vector)."""
    usable = []
    for i, label, vector in set((i, label, None if v is None else tuple(v)) for i, label, v in rows):
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        q = [math.floor(scale * float(np.float32(x))) for x in vector]
        if all(abs(x) < 1 << hn.MAX_BITS for x in q):
            usable.append((i, label, q))
    out = []
    for i, label, q in usable:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, r, strict=False)), j, other) for j, other, r in usable if j != i)
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            fit = [(t, j) for t, j, other in scored if other != label and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(i, p, k, j, -s, -t) for k, (t, j) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", node int, codes string").repartition(3)
    found = hn.mine(frame, F.col("vec_id") % 10 == 0, **more)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


def clustered(seed, n, dims, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dims))
    rows = []
    for i in range(n):
        x = centres[rng.integers(4)] + 0.4 * rng.normal(size=dims)
        rows.append((i, int(rng.integers(3)), (x / np.linalg.norm(x)).astype(np.float32).tolist()))
    # equal vectors under other ids tie in every score
    rows += [(n + i, int(rng.integers(3)), rows[0][2]) for i in range(copies)]
    return rows


def test_equals_brute_force(spark):
    for seed, dims, copies in ((1, 64, 0), (2, 13, 40)):
        rows = clustered(seed, 220, dims, copies)
        found = mined(spark, rows)
        assert found == brute(rows) and len(found) > 100


def test_many_blocks_and_slices(spark, monkeypatch):
    rows = clustered(3, 300, 20)
    expected = brute(rows)
    for name, value in (("ANCHORS", 7), ("ROWS", 40), ("TASKS", 5), ("SLICE", 2), ("CHUNK", 9)):
        monkeypatch.setattr(hn, name, value)
    assert mined(spark, rows) == expected


def test_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, i % 2, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(40)]
    rows += rows[:12]  # repeated rows count once
    rows += [(20, 1, [0.5] * 5), (7, 0, [0.25] * 5)]  # an id again, with another vector
    rows += [(50, 1, [rng.uniform(-1, 1) for _ in range(11)]), (51, 0, [0.5]), (60, 1, []), (61, 0, [0.0] * 5)]
    rows += [(70, 1, None), (80, None, [0.1] * 5), (None, 1, [0.1] * 5), (90, 1, [0.1, None]), (100, 0, [float("nan")]), (110, 1, [float("inf")])]
    rows += [(120, 1, [1e30] * 5), (130, 0, [700.0, -900.0])]
    rows = [(i, label, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows]
    assert mined(spark, rows) == brute(rows)


def test_empty_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [0.5])]) == []
    assert mined(spark, [(10, 1, [0.5]), (20, 1, None)]) == []


def test_tables_give_products():
    rng = np.random.default_rng(1)
    for dims, most in ((1, 1), (8, 3), (64, 150), (70, 1 << 19)):
        a, b = (rng.integers(-most, most, (n, dims)) for n in (17, 33))
        planes = int(most).bit_length() + 1
        packed = [hn._planes_of(x, planes) for x in (a, b)]
        assert (hn._integers_of(packed[0])[:, :dims] == a).all()
        assert (hn.Tables(packed[0]).scores(packed[1]) == a @ b.T).all()
