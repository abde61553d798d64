"""NN-descent against all cosines."""

import numpy as np
import pytest

from ledgerloom.llm import nn_descent


def brute(rows, threshold):
    """(n_links, component) per row."""
    n = len(rows)
    ok = [
        i is not None and label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        for i, v, label in rows
    ]
    link = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(n):
            if a != b and ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], float) / np.abs(rows[k][1]).max() for k in (a, b))
                link[a, b] = x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold
    component = [rows[a][0] for a in range(n)]
    for _ in range(n):
        new = [min([component[a], *[component[b] for b in np.flatnonzero(link[a])]]) if link[a].any() else component[a] for a in range(n)]
        if new == component:
            break
        component = new
    return link.sum(axis=1), component


@pytest.mark.parametrize("seed", [1])
def test_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    rows, i = [], 10
    for label in (0, 1, 2):
        for size in (1, 1, 1, 2, 3, 12, 90 if label == 1 else 5):
            center = rng.standard_normal(16)
            for _ in range(size):
                rows.append((i, [float(x) for x in center + rng.standard_normal(16) * 0.07], label))
                i += 1
        rows += [(i + k, [float(x) for x in rng.standard_normal(16)], label) for k in range(40)]
        i += 40
    rows += [(i, rows[3][1], 0), (i + 1, rows[3][1], 0), (i + 1, rows[3][1], 0), (i + 2, rows[3][1], 1), (i + 3, rows[3][1], None)]
    rows += [(i + 4, [x * 1e-30 for x in rows[3][1]], 0), (i + 5, rows[3][1][:8], 0), (i + 6, rows[3][1][:8], 0)]
    rows += [(i + 7, None, 0), (i + 8, [], 0), (i + 9, [0.0] * 16, 0), (i + 10, [float("nan")] + [1.0] * 15, 0)]
    rows += [(i + 11, [None] + [1.0] * 15, 0), (i + 12, [float("inf")] + [1.0] * 15, 0)]
    table = spark.createDataFrame([(*r, 0, "n") for r in rows], "vec_id long, embedding array<double>, label int, node int, space string")
    found = nn_descent.near_duplicates(table.repartition(3)).collect()
    links, components = brute(rows, 0.98)
    expected = sorted((r[0], int(n), c, r[0] == c) for r, n, c in zip(rows, links, components, strict=True))
    assert sorted(tuple(r) for r in found) == expected


def test_missing_ids_and_empty_tables(spark):
    kinds = "vec_id long, embedding array<float>, label int"
    table = spark.createDataFrame([(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1)], kinds)
    found = {r.vec_id: tuple(r)[1:] for r in nn_descent.near_duplicates(table).collect()}
    assert found == {None: (0, None, True), 1: (1, 1, True), 2: (1, 1, False)}
    assert nn_descent.near_duplicates(spark.createDataFrame([], kinds)).collect() == []


def test_blocks_of_a_large_component_count_like_one(spark, monkeypatch):
    rng = np.random.default_rng(2)
    center = rng.standard_normal(8)
    rows = [(i, (center + rng.standard_normal(8) * 0.1).tolist(), 0) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    _, classes = nn_descent._classes(table)
    components = classes.selectExpr("node", "cast(1 as long) as component")
    whole = sorted(tuple(r) for r in nn_descent._linked(classes, components, 0.98).collect())
    monkeypatch.setattr(nn_descent, "BLOCK", 7)
    parts = sorted(tuple(r) for r in nn_descent._linked(classes, components, 0.98).collect())
    links, _ = brute(rows, 0.98)
    assert whole == parts and sorted(n for _, n in whole) == sorted(links)


def test_tight_groups_whose_lists_are_full_are_linked(spark):
    rng = np.random.default_rng(4)
    rows = []
    for label, sizes in ((0, (12, 12)), (1, (150, 90, 20))):
        start = np.zeros(16)
        start[0] = 1.0
        for group, size in enumerate(sizes):
            center = start.copy()
            center[1 + group] = 0.17 if group else 0.0
            for _ in range(size):
                rows.append((len(rows), (center + rng.standard_normal(16) * 0.002).tolist(), label))
        rows += [(len(rows) + k, rng.standard_normal(16).tolist(), label) for k in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    links, components = brute(rows, 0.98)
    x = np.array([r[1] for r in rows[:24]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert (np.argsort(-(x @ x.T), axis=1)[:12, : nn_descent.LIST + 1] < 12).all() and components[12] == 0
    found = nn_descent.near_duplicates(table.repartition(3)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == [
        (r[0], int(n), c) for r, n, c in zip(rows, links, components, strict=True)
    ]


def _audited(spark, rows, lost):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    nodes, classes = nn_descent._classes(table)
    links, _ = brute(rows, 0.98)
    known = spark.createDataFrame([(r[0], 0 if r[0] in lost else int(n)) for r, n in zip(rows, links, strict=True)], "vec_id long, links long")
    return nn_descent.audit(classes, nodes.join(known, "vec_id").select("node", "links"), 0.98)


def test_audit_counts_a_lost_pair_like_a_member_of_a_hot_group(spark):
    rng = np.random.default_rng(6)
    center = rng.standard_normal(16)
    rows = [(i, (center + rng.standard_normal(16) * 0.01).tolist(), 0) for i in range(100)]
    for i in range(100, 120, 2):
        center = rng.standard_normal(16)
        rows += [(i + k, (center + rng.standard_normal(16) * 0.01).tolist(), 0) for k in range(2)]
    assert _audited(spark, rows, set()) == 1
    assert _audited(spark, rows, set(range(100, 120))) == pytest.approx(100 / 120)


def test_audit_goes_on_until_it_sees_links(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "DRAWN", 50)
    rng = np.random.default_rng(7)
    rows = [(i, rng.standard_normal(16).tolist(), 0) for i in range(600)]
    rows += [(600 + i, (np.array(rows[i][1]) + 0.001).tolist(), 0) for i in range(2)]
    assert _audited(spark, rows, {0, 1, 600, 601}) == 0
    assert _audited(spark, rows, set()) == 1
