"""NB-SVM: held-out accuracy, the optimum of the dual, and the odd rows."""

import random
import zlib

import numpy as np
import pyarrow as pa

from ledgerloom.llm import quality_nbsvm as nb


def prose(rng, n, junk):
    words = ["".join(rng.choice(["an", "er", "th", "on", "re", "ing"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    if junk == 1:
        words = [w + rng.choice(["###", "%%%", ""]) for w in words]
    if junk == 2:
        words = [w.upper() + "!!" for w in words]
    if junk == 3:
        words = [words[0]] * n
    return " ".join(words)


def labelled(seed, n):
    rng = random.Random(seed)
    return [(i, prose(rng, rng.randint(20, 200), (i % 4 == 0) * rng.randint(1, 3)), int(i % 4 != 0)) for i in range(n)]


def test_held_out_accuracy(spark):
    rows = labelled(1, 800)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string").repartition(4)
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows], "doc_id long, quality int, text int")
    found = {r.doc_id: r for r in nb.classify(docs, labels).collect()}
    assert {i: r.held_out for i, r in found.items()} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in rows}
    held = [(found[i], y) for i, _, y in rows if found[i].held_out]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found.values())
    assert sum(r.predicted == y for r, y in held) >= 0.97 * len(held)


def test_held_out_accuracy_on_the_given_tables(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = {r.doc_id: r for r in nb.classify(docs, labels).collect()}
    held = [(found[r.doc_id], r.quality) for r in labels.collect() if found[r.doc_id].held_out]
    assert sum(r.predicted == y for r, y in held) >= 0.95 * len(held)


def test_dual_coordinate_descent_finds_the_optimum():
    rng = np.random.default_rng(2)
    rows = [np.flatnonzero(rng.random(30) < 0.3).astype(np.uint32) for _ in range(120)]
    y = np.where(np.array([5 in r for r in rows]) ^ (rng.random(120) < 0.1), 1.0, -1.0)
    ratio = rng.normal(size=30)
    x = np.zeros((120, 31))
    for i, row in enumerate(rows):
        x[i, row] = ratio[row] / max(1e-9, np.sqrt((ratio[row] ** 2).sum()))
    x[:, 30] = 1

    def loss(w):
        return w @ w / 2 + nb.C * np.maximum(0, 1 - y * (x @ w)).sum()

    weights = nb.descend(rows, y, ratio, 1)
    least = loss(weights)
    assert all(loss(weights + rng.normal(scale=s, size=31)) > least - 0.05 for s in (1e-3, 1e-2, 0.1) for _ in range(200))
    grams = np.concatenate(rows)
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    assert np.allclose(nb.margins(grams, bounds, ratio, weights), x @ weights)


def test_nulls_repeats_long_texts_and_few_labels(spark):
    rows = labelled(2, 60)
    odd = [(100, None), (101, ""), (101, ""), (None, "a b"), (102, "x" * 300_000), (103, "word " * 60_000)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + odd, "doc_id long, text string")
    more = [(100, 1), (None, 0), (101, None), (102, 0), (102, 1), (104, 7)]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + more, "doc_id long, quality int")
    found = nb.classify(docs, labels).collect()
    assert len(found) == len(rows) + len(odd)
    assert len({r.score for r in found if r.doc_id in (100, 101)}) == 1
    assert all(r.held_out is not None and 0 <= r.score <= 1 for r in found)


def test_one_label_or_none_gives_the_share(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    for label, expected in ((1, 1.0), (0, 0.0)):
        labels = spark.createDataFrame([(2, label), (1, label)], "doc_id long, quality int")
        assert {r.score for r in nb.classify(docs, labels).collect()} == {expected}
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in nb.classify(docs, none).collect()} == {0.0}
    assert nb.classify(spark.createDataFrame([], "doc_id long, text string"), none).collect() == []


def test_ngrams_are_those_of_each_text_alone():
    texts = ["One two  two\nthree", "", None, "É!! ÉÉ!! a9", "one TWO two three", "w"]
    together, bounds = nb.ngrams(pa.array(texts))
    for i, text in enumerate(texts):
        alone, _ = nb.ngrams(pa.array([text], pa.string()))
        assert (together[bounds[i] : bounds[i + 1]] == alone).all() and (np.diff(alone.astype(int)) > 0).all()
    # words are lower-cased, shapes are not
    a, b = (set(together[bounds[i] : bounds[i + 1]].tolist()) for i in (0, 4))
    assert a != b and len(a & b) >= 7
