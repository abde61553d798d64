"""Compression distances: held-out accuracy on planted words, and the odd rows."""

import random
import zlib

import numpy as np

from ledgerloom.llm import toxicity_zstd as tz

INSULTS = ["grumblefoot", "nastywart", "vilecrumb", "dumbolt"]


def prose(rng, n, insults=0):
    words = ["".join(rng.choice(["an", "er", "th", "on", "re", "ing"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    for _ in range(insults):
        words[rng.randrange(n)] = rng.choice(INSULTS)
    return " ".join(words)


def labelled(seed, n):
    rng = random.Random(seed)
    return [(i, prose(rng, rng.randint(30, 200), rng.randint(2, 6) if i % 5 == 0 else 0), int(i % 5 == 0)) for i in range(n)]


def test_held_out_accuracy(spark):
    rows = labelled(1, 900)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string").repartition(4)
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows], "doc_id long, toxic int, text int")
    found = {r.doc_id: r for r in tz.classify(docs, labels).collect()}
    assert {i: r.held_out for i, r in found.items()} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in rows}
    held = [(found[i].score, y) for i, _, y in rows if found[i].held_out]
    assert all(0 <= s <= 1 for s, _ in held)
    right = sum((s >= 0.5) == bool(y) for s, y in held)
    assert right >= 0.95 * len(held)
    assert all(r.predicted == int(r.score >= 0.5) for r in found.values())


def test_nulls_repeats_long_texts_and_few_labels(spark):
    rows = labelled(2, 40)
    odd = [(100, None), (101, ""), (101, ""), (None, "a b"), (102, "x" * 300_000), (103, "word " * 60_000)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + odd, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(100, 1), (None, 0), (101, None)], "doc_id long, toxic int")
    found = tz.classify(docs, labels).collect()
    assert len(found) == len(rows) + len(odd)
    same = {r.score for r in found if r.doc_id in (100, 101)}
    assert len(same) == 1 and same.pop() < 0.5
    assert all(r.held_out is not None and r.score is not None for r in found)


def test_one_label_or_none_gives_the_share(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    for label, expected in ((1, 1.0), (0, 0.0)):
        labels = spark.createDataFrame([(2, label), (1, label)], "doc_id long, toxic int")
        assert {r.score for r in tz.classify(docs, labels).collect()} == {expected}
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in tz.classify(docs, none).collect()} == {0.0}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tz.classify(empty, none).collect() == []


def test_windows_cover_the_whole_text():
    text = "Ab cD " + "é" * 100
    assert b"".join(tz.windows(text)) == b"abcd" + "é".encode() * 100
    distance = tz.Distance(b"ordinary words of any kind " * 20, b"grumblefoot nastywart " * 20)
    assert distance(b"grumblefoot") > 0 > distance(b"ordinary")
    assert np.isfinite(distance.describe("")).all()
