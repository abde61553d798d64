"""Jaccard join against sets in plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import jaccard_join as jj
from ledgerloom.llm import wordhash

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    words = SPACE.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def brute(rows, width, percent):
    """(doc_id, n, component) of distinct ids."""
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return sorted((i, len(sets[i]), root(i)) for i in ids)


def corpus(seed, copies):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeÉ") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([1, 2, 3, 20, 90, 300]))] + (passage if rng.random() < 0.4 else [])
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = word()
            texts.append(rng.choice([" ", "\n", " \t"]).join(w.upper() if rng.random() < 0.1 else w for w in own))
    texts += ["", " \n", None, "one", "ONE", "one two", "one  two ", "w " * 3000]
    rng.shuffle(texts)
    return list(enumerate(texts, 5))


@pytest.mark.parametrize(("seed", "copies", "width", "percent"), [(1, 14, 3, 90), (2, 8, 5, 80)])
def test_components_equal_brute_force(spark, seed, copies, width, percent):
    rows = corpus(seed, copies)
    # other columns with the names that the operator uses itself
    docs = spark.createDataFrame([(i, t, i, "x", 0) for i, t in rows], "doc_id long, text string, n long, prefix string, node int")
    found = jj.similar_documents(docs.repartition(5), width, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute(rows, width, percent)


def test_missing_ids_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (7, text), (7, text), (3, text + " more"), (9, None), (9, None), (4, "a b c"), (4, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jj.similar_documents(docs).collect()
    components = sorted((str(r.doc_id), r.component_id) for r in found)
    assert components == [("3", 3), ("4", 3), ("4", 4), ("7", 3), ("7", 3), ("9", 9), ("9", 9), ("None", None)]
    kept = jj.one_of_each(docs).collect()
    # 4 has two unlike texts: the other one is a near copy of 3
    assert sorted((str(r.doc_id), r.text) for r in kept if r.text) == [("3", text + " more"), ("4", "a b c"), ("None", text)]
    assert [r.doc_id for r in kept if not r.text] == [9, 9]


def test_one_of_each_keeps_every_unlike_text(spark):
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcd"]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[2]), (2, texts[2] + " x"), (3, texts[2]), (4, texts[3]), (4, texts[3]), (4, " \n"), (5, "")]
    docs = spark.createDataFrame([(i, t, 7, "r", 1) for i, t in rows], "doc_id int, text string, `a.b` int, row string, n int").repartition(3)
    kept = jj.one_of_each(docs)
    assert kept.columns == docs.columns
    found = sorted((r.doc_id, r.text) for r in kept.collect())
    two = [x for x in found if x[0] == 2]
    assert len(two) == 1 and two[0][1] in (texts[2], texts[2] + " x")
    assert [x for x in found if x[0] != 2] == [(1, texts[0]), (1, texts[1]), (4, " \n"), (4, texts[3]), (5, "")]


@pytest.mark.parametrize("block", [3])
def test_groups_that_leaders_leave_open(spark, monkeypatch, block):
    """Chains of near copies, no leader links all of them, and passages that unlike texts share."""
    rng = random.Random(9)
    monkeypatch.setattr(jj, "BLOCK", block)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts, passage = [], [word() for _ in range(25)]
    for _ in range(6):
        words = [word() for _ in range(80)]
        for step in range(25):
            words[(step * 3) % 80] = word()
            texts.append(" ".join(words))
        texts += [" ".join([*passage, *(word() for _ in range(rng.randint(5, 60)))]) for _ in range(6)]
    rng.shuffle(texts)
    rows = list(enumerate(texts, 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jj.similar_documents(docs, 3, 90).collect())
    assert found == brute(rows, 3, 90)


def test_parity_of_many_pairs_is_that_of_each():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 54, n).astype(np.uint64)) for n in (1, 5, 40, 60, 70, 200, 900, 1100)]
    wide = [jj._parity(s) for s in sets]
    i, j = (x.ravel() for x in np.meshgrid(range(8), range(8)))
    found = jj._differ(pa.chunked_array([wide[:3], wide[3:]], pa.binary()), i, j)
    assert found.tolist() == [jj._least_difference(wide[a], wide[b]) for a, b in zip(i, j, strict=True)]
    assert len(jj._differ(pa.chunked_array([], pa.binary()), i[:0], j[:0])) == 0


def test_fingerprints_of_links_always_meet():
    rng = np.random.default_rng(5)
    for _ in range(300):
        tokens = np.unique(rng.integers(0, 1 << 54, rng.integers(1, 300)).astype(np.uint64))
        other = np.unique(np.concatenate([tokens[rng.random(len(tokens)) < 0.97], rng.integers(0, 1 << 54, rng.integers(0, 5)).astype(np.uint64)]))
        common = len(np.intersect1d(tokens, other))
        if 100 * common >= 80 * (len(tokens) + len(other) - common):
            assert jj._shares_prefixes(jj._fingerprints(tokens, 80), jj._fingerprints(other, 80))


def test_empty_table(spark):
    assert jj.similar_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_words_and_shingles_are_those_of_the_pattern():
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "B", "é", " ", "\t", "\n", "\x0b", "\x1f", " ", "漢"]) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    data, offsets = wordhash.text_bytes(pa.array([*texts, None]))
    start, end, bounds = wordhash.word_spans(data, offsets)
    for i, text in enumerate(texts):
        words = [bytes(data[a:b]).decode() for a, b in zip(start[bounds[i] : bounds[i + 1]], end[bounds[i] : bounds[i + 1]], strict=True)]
        assert words == SPACE.findall(text)
    _, limits = wordhash.shingle_sets(pa.array([*texts, None]), 3)
    assert list(np.diff(limits)) == [len(shingles(t, 3)) for t in [*texts, None]]


def test_long_words_hash_like_short_ones():
    word = "ab" * 900_000
    sets, bounds = wordhash.shingle_sets(pa.array([f"{word} x y", f"x {word} x y", f"{word[:-1]} x y"]), 3)
    first, second, third = (set(sets[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True))
    assert first < second and not first & third


def test_parity_bits_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(300):
        tokens = np.unique(rng.integers(0, 1 << 54, rng.integers(2, 400)).astype(np.uint64))
        a, b = (tokens[rng.random(len(tokens)) < rng.uniform(0.5, 1)] for _ in range(2))
        if len(a) and len(b):
            assert jj._least_difference(jj._parity(a), jj._parity(b)) <= len(np.setxor1d(a, b))


def test_flags_are_the_buckets_that_occur(spark):
    frame = spark.createDataFrame([(i * 37 % 5000,) for i in range(300)], "b long").repartition(3)
    flags = jj.bounded.bucket_flags(frame, lambda batch: iter([batch.column(0).to_numpy()]), 18)
    assert np.flatnonzero(flags).tolist() == sorted(i * 37 % 5000 for i in range(300))


def test_what_the_first_leaders_settled_is_not_compared_again(spark):
    rows = [(1, 10, 0, 2), (1, 11, 1, 2), (2, 10, 1, 3), (2, 11, 0, 3), (2, 12, 2, 3)]
    index = spark.createDataFrame(rows, "list long, node long, place int, df long")
    links = spark.createDataFrame([(11, 10), (10, 10)], "node long, component long")
    for components in (links, None):
        left = jj._apart(index, components, 1).select("list", "node").collect()
        assert sorted(map(tuple, left)) == [(2, 10), (2, 12)]
    assert jj._apart(index, None, 0).count() == 5


def test_a_task_of_one_of_each_needs_one_python_worker(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(7, text), (3, text + " more"), (9, None)], "doc_id long, text string")
    plan = jj.one_of_each(docs)._jdf.queryExecution().executedPlan().toString()
    # one for each of the three kinds of rows that stay
    assert plan.split("== Initial Plan ==")[0].count("MapInArrow") == 3
