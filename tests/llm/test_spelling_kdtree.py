"""Spelling variants against all pairs in plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import spelling_kdtree as sk

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows):
    counts = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute(rows):
    counts = counted(rows)
    found = {}
    for word, n in counts.items():
        close = [(-counts[w], w) for w in counts if abs(len(w) - len(word)) < 2 and w != word and near(w, word)]
        form = min(close)[1] if close and -min(close)[0] >= 2 * n else None
        found[word] = (form, n, len(close))
    out = []
    for word, (form, n, n_near) in found.items():
        root = word
        while found[root][0]:
            root = found[root][0]
        out.append((word, form, root, n, n_near, counts.get(form)))
    return sorted(out)


def corpus(seed, docs, syllables=("an", "er", "th", "on", "ré", "ing", "ß", "ÿ", "Ö")):
    rng = random.Random(seed)
    rows = []
    for i in range(docs):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 5))) for _ in range(120)]
        words = [w.upper() if rng.random() < 0.1 else w for w in words]
        rows.append((i * 7 - 3, rng.choice([" ", "-", "3", "\n", "×", "Ā"]).join(words)))
    return rows


def found(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(3)
    result = sk.variants(docs)
    assert result.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in result.collect()), key=lambda r: r[0])


def test_equals_brute_force(spark):
    rows = corpus(1, 60)
    expected = brute(rows)
    assert found(spark, rows) == expected
    assert sum(r[1] is not None for r in expected) >= 10


def test_many_cells(spark, monkeypatch):
    rows = corpus(2, 50)
    for name, value in (("CELL", 20), ("PER_CELL", 8), ("LEAF", 2), ("CHUNK", 16), ("FLUSH", 50), ("LONG_TEXT", 200), ("BYTES", 64)):
        monkeypatch.setattr(sk, name, value)
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    long = "a" * 5000
    rows = [(None, "house house mouse"), (1, "house"), (1, "house"), (2, "mouse mouse moused moused moused"), (3, None), (4, ""), (5, " 12 ")]
    rows += [(6, f"{long} {long} {long} {long}b {long}b {long}b"), (7, "ärger Ärger ÄRGER ärger ärger"), (8, "word " * 300_000)]
    rows += [(9, "sited sited sited sitedx sitedx sitedx sitedy sitedy sitedy")]
    assert found(spark, rows) == brute(rows)


def test_chains_end_at_the_last_form(spark):
    chain = ["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb", "aaabbbb", "aabbbbb"]
    rows = [(i, f" {word}" * (3 << i)) for i, word in enumerate(chain)]
    result = found(spark, rows)
    assert result == brute(rows) and max(sum(r[2] == root for r in result) for root in chain) >= 5


def test_empty_table(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, "few")]) == []


@pytest.mark.parametrize("leaf", [1, 5])
def test_no_box_in_reach_is_skipped(leaf):
    rng = np.random.default_rng(leaf)
    points = rng.integers(0, 3, (200, sk.LETTERS)) * (rng.random((200, sk.LETTERS)) < 0.08)
    tree = sk.Tree(points, leaf)
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(200))
    homes = tree.homes(points)
    assert all(i in tree.leaves[homes[i]] for i in range(200))
    queries = points.copy()
    for i in range(200):
        queries[i, rng.integers(sk.LETTERS)] += 1
    for gain, lose in ((0, 1), (1, 1), (1, 0)):
        pairs = {(int(a), int(b)) for q, p in sk._in_reach(tree, points, queries, gain, lose) for a, b in zip(q, p, strict=True)}
        d = points[None].astype(int) - queries[:, None]
        expected = (np.maximum(d, 0).sum(2) == gain) & (np.maximum(-d, 0).sum(2) == lose)
        assert pairs == {(int(a), int(b)) for a, b in zip(*np.nonzero(expected), strict=True)}


def test_one_edit():
    rng = random.Random(3)
    for _ in range(2000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(3, 6)))
        b = "".join(rng.choice("ab") for _ in range(len(a) + rng.randint(0, 1)))
        x, y = (np.array([[ord(c) for c in w]]) for w in (a, b))
        assert bool(sk._one_edit(x, y)[0]) == near(a, b)
