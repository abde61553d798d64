"""Mixing against a step-by-step split in plain Python."""

import hashlib
import random
import re
from fractions import Fraction

from pyspark.sql import functions as F

from ledgerloom.llm import mixing

WEIGHTS = {"domain": {"domain0": 1, "domain1": 5, "domain2": 0}, "lang": {"en": 4, "de": 2, "": 3}}


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def split(budget, nodes):
    """nodes: name -> (weight, capacity); whole numbers, shortages to siblings by weight."""
    got = dict.fromkeys(nodes, 0)
    budget = min(budget, sum(c for w, c in nodes.values() if w))
    left = {n for n, (w, _) in nodes.items() if w}
    rest = budget
    while left:
        total = sum(nodes[n][0] for n in left)
        full = {n for n in left if Fraction(rest * nodes[n][0], total) >= nodes[n][1]}
        if not full:
            break
        # the neediest first: one at a time keeps the others' parts right
        n = min(full, key=lambda n: (Fraction(nodes[n][1], nodes[n][0]), n))
        got[n] = nodes[n][1]
        rest -= got[n]
        left.discard(n)
    if left:
        total = sum(nodes[n][0] for n in left)
        for n in left:
            got[n] = rest * nodes[n][0] // total
        for n in sorted(left)[: rest - sum(got[n] for n in left)]:
            got[n] += 1
    return got


def brute(rows, percent, epochs, seed):
    leaves = {}
    for doc, text, lang, source in rows:
        number = re.search("([0-9]+)", source or "")
        key = (f"domain{int(number.group(1)) % 4 if number else 0}", lang or "", source or "")
        leaves.setdefault(key, []).append((doc, words(text)))
    size = {k: sum(n for _, n in v) for k, v in leaves.items()}
    quota = {(): sum(size.values()) * percent // 100}
    for depth, name in enumerate(mixing.LEAF):
        new = {}
        for parent, budget in quota.items():
            children = {k[: depth + 1] for k in leaves if k[:depth] == parent}
            nodes = {
                c: (WEIGHTS.get(name, {}).get(c[-1], 1), epochs * sum(s for k, s in size.items() if k[: depth + 1] == c))
                for c in children
            }
            new |= split(budget, nodes)
        quota = new
    out = []
    for key, docs in leaves.items():
        if not quota[key]:
            continue
        whole, rest = divmod(quota[key], size[key])
        before = 0
        place = lambda d: hashlib.md5(f"{seed}:{whole}:{d}".encode()).hexdigest()  # noqa: E731, B023
        for doc, n in sorted(docs, key=lambda x: place(x[0])):
            out += [(doc, e) for e in range(whole + (before < rest))]
            before += n
    return sorted(out)


def run(docs, percent, epochs, seed):
    domain = mixing.source_domain()
    _, leaves = mixing.plan(docs, domain, percent, epochs, WEIGHTS, seed)
    return mixing.copies(docs, leaves, domain, seed).select("row.*", "epoch")


def test_quotas_and_prefixes_equal_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for doc in range(400):
        source = rng.choice(["src1"] * 6 + ["src2", "src3", "src5", "src7", "other", None])
        text = rng.choice([None, "", " \n "]) if rng.random() < 0.05 else " ".join("x" * rng.randint(1, 60)) + rng.choice(["", " ", "\n"])
        rows.append((doc, text, rng.choice(["en", "en", "de", "fr", None]), source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for percent, epochs, seed in ((40, 1, 3), (130, 3, 4)):
        found = sorted((r.doc_id, r.epoch) for r in run(docs, percent, epochs, seed).collect())
        assert found == brute(rows, percent, epochs, seed)


def test_other_columns_repeated_rows_and_missing_ids(spark):
    rows = [(1, "a b", "en", "s1", 5, "x"), (1, "a b", "en", "s1", 5, "x"), (None, "c", None, None, 6, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, quota int, domain string")
    found = run(docs, 100, 1, 1)
    assert found.columns == [*docs.columns, "epoch"]
    assert sorted(map(str, (tuple(r)[:-1] for r in found.collect()))) == sorted(map(str, rows))


def test_any_column_names(spark):
    rows = [(1, "a b", "en", "s1", 9, 8, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epoch int, row int, `a.b` int")
    domain = mixing.source_domain()
    _, leaves = mixing.plan(docs, domain, 100, 1, WEIGHTS)
    found = mixing.copies(docs, leaves, domain).collect()
    assert [(tuple(r.row), r.epoch) for r in found] == [(rows[0], 0)]


def test_empty_table(spark):
    assert run(spark.createDataFrame([], "doc_id long, text string, lang string, source string"), 50, 2, 1).collect() == []


def test_word_counts(spark):
    texts = ["", " ", "a", " a", "a ", " a b\n", "\x0b\x0c", "a b c", None, "\x1fa\t\tb"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.count_words(F.col("text")).alias("n")).collect()
    assert [r.n for r in rows] == [words(t) for t in texts]
