"""Quality rules against plain Python counts."""

import random
import re
from collections import Counter

from ledgerloom.llm import quality_divergence as qd


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    n, r = len(words), len(repeated)
    return (
        n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), r,
        n < 50 or 100 * r > 50 * n,
    )


def prose(rng, n):
    usual = ["the", "of", "and", "to", "in"]
    return " ".join(rng.choice(usual) if rng.random() < 0.4 else "".join(rng.choice("aeinorst") for _ in range(rng.randint(3, 9))) for _ in range(n))


def texts():
    rng = random.Random(6)
    out = [prose(rng, rng.randint(60, 300)) for _ in range(120)]
    line = prose(rng, 8)
    out += [
        None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "a b c d a b c d a b c d", "x " * 400, "\n".join([line] * 30),
        "\n".join([line, line + " ", line, "", ""]), "é漢 Ж " * 30, "a\r\nb\r\na\r\n", "#*$%&|<> " * 5, "one\x1ftwo three",
    ]
    junk = {
        "symbols": " ".join(w + "***" for w in prose(rng, 200).split()),
        "capitals": " ".join(w.upper() + "!!" for w in prose(rng, 200).split()),
        "strange": " ".join("".join(rng.choice("qxzjkvw") for _ in range(7)) for _ in range(200)),
    }
    return out, junk


def test_counts_and_verdicts(spark):
    plain, junk = texts()
    rows = [(i, t, "en", i, "row") for i, t in enumerate([*plain, *junk.values()])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, word int, row string").repartition(3)
    found = {r.doc_id: r for r in qd.assess(docs).collect()}
    assert len(found) == len(rows)
    for i, text, *_ in rows:
        r = found[i]
        own = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert own == brute(text), (text or "")[:60]
    assert all(found[i].kept for i in range(120))
    assert not any(found[len(plain) + k].kept for k in range(len(junk)))
    kept = qd.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in found.items() if r.kept)


def test_without_language_only_the_counts_decide(spark):
    _, junk = texts()
    rows = [(1, junk["symbols"], None), (None, junk["symbols"], "xx"), (1, junk["symbols"], None), (2, "short", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted((str(r.doc_id), r.kept) for r in qd.assess(docs).collect()) == [("1", True), ("1", True), ("2", False), ("None", True)]


def test_long_text(spark):
    text = "alpha beta gamma delta " * 60_000 + " ".join(f"w{i}" for i in range(50_000))
    r = qd.assess(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")).first()
    assert (r.n_words, r.n_repeat_words) == (290_000, 240_000)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert qd.assess(docs).collect() == [] and qd.kept_documents(docs).collect() == []
