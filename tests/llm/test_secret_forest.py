"""Secrets: planted ones are found, look-alikes stay, texts around them stay as they are."""

import random
import time

import numpy as np

from ledgerloom.llm import secret_forest as sf


def corpus():
    rng = random.Random(3)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    rows, truth = [], {}
    for i in range(300):
        words = [pick("aeiourstln", rng.randint(2, 9)) for _ in range(60)]
        kind = i % 6
        planted = {
            0: f"password={pick('0123456789abcdef', 18)}",
            1: f'token = "{pick("0123456789abcdef", 40)}"',
            2: "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16),
            3: pick("0123456789", 16),
            4: f"/{pick('abcdefg123', 20)}/x",
        }.get(kind, "plain")
        words[30] = planted
        rows.append((i, " ".join(words)))
        truth[i] = kind < 3
    return rows, truth


def test_forest_finds_planted_secrets(spark):
    rows, truth = corpus()
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double").repartition(4)
    found = sf.scan(docs).collect()
    again = sf.scan(docs.repartition(2)).collect()
    key = lambda r: (r.doc_id, r.start)
    assert sorted(found, key=key) == sorted(again, key=key)
    flagged = {r.doc_id for r in found if r.is_secret}
    assert flagged == {i for i, secret in truth.items() if secret}
    texts = dict(rows)
    for r in found:
        assert (r.start, r.end) in set(sf.candidates(texts[r.doc_id]))
    clean = {r.doc_id: r.text for r in sf.redact(docs).collect()}
    for i, text in texts.items():
        spans = sorted((r.start, r.end) for r in found if r.doc_id == i and r.is_secret)
        expected, at = "", 0
        for a, b in spans:
            expected += text[at:a] + sf.PLACEHOLDER
            at = b
        assert clean[i] == expected + text[at:]


def test_a_forest_from_given_findings(spark):
    rows, truth = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, int(s)) for i, s in truth.items()], "doc_id long, truth int")
    labelled = sf.findings(docs, sf.triple_weights(docs)).join(known, "doc_id").drop("label").withColumnRenamed("truth", "label")
    found = sf.scan(docs, labelled.where("doc_id div 6 % 2 = 0"))
    wrong = [r for r in found.collect() if r.doc_id // 6 % 2 and r.is_secret != truth[r.doc_id]]
    assert not wrong


def test_planted_findings_are_told_apart():
    """Precision and recall on findings made with another seed, none of which the forest has seen."""
    words, weights = ["house", "reading", "the", "tree", "Under", "walked", "nothing", "eiche"], np.zeros(1 << 15, np.float32)
    x, y = sf.planted(words, weights, 1500)
    forest = [np.array(sf._grow(x, y, np.random.default_rng([1, t])), float) for t in range(12)]
    x, y = sf.planted(["garden", "and", "slowly", "Fluss", "painted"], weights, 600, 77)
    found = sf.score(forest, x) >= sf.THRESHOLD
    assert y[found].mean() > 0.97 and found[y == 1].mean() > 0.97


# what the names of keys alone cannot settle
UNSETTLED = [
    ("secret = none of it", False), ("token = some more", False), ("password=$PASSWORD end", False), ("password: please enter", False),
    ("PASSWORD=${DB_PASSWORD}", False), ("token: 'changeme'", False), ("PRIVATE_KEY=abc123abc123 x", True), ("Bearer abc.def.ghi123-x9 z", True),
    ("see postgres://u:p4ss77x@host/db now", True), ("sha256 1d46e940c38b6b02bbe8d98b2da087fb424daede1111 end", False),
    ("the card 4512463504900732 by", False), ("in /home/anna/work/files2 there", False),
]


def test_references_and_placeholders_are_no_secrets(spark):
    docs, _ = corpus()
    n = len(docs)
    docs += [(n + i, f"some words before it {text} and some after it") for i, (text, _) in enumerate(UNSETTLED)]
    found = sf.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    flagged = {r.doc_id for r in found if r.is_secret}
    assert {n + i for i, (_, secret) in enumerate(UNSETTLED) if secret} == {i for i in flagged if i >= n}
    seen = {r.doc_id for r in found}
    assert all(n + i in seen for i, (_, secret) in enumerate(UNSETTLED) if secret)


def test_nulls_and_repeats(spark):
    secret = "password=0123456789abcdef01"
    rows = [(1, secret), (1, secret), (2, None), (3, ""), (None, f"x {secret}"), (4, "no candidate")]
    docs = spark.createDataFrame([(i, t, t) for i, t in rows], "doc_id long, text string, label string")
    found = sf.scan(docs).collect()
    assert sorted((str(r.doc_id), r.start, r.is_secret) for r in found) == [("1", 9, True), ("1", 9, True), ("None", 11, True)]
    clean = sf.redact(docs)
    assert clean.columns == docs.columns
    assert sorted(str(tuple(r)) for r in clean.collect()) == sorted(
        str((i, t and t.replace(secret[9:], sf.PLACEHOLDER), t)) for i, t in rows
    )


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sf.scan(docs).collect() == [] and sf.redact(docs).collect() == []


def test_long_texts(spark):
    text = "a1B2" * 100_000 + " " + "word " * 100_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [(r.start, r.end) for r in sf.scan(docs).collect()] == [(0, 400_000)]


ASSIGNED = [
    ("password=Summer2024 x", "Summer2024"),
    ('pwd: "Tr0ub4dor&3xyz"', "Tr0ub4dor&3xyz"),
    ("secret=correcthorsebatterystaple", "correcthorsebatterystaple"),
    ("DB_PASSWORD = 'two words!'", "two words!"),
    ('{"clientSecret": "a9Xk2"}', "a9Xk2"),
    ("'secret' => 'x1k9z'", "x1k9z"),
    ("passwd := hunter22", "hunter22"),
    ("token=abc/def-0123456789abcdef#end rest", "abc/def-0123456789abcdef#end"),
]


def test_values_of_any_form_that_are_assigned_to_a_name():
    for text, value in ASSIGNED:
        a = text.index(value)
        assert list(sf.candidates(text)) == [(a, a + len(value))], text
    for text in ("author: Smith", "the password is long", "secretary=x", "tokens: 12", "password", "password="):
        assert list(sf.candidates(text)) == [], text


def test_short_and_punctuated_passwords_are_redacted(spark):
    rows, truth = corpus()
    n = len(rows)
    rows += [(n + i, f"some words before {text} and after") for i, (text, _) in enumerate(ASSIGNED)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in sf.redact(docs).collect()}
    for i, (text, value) in enumerate(ASSIGNED):
        assert clean[n + i] == f"some words before {text.replace(value, sf.PLACEHOLDER)} and after"


def test_many_names_take_linear_time():
    for piece in ("password", "password_", "token=", "secret ", "auth: ", "pwd='", 'pwd="'):
        started = time.process_time()
        list(sf.candidates(piece * (400_000 // len(piece))))
        assert time.process_time() - started < 8, piece
