"""A run of statements against a loop over its rows."""

import datetime as dt
import json
import random
from decimal import Decimal

import pytest

from ledgerloom.functions.indel import lcs_lengths
from ledgerloom.operators import rangefirst, similarity
from ledgerloom.operators.similarity import categorize_run
from ledgerloom.plans import ingest as plan
from ledgerloom.runtime import cut
from ledgerloom.sources import statements as st

TEXTS = ["NORTH STAR COFFEE", "NORTH STAR COFFEES", "NORTH STAR TOFFEE", "NORTH STARS TOFFEE", "GREEN GROCER", "GREEN GROCERS X", "RAIL CARD"]


def text_score(a, b):
    a, b = (" ".join(sorted(t.split())) for t in (a, b))
    return 100 * 2 * int(lcs_lengths([a], [b])[0]) / (len(a) + len(b))


def in_range(a, b):
    return abs(a - b) <= 5 or max(a, b) <= 4 * min(a, b)


def in_turn(rows, known):
    """rows (id, text, amount, llm), known (id, text, amount, category, source); decisions one row after the other."""
    precedents, out = list(known), []
    for name, text, amount, llm in rows:
        best = None
        for place, (other, their_text, their_amount, category, source) in enumerate(precedents):
            score = text_score(text, their_text)
            if score >= 85 and in_range(amount, their_amount):
                best = min(best or (9,), (source != "manual", -score, place, str(other), category))
        opinion = None if llm == "UNSURE" else llm
        match = best[4] if best else None
        if match and opinion and match != opinion:
            decision = ("UNSURE", "unsure", None)
        elif match:
            decision = (match, "similarity", best[3])
        else:
            decision = (opinion, "llm", None) if opinion else ("UNSURE", "unsure", None)
        out.append((name, *decision))
        if decision[1] != "unsure":
            precedents.append((name, text, amount, decision[0], decision[1]))
    return out


def test_rows_of_a_run_are_precedents_for_those_after_them(spark):
    rng = random.Random(3)
    for seed in range(2):
        amount = lambda: rng.choice([3, 6, 20, 90, 200, 900])
        rows = [(f"s{i // 20}#{i:04d}", rng.choice(TEXTS), amount(), rng.choice(["A", "B", "C", "UNSURE", "UNSURE"])) for i in range(90)]
        known = [(i, rng.choice(TEXTS[: 3 + 4 * seed]), amount(), rng.choice("AB"), rng.choice(["manual", "llm", "similarity"])) for i in range(4 + 3 * seed)]
        incoming = spark.createDataFrame(
            [(i, t, Decimal(a), c) for i, t, a, c in rows], "transaction_id string, description string, amount decimal(18,2), llm_category string"
        )
        candidates = spark.createDataFrame(
            [(i, t, c, s, Decimal(a)) for i, t, a, c, s in known],
            "transaction_id long, description string, category_name string, category_source string, amount decimal(18,2)",
        )
        found = categorize_run(incoming.repartition(3), candidates).collect()
        expected = in_turn(rows, known)
        assert sorted((r.transaction_id, r.category, r.source, r.precedent_id) for r in found) == sorted(expected)
        assert any(p and "#" in p for *_, p in expected)


def test_a_whole_run(spark):
    """Two files and a copy: the second row follows the first of the same run, a label disagrees, a payment is matched."""

    def answer(*lines):
        return json.dumps({
            "bank_name": "ACME", "currency": "SGD", "confidence": "high",
            "transactions": [
                {"transaction_date": d, "description": t, "amount": a, "direction": "out", "printed_converted_amount_sgd": None, "confidence": "high"}
                for d, t, a in lines
            ],
        })

    one = answer(("2027-01-14", "STREAM TV", 12.0), ("2027-01-20", "STREAM TV", 13.0))
    two = answer(("2027-02-15", "STREAM TV", 12.0), ("2027-02-16", "GREEN GROCER", 50.0))
    raw = [("f1", one), ("f2", two), ("f3", one)]
    files = spark.createDataFrame(raw, "file_id string, raw string").withColumn("content_hash", st.content_hash("raw"))
    labels = [("f1", "STREAM TV", "Fun"), ("f2", "STREAM TV", "Food"), ("f2", "GREEN GROCER", "Food")]
    books = plan.Books(
        candidates=spark.createDataFrame([], "transaction_id long, description string, category_name string, category_source string, amount decimal(18,2)"),
        categories=spark.createDataFrame([("fun", "Fun"), ("food", "Food"), ("unsure", "UNSURE")], "category_id string, name string"),
        rates=spark.createDataFrame([], "rate_date date, from_currency string, to_currency string, rate decimal(18,6)"),
        payments=spark.createDataFrame(
            [(7, "Stream TV", Decimal(12), "monthly", None, 15, "fun", "Fun", True)],
            "payment_id long, name string, expected_amount decimal(18,2), frequency string, due_month int, due_day int, category_id string, category string, is_trusted boolean",
        ),
        matches=spark.createDataFrame([], "payment_id long, cycle_period string, status string, transaction_id string"),
        known=spark.createDataFrame([], "content_hash string, statement_id string"),
    )
    done = plan.ingest(files, spark.createDataFrame(labels, "statement_id string, description string, label string"), books, dt.date(2030, 1, 1))
    outcomes = {r.file_id: r.outcome for r in done.outcomes.collect()}
    assert outcomes == {"f1": "processed", "f2": "processed", "f3": "skipped_duplicate"}
    rows = {r.transaction_id: (r.category, r.category_source) for r in done.ledger.collect()}
    assert rows == {
        "f1#000000": ("Fun", "llm"), "f1#000001": ("Fun", "similarity"), "f2#000000": ("UNSURE", "unsure"), "f2#000001": ("Food", "llm"),
    }
    clash = done.disagreements.collect()
    assert [(r.transaction_id, r.similarity_category, r.llm_category) for r in clash] == [("f2#000000", "Fun", "Food")]
    taken = sorted((r.payment_id, r.cycle_period, r.transaction_id) for r in done.matches.collect())
    assert taken == [(7, "2027-01", "f1#000000"), (7, "2027-02", "f2#000000")]


def test_rows_of_a_run_are_shuffled_not_sent_through_the_driver(spark):
    """Small files are no small tables: ten thousand rows of one text take a few kilobytes on disk."""
    ids = spark.range(10_000).selectExpr("cast(id as string) AS transaction_id")
    incoming = cut(ids.selectExpr("transaction_id", "'ACME' AS description", "'A' AS llm_category"))
    matches = cut(ids.selectExpr("transaction_id", "'1' AS match_id", "'A' AS match_category", "90.0D AS score"))
    decided = similarity.with_decision(incoming, matches)
    assert "BroadcastHashJoin" not in decided._jdf.queryExecution().executedPlan().toString()
    assert decided.where("source = 'similarity'").count() == 10_000


def test_many_questions_of_few_texts_stay_where_they_are(spark):
    """The first items per text are the small side, though their size is only known once they are stored."""
    questions = cut(spark.range(20_000).selectExpr("'ACME' AS c_key", "id AS q", "1L AS low", "5L AS high"))
    items = cut(spark.range(60_000).selectExpr("'ACME' AS c_key", "id AS match_id", "id + 4 AS cents", "100L AS reach"))
    stored = []
    keep = lambda df: stored.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(rangefirst, "cut", keep)
        found = rangefirst.first_in_range(questions, items, ["c_key"], "match_id", [])
    assert found.count() == 20_000 and {r["item"]["order"] for r in found.select("item").distinct().collect()} == {0}
    joined = [p for p in stored if "Join" in p]
    assert joined and all("BuildLeft" not in p for p in joined)


def test_a_round_of_a_run_joins_rows_with_what_they_may_follow_only(spark, monkeypatch):
    """What does not change from round to round stands in one table, the decisions of the round before in one more."""
    plans = []
    monkeypatch.setattr(similarity, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    rows = [(f"f#{i}", "ACME", "A" if i == 1 else "UNSURE") for i in range(4)]
    incoming = spark.createDataFrame(rows, "transaction_id string, description string, llm_category string").selectExpr("*", "5.0BD AS amount")
    candidates = incoming.selectExpr("1L AS transaction_id", "'OTHER SHOP' AS description", "amount", "'B' AS category_name", "'llm' AS category_source").limit(1)
    found = {r["transaction_id"]: (r["source"], r["precedent_id"]) for r in categorize_run(incoming, candidates).collect()}
    assert found == {"f#0": ("unsure", None), "f#1": ("llm", None), "f#2": ("similarity", "f#1"), "f#3": ("similarity", "f#1")}
    last = plans[-1]
    assert last.count("SortMergeJoin") + last.count("BroadcastHashJoin") == 2
