"""Scalar functions: written-out cases and properties."""

import datetime as dt
import math
import random
from decimal import Decimal as D

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from ledgerloom.functions import amounts, dates, decisions, text, vectors
from ledgerloom.functions.indel import _score_batch, lcs_lengths
from ledgerloom.settings import DEFAULTS


def column(spark, values, schema, expr):
    rows = spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)
    return [r[0] for r in rows.select(expr).collect()]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(hs.lists(hs.tuples(hs.text("ab cé", max_size=80), hs.text("ab cé", max_size=80)), min_size=1, max_size=8))
def test_lcs_lengths_equal_the_table_method(pairs):
    left, right = [p[0] for p in pairs], [p[1] for p in pairs]
    assert lcs_lengths(left, right).tolist() == [lcs(a, b) for a, b in pairs]


def test_lcs_at_the_word_size():
    for n in (63, 64, 65, 128, 200):
        rng = random.Random(n)
        a, b = "".join(rng.choices("abc", k=n)), "".join(rng.choices("abc", k=n + 3))
        assert lcs_lengths([a], [b]).tolist() == [lcs(a, b)]


def test_score_of_equal_empty_and_disjoint_texts():
    import pandas as pd

    scores = _score_batch(pd.Series(["same", "", "abc"]), pd.Series(["same", "", "xyz"]))
    assert scores.tolist() == [100.0, 100.0, 0.0]


def test_normalize_noise(spark):
    cases = {
        "ROUND 3M TAPE 12 34567": "ROUND TAPE 12",
        "PAYNOW to ACME OTHR-998877": "PAYNOW to ACME OTHR-",
        "ABCDEFGHIJK12345 stays": "ABCDEFGHIJK12345 stays",
        "  a   b ": "a b",
        "A1B2C3": "",
    }
    got = column(spark, list(cases), "d string", text.normalize_noise(F.col("d")))
    assert got == list(cases.values())


def test_normalize_noise_is_idempotent(spark):
    rng = random.Random(5)
    words = ["ACME", "PTE", "OTHR-", "77812", "QR9", "x1y2", "12", "LTD.", "#55", "ABCDEFGHIJKLM9"]
    texts = [" ".join(rng.choices(words, k=6)) for _ in range(200)]
    once = column(spark, texts, "d string", text.normalize_noise(F.col("d")))
    assert column(spark, once, "d string", text.normalize_noise(F.col("d"))) == once


def test_pattern_key_drops_one_trailing_reference(spark):
    cases = {" corner shop #1000 ": "CORNER SHOP", "A 12": "A 12", "B 123 456": "B 123", "#777": ""}
    assert column(spark, list(cases), "d string", text.pattern_key(F.col("d"))) == list(cases.values())


def test_token_key_sorts_words(spark):
    assert column(spark, ["b  a C", ""], "d string", text.token_key(F.col("d"))) == ["C a b", ""]


def test_balance_and_unordered_lines(spark):
    balance = ["Balance brought forward", "opening BALANCE", "Total outstanding balance", "BAL B/F", "Bal. c/f"]
    other = ["BALANCE YOGA", "CREDIT BALANCED DIET"]
    assert all(column(spark, balance, "d string", text.is_balance_line(F.col("d"))))
    assert not any(column(spark, other, "d string", text.is_balance_line(F.col("d"))))
    skip = ["PAYMENT RECEIVED", "Interest  charge", "LATE FEE", "cash rebate", "ANNUAL FEE", "CCY CONVERSION FEE"]
    assert all(column(spark, skip, "d string", text.is_unordered_line(F.col("d"))))
    assert not any(column(spark, ["REPAYMENTS", "LATE LUNCH"], "d string", text.is_unordered_line(F.col("d"))))


def test_amounts_in_range_and_its_interval(spark):
    rng = random.Random(1)
    pairs = [(D(rng.randint(1, 3000)) / 100, D(rng.randint(1, 3000)) / 100) for _ in range(3000)]
    pairs += [(D("100.00"), D("400.00")), (D("100.00"), D("400.01")), (D("1.00"), D("6.00")), (D("1.00"), D("6.01"))]
    for ratio, floor in ((DEFAULTS.amount_ratio, DEFAULTS.amount_floor), (DEFAULTS.trusted_ratio, DEFAULTS.trusted_floor)):
        rows = spark.createDataFrame(pairs, "a decimal(18,2), b decimal(18,2)")
        low, high = amounts.cents_window(amounts.cents(F.col("a")), ratio, floor)
        got = rows.select(
            amounts.amounts_in_range(F.col("a"), F.col("b"), ratio, floor).alias("gate"),
            amounts.cents(F.col("b")).between(low, high).alias("window"),
        ).collect()
        want = [abs(a - b) <= floor or max(a, b) <= ratio * min(a, b) for a, b in pairs]
        assert [r["gate"] for r in got] == want
        assert [r["window"] for r in got] == want


def test_price_bucket_boundaries(spark):
    cases = {"0.00": "$0 to $1", "1.00": "$0 to $1", "1.01": "$1 to $5", "-7.00": "$5 to $10", "5000.00": "$2000 to $5000", "5000.01": "$5000+"}
    got = column(spark, [D(k) for k in cases], "a decimal(18,2)", amounts.price_bucket(F.col("a")))
    assert got == list(cases.values())


def test_due_dates_around_month_ends(spark):
    day = dt.date
    cases = [
        ("monthly", None, 31, day(2026, 2, 27), day(2026, 2, 28)),
        ("monthly", None, 1, day(2025, 12, 30), day(2026, 1, 1)),
        ("monthly", None, 28, day(2026, 3, 2), day(2026, 2, 28)),
        ("monthly", None, 15, day(2026, 5, 15), day(2026, 5, 15)),
        ("annual", 1, 2, day(2025, 12, 29), day(2026, 1, 2)),
        ("annual", 12, 30, day(2026, 1, 3), day(2025, 12, 30)),
        ("annual", 2, 29, day(2026, 2, 27), day(2026, 2, 28)),
    ]
    rows = spark.createDataFrame(cases, "f string, m int, n int, d date, want date")
    due = dates.nearest_due_date(F.col("f"), F.col("m"), F.col("n"), F.col("d"))
    assert rows.where(due != F.col("want")).count() == 0
    periods = column(spark, [("monthly", day(2026, 2, 28)), ("annual", day(2026, 2, 28))], "f string, d date",
                     dates.cycle_period(F.col("f"), F.col("d")))
    assert periods == ["2026-02", "2026"]


def test_nearest_due_date_is_nearest(spark):
    """No due date of the neighbouring months is closer."""
    base = spark.range(0, 1200, 1).selectExpr("date_add(DATE '2023-01-01', CAST(id AS INT)) AS d", "CAST(id % 31 + 1 AS INT) AS n")
    due = dates.nearest_monthly(F.col("n"), F.col("d"))
    others = [
        F.abs(F.datediff("d", dates.month_instance(F.add_months(dates.month_start(F.col("d")), k), F.col("n"))))
        for k in (-1, 0, 1)
    ]
    assert base.where(F.abs(F.datediff("d", due)) > F.least(*others)).count() == 0


def test_cosine_similarity_edges_and_scale(spark):
    rows = [([1.0, 0.0], [2.0, 0.0]), ([1.0], [1.0, 2.0]), ([], []), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 2.0], [-2.0, 1.0])]
    got = column(spark, rows, "a array<float>, b array<float>", vectors.cosine_similarity(F.col("a"), F.col("b")))
    assert got == [1.0, 0.0, 0.0, 0.0, 0.0]
    rng = np.random.default_rng(3)
    pairs = [(rng.normal(size=8).tolist(), rng.normal(size=8).tolist()) for _ in range(50)]
    plain = column(spark, pairs, "a array<double>, b array<double>", vectors.cosine_similarity(F.col("a"), F.col("b")))
    scaled = column(spark, [([7 * x for x in a], b) for a, b in pairs], "a array<double>, b array<double>",
                    vectors.cosine_similarity(F.col("a"), F.col("b")))
    assert all(math.isclose(x, y, abs_tol=1e-12) for x, y in zip(plain, scaled, strict=True))


def test_decide_category_table(spark):
    cases = [
        ("Dining", "Dining", ("Dining", "similarity", False)),
        ("Dining", "Bills", ("UNSURE", "unsure", True)),
        ("Dining", "UNSURE", ("Dining", "similarity", False)),
        (None, "Bills", ("Bills", "llm", False)),
        (None, "UNSURE", ("UNSURE", "unsure", False)),
        ("Dining", None, ("Dining", "similarity", False)),
        (None, None, ("UNSURE", "unsure", False)),
    ]
    rows = [(a, b) for a, b, _ in cases]
    got = column(spark, rows, "s string, l string", decisions.decide_category(F.col("s"), F.col("l")))
    assert [(r["category"], r["source"], r["disagrees"]) for r in got] == [w for *_, w in cases]


def test_boost_never_lowers_and_stops_at_one(spark):
    rows = [(0.80, "A", "A"), (0.98, "A", "A"), (0.80, "A", "B"), (0.80, "UNSURE", "UNSURE"), (0.80, "A", None)]
    got = column(spark, rows, "s double, c string, l string", vectors.boosted(F.col("s"), F.col("c"), F.col("l"), 0.05))
    assert [round(x, 6) for x in got] == [0.85, 1.0, 0.80, 0.80, 0.80]


def test_payment_status(spark):
    today = dt.date(2026, 8, 10)
    rows = [
        ("pending", dt.date(2026, 8, 5), dt.date(2026, 9, 5), "pending_review"),
        ("approved", dt.date(2026, 8, 5), dt.date(2026, 9, 5), "paid"),
        ("auto_applied", dt.date(2026, 7, 14), dt.date(2026, 8, 14), "due_soon"),
        (None, dt.date(2026, 8, 9), dt.date(2026, 9, 9), "overdue"),
        (None, dt.date(2026, 8, 10), dt.date(2026, 9, 10), "due_soon"),
    ]
    frame = spark.createDataFrame(rows, "m string, c date, n date, want string")
    status = decisions.payment_status(F.lit("monthly"), F.col("m"), F.col("c"), F.col("n"), F.lit(today), 5)
    assert [r[0] for r in frame.select(status).collect()] == [r[3] for r in rows]


def test_strip_takes_white_space_of_any_kind_without_a_pattern(spark):
    rows = [(i, f"{chr(i)} {chr(i)}a{chr(i)}b {chr(i)}") for i in range(0x10000) if not 0xD800 <= i < 0xE000]
    frame = spark.createDataFrame([*rows, (-1, None), (-2, ""), (-3, " \n\r\n"), (-4, "　x\n")], "id int, t string")
    both = frame.select("id", text.strip(F.col("t")).alias("ours"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("want"))
    assert both.where("NOT ours <=> want").collect() == []
    assert "regexp" not in frame.select(text.strip(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
