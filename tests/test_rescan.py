"""The re-scan after corrections against jobs run one after the other."""

import math
import random
from decimal import Decimal

from ledgerloom import runtime
from ledgerloom.functions.indel import lcs_lengths
from ledgerloom.operators import rangefirst, similarity
from ledgerloom.operators.similarity import rescan

TEXTS = ["NORTH STAR COFFEE", "NORTH STAR COFFEES", "NORTH STAR TOFFEE", "GREEN GROCER", "GREEN GROCERS X"]


def text_score(a, b):
    a, b = (" ".join(sorted(t.split())) for t in (a, b))
    return 100 * 2 * lcs_lengths([a], [b])[0] / (len(a) + len(b))


def in_range(a, b):
    return abs(a - b) <= 5 or max(a, b) <= 4 * min(a, b)


def match(row, job):
    if row["vector"] and job["vector"]:
        score = sum(x * y for x, y in zip(row["vector"], job["vector"], strict=True))
        if row["llm"] not in ("UNSURE", None) and row["llm"] == job["category"]:
            score = min(1.0, score + 0.05)
        if score >= 0.82 and in_range(row["amount"], job["amount"]):
            return round(score * 100, 2)
    score = text_score(row["text"], job["text"])
    return score if score >= 85 and in_range(row["amount"], job["amount"]) else None


def brute(rows, jobs):
    out = []
    for row in rows:
        for job in sorted(jobs, key=lambda j: j["id"]):
            score = match(row, job)
            if score is not None:
                status = "auto_applied" if score >= 97 else "pending"
                out.append((row["id"], job["id"], job["category"], round(score, 2), status))
                if status == "auto_applied":
                    break
    return sorted(out)


def made(rng, n, first):
    angles = [0, 0.3, 0.55, 0.62, 0.9, 2.0]
    rows = []
    for i in range(n):
        angle = rng.choice([*angles, None])
        rows.append({
            "id": first + i, "text": rng.choice(TEXTS), "amount": rng.choice([3, 6, 20, 90, 200, 900]), "llm": rng.choice(["A", "B", "UNSURE", None]),
            "category": rng.choice("AB"), "vector": None if angle is None else [math.cos(angle), math.sin(angle)],
        })
    return rows


def test_two_kinds_of_evidence_in_job_order(spark):
    rng = random.Random(4)
    rows, jobs = made(rng, 60, 0), made(rng, 25, 1000)
    unsure = spark.createDataFrame(
        [(r["id"], r["text"], Decimal(r["amount"]), r["llm"], r["vector"]) for r in rows],
        "transaction_id long, description string, amount decimal(18,2), llm_category string, vector array<double>",
    )
    corrected = spark.createDataFrame(
        [(j["id"], j["id"], j["text"], Decimal(j["amount"]), j["category"], "manual", j["vector"]) for j in jobs],
        "job_id long, transaction_id long, description string, amount decimal(18,2), category_name string, category_source string, vector array<double>",
    )
    found = sorted(tuple(r) for r in rescan(unsure, corrected).collect())
    expected = brute(rows, jobs)
    assert found == expected
    assert {status for *_, status in expected} == {"pending", "auto_applied"}
    # texts alone, where no side has vectors
    plain = rescan(unsure.drop("vector", "llm_category"), corrected.drop("vector")).collect()
    for r in [*rows, *jobs]:
        r["vector"] = None
    assert sorted(tuple(r) for r in plain) == brute(rows, jobs)


def test_tables_with_a_row_per_question_or_job_are_not_sent_to_all_tasks(spark, monkeypatch):
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return runtime.cut(df)

    monkeypatch.setattr(similarity, "cut", noted)
    monkeypatch.setattr(rangefirst, "cut", noted)
    monkeypatch.setattr(rangefirst, "SENT_ITEMS", 0)
    rng = random.Random(4)
    rows, jobs = made(rng, 60, 0), made(rng, 25, 1000)
    amount = "amount decimal(18,2)"
    unsure = spark.createDataFrame([(r["id"], r["text"], Decimal(r["amount"])) for r in rows], f"transaction_id long, description string, {amount}")
    corrected = spark.createDataFrame(
        [(j["id"], j["id"], j["text"], Decimal(j["amount"]), j["category"], "manual") for j in jobs],
        f"job_id long, transaction_id long, description string, {amount}, category_name string, category_source string",
    )
    found = rescan(unsure, corrected)
    ledger = unsure.selectExpr("transaction_id", "'UNSURE' AS category", "'unsure' AS category_source")
    for df in (found, similarity.apply_rescan(ledger, found)):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
    # the join of similar texts is another operator's
    assert sum("SortMergeJoin" in p for p in plans) > 5
    assert not [p for p in plans if "BroadcastHashJoin" in p and "MapInArrow" not in p]
