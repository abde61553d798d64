"""Physical plans: pushed filters, pruned columns, no products, few exchanges."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates
from ledgerloom.operators import categories as cats
from ledgerloom.operators import dashboards as dash
from ledgerloom.operators import filters as flt
from ledgerloom.operators import fx, recurring, similarity
from ledgerloom.settings import DEFAULTS
from ledgerloom.sources.bindings import bind


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    """The converted ledger as a stored table."""
    path = str(tmp_path_factory.mktemp("ledger") / "converted")
    fx.resolve_conversion(bind(spark, sf_dir, "ledger"), bind(spark, sf_dir, "fx_rates")).write.parquet(path)
    return spark.read.parquet(path)


def test_filters_reach_the_scan(spark, stored):
    record = flt.LedgerFilter(
        date_from=dt.date(1996, 1, 1), date_to=dt.date(1999, 1, 1), bank="ASIA", currency="USD", flow_direction="out"
    )
    text = plan(stored.where(flt.predicate(record)).select("transaction_id"))
    for part in ("GreaterThanOrEqual(transaction_date", "EqualTo(bank_name,ASIA)", "EqualTo(currency,USD)", "IsNotNull(out_flow)"):
        assert part in text
    assert "description" not in text.split("ReadSchema")[1].split("\n")[0]


def test_dashboards_have_one_exchange_and_read_few_columns(spark, stored):
    scope = dash.scope(stored, dt.date(1996, 1, 1), dt.date(1999, 1, 1))
    for series in (dash.category_trends(scope), dash.cash_flow(scope), dash.bank_breakdown(scope)):
        text = plan(series)
        assert text.count("hashpartitioning(") == 1
        assert "description" not in text.split("ReadSchema")[1].split("\n")[0]


def test_no_products(spark, sf_dir):
    ledger, categories, rates = (bind(spark, sf_dir, n) for n in ("ledger", "categories", "fx_rates"))
    candidates = flt.eligible_candidates(ledger, categories)
    unsure = flt.unsure_rows(ledger)
    corrected = candidates.withColumn("job_id", F.col("transaction_id"))
    frames = (
        similarity.best_text_match(unsure, candidates),
        similarity.rescan(unsure, corrected),
        recurring.match_by_text(ledger, bind(spark, sf_dir, "payments"), bind(spark, sf_dir, "matches")),
        fx.resolve_conversion(ledger, rates),
    )
    for df in frames:
        text = plan(df)
        assert "CartesianProduct" not in text
        assert "BroadcastNestedLoopJoin" not in text


def test_the_category_dimension_is_broadcast(spark, sf_dir, stored):
    # As a stored table its size is known before the query runs.
    text = plan(cats.with_category(stored, spark.createDataFrame([("promo", "PROMO", True)], "category_id string, name string, active boolean")))
    assert "BroadcastHashJoin" in text


def test_rates_join_by_equality(spark, sf_dir):
    text = plan(fx.asof_rates(bind(spark, sf_dir, "ledger"), bind(spark, sf_dir, "fx_rates")))
    windows = [line for line in text.splitlines() if "Window" in line and "currency" in line]
    assert all("rate_date" in line for line in windows)
    assert "BroadcastNestedLoopJoin" not in text


def test_due_dates_are_computed_once_and_first_rows_combined_by_hash(spark):
    pairs = spark.sql(
        """SELECT id AS transaction_id, date_add(DATE '2000-01-01', CAST(id % 800 AS INT)) AS transaction_date, CAST(id AS DECIMAL(18,2)) AS amount,
        id % 7 AS payment_id, CAST(5 AS DECIMAL(18,2)) AS expected_amount, CASE WHEN id % 7 = 0 THEN 'annual' WHEN id % 7 < 6 THEN 'monthly' END AS frequency,
        CASE WHEN id % 7 = 0 THEN 2 END AS due_month, CAST(31 - id % 7 AS INT) AS due_day, true AS is_trusted FROM range(5000)"""
    )
    matches = spark.createDataFrame([(1, "2000-02", "approved"), (2, "2000-02", "rejected")], "payment_id long, cycle_period string, status string")
    first = recurring._first_per_cycle(pairs, matches, DEFAULTS)
    plan = first._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("add_months") <= 2
    assert "SortAggregate" not in first._jdf.queryExecution().sparkPlan().toString()
    due = dates.nearest_due_date(F.col("frequency"), F.col("due_month"), F.col("due_day"), F.col("transaction_date"))
    cycle = dates.cycle_period(F.col("frequency"), F.col("due"))
    plain = pairs.withColumn("due", due).where("abs(datediff(transaction_date, due)) <= 5").select("payment_id", cycle.alias("cycle_period"), "transaction_id")
    wanted = {}
    for payment, period, row in plain.collect():
        wanted[payment, period] = min(row, wanted.get((payment, period), row))
    assert wanted.pop((1, "2000-02")) is not None
    assert {(r.payment_id, r.cycle_period): r.transaction_id for r in first.collect()} == wanted
    assert all(r.amount_at_match == r.transaction_id for r in first.collect())


def test_vectors_are_searched_once_by_categorize(spark):
    rows = [(1, "A SHOP", 5, "UNSURE", [1.0, 0.0]), (2, "B SHOP", 5, "UNSURE", [0.0, 1.0])]
    incoming = spark.createDataFrame(rows, "transaction_id long, description string, amount int, llm_category string, vector array<float>")
    incoming = incoming.withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    candidates = incoming.selectExpr("transaction_id + 10 AS transaction_id", "description", "amount", "'X' AS category_name", "'llm' AS category_source")
    index = incoming.selectExpr("transaction_id + 10 AS id", "vector")
    decided = similarity.categorize(incoming, candidates, index)
    # the search is behind a stored table, which the open rows and the outcome read
    assert "InPandas" not in plan(decided)
    assert sorted((r["transaction_id"], r["precedent_id"]) for r in decided.collect()) == [(1, 11), (2, 12)]
