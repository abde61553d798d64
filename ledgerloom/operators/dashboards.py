"""Dashboard series and ledger groupings: one shuffle on the group key each."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import settings as s
from ledgerloom.runtime import cut
from ledgerloom.functions.dates import month_key
from ledgerloom.operators.filters import currency_is, date_range

TOTAL = "decimal(28,2)"


def scope(converted: DataFrame, date_from: dt.date, date_to: dt.date, currency: str | None = None) -> DataFrame:
    keep = date_range(F.col("transaction_date"), date_from, date_to)
    return converted.where(keep if currency is None else keep & currency_is(currency))


def _month() -> Column:
    return month_key(F.col("transaction_date")).alias("month")


def category_trends(rows: DataFrame) -> DataFrame:
    """Spending by category and month, rows without a conversion left out."""
    spent = rows.where(~F.col("is_unavailable") & F.col("out_flow").isNotNull())
    return spent.groupBy("category", _month()).agg(F.sum("converted_sgd").cast(TOTAL).alias("total_sgd"))


def cash_flow(rows: DataFrame) -> DataFrame:
    """Income, expense and their difference per month that has any row."""

    def total(flow: str) -> Column:
        part = F.when(F.col(flow).isNotNull(), F.coalesce(F.col("converted_sgd"), F.lit(0)))
        return F.coalesce(F.sum(part), F.lit(0)).cast(TOTAL)

    months = rows.where(~F.col("is_unavailable")).groupBy(_month()).agg(
        total("in_flow").alias("income_sgd"), total("out_flow").alias("expense_sgd")
    )
    return months.withColumn("net_sgd", (F.col("income_sgd") - F.col("expense_sgd")).cast(TOTAL))


def bank_breakdown(rows: DataFrame) -> DataFrame:
    """Turnover by bank and month, both directions added up."""
    return rows.where(~F.col("is_unavailable")).groupBy("bank_name", _month()).agg(
        F.sum(F.coalesce(F.col("converted_sgd"), F.lit(0))).cast(TOTAL).alias("total_sgd")
    )


def disclosure_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count_if("is_approximate").alias("approximate_count"),
        F.count_if("is_unavailable").alias("excluded_count"),
    )


def excluded_rows(rows: DataFrame) -> DataFrame:
    """Ids of the rows that no series contains, as rows: the list grows with the ledger."""
    return rows.where("is_unavailable").select("transaction_id")


GROUP_KEYS = {
    "category": "category",
    "bank": "bank_name",
    "month": "month",
    "category_source": "category_source",
}


def group_summaries(ledger: DataFrame, group_by: str) -> DataFrame:
    """Subtotals per group. They add up original amounts of any currency, despite the names."""
    if group_by not in GROUP_KEYS:
        raise ValueError(f"group key must be one of {sorted(GROUP_KEYS)}, not {group_by!r}")
    key = month_key(F.col("transaction_date")) if group_by == "month" else F.col(GROUP_KEYS[group_by])
    zero = F.lit(0)
    return ledger.groupBy(key.alias("group_key")).agg(
        F.coalesce(F.sum("out_flow"), zero).cast(TOTAL).alias("subtotal_out_flow_sgd"),
        F.coalesce(F.sum("in_flow"), zero).cast(TOTAL).alias("subtotal_in_flow_sgd"),
        F.count("*").alias("transaction_count"),
    )


def groups_by_count(groups: DataFrame) -> DataFrame:
    return groups.orderBy(F.col("transaction_count").desc(), F.col("group_key"))


def top_series(points: DataFrame, keep: int = s.DEFAULTS.named_series) -> DataFrame:
    """The largest series by total, the others summed as ``Other``, zero for every missing month.

    ``points`` (series, month, value) is an aggregate: series x months rows.
    """
    points = cut(points)
    totals = points.groupBy("series").agg(F.sum("value").alias("total"))
    best = totals.orderBy(F.col("total").desc(), F.col("series")).limit(keep).select(
        "series", F.col("series").alias("named")
    )
    labels = points.join(best, "series", "left").select(
        F.coalesce("named", F.lit("Other")).alias("series"), "month", "value"
    )
    folded = labels.groupBy("series", "month").agg(F.sum("value").alias("value"))
    # Every month meets the at most keep + 1 names, read as one small scalar.
    names = labels.agg(F.collect_set("series")).scalar()
    slots = points.select("month").distinct().select("month", F.explode(names).alias("series"))
    return slots.join(folded, ["series", "month"], "left").select(
        "series", "month", F.coalesce("value", F.lit(0)).cast(TOTAL).alias("value")
    )
