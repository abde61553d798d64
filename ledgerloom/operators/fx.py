"""Exchange rates: exact, latest earlier, and the choice between all conversion sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import settings as s

MONEY = "decimal(18,2)"


def to_reporting(rates: DataFrame, reporting: str) -> DataFrame:
    return rates.where(F.col("to_currency") == reporting).select("from_currency", "rate_date", "rate")


def exact_rates(ledger: DataFrame, rates: DataFrame, reporting: str = s.REPORTING_CURRENCY) -> DataFrame:
    """Rows with a rate of their own day."""
    r = to_reporting(rates, reporting)
    on = (ledger["currency"] == r["from_currency"]) & (ledger["transaction_date"] == r["rate_date"])
    return ledger.join(r, on, "inner").drop("from_currency", "rate_date")


def daily_rates(rates: DataFrame, reporting: str = s.REPORTING_CURRENCY) -> DataFrame:
    """The rate in force per currency and day, from each rate's day up to the next rate's.

    The window and the expansion touch the rates alone (currencies x days), so the as-of
    join of the ledger becomes an equi-join and the ledger is neither sorted nor grouped by
    currency. The last rate of a currency has ``open_end`` set and covers its own day only.
    """
    following = F.lead("rate_date").over(Window.partitionBy("from_currency").orderBy("rate_date"))
    spans = to_reporting(rates, reporting).withColumn("next_date", following)
    last_day = F.coalesce(F.date_sub("next_date", 1), F.col("rate_date"))
    return spans.select(
        F.col("from_currency").alias("fx_currency"),
        F.explode(F.sequence("rate_date", last_day)).alias("fx_day"),
        F.col("rate").alias("fx_rate"),
        F.col("rate_date").alias("fx_rate_date"),
        F.col("next_date").isNull().alias("open_end"),
    )


def asof_rates(ledger: DataFrame, rates: DataFrame, reporting: str = s.REPORTING_CURRENCY) -> DataFrame:
    """Every row with the latest rate on or before its day, null if there is none."""
    days = daily_rates(rates, reporting)
    within = days.drop("open_end")
    # One row per currency code, of which ISO 4217 has under two hundred.
    after = F.broadcast(
        days.where("open_end").select(
            F.col("fx_currency").alias("last_currency"),
            F.col("fx_rate").alias("last_rate"),
            F.col("fx_rate_date").alias("last_date"),
        )
    )
    joined = ledger.join(
        within,
        (ledger["currency"] == within["fx_currency"]) & (ledger["transaction_date"] == within["fx_day"]),
        "left",
    ).join(
        after,
        (ledger["currency"] == after["last_currency"]) & (ledger["transaction_date"] > after["last_date"]),
        "left",
    )
    return joined.select(
        *ledger.columns,
        F.coalesce("fx_rate", "last_rate").alias("rate"),
        F.coalesce("fx_rate_date", "last_date").alias("rate_date"),
    )


def resolve_conversion(ledger: DataFrame, rates: DataFrame, reporting: str = s.REPORTING_CURRENCY) -> DataFrame:
    """Converted amount by priority: printed, already reporting currency, exact, earlier, none."""
    rated = asof_rates(ledger, rates, reporting)
    printed = F.col("printed_sgd").isNotNull()
    same = F.col("currency") == reporting
    by_rate = F.bround(F.col("amount") * F.col("rate"), 2).cast(MONEY)
    source = (
        F.when(printed, F.lit("printed"))
        .when(same, F.lit("identity"))
        .when(F.col("rate_date") == F.col("transaction_date"), F.lit("exact"))
        .when(F.col("rate_date").isNotNull(), F.lit("asof"))
        .otherwise(F.lit("unavailable"))
    )
    rated = rated.withColumn("conversion_source", source)
    used = F.col("conversion_source").isin("exact", "asof")
    return rated.select(
        *ledger.columns,
        "conversion_source",
        F.when(printed, F.col("printed_sgd"))
        .when(same, F.col("amount"))
        .when(used, by_rate)
        .cast(MONEY)
        .alias("converted_sgd"),
        (F.col("conversion_source") == "asof").alias("is_approximate"),
        (F.col("conversion_source") == "unavailable").alias("is_unavailable"),
        F.when(used, F.col("rate")).alias("fx_rate"),
    )
