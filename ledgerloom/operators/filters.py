"""Ledger filters. A filter record is folded into one predicate that reaches the scan."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import settings as s
from ledgerloom.functions.amounts import magnitude
from ledgerloom.functions.text import is_balance_line


@dataclass(frozen=True)
class LedgerFilter:
    date_from: dt.date | None = None
    date_to: dt.date | None = None
    bank: str | None = None
    category: str | None = None
    flow_direction: str | None = None
    currency: str | None = None
    text_search: str | None = None
    category_source: str | None = None


def date_range(day: Column, date_from: dt.date | None, date_to: dt.date | None) -> Column:
    keep = F.lit(True)
    if date_from is not None:
        keep = keep & (day >= F.lit(date_from))
    if date_to is not None:
        keep = keep & (day <= F.lit(date_to))
    return keep


def flow_direction(direction: str) -> Column:
    if direction not in ("in", "out"):
        raise ValueError(f"flow direction must be in or out, not {direction!r}")
    return F.col("in_flow" if direction == "in" else "out_flow").isNotNull()


def currency_is(code: str) -> Column:
    if not re.fullmatch(s.CURRENCY_CODE, code):
        raise ValueError(f"{code!r} is not an ISO 4217 currency code")
    return F.col("currency") == code


def text_contains(needle: str) -> Column:
    """Case-insensitive; ``%`` and ``_`` in the needle act as wildcards."""
    return F.col("description").ilike(f"%{needle}%")


def source_is(source: str) -> Column:
    if source not in s.CATEGORY_SOURCES:
        raise ValueError(f"unknown category source {source!r}")
    return F.col("category_source") == source


def predicate(f: LedgerFilter) -> Column:
    """All parts of the record but the category name."""
    keep = date_range(F.col("transaction_date"), f.date_from, f.date_to)
    if f.bank is not None:
        keep = keep & (F.col("bank_name") == f.bank)
    if f.flow_direction is not None:
        keep = keep & flow_direction(f.flow_direction)
    if f.currency is not None:
        keep = keep & currency_is(f.currency)
    if f.text_search is not None:
        keep = keep & text_contains(f.text_search)
    if f.category_source is not None:
        keep = keep & source_is(f.category_source)
    return keep


def by_category_name(ledger: DataFrame, categories: DataFrame, name: str) -> DataFrame:
    wanted = categories.where(F.col("name") == name).select("category_id")
    return ledger.join(wanted, "category_id", "left_semi")


def apply_filter(ledger: DataFrame, categories: DataFrame, f: LedgerFilter) -> DataFrame:
    rows = ledger.where(predicate(f))
    return rows if f.category is None else by_category_name(rows, categories, f.category)


def amount_projection(ledger: DataFrame) -> DataFrame:
    return ledger.withColumn("magnitude", magnitude(F.col("out_flow"), F.col("in_flow")))


def direction_split(lines: DataFrame) -> DataFrame:
    """Amount and direction as one of two flows."""
    return lines.withColumn("out_flow", F.when(F.col("direction") == "out", F.col("amount"))).withColumn(
        "in_flow", F.when(F.col("direction") == "in", F.col("amount"))
    )


def drop_balance_lines(lines: DataFrame) -> DataFrame:
    return lines.where(~is_balance_line(F.col("description")))


def drop_future_dated(lines: DataFrame, as_of: dt.date) -> DataFrame:
    return lines.where(F.col("transaction_date") <= F.lit(as_of))


def unsure_rows(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("category_source") == "unsure")


def eligible_candidates(ledger: DataFrame, categories: DataFrame) -> DataFrame:
    """Decided rows with what matching needs of them."""
    names = categories.select("category_id", F.col("name").alias("category_name"))
    return (
        ledger.where(F.col("category_source") != "unsure")
        .join(names, "category_id")
        .select(
            "transaction_id",
            "description",
            "category_name",
            "category_source",
            magnitude(F.col("out_flow"), F.col("in_flow")).alias("amount"),
        )
    )


def active_whitelist(categories: DataFrame) -> DataFrame:
    return categories.where(F.col("active") & (F.col("name") != s.UNSURE)).select("name")


def default_range(as_of: dt.date) -> tuple[Column, Column]:
    """First day of the month five months back, and the day itself."""
    return F.trunc(F.add_months(F.lit(as_of), -5), "month"), F.lit(as_of)


def check_scope(date_from: dt.date | None, date_to: dt.date | None, everything: bool) -> None:
    """A question about the ledger needs a proper date range unless it is about all of it."""
    if everything:
        return
    if date_from is None or date_to is None:
        raise ValueError("a date range is required unless all transactions are asked for")
    if date_from > date_to:
        raise ValueError("date_from must not be after date_to")


def question_scope(ledger: DataFrame, as_of: dt.date, months: int = 3) -> DataFrame:
    """Default scope of a question: the last three months up to ``as_of``."""
    day = F.col("transaction_date")
    return ledger.where((day >= F.add_months(F.lit(as_of), -months)) & (day <= F.lit(as_of)))


def context_window(ledger: DataFrame, anchors: DataFrame, days: int = 30) -> DataFrame:
    """Per anchor row, number and total of the rows within ``days`` of it.

    Day totals are formed first, so each anchor meets at most ``2 * days + 1`` rows however
    many transactions fall on a day.
    """
    per_day = ledger.groupBy("transaction_date").agg(
        F.count("*").alias("day_rows"), F.sum("amount").alias("day_amount")
    )
    window_days = F.sequence(F.date_sub("anchor_date", days), F.date_add("anchor_date", days))
    dates = (
        anchors.select(F.col("transaction_date").alias("anchor_date"))
        .distinct()
        .withColumn("transaction_date", F.explode(window_days))
        .join(per_day, "transaction_date")
        .groupBy("anchor_date")
        .agg(F.sum("day_rows").alias("rows_near"), F.sum("day_amount").alias("amount_near"))
    )
    return anchors.join(dates, anchors["transaction_date"] == dates["anchor_date"]).drop("anchor_date")


def context_rows(ledger: DataFrame, anchors: DataFrame, days: int = 30) -> DataFrame:
    """``anchor_date`` and the row, for every row within ``days`` of a day that has an anchor.

    A window depends on the anchor's day only, so anchors of one day share it, and a row is in at most ``2 * days + 1``
    windows whatever their number. The days of all windows, bounded by the calendar, meet the ledger in an equi-join
    on the day; a day that holds a large part of the rows is a skewed key that the join may split.
    """
    window_days = F.sequence(F.date_sub("anchor_date", days), F.date_add("anchor_date", days))
    wanted = anchors.select(F.col("transaction_date").alias("anchor_date")).distinct()
    return wanted.withColumn("transaction_date", F.explode(window_days)).join(ledger, "transaction_date").select("anchor_date", *ledger.columns)
