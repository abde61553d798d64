"""Date repair, clean-up and acceptance of parsed statements."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import settings as s
from ledgerloom.functions.dates import swapped_day_month
from ledgerloom.functions.decisions import confidence_rank
from ledgerloom.functions.text import is_balance_line, is_unordered_line
from ledgerloom.sources.statements import CHECKED_LINE


def _prepared(lines: Column) -> Column:
    """Each line with its place, its exchanged date and whether it stands outside the print order."""
    return F.transform(
        lines,
        lambda x, i: F.struct(
            i.alias("pos"),
            x.alias("line"),
            swapped_day_month(x["transaction_date"]).alias("other"),
            is_unordered_line(x["description"]).alias("skip"),
        ),
    )


def trusted_date(prepared: Column) -> Column:
    """Latest ordered date that cannot be a day-month mix-up (its day exceeds 12)."""
    sure = F.filter(prepared, lambda x: ~x["skip"] & (F.dayofmonth(x["line"]["transaction_date"]) > 12))
    return F.array_max(F.transform(sure, lambda x: x["line"]["transaction_date"]))


def anchor_date(statement_date: Column, trusted: Column, max_gap: int) -> Column:
    """The statement date as printed or exchanged, if it follows the trusted date closely."""
    last = F.date_add(trusted, max_gap)
    options = F.array(statement_date, swapped_day_month(statement_date))
    return F.array_min(F.filter(options, lambda d: (d >= trusted) & (d <= last)))


def _exchanged(item: Column, last: Column) -> Column:
    """Whether an ordered line is better read with day and month exchanged, after a line of the date ``last``."""
    read, other = item["line"]["transaction_date"], item["other"]
    here, there = F.datediff(read, last), F.datediff(other, last)
    better = (
        F.when((here >= 0) & (there >= 0), there < here)
        .when((here >= 0) | (there >= 0), there >= 0)
        .otherwise(F.abs(there) < F.abs(here))
    )
    return F.coalesce(better, F.lit(False)).cast("int")


def _maps(ordered: Column) -> Column:
    """For each line what it becomes (0 as read, 1 exchanged) if the line before is 0 (lower bit) or 1 (upper bit)."""
    before = F.concat(F.array(F.lit(None)), F.slice(ordered, 1, F.greatest(F.size(ordered) - 1, F.lit(0))))
    maps = F.zip_with(
        F.when(F.size(ordered) > 0, ordered),
        before,
        lambda x, b: _exchanged(x, b["line"]["transaction_date"]) + 2 * _exchanged(x, b["other"]),
    )
    return F.coalesce(maps, F.array().cast("array<int>")).cast("array<int>")


def _scanned(maps: Column) -> Column:
    """Each line's map after those of all lines before it, by doubling: pass ``j`` composes with the one 2^j before."""

    def shift(name: str, number: Column, by: Column) -> Column:
        return F.call_function(name, number, by.cast("int"))

    def after(first: Column, then: Column) -> Column:
        low = shift("shiftright", then, first.bitwiseAND(1)).bitwiseAND(1)
        high = shift("shiftright", then, shift("shiftright", first, F.lit(1)).bitwiseAND(1)).bitwiseAND(1)
        return low + 2 * high

    def pass_over(scan: Column, j: Column) -> Column:
        far = shift("shiftleft", F.lit(1), j)
        return F.transform(scan, lambda x, i: F.when(i >= far, after(F.get(scan, i - far), x)).otherwise(x)).cast("array<int>")

    passes = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(maps), F.lit(1)))).cast("int"))
    return F.aggregate(passes, maps, pass_over)


def repaired_lines(ordered: Column, skipped: Column, scanned: Column, anchor: Column) -> Column:
    """All lines in print order with their dates."""

    def dated(item: Column, exchanged: Column) -> Column:
        day = F.when(exchanged, item["other"]).otherwise(item["line"]["transaction_date"])
        return F.struct(item["pos"].alias("pos"), item["line"].withField("transaction_date", day).alias("line"))

    in_order = F.zip_with(ordered, scanned, lambda x, m: dated(x, m.bitwiseAND(1) == 1))
    outside = F.transform(skipped, lambda x: dated(x, x["other"] == anchor))
    return F.transform(F.sort_array(F.concat(in_order, outside)), lambda x: x["line"])


def repair_statements(parsed: DataFrame, cfg: s.Settings = s.DEFAULTS) -> DataFrame:
    """Statements with repaired line dates; those exchanged as a whole stay as they are.

    Each ordered line is read so that the sequence moves on least, which depends on how the line before is read. A line
    is thus a map between two states, maps compose, and the dates are a prefix scan over them: a number of
    passes that grows with the logarithm of the lines, where a fold that collects its results would copy them at every line.
    The first ordered line stays as it is read. Lines outside of the print order follow the statement's date instead.
    """
    typed = parsed.withColumn("lines", F.col("lines").cast(f"array<{CHECKED_LINE}>"))
    prepared = typed.withColumn("prepared", _prepared(F.col("lines")))
    anchored = prepared.withColumns(
        {
            "anchor": anchor_date(F.col("statement_date"), trusted_date(F.col("prepared")), cfg.statement_date_max_gap_days),
            "in_order": F.filter("prepared", lambda x: ~x["skip"]),
            "outside": F.filter("prepared", lambda x: x["skip"]),
        }
    )
    scanned = anchored.withColumn("maps", _maps(F.col("in_order"))).withColumn("scan", _scanned(F.col("maps")))
    fixed = repaired_lines(F.col("in_order"), F.col("outside"), F.col("scan"), F.col("anchor"))
    return scanned.withColumn(
        "lines", F.when(F.col("valid") & ~F.col("swapped"), fixed).otherwise(F.col("lines"))
    ).drop("prepared", "anchor", "in_order", "outside", "maps", "scan")


def valid_lines(statements: DataFrame) -> DataFrame:
    """(statement_id, pos, line) of the statements that pass the schema check."""
    return statements.select(
        "statement_id", F.posexplode(F.when(F.col("valid"), F.col("lines"))).alias("pos", "line")
    )


def gate_statements(repaired: DataFrame, as_of: dt.date, cfg: s.Settings = s.DEFAULTS) -> DataFrame:
    """Drops balance lines and future dates, then names the first failing check."""
    kept = F.filter(
        "lines", lambda x: ~is_balance_line(x["description"]) & (x["transaction_date"] <= F.lit(as_of))
    )
    cleaned = repaired.withColumn("lines", kept)
    least = s.CONFIDENCE_LEVELS.index(cfg.confidence_threshold)
    reason = (
        F.when(~F.col("valid"), F.lit("schema validation failed"))
        .when(F.col("bank_name").isNull() | F.col("currency").isNull(), F.lit("bank or currency missing"))
        .when(F.size("lines") == 0, F.lit("no transactions"))
        .when(confidence_rank(F.col("confidence")) < least, F.lit("confidence below threshold"))
    )
    return cleaned.withColumn("reason", reason)


def accepted_lines(gated: DataFrame) -> DataFrame:
    """Ledger lines of the accepted statements, in print order (``pos``).

    Rejected statements explode to nothing. A filter would be pushed below the parsing and
    evaluate it once more per reference.
    """
    return gated.select(
        "statement_id",
        "bank_name",
        "currency",
        F.posexplode(F.when(F.col("reason").isNull(), F.col("lines"))).alias("pos", "line"),
    ).select(
        "statement_id",
        "pos",
        "bank_name",
        "currency",
        "line.transaction_date",
        "line.description",
        "line.amount",
        "line.direction",
        F.col("line.printed").alias("printed_sgd"),
    )


def dedupe_statements(files: DataFrame, known: DataFrame) -> DataFrame:
    """Outcome per file: duplicates of processed contents are skipped, failures are not recorded.

    ``files``: file_id (arrival order), content_hash, readable. ``known``: content_hash and
    statement_id of earlier runs. The first readable copy of a new content is processed;
    only copies after it are duplicates. One minimum per hash, so a content that fills a
    third of the batch needs no group in one task.
    """
    firsts = files.groupBy("content_hash").agg(
        F.min(F.when(F.col("readable"), F.col("file_id"))).alias("first_id")
    )
    earlier = known.groupBy("content_hash").agg(F.min("statement_id").alias("known_id"))
    facts = firsts.join(earlier, "content_hash", "left")
    late = F.coalesce(F.col("file_id") > F.col("first_id"), F.lit(False))
    outcome = (
        F.when(F.col("known_id").isNotNull() | late, F.lit("skipped_duplicate"))
        .when(F.col("readable"), F.lit("processed"))
        .otherwise(F.lit("failed"))
    )
    return files.join(facts, "content_hash").select(
        "file_id",
        "content_hash",
        outcome.alias("outcome"),
        F.when(F.col("known_id").isNotNull(), F.col("known_id")).when(late, F.col("first_id")).alias("duplicate_of"),
    )


def run_counters(outcomes: DataFrame) -> DataFrame:
    """Counters and final status per run."""
    counts = outcomes.groupBy("run_id").agg(
        F.count("*").alias("files_found"),
        F.count_if(F.col("outcome") == "processed").alias("files_processed"),
        F.count_if(F.col("outcome") == "skipped_duplicate").alias("files_skipped"),
        F.count_if(F.col("outcome") == "failed").alias("files_failed"),
    )
    failed = F.col("files_failed") > 0
    return counts.withColumn(
        "status", F.when(failed, F.lit("completed_with_failures")).otherwise(F.lit("completed"))
    )
