"""Integrity rules of the tables, counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import settings as s


def broken(**rules: Column) -> list[Column]:
    return [F.count_if(F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()]


def count_violations(table: str, rows: DataFrame, **rules: Column) -> DataFrame:
    """(table, rule, violations) for predicates that name bad rows: one pass over the table."""
    counted = rows.agg(*broken(**rules))
    return counted.unpivot([], list(rules), "rule", "violations").select(
        F.lit(table).alias("table"), "rule", "violations"
    )


def count_repeats(table: str, rule: str, rows: DataFrame, *keys: str) -> DataFrame:
    """Number of keys that occur more than once."""
    repeated = rows.groupBy(*keys).count().where("count > 1")
    return repeated.agg(F.count("*").alias("violations")).select(
        F.lit(table).alias("table"), F.lit(rule).alias("rule"), "violations"
    )


def count_keyed(table: str, rows: DataFrame, rule: str, keys: tuple[str, ...], **rules: Column) -> DataFrame:
    """Keys that occur more than once and rows that break ``rules``, in one pass over the table."""
    by_key = rows.groupBy(*keys).agg(F.count("*").alias("_rows"), *broken(**rules))
    counted = by_key.agg(
        F.count_if(F.col("_rows") > 1).alias(rule), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in rules]
    )
    return counted.unpivot([], [rule, *rules], "rule", "violations").select(F.lit(table).alias("table"), "rule", "violations")


def audit(tables: dict[str, DataFrame]) -> DataFrame:
    """Violations of every rule whose table is given."""
    c = F.col
    live = c("status").isin(*s.LIVE_MATCH_STATUSES)
    single = (c("out_flow").isNotNull() & c("in_flow").isNull()) | (c("out_flow").isNull() & c("in_flow").isNotNull())
    due = c("due_day").between(1, 31)
    checks = {
        "ledger": lambda t: [
            count_keyed(
                "ledger", t, "unique_id", ("transaction_id",),
                one_positive_flow=~(single & (F.coalesce("out_flow", "in_flow") > 0)),
                unavailable_has_no_amount=c("is_unavailable") & (c("converted_sgd").isNotNull() | c("fx_rate").isNotNull()),
                not_both_flags=c("is_unavailable") & c("is_approximate"),
                known_source=~c("category_source").isin(*s.CATEGORY_SOURCES),
            )
        ],
        "run_files": lambda t: [
            count_violations(
                "run_files", t, failed_has_reason=(c("outcome") == "failed") & c("failure_reason").isNull()
            )
        ],
        "runs": lambda t: [
            t.agg((F.count_if(c("status") == "running") > 1).cast("bigint").alias("violations")).select(
                F.lit("runs").alias("table"), F.lit("one_active_run").alias("rule"), "violations"
            )
        ],
        "payments": lambda t: [
            count_violations(
                "payments", t,
                due_month_fits_frequency=((c("frequency") == "annual") != c("due_month").isNotNull()),
                due_day_in_month=~due,
            )
        ],
        "categories": lambda t: [count_repeats("categories", "unique_name", t, "name")],
        "files": lambda t: [count_repeats("files", "unique_hash", t, "content_hash")],
        "fx_rates": lambda t: [
            count_repeats("fx_rates", "unique_pair_and_day", t, "from_currency", "to_currency", "rate_date")
        ],
        "suggestions": lambda t: [count_repeats("suggestions", "unique_pattern", t, "description_pattern")],
        "matches": lambda t: [count_repeats("matches", "one_live_match", t.where(live), "payment_id", "cycle_period")],
        "proposals": lambda t: [
            count_repeats("proposals", "one_pending", t.where("status = 'pending'"), "transaction_id", "job_id")
        ],
        "disagreements": lambda t: [
            count_violations(
                "disagreements", t,
                resolved_by_offered_category=(c("status") == "resolved")
                & ~F.coalesce(
                    (c("resolved_category_id") == c("similarity_category_id"))
                    | (c("resolved_category_id") == c("llm_category_id")),
                    F.lit(False),
                ),
            )
        ],
        "backups": lambda t: [
            count_keyed(
                "backups", t, "one_per_day", ("backup_date",),
                category_fits_outcome=((c("outcome") == "failed") != c("failure_category").isNotNull()),
            )
        ],
    }
    parts = [part for name, rows in tables.items() for part in checks[name](rows)]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
