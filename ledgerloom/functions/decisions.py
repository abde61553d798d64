"""Decision tables as chained conditions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom import settings as s
from ledgerloom.functions.amounts import amounts_in_range


def confidence_rank(level: Column) -> Column:
    rank = F.lit(None).cast("int")
    for position, name in enumerate(s.CONFIDENCE_LEVELS):
        rank = F.when(level == name, F.lit(position)).otherwise(rank)
    return rank


def match_status(trusted: Column, amount: Column, expected: Column, cfg: s.Settings = s.DEFAULTS) -> Column:
    """A trusted payment within tolerance is applied at once, all else waits for review."""
    close = amounts_in_range(amount, expected, cfg.trusted_ratio, cfg.trusted_floor)
    return F.when(trusted & close, F.lit("auto_applied")).otherwise(F.lit("pending"))


def decide_category(similar: Column, llm: Column) -> Column:
    """Struct of category, source, kept model label and whether both opinions clash.

    ``similar`` is null without a precedent; ``llm`` is null or UNSURE without an opinion.
    """
    opinion = F.when(llm != s.UNSURE, llm)
    has_similar, has_opinion = similar.isNotNull(), opinion.isNotNull()
    clash = has_similar & has_opinion & (similar != opinion)
    clash = F.coalesce(clash, F.lit(False))
    category = F.when(clash, F.lit(s.UNSURE)).otherwise(F.coalesce(similar, opinion, F.lit(s.UNSURE)))
    source = (
        F.when(clash, F.lit("unsure"))
        .when(has_similar, F.lit("similarity"))
        .when(has_opinion, F.lit("llm"))
        .otherwise(F.lit("unsure"))
    )
    return F.struct(
        category.alias("category"),
        source.alias("source"),
        opinion.alias("llm_suggested"),
        clash.alias("disagrees"),
    )


def payment_status(
    frequency: Column, match: Column, current_due: Column, next_due: Column, as_of: Column, lead_days: int
) -> Column:
    """Status of the cycle now due, from its live match if there is one."""
    return (
        F.when(match == "pending", F.lit("pending_review"))
        .when(match.isNotNull() & (F.datediff(next_due, as_of) <= lead_days), F.lit("due_soon"))
        .when(match.isNotNull(), F.lit("paid"))
        .when(current_due < as_of, F.lit("overdue"))
        .otherwise(F.lit("due_soon"))
    )
