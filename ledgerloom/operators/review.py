"""Review decisions applied to state tables.

A decisions table is judged against the state: every decision gets a ``reason`` when it is
refused (null when it holds), and a new version of the state is derived from the accepted
ones. Something pending is resolved once: of several decisions on one item the first counts.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import settings as s


def _first_only(decisions: DataFrame, key: str) -> DataFrame:
    """Marks decisions that come after another one on the same item."""
    firsts = decisions.groupBy(key).agg(F.min("decision_id").alias("first_decision"))
    return decisions.join(firsts, key).withColumn("late", F.col("decision_id") > F.col("first_decision")).drop(
        "first_decision"
    )


def _open_reason(status: Column, wanted: str) -> Column:
    return (
        F.when(status.isNull(), F.lit("not found"))
        .when((status != wanted) | F.col("late"), F.lit(f"not {wanted}"))
    )


def apply_corrections(decisions: DataFrame, ledger: DataFrame, categories: DataFrame) -> DataFrame:
    """Outcome of manual corrections (decision_id, transaction_id, category_id).

    The category must exist and be active. An accepted correction makes the row manual and
    opens one re-scan job, named by the decision.
    """
    names = categories.select("category_id", F.col("name").alias("new_category"), "active")
    known = ledger.select("transaction_id", F.col("category").alias("old_category"))
    judged = decisions.join(known, "transaction_id", "left").join(names, "category_id", "left")
    reason = (
        F.when(F.col("old_category").isNull(), F.lit("transaction not found"))
        .when(F.col("new_category").isNull(), F.lit("category not found"))
        .when(~F.col("active"), F.lit("category inactive"))
    )
    fine = F.col("reason").isNull()
    return judged.withColumn("reason", reason).select(
        "decision_id",
        "transaction_id",
        "reason",
        F.when(fine, F.col("new_category")).alias("category"),
        F.when(fine, F.lit(s.MANUAL)).alias("category_source"),
        F.when(fine, F.col("decision_id")).alias("job_id"),
    )


def corrected_ledger(ledger: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The ledger after the outcomes; the last accepted decision on a row wins."""
    last = (
        outcomes.where(F.col("reason").isNull())
        .groupBy("transaction_id")
        .agg(F.max_by(F.struct("category", "category_source"), "decision_id").alias("new"))
    )
    was = ledger.withColumnsRenamed({"category": "was", "category_source": "by"})
    return was.join(last, "transaction_id", "left").select(
        *[c for c in ledger.columns if c not in ("category", "category_source")],
        F.coalesce("new.category", "was").alias("category"),
        F.coalesce("new.category_source", "by").alias("category_source"),
    )


def apply_proposals(decisions: DataFrame, proposals: DataFrame) -> DataFrame:
    """Approve or reject pending proposals; an approval turns the row into a similarity decision."""
    state = proposals.select("proposal_id", "transaction_id", "proposed_category_id", "status")
    judged = _first_only(decisions, "proposal_id").join(state, "proposal_id", "left")
    judged = judged.withColumn("reason", _open_reason(F.col("status"), "pending"))
    approved = F.col("reason").isNull() & (F.col("action") == "approve")
    return judged.select(
        "decision_id",
        "proposal_id",
        "reason",
        F.when(F.col("reason").isNull(), F.when(approved, F.lit("approved")).otherwise(F.lit("rejected")))
        .otherwise(F.col("status")).alias("status"),
        F.when(approved, F.col("transaction_id")).alias("transaction_id"),
        F.when(approved, F.col("proposed_category_id")).alias("category_id"),
        F.when(approved, F.lit("similarity")).alias("category_source"),
    )


def apply_disagreements(decisions: DataFrame, disagreements: DataFrame) -> DataFrame:
    """Resolve by one of the two offered categories, whose origin becomes the source, or reject."""
    state = disagreements.select(
        "disagreement_id", "transaction_id", "similarity_category_id", "llm_category_id", "status"
    )
    judged = _first_only(decisions, "disagreement_id").join(state, "disagreement_id", "left")
    chosen, reject = F.col("chosen_category_id"), F.col("action") == "reject"
    source = F.when(chosen == F.col("similarity_category_id"), F.lit("similarity")).when(
        chosen == F.col("llm_category_id"), F.lit("llm")
    )
    judged = judged.withColumn("origin", F.when(~reject, source))
    reason = F.coalesce(
        _open_reason(F.col("status"), "pending"),
        F.when(~reject & F.col("origin").isNull(), F.lit("not one of the two categories")),
    )
    judged = judged.withColumn("reason", reason)
    taken = F.col("reason").isNull()
    return judged.select(
        "decision_id",
        "disagreement_id",
        "reason",
        F.when(taken, F.when(reject, F.lit("rejected")).otherwise(F.lit("resolved")))
        .otherwise(F.col("status")).alias("status"),
        F.when(taken & ~reject, chosen).alias("category_id"),
        F.when(taken, F.col("origin")).alias("category_source"),
    )


def apply_match_decisions(decisions: DataFrame, matches: DataFrame) -> DataFrame:
    state = matches.select("match_id", "payment_id", "status")
    judged = _first_only(decisions, "match_id").join(state, "match_id", "left")
    judged = judged.withColumn("reason", _open_reason(F.col("status"), "pending"))
    approve = F.col("action") == "approve"
    return judged.select(
        "decision_id",
        "match_id",
        "payment_id",
        "reason",
        F.when(F.col("reason").isNull(), F.when(approve, F.lit("approved")).otherwise(F.lit("rejected")))
        .otherwise(F.col("status")).alias("status"),
    )


def trusted_payments(payments: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One approval makes a payment trusted for good."""
    approved = outcomes.where(F.col("reason").isNull() & (F.col("status") == "approved"))
    earned = approved.select("payment_id").distinct().withColumn("earned", F.lit(True))
    return payments.join(earned, "payment_id", "left").withColumn(
        "is_trusted", F.col("is_trusted") | F.coalesce("earned", F.lit(False))
    ).drop("earned")


def apply_suggestion_decisions(
    decisions: DataFrame, suggestions: DataFrame, as_of: dt.date
) -> DataFrame:
    """Dismiss for good, or add a payment made of the suggestion and the overrides given."""
    state = suggestions.select(
        "suggestion_id", "description_pattern", "suggested_amount", "suggested_category_id", "status"
    )
    judged = _first_only(decisions, "suggestion_id").join(state, "suggestion_id", "left")
    frequency = F.coalesce("frequency", F.lit("monthly"))
    due_day = F.coalesce("due_day", F.lit(as_of.day))
    add = F.col("action") == "add"
    shape = (
        F.when(~frequency.isin("monthly", "annual"), F.lit("unknown frequency"))
        .when((frequency == "annual") & F.col("due_month").isNull(), F.lit("annual without due month"))
        .when((frequency == "monthly") & F.col("due_month").isNotNull(), F.lit("monthly with due month"))
        .when(~due_day.between(1, 31), F.lit("due day out of range"))
        .when((frequency == "annual") & ~F.col("due_month").between(1, 12), F.lit("due month out of range"))
    )
    judged = judged.withColumn("reason", F.coalesce(_open_reason(F.col("status"), "new"), F.when(add, shape)))
    added = F.col("reason").isNull() & add
    return judged.select(
        "decision_id",
        "suggestion_id",
        "reason",
        F.when(F.col("reason").isNull(), F.when(add, F.lit("added")).otherwise(F.lit("dismissed")))
        .otherwise(F.col("status")).alias("status"),
        F.when(added, F.coalesce("name", "description_pattern")).alias("name"),
        F.when(added, F.coalesce("expected_amount", "suggested_amount")).alias("expected_amount"),
        F.when(added, frequency).alias("frequency"),
        F.when(added, F.col("due_month")).alias("due_month"),
        F.when(added, due_day).alias("due_day"),
        F.when(added, F.coalesce("category_id", "suggested_category_id")).alias("category_id"),
    )


def reset_embedding_status(old: DataFrame, new: DataFrame) -> DataFrame:
    """Renamed payments wait for a vector again."""
    before = old.select("payment_id", F.col("name").alias("old_name"), "embedding_status")
    renamed = F.col("old_name").isNull() | (F.col("name") != F.col("old_name"))
    return new.join(before, "payment_id", "left").select(
        *new.columns,
        F.when(renamed, F.lit("pending")).otherwise(F.col("embedding_status")).alias("embedding_status"),
    )


def mark_embedded(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pending rows are completed where a vector was written, and only there."""
    written = vectors.select(F.col("id").alias("transaction_id")).distinct().withColumn("written", F.lit(True))
    done = F.coalesce("written", F.lit(False)) & (F.col("embedding_status") == "pending")
    return rows.join(written, "transaction_id", "left").withColumn(
        "embedding_status", F.when(done, F.lit("completed")).otherwise(F.col("embedding_status"))
    ).drop("written")


def upsert_vectors(existing: DataFrame, updates: DataFrame) -> DataFrame:
    """(id, vector, version) with the latest version per id: repeating an update changes nothing.

    Of unlike vectors under one version the greatest stays, compared component by component.
    """
    latest = F.max(F.struct("version", "vector")).alias("latest")
    return existing.unionByName(updates).groupBy("id").agg(latest).select("id", "latest.vector", "latest.version")


# --- pending lists ---------------------------------------------------------------------------


def proposals_enriched(proposals: DataFrame, ledger: DataFrame, categories: DataFrame, jobs: DataFrame) -> DataFrame:
    rows = ledger.select("transaction_id", "transaction_date", "description", "amount", "category")
    names = categories.select(
        F.col("category_id").alias("proposed_category_id"), F.col("name").alias("proposed_category")
    )
    sources = jobs.select("job_id", "source_transaction_id")
    pending = proposals.where("status = 'pending'").drop("created_at")
    return pending.join(rows, "transaction_id").join(names, "proposed_category_id").join(sources, "job_id")


def disagreements_enriched(disagreements: DataFrame, ledger: DataFrame, categories: DataFrame) -> DataFrame:
    """Open disagreements with the names of the one dimension in its three roles."""

    def role(name: str) -> DataFrame:
        return categories.select(F.col("category_id").alias(f"{name}_category_id"), F.col("name").alias(name))

    rows = ledger.select("transaction_id", "description", "amount")
    return (
        disagreements.where("status = 'pending'")
        .drop("created_at")
        .join(rows, "transaction_id")
        .join(role("similarity"), "similarity_category_id")
        .join(role("llm"), "llm_category_id")
        .join(role("resolved"), "resolved_category_id", "left")
    )


def matches_enriched(matches: DataFrame, payments: DataFrame, ledger: DataFrame) -> DataFrame:
    named = payments.select("payment_id", F.col("name").alias("payment_name"))
    rows = ledger.select("transaction_id", "transaction_date", "description", "category")
    pending = matches.where("status = 'pending'").drop("created_at")
    return pending.join(named, "payment_id").join(rows, "transaction_id")


def pending_counts(proposals: DataFrame, disagreements: DataFrame) -> DataFrame:
    parts = [
        frame.where("status = 'pending'").agg(F.count("*").alias("n")) for frame in (proposals, disagreements)
    ]
    return parts[0].unionByName(parts[1]).agg(F.sum("n").alias("pending_count"))


def latest_instance(rows: DataFrame, by: str, *columns: str) -> DataFrame:
    """The latest row, without sorting the rest."""
    return rows.agg(F.max_by(F.struct(*columns), by).alias("last")).select("last.*")
