"""Training examples from the ledger, their split, and scores of predictions."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import settings as s
from ledgerloom.functions.amounts import amount_label
from ledgerloom.runtime import cut

SPLITTERS = 200


def eligible_for_training(ledger: DataFrame, proposals: DataFrame) -> DataFrame:
    """Manual rows, and similarity rows that a reviewer approved."""
    approved = (
        proposals.where("status = 'approved'").select("transaction_id").distinct().withColumn("approved", F.lit(True))
    )
    source = F.col("category_source")
    keep = (source == s.MANUAL) | ((source == "similarity") & F.coalesce("approved", F.lit(False)))
    return (
        ledger.where(source.isin(s.MANUAL, "similarity"))
        .join(approved, "transaction_id", "left")
        .where(keep)
        .select("transaction_id", "description", F.col("converted_sgd").alias("amount_sgd"), "category", "category_source")
    )


def source_breakdown(eligible: DataFrame) -> DataFrame:
    """Per source the usable rows and those left out for want of an amount."""
    return eligible.groupBy("category_source").agg(
        F.count("amount_sgd").alias("usable"), F.count_if(F.col("amount_sgd").isNull()).alias("excluded")
    )


def kth_smallest(rows: DataFrame, column: str, k: int):
    """The k-th smallest value (from 1), found by narrowing a value range.

    Counts between a few hundred sampled values show which range holds the value, until the range
    holds one value. The sample affects the number of rounds, not the answer; no rows are sorted.
    """
    rows = rows.select(column)
    while True:
        n = rows.count()
        if not 1 <= k <= n:
            raise ValueError(f"there is no value number {k} among {n}")
        sample = rows.orderBy(F.xxhash64(column, F.lit(n)), column).limit(SPLITTERS).distinct().collect()
        cuts = sorted(r[0] for r in sample)
        place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(column)))
        counts = {r["place"]: r["count"] for r in rows.groupBy(place.alias("place")).count().collect()}
        for here in itertools.count():
            size = counts.get(here, 0)
            if k <= size:
                break
            k -= size
        if size == n:
            # All rows in one range: a single value that repeats, or cuts outside of it.
            low, high = rows.agg(F.min(column), F.max(column)).first()
            if low == high:
                return low
        if here > 0:
            rows = rows.where(F.col(column) > F.lit(cuts[here - 1]))
        if here < len(cuts):
            rows = rows.where(F.col(column) <= F.lit(cuts[here]))


def train_val_split(usable: DataFrame, ratio: float = s.DEFAULTS.train_ratio) -> DataFrame:
    """The first ``int(n * ratio)`` rows by id are for training, the others for validation."""
    ids = cut(usable.select("transaction_id"))
    n_train = int(ids.count() * ratio)
    if n_train == 0:
        return usable.withColumn("split", F.lit("val"))
    last = kth_smallest(ids, "transaction_id", n_train)
    return usable.withColumn("split", F.when(F.col("transaction_id") <= F.lit(last), "train").otherwise("val"))


def whitelist_text(whitelist: DataFrame) -> Column:
    """The category names as prompts list them: one short scalar."""
    return whitelist.agg(F.array_join(F.sort_array(F.collect_list("name")), ", ")).scalar()


def sft_examples(usable: DataFrame, whitelist: DataFrame) -> DataFrame:
    """One chat example per row as a JSON text; underscored fields are not for the model."""
    prompt = F.format_string(
        s.SINGLE_PROMPT, whitelist_text(whitelist), F.col("description"), amount_label(F.col("amount_sgd"))
    )
    messages = F.array(
        F.struct(F.lit("user").alias("role"), prompt.alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.col("category").alias("content")),
    )
    example = F.struct(
        messages.alias("messages"),
        F.col("transaction_id").cast("string").alias("_transaction_id"),
        F.col("description").alias("_description"),
        F.col("amount_sgd").cast("string").alias("_amount_sgd"),
    )
    kept = [c for c in ("transaction_id", "split") if c in usable.columns]
    return usable.select(*kept, F.to_json(example).alias("example"))


EXAMPLE = "struct<messages:array<struct<role:string,content:string>>>"


def chat_parts(examples: DataFrame) -> DataFrame:
    """Examples whose message texts are lists of typed parts."""
    read = F.from_json("example", EXAMPLE)["messages"]
    parts = F.transform(
        read,
        lambda m: F.struct(
            m["role"].alias("role"),
            F.array(F.struct(F.lit("text").alias("type"), m["content"].alias("text"))).alias("content"),
        ),
    )
    return examples.withColumn("messages", parts).drop("example")


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("truth", "predicted").agg(F.count("*").alias("n"))


def eval_scores(predictions: DataFrame) -> DataFrame:
    """Accuracy and agreement with the second model; an empty set is an error."""
    n = F.count("*")
    scores = predictions.agg(
        n.alias("n"),
        F.avg((F.col("predicted") == F.col("truth")).cast("double")).alias("accuracy"),
        F.avg((F.col("predicted") == F.col("live")).cast("double")).alias("agreement"),
    )
    guard = F.when(F.col("n") > 0, F.col("accuracy")).otherwise(
        F.raise_error(F.lit("cannot score an empty set")).cast("double")
    )
    return scores.withColumn("accuracy", guard)
