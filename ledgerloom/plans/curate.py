"""Training-set curation and evaluation of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import settings as s
from ledgerloom.operators import training


def curate(
    eligible: DataFrame, whitelist: DataFrame, path: str, ratio: float = s.DEFAULTS.train_ratio
) -> DataFrame:
    """Writes the examples per split below ``path`` as JSON lines and returns the summary row."""
    usable = eligible.where(F.col("amount_sgd").isNotNull())
    split = training.train_val_split(usable, ratio)
    training.sft_examples(split, whitelist).select("split", "example").write.partitionBy("split").text(path)
    written = usable.sparkSession.read.text(path).groupBy().agg(
        F.count_if(F.col("split") == "train").alias("train_count"),
        F.count_if(F.col("split") == "val").alias("val_count"),
    )
    sources = training.source_breakdown(eligible).groupBy().agg(
        F.coalesce(F.sum(F.when(F.col("category_source") == s.MANUAL, F.col("usable"))), F.lit(0)).alias("manual_count"),
        F.coalesce(F.sum(F.when(F.col("category_source") == "similarity", F.col("usable"))), F.lit(0)).alias("similarity_count"),
        F.coalesce(F.sum("excluded"), F.lit(0)).alias("excluded_count"),
    )
    # Two single rows side by side.
    return written.select(
        "train_count", "val_count",
        sources.select("manual_count").scalar().alias("manual_count"),
        sources.select("similarity_count").scalar().alias("similarity_count"),
        sources.select("excluded_count").scalar().alias("excluded_count"),
    )


def evaluate(predictions: DataFrame) -> DataFrame:
    """Confusion matrix with the overall scores beside every cell."""
    scores = training.eval_scores(predictions)
    return training.confusion_matrix(predictions).select(
        "truth",
        "predicted",
        F.col("n").alias("n_pairs"),
        F.round(scores.select("accuracy").scalar(), 9).alias("accuracy"),
        F.round(scores.select("agreement").scalar(), 9).alias("agreement"),
    )
