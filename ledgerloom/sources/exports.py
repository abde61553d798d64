"""Ledger exports, snapshots and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import settings as s
from ledgerloom.functions.amounts import amount_label
from ledgerloom.operators.training import whitelist_text


def export_rows(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """The rows, newest first, with the eight export columns; all of them unless a limit is asked for."""
    columns = (
        "transaction_date", "description", "out_flow", "in_flow", "bank_name", "category", "currency", "converted_sgd",
    )
    newest = rows.orderBy(F.col("transaction_date").desc(), F.col("transaction_id").asc())
    newest = newest if limit is None else newest.limit(limit)
    return newest.select(*[F.col(c).alias(h) for c, h in zip(columns, s.EXPORT_HEADER, strict=True)])


def write_csv(rows: DataFrame, path: str) -> None:
    """Header, empty nulls, doubled quotes; one file per partition."""
    rows.write.mode("overwrite").option("header", True).option("nullValue", "").option("escape", '"').csv(path)


def backup_rows(ledger: DataFrame) -> DataFrame:
    """The sixteen columns of a snapshot. Embedding status and model label are not part of it."""
    return ledger.select(*s.BACKUP_COLUMNS)


def context_csv(rows: DataFrame, account: str, limit: int = s.DEFAULTS.context_max_rows) -> DataFrame:
    """The newest rows of each account as one CSV text for a prompt; ``truncated`` tells if there are more.

    The limit on rows is part of the feature: a prompt holds so many. It bounds each text, and rows
    beyond it are dropped before any are gathered.
    """
    newest_first = Window.partitionBy(account).orderBy(F.col("transaction_date").desc(), F.col("transaction_id").asc())
    sizes = rows.groupBy(account).agg((F.count("*") > limit).alias("truncated"))
    rows = rows.withColumn("_place", F.row_number().over(newest_first)).where(F.col("_place") <= limit)
    quoted = F.concat(F.lit('"'), F.replace("description", F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(
        ",",
        F.col("transaction_date").cast("string"),
        quoted,
        F.when(F.col("out_flow").isNotNull(), F.lit("out")).otherwise(F.lit("in")),
        F.coalesce("out_flow", "in_flow").cast("string"),
        "currency",
        F.coalesce(F.col("converted_sgd").cast("string"), F.lit("")),
        "bank_name",
        "category",
    )
    order = F.struct(
        (-F.unix_date("transaction_date")).alias("newest"), "transaction_id", line.alias("line")
    )
    body = F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["line"]), "\n")
    texts = rows.groupBy(account).agg(
        F.count("*").alias("n_rows"), F.concat(F.lit(s.CONTEXT_HEADER + "\n"), body).alias("context")
    )
    return texts.join(sizes, account)


def prompt_items(lines: DataFrame, batch: int = s.DEFAULTS.label_batch_size) -> DataFrame:
    """Distinct descriptions of a statement in print order, numbered in batches.

    A repeated description keeps the amount of its first line.
    """
    firsts = first_amounts(lines)
    rank = F.expr("row_number() OVER (PARTITION BY statement_id ORDER BY first_pos)") - 1
    return firsts.withColumn("rank", rank).select(
        "statement_id",
        F.floor(F.col("rank") / batch).alias("chunk"),
        (F.col("rank") % batch).alias("slot"),
        "description",
        "amount_sgd",
    )


def first_amounts(lines: DataFrame) -> DataFrame:
    """One row per statement and description with the amount of its first line."""
    return lines.groupBy("statement_id", "description").agg(
        F.min("pos").alias("first_pos"), F.min_by("amount_sgd", "pos").alias("amount_sgd")
    )


def batch_prompts(items: DataFrame, whitelist: DataFrame) -> DataFrame:
    """One numbered prompt per batch of at most ten descriptions."""
    line = F.concat(
        (F.col("slot") + 1).cast("string"), F.lit(". "), "description",
        F.lit(" (amount: "), amount_label(F.col("amount_sgd")), F.lit(")"),
    )
    batches = items.groupBy("statement_id", "chunk").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("slot", line.alias("line")))).alias("all")
    )
    text = F.array_join(F.transform("all", lambda x: x["line"]), "\n")
    prompt = F.format_string(s.BATCH_PROMPT, F.col("n"), whitelist_text(whitelist), text)
    return batches.select("statement_id", "chunk", prompt.alias("prompt"))
