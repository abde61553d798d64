"""Streams over the batch operators. Each takes what is available and stops.

Results go to a folder with one part per micro-batch, overwritten when a batch is repeated:
with the checkpoint this makes every row count once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import settings as s
from ledgerloom.operators import dashboards, recurring
from ledgerloom.runtime import scratch_path
from ledgerloom.sources.statements import FILE_SCHEMA


def file_stream(spark: SparkSession, folder: str, pattern: str, schema: T.StructType, files: int = 1) -> DataFrame:
    """New parquet files of a folder, ``files`` per micro-batch."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files)
        .parquet(folder)
    )


def statement_file_stream(spark: SparkSession, folder: str, files: int = 1000) -> DataFrame:
    """New statement files as (path, modificationTime, length, content)."""
    return (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("pathGlobFilter", "*.pdf")
        .option("maxFilesPerTrigger", files)
        .load(folder)
    )


def _drain(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(each)
        .start()
    )
    query.awaitTermination()


def _stored(spark: SparkSession, path: str, schema: T.StructType, before: int) -> DataFrame:
    """Results of the micro-batches before this one."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(
        path
    ).where(F.col("batch") < before).drop("batch")


def stream_statements(
    stream: DataFrame, run: Callable[[DataFrame, DataFrame], DataFrame], out: str, checkpoint: str
) -> DataFrame:
    """File outcomes, a content processed once over all micro-batches.

    ``run(files, known)`` is the batch job on one micro-batch; ``known`` are the contents that
    earlier micro-batches processed.
    """
    spark = stream.sparkSession
    schema = T.StructType(
        [
            T.StructField("file_id", T.StringType()),
            T.StructField("content_hash", T.StringType()),
            T.StructField("outcome", T.StringType()),
            T.StructField("reason", T.StringType()),
            T.StructField("statement_id", T.StringType()),
            T.StructField("n_transactions", T.IntegerType()),
        ]
    )
    spark.createDataFrame([], schema).withColumn("batch", F.lit(-1).cast("long")).write.partitionBy("batch").mode(
        "append"
    ).parquet(out)

    def each(files: DataFrame, batch: int) -> None:
        known = _stored(spark, out, schema, batch).where("outcome = 'processed'").select("content_hash", "statement_id")
        outcome = run(files, known).join(files.select("file_id", "content_hash"), "file_id")
        outcome.select(*schema.names).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    _drain(stream, checkpoint, each)
    return _stored(spark, out, schema, 1 << 62)


MATCHES = T.StructType(
    [
        T.StructField("payment_id", T.LongType()),
        T.StructField("cycle_period", T.StringType()),
        T.StructField("transaction_id", T.LongType()),
        T.StructField("amount_at_match", T.DecimalType(18, 2)),
        T.StructField("status", T.StringType()),
    ]
)


def stream_recurring_matches(
    stream: DataFrame, payments: DataFrame, matches: DataFrame, out: str, checkpoint: str, cfg: s.Settings = s.DEFAULTS
) -> DataFrame:
    """Ledger rows matched as they arrive; a cycle taken in one micro-batch is taken in the next."""
    spark = stream.sparkSession
    spark.createDataFrame([], MATCHES).withColumn("batch", F.lit(-1).cast("long")).write.partitionBy("batch").mode(
        "append"
    ).parquet(out)
    held = matches.select("payment_id", "cycle_period", "status")

    def each(rows: DataFrame, batch: int) -> None:
        live = held.unionByName(_stored(spark, out, MATCHES, batch).select("payment_id", "cycle_period", "status"))
        found = recurring.match_by_text(rows, payments, live, cfg)
        found.select(*MATCHES.names).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    _drain(stream, checkpoint, each)
    return _stored(spark, out, MATCHES, 1 << 62)


def stream_log_tail(lines: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Append-only log lines copied on; the checkpoint is the cursor."""
    query = (
        lines.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return lines.sparkSession.read.schema(lines.schema).parquet(out)


def stream_monthly_totals(converted: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Cash flow per month kept up to date; the state is one row per month."""
    spark = converted.sparkSession
    totals = dashboards.cash_flow(converted)

    def each(months: DataFrame, batch: int) -> None:
        months.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    _drain(totals, checkpoint, each, mode="complete")
    written = spark.read.parquet(out)
    newest = written.agg(F.max("batch")).scalar()
    return written.where(F.col("batch") == newest).drop("batch")


def paths(spark: SparkSession, name: str) -> tuple[str, str]:
    """A result folder and a checkpoint folder below the shared one."""
    base = scratch_path(spark, name)
    return f"{base}/out", f"{base}/checkpoint"
