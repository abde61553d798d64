"""Statement files and model answers as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import settings as s
from ledgerloom.functions.text import strip
from ledgerloom.runtime import unsent

FILE_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)

LINE = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "transaction_date", "description", "amount", "direction", "printed_converted_amount_sgd", "confidence",
        )
    ]
)

# Leaves are read as text first, so that one bad value can be told from a missing one.
STATEMENT = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("bank_name", "currency", "confidence", "statement_date")],
        T.StructField("transactions", T.ArrayType(LINE)),
        T.StructField("_corrupt", T.StringType()),
    ]
)

LISTERS = 128

CHECKED_LINE = "struct<transaction_date:date,description:string,amount:decimal(18,2),direction:string,printed:decimal(18,2),confidence:string>"


def list_files(spark: SparkSession, folder: str, suffix: str = "pdf") -> DataFrame:
    """Files of a folder with that ending; names starting with a dot or underscore count as trash.

    Folders below it are looked at in ``LISTERS`` tasks a level; with a task for each of them, starting tasks took most of the time.
    """
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(min(int(before), LISTERS)))
    try:
        return spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(folder)
    finally:
        spark.conf.set(setting, before)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def strip_fence(raw: Column) -> Column:
    """The text inside a Markdown code fence, or the whole text without one."""
    text = strip(raw)
    inside = F.regexp_replace(F.get(F.split(text, "```"), F.lit(1)), "^json", "")
    return strip(F.when(text.startswith("```"), inside).otherwise(text))


def _parts(day: Column) -> Column:
    return F.split(day, "-")


def _is_swapped(day: Column) -> Column:
    """Month beyond 12 where the day would do as a month."""
    parts = _parts(day)
    month, dom = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    usable = (F.size(parts) == 3) & month.rlike("^[0-9]+$") & dom.rlike("^[0-9]+$")
    return F.coalesce(
        F.when(usable, (month.try_cast("int") > 12) & dom.try_cast("int").between(1, 12)), F.lit(False)
    )


def _swap_text(day: Column) -> Column:
    parts = _parts(day)
    swapped = F.concat_ws("-", F.get(parts, F.lit(0)), F.get(parts, F.lit(2)), F.get(parts, F.lit(1)))
    return F.when(F.size(parts) == 3, swapped).otherwise(day)


def needs_swap(lines: Column) -> Column:
    """True if some date of the document can only be read with day and month exchanged."""
    return F.coalesce(F.exists(lines, lambda x: _is_swapped(x["transaction_date"])), F.lit(False))


def _checked(line: Column, swap: Column) -> Column:
    day = F.when(swap, _swap_text(line["transaction_date"])).otherwise(line["transaction_date"])
    return F.struct(
        F.try_to_date(day, "yyyy-MM-dd").alias("transaction_date"),
        line["description"].alias("description"),
        line["amount"].try_cast("decimal(18,2)").alias("amount"),
        line["direction"].alias("direction"),
        line["printed_converted_amount_sgd"].try_cast("decimal(18,2)").alias("printed"),
        line["confidence"].alias("confidence"),
    )


def _line_ok(raw: Column, line: Column) -> Column:
    printed = raw["printed_converted_amount_sgd"]
    return F.coalesce(
        line["transaction_date"].isNotNull()
        & line["description"].isNotNull()
        & (line["amount"] > 0)
        & line["direction"].isin("in", "out")
        & line["confidence"].isin(*s.CONFIDENCE_LEVELS)
        & (printed.isNull() | line["printed"].isNotNull()),
        F.lit(False),
    )


def parse_statements(answers: DataFrame) -> DataFrame:
    """(statement_id, valid, swapped, bank_name, currency, confidence, statement_date, lines).

    ``answers``: statement_id and the model's text ``raw``. The schema is checked as a whole:
    one bad line invalidates its statement. A document whose dates all have day and month
    exchanged is set right here.
    """
    parsed = answers.withColumn(
        "doc", F.from_json(strip_fence(F.col("raw")), STATEMENT, {"columnNameOfCorruptRecord": "_corrupt"})
    ).withColumn("rows", F.coalesce("doc.transactions", F.array().cast(T.ArrayType(LINE))))
    parsed = parsed.withColumn("swapped", needs_swap(F.col("rows")))
    checked = parsed.withColumn("lines", F.transform("rows", lambda x: _checked(x, F.col("swapped"))))
    given = F.col("doc.statement_date")
    head_ok = (
        F.col("doc").isNotNull()
        & F.col("doc._corrupt").isNull()
        & F.col("doc.transactions").isNotNull()
        & F.col("doc.confidence").isin(*s.CONFIDENCE_LEVELS)
        & (given.isNull() | F.try_to_date(given, "yyyy-MM-dd").isNotNull())
    )
    lines_ok = F.forall(F.arrays_zip("rows", "lines"), lambda z: _line_ok(z["rows"], z["lines"]))
    return checked.select(
        *[c for c in answers.columns if c != "raw"],
        F.coalesce(head_ok & lines_ok, F.lit(False)).alias("valid"),
        "swapped",
        "doc.bank_name",
        "doc.currency",
        "doc.confidence",
        F.try_to_date("doc.statement_date", "yyyy-MM-dd").alias("statement_date"),
        "lines",
    )


def parse_batch_labels(answers: DataFrame, items: DataFrame, whitelist: DataFrame) -> DataFrame:
    """(batch keys, slot, label): usable labels of batch answers, matched to the request by position.

    ``answers``: statement_id, chunk, raw. ``items``: statement_id, chunk, slot, description. The
    outermost bracketed part of the text is read as a list of texts; entries that are no text,
    off the list or missing are left out and must be asked for one by one.
    """
    bracketed = F.regexp_extract("raw", r"(?s)\[.*\]", 0)
    # A typed read keeps strings apart from numbers: only quoted entries are labels.
    entries = F.from_json(bracketed, "array<variant>", {"mode": "PERMISSIVE"})
    placed = answers.select("statement_id", "chunk", F.posexplode(entries).alias("slot", "entry")).select(
        "statement_id",
        "chunk",
        "slot",
        F.when(F.schema_of_variant("entry") == "STRING", strip(F.try_variant_get("entry", "$", "string"))).alias("label"),
    )
    allowed = whitelist.select(F.col("name").alias("label")).unionByName(
        whitelist.sparkSession.range(1).select(F.lit(s.UNSURE).alias("label"))
    ).distinct()
    return unsent(items).join(placed, ["statement_id", "chunk", "slot"]).join(allowed, "label", "left_semi")


def merge_labels(items: DataFrame, batch: DataFrame, single: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Label per item: the batch's, else the trimmed single answer if on the list, else UNSURE."""
    listed = whitelist.select(F.col("name").alias("single_label"))
    singles = single.select("statement_id", "description", strip(F.col("answer")).alias("single_label")).join(
        listed, "single_label", "left_semi"
    )
    keys = ["statement_id", "description"]
    return (
        unsent(items).join(unsent(batch.select(*keys, "label")), keys, "left")
        .join(unsent(singles), keys, "left")
        .withColumn("label", F.coalesce("label", "single_label", F.lit(s.UNSURE)))
        .drop("single_label")
    )


def parse_bulk_import(text: DataFrame) -> DataFrame:
    """Pasted text (line_id, line; possibly many lines each) as raw payment rows."""
    lines = text.select("line_id", F.posexplode(F.split("line", "\n")).alias("row", "entry")).where(
        strip(F.col("entry")) != ""
    )
    parts = F.transform(F.split(strip(F.col("entry")), ","), strip)
    frequency = F.lower(F.get("parts", F.lit(2)))
    annual = (frequency == "annual") & (F.size("parts") >= 5)
    return lines.withColumn("parts", parts).select(
        "line_id",
        "row",
        F.get("parts", F.lit(0)).alias("name"),
        F.get("parts", F.lit(1)).alias("amount"),
        frequency.alias("frequency"),
        F.when(annual, F.get("parts", F.lit(3))).alias("due_month"),
        F.when(annual, F.get("parts", F.lit(4))).otherwise(F.get("parts", F.lit(3))).alias("due_day"),
    )


def validate_bulk_rows(rows: DataFrame) -> DataFrame:
    """Typed rows with the reason of a refusal; good rows survive bad ones."""
    typed = rows.select(
        "line_id",
        "row",
        "name",
        "frequency",
        F.col("amount").try_cast("decimal(18,2)").alias("expected_amount"),
        F.col("due_month").try_cast("int").alias("month"),
        F.col("due_day").try_cast("int").alias("day"),
        (F.coalesce("due_month", F.lit("")) == "").alias("no_month"),
        (F.coalesce("due_day", F.lit("")) == "").alias("no_day"),
    )
    annual, monthly = F.col("frequency") == "annual", F.col("frequency") == "monthly"
    reason = (
        F.when(F.col("expected_amount").isNull(), F.lit("bad amount"))
        .when(~F.col("no_month") & F.col("month").isNull(), F.lit("bad due month"))
        .when(~F.col("no_day") & F.col("day").isNull(), F.lit("bad due day"))
        .when(F.col("no_day"), F.lit("due day missing"))
        .when(~(F.coalesce(annual | monthly, F.lit(False))), F.lit("unknown frequency"))
        .when(annual & F.col("no_month"), F.lit("annual without due month"))
        .when(monthly & ~F.col("no_month"), F.lit("monthly with due month"))
        .when(~F.col("day").between(1, 31), F.lit("due day out of range"))
        .when(annual & ~F.col("month").between(1, 12), F.lit("due month out of range"))
    )
    return typed.select(
        "line_id",
        "row",
        "name",
        "expected_amount",
        "frequency",
        F.col("month").alias("due_month"),
        F.col("day").alias("due_day"),
        reason.alias("reason"),
    )
