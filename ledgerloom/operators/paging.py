"""Sorts, pages and menus. Every order ends in a unique key, so pages are repeatable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import settings as s
from ledgerloom.functions.amounts import magnitude
from ledgerloom.runtime import cut

PAGE_ROWS = 100_000
SPLITTERS = 256
SORT_KEYS = ("date", "amount", "category", "bank")


def sort_column(key: str) -> Column:
    if key not in SORT_KEYS:
        raise ValueError(f"sort key must be one of {SORT_KEYS}, not {key!r}")
    if key == "amount":
        return magnitude(F.col("out_flow"), F.col("in_flow"))
    return F.col({"date": "transaction_date", "category": "category", "bank": "bank_name"}[key])


def sort_ledger(ledger: DataFrame, key: str = "date", descending: bool = True) -> DataFrame:
    column = sort_column(key)
    return ledger.orderBy(column.desc() if descending else column.asc(), F.col("transaction_id").asc())


def with_rank(ordered: DataFrame) -> DataFrame:
    """Adds ``rank``, the place of each row in an ordered result, counted from 1.

    The order is stored once. Rows are numbered within the parts of the sort; the parts before give
    the rest, so no task sees more than its part.
    """
    placed = cut(ordered.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per part of the sort
    before = sizes.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    within = F.col("_id") - F.shiftleft(part, 33)
    return (
        placed.withColumn("_part", part)
        .join(before, "_part")
        .withColumn("rank", (F.col("_before") + within + 1).cast("bigint"))
        .drop("_id", "_part", "_before")
    )


def sort_by_category(ledger: DataFrame, categories: DataFrame, descending: bool = False) -> DataFrame:
    """Rows ordered by the looked-up category name; rows without a category are kept."""
    names = categories.select("category_id", F.col("name").alias("sort_name"))
    column = F.col("sort_name")
    ordered = ledger.join(names, "category_id", "left").orderBy(
        column.desc() if descending else column.asc(), F.col("transaction_id").asc()
    )
    return ordered


def page(ordered: DataFrame, number: int, size: int = s.DEFAULTS.page_size) -> DataFrame:
    """One page of an ordered result, counted from 1."""
    if number < 1 or not 1 <= size <= s.DEFAULTS.max_page_size:
        raise ValueError(f"page must be at least 1 and its size between 1 and {s.DEFAULTS.max_page_size}")
    return ordered.offset((number - 1) * size).limit(size)


def _number_below(cuts: list[Column], key: Column) -> Column:
    """How many of the ascending ``cuts`` are below ``key``: among the ends of groups first, then within one group."""
    size = max(1, round(len(cuts) ** 0.5))
    groups = [cuts[at : at + size] for at in range(0, len(cuts), size)]
    passed = F.size(F.filter(F.array(*[g[-1] for g in groups]), lambda c: c < key))
    within = F.size(F.filter(F.get(F.array(*[F.array(*g) for g in groups]), passed), lambda c: c < key))
    return F.when(passed == len(groups), F.lit(len(cuts))).otherwise(passed * size + within)


def deep_page(rows: DataFrame, keys: list[Column], number: int, size: int = s.DEFAULTS.page_size, bound: int = PAGE_ROWS) -> DataFrame:
    """The page that ``page`` gives of ``rows`` ordered by ``keys`` (ascending, unique together), without sorting what precedes it.

    Counts between a few hundred sampled keys tell which range holds the page and how many rows stand before it;
    the range is counted in turn until it has at most ``bound`` rows, and only those are sorted. Each round reads
    the range that the last one left, by a condition on the keys that a stored table can prune with.
    """
    if number < 1 or not 1 <= size <= s.DEFAULTS.max_page_size:
        raise ValueError(f"page must be at least 1 and its size between 1 and {s.DEFAULTS.max_page_size}")
    key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    kind = rows.select(key.alias("key")).schema["key"].dataType
    part, skip = rows, (number - 1) * size
    while True:
        n = part.count()
        if skip >= n:
            return rows.limit(0)
        if n <= max(bound, size):
            break
        drawn = part.select(key.alias("key")).orderBy(F.xxhash64("key", F.lit(n)), "key").limit(SPLITTERS).distinct().orderBy("key").collect()
        cuts = [F.struct(*[F.lit(x) for x in r["key"]]).cast(kind) for r in drawn]
        place = _number_below(cuts, key)
        counts = {r["place"]: r["count"] for r in part.groupBy(place.alias("place")).count().collect()}
        first, before = 0, 0
        while before + counts.get(first, 0) <= skip:
            before += counts.get(first, 0)
            first += 1
        last, seen = first, before + counts.get(first, 0)
        while seen < min(skip + size, n):
            last += 1
            seen += counts.get(last, 0)
        if seen - before == n:
            break
        skip -= before
        if first > 0:
            part = part.where(key > cuts[first - 1])
        if last < len(cuts):
            part = part.where(key <= cuts[last])
    return part.orderBy(*keys).offset(skip).limit(size)


def limit_with_truncation(rows: DataFrame, limit: int = s.DEFAULTS.context_max_rows) -> DataFrame:
    """The newest rows up to ``limit``, each with the flag that more exist.

    One row more than the limit is read; that bounded set is all the window ever sees.
    """
    newest = [F.col("transaction_date").desc(), F.col("transaction_id").asc()]
    some = rows.orderBy(*newest).limit(limit + 1)
    ranked = some.withColumn("rank", F.row_number().over(Window.orderBy(*newest))).withColumn(
        "truncated", F.count("*").over(Window.partitionBy()) > limit
    )
    return ranked.where(F.col("rank") <= limit).drop("rank")


def cursor_tail(lines: DataFrame, run_id: int, cursor: int, limit: int = s.DEFAULTS.log_page_size) -> DataFrame:
    """Log lines of a run past the cursor."""
    return (
        lines.where((F.col("run_id") == run_id) & (F.col("line_id") > cursor)).orderBy("line_id").limit(limit)
    )


def run_history(runs: DataFrame, number: int, size: int) -> DataFrame:
    return page(runs.orderBy(F.col("started_at").desc(), F.col("run_id").asc()), number, size)


def run_files(files: DataFrame, run_id: int) -> DataFrame:
    return files.where(F.col("run_id") == run_id).orderBy("processed_at", "file_id")


def pending_batch(rows: DataFrame, limit: int = s.DEFAULTS.embedding_batch_size) -> DataFrame:
    """The oldest rows that still wait for a vector."""
    waiting = rows.where(F.col("embedding_status") == "pending")
    return waiting.orderBy("created_at", "transaction_id").limit(limit)


def category_menu_order(usage: DataFrame, top: int = s.DEFAULTS.top_used_categories) -> DataFrame:
    """Most used categories first, the others by name; ``menu_rank`` numbers the menu."""
    usage = cut(usage)
    first = usage.orderBy(F.col("n_transactions").desc(), F.col("name").asc()).limit(top)
    # at most ``top`` rows are ever in one place
    ranked = first.select("name", F.row_number().over(Window.orderBy(F.col("n_transactions").desc(), "name")).alias("menu_rank"))
    others = with_rank(usage.join(ranked, "name", "left_anti").orderBy("name")).withColumnRenamed("rank", "menu_rank")
    named = usage.join(ranked, "name")
    return named.unionByName(others.withColumn("menu_rank", F.col("menu_rank") + top).select(named.columns))


def bank_and_category_menus(ledger: DataFrame, categories: DataFrame) -> DataFrame:
    banks = ledger.select(F.lit("bank").alias("menu"), F.col("bank_name").alias("entry")).distinct()
    names = categories.where("active").select(F.lit("category").alias("menu"), F.col("name").alias("entry"))
    return banks.unionByName(names).orderBy("menu", "entry")


def recent_activity(runs: DataFrame, jobs: DataFrame, limit: int = s.DEFAULTS.recent_activity) -> DataFrame:
    """Newest finished runs and jobs together; both sides are cut before they meet."""
    sides = [
        frame.where(F.col("completed_at").isNotNull())
        .select(
            F.lit(kind).alias("kind"),
            F.col(key).alias("item_id"),
            F.col("completed_at").cast("timestamp_ntz").alias("happened_at"),
        )
        .orderBy(F.col("happened_at").desc(), F.col("item_id").asc())
        .limit(limit)
        for kind, key, frame in (("ingestion_run", "run_id", runs), ("recategorization_job", "job_id", jobs))
    ]
    return sides[0].unionByName(sides[1]).orderBy(F.col("happened_at").desc(), F.col("kind"), F.col("item_id")).limit(limit)


def current_activity(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """The running run or job that started last."""
    sides = [
        frame.where(F.col("status") == "running").select(
            F.lit(kind).alias("kind"),
            F.col(key).alias("item_id"),
            F.col(started).cast("timestamp_ntz").alias("happened_at"),
        )
        for kind, key, started, frame in (
            ("ingestion_run", "run_id", "started_at", runs),
            ("recategorization_job", "job_id", "created_at", jobs),
        )
    ]
    return sides[0].unionByName(sides[1]).orderBy(F.col("happened_at").desc(), F.col("kind"), F.col("item_id")).limit(1)
