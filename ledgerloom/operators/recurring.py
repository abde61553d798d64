"""Recurring payments: matching rows to a register, status, and detection of new ones."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import settings as s
from ledgerloom.functions import dates
from ledgerloom.functions.amounts import cents
from ledgerloom.functions.decisions import match_status, payment_status
from ledgerloom.functions.text import pattern_key, token_key
from ledgerloom.functions.vectors import boosted
from ledgerloom.operators.components import connected_components
from ledgerloom.operators.neighbours import similar_links
from ledgerloom.operators.textjoin import similar_texts
from ledgerloom.runtime import cut


# --- matching --------------------------------------------------------------------------------


def with_cycle(pairs: DataFrame, cfg: s.Settings = s.DEFAULTS) -> DataFrame:
    """Keeps pairs within the window around the nearest due date and names their cycle.

    The date comes from a generator, whose result is a column. Written as an expression the optimizer would repeat it wherever
    it is used.
    """
    day = F.col("transaction_date")
    for name, value in dates.nearest_due_steps(F.col("frequency"), F.col("due_month"), F.col("due_day"), day):
        pairs = pairs.withColumn(name, F.explode(F.array(value)))
    near = pairs.drop("_here", "_there").where(F.abs(F.datediff(day, F.col("due_date"))) <= cfg.match_window_days)
    return near.withColumn("cycle_period", dates.cycle_period(F.col("frequency"), F.col("due_date")))


def live_cycles(matches: DataFrame) -> DataFrame:
    live = matches.where(F.col("status").isin(*s.LIVE_MATCH_STATUSES))
    return live.select("payment_id", "cycle_period").distinct()


def _first_per_cycle(pairs: DataFrame, matches: DataFrame, cfg: s.Settings) -> DataFrame:
    """First arrival takes a (payment, cycle) without a live match; a minimum, so combined early.

    The columns of the first row are of fixed width each, as a struct of them could not be combined by hash. A cycle has a
    live match or not for all of its rows alike, which is looked up once they are combined.
    """
    names = ("amount", "expected_amount", "is_trusted")
    first = with_cycle(pairs, cfg).groupBy("payment_id", "cycle_period").agg(
        F.min("transaction_id").alias("first_id"), *[F.min_by(c, "transaction_id").alias(c) for c in names]
    )
    free = first.join(live_cycles(matches), ["payment_id", "cycle_period"], "left_anti")
    status = match_status(F.col("is_trusted"), F.col("amount"), F.col("expected_amount"), cfg)
    return free.select(
        "payment_id",
        "cycle_period",
        F.col("first_id").alias("transaction_id"),
        F.col("amount").alias("amount_at_match"),
        status.alias("status"),
    )


PAYMENT_COLUMNS = ("payment_id", "expected_amount", "frequency", "due_month", "due_day", "is_trusted")
PAIR_COLUMNS = ("transaction_id", "transaction_date", "amount", *PAYMENT_COLUMNS)


def _text_pairs(rows: DataFrame, payments: DataFrame, cfg: s.Settings) -> DataFrame:
    """Rows with the payments whose name is like their upper-cased text.

    Rows are cut to the first per (text, day) before they meet the payments: no other can win a cycle.
    """
    keyed = rows.select(
        token_key(F.upper("description")).alias("text_key"), "transaction_date", "transaction_id", "amount"
    )
    firsts = cut(
        keyed.groupBy("text_key", "transaction_date")
        .agg(F.min(F.struct("transaction_id", "amount")).alias("first"))
        .select("text_key", "transaction_date", "first.*")
    )
    named = payments.select(token_key(F.upper("name")).alias("name_key"), *PAYMENT_COLUMNS)
    pairs = similar_texts(
        firsts.select(F.col("text_key").alias("key")).distinct(),
        named.select(F.col("name_key").alias("key")).distinct(),
        cfg.text_threshold,
    )
    pairs = cut(pairs.select(F.col("left_key").alias("text_key"), F.col("right_key").alias("name_key")))
    return firsts.join(pairs, "text_key").join(named, "name_key").select(*PAIR_COLUMNS)


def _near_pairs(rows: DataFrame, payments: DataFrame, neighbours: DataFrame, cfg: s.Settings) -> DataFrame:
    """Rows with those of their ``neighbours`` (transaction_id, payment_id, score) that are near enough."""
    named = payments.select(F.col("category").alias("payment_category"), *PAYMENT_COLUMNS)
    score = boosted(F.col("score"), F.col("payment_category"), F.col("llm_category"), cfg.llm_boost)
    return (
        neighbours.join(
            rows.select("transaction_id", "transaction_date", "amount", "llm_category"), "transaction_id"
        )
        .join(named, "payment_id")
        .where(score >= cfg.vector_threshold)
        .select(*PAIR_COLUMNS)
    )


def match_by_text(
    rows: DataFrame, payments: DataFrame, matches: DataFrame, cfg: s.Settings = s.DEFAULTS
) -> DataFrame:
    """New matches of ledger rows whose upper-cased text is like a payment's name.

    The amount plays no part in the choice, only in the status.
    """
    return _first_per_cycle(_text_pairs(rows, payments, cfg), matches, cfg)


def match_by_neighbours(
    rows: DataFrame, payments: DataFrame, matches: DataFrame, neighbours: DataFrame, cfg: s.Settings = s.DEFAULTS
) -> DataFrame:
    """New matches where a vector search found payments near the row; ``neighbours`` as for ``match_recurring``."""
    return _first_per_cycle(_near_pairs(rows, payments, neighbours, cfg), matches, cfg)


def match_recurring(
    rows: DataFrame, payments: DataFrame, matches: DataFrame, neighbours: DataFrame, cfg: s.Settings = s.DEFAULTS
) -> DataFrame:
    """New matches by vectors for rows whose search returned anything, by text for the others.

    ``neighbours``: transaction_id, payment_id, score, all that the search returned. Whether it returned
    anything decides before any threshold; a searched row without a near payment stays unmatched.
    The first row of either kind takes a cycle.
    """
    searched = neighbours.select("transaction_id").distinct()
    others = rows.join(searched, "transaction_id", "left_anti")
    pairs = _near_pairs(rows, payments, neighbours, cfg).unionByName(_text_pairs(others, payments, cfg))
    return _first_per_cycle(pairs, matches, cfg)


def payment_statuses(
    payments: DataFrame, matches: DataFrame, as_of: dt.date, cfg: s.Settings = s.DEFAULTS
) -> DataFrame:
    """Status of the cycle now due per payment, and the monthly share of annual ones."""
    today = F.lit(as_of)
    due = dates.current_due_date(F.col("frequency"), F.col("due_month"), F.col("due_day"), today)
    now = payments.withColumn("current_due", due).withColumn(
        "cycle_period", dates.cycle_period(F.col("frequency"), F.col("current_due"))
    )
    live = (
        matches.where(F.col("status").isin(*s.LIVE_MATCH_STATUSES))
        .groupBy("payment_id", "cycle_period")
        .agg(F.min_by("status", "match_id").alias("match_state"))
    )
    following = dates.next_due_date(F.col("frequency"), F.col("due_day"), F.col("current_due"))
    status = payment_status(
        F.col("frequency"), F.col("match_state"), F.col("current_due"), following, today, cfg.due_soon_days
    )
    share = F.when(F.col("frequency") == "annual", (F.col("expected_amount") / 12).cast("decimal(18,2)"))
    return now.join(live, ["payment_id", "cycle_period"], "left").select(
        "payment_id", "cycle_period", "current_due", status.alias("status"), share.alias("monthly_set_aside")
    )


def status_summary(
    payments: DataFrame, matches: DataFrame, suggestions: DataFrame, as_of: dt.date, cfg: s.Settings = s.DEFAULTS
) -> DataFrame:
    """One row of counts for the overview."""
    parts = (
        payment_statuses(payments, matches, as_of, cfg).select("status")
        .unionByName(matches.where("status = 'pending'").select(F.lit("match").alias("status")))
        .unionByName(suggestions.where("status = 'new'").select(F.lit("suggestion").alias("status")))
    )
    return parts.agg(
        F.count_if(F.col("status") == "due_soon").alias("due_soon_count"),
        F.count_if(F.col("status") == "overdue").alias("overdue_count"),
        F.count_if(F.col("status") == "match").alias("pending_match_count"),
        F.count_if(F.col("status") == "suggestion").alias("new_suggestion_count"),
    )


# --- detection -------------------------------------------------------------------------------


def unmatched(ledger: DataFrame, matches: DataFrame) -> DataFrame:
    """Rows without a match of any status; a rejected one counts too."""
    return ledger.join(matches.select("transaction_id").distinct(), "transaction_id", "left_anti")


def with_pattern(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pattern", pattern_key(F.col("description")))


def group_by_pattern(rows: DataFrame) -> DataFrame:
    return with_pattern(rows).groupBy("pattern").agg(F.count("*").alias("n_rows"))


def _upper(head: int, cfg: s.Settings) -> int:
    """Largest amount in cents that still joins a cluster with this head."""
    num, den = cfg.trusted_ratio.as_integer_ratio()
    return max(head + int(cfg.trusted_floor * 100), head * num // den)


def cluster_heads(rows: DataFrame, cfg: s.Settings = s.DEFAULTS) -> DataFrame:
    """(pattern, heads): the first amounts of the amount clusters of each pattern, ascending.

    Amounts join the newest cluster if in range of its first amount, else start one. As the
    range grows with the head, heads multiply by at least the ratio: a pattern has at most a
    few hundred. Only distinct amounts matter; they pass in order, and all that is kept of a pattern is its newest
    head, so its size is of no concern: a step looks up where the range of the head ends.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, limit = None, None
        for batch in batches:
            patterns = batch.column(0).dictionary_encode()
            codes, names = patterns.indices.to_numpy(), patterns.dictionary.to_pylist()
            amounts = batch.column(1).to_numpy()
            found: list[tuple[str, int]] = []
            edges = np.flatnonzero(codes[1:] != codes[:-1]) + 1
            for start, stop in zip(np.append(0, edges), np.append(edges, len(codes)), strict=True):
                if start == stop:
                    continue
                name = names[codes[start]]
                if name != current:
                    current, limit = name, None
                own = amounts[start:stop]
                at = 0 if limit is None else int(np.searchsorted(own, limit, side="right"))
                while at < len(own):
                    found.append((name, int(own[at])))
                    limit = _upper(int(own[at]), cfg)
                    at = int(np.searchsorted(own, limit, side="right"))
            columns = list(zip(*found, strict=True)) if found else [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64())], names=["pattern", "head"])

    amounts = rows.where("pattern is not null and cents is not null").select("pattern", "cents").distinct()
    ordered = amounts.repartition("pattern").sortWithinPartitions("pattern", "cents")
    heads = ordered.mapInArrow(scan, "pattern string, head bigint")
    return heads.groupBy("pattern").agg(F.sort_array(F.collect_list("head")).alias("heads"))


def amount_clusters(rows: DataFrame, cfg: s.Settings = s.DEFAULTS) -> DataFrame:
    """Rows (pattern, amount, ...) with ``cents`` and the first amount of their cluster."""
    sized = rows.withColumn("cents", cents(F.col("amount")))
    heads = cluster_heads(sized, cfg)
    mine = F.array_max(F.filter("heads", lambda h: h <= F.col("cents")))
    return sized.join(heads, "pattern").withColumn("cluster_head", mine).drop("heads")


def cluster_days(clustered: DataFrame) -> DataFrame:
    """One row per cluster and day: all that cadence and profile need, bounded by the calendar."""
    return clustered.groupBy("pattern", "cluster_head", "transaction_date").agg(
        F.count("*").alias("n_rows"),
        F.min("amount").alias("amount"),
        F.min("category").alias("low_category"),
        F.max("category").alias("high_category"),
    )


def cadence_gaps(days: DataFrame) -> DataFrame:
    """Days since the cluster's previous day with a row."""
    before = F.lag("transaction_date").over(
        Window.partitionBy("pattern", "cluster_head").orderBy("transaction_date")
    )
    return days.withColumn("gap_days", F.datediff("transaction_date", before))


def cluster_profiles(days: DataFrame, cfg: s.Settings = s.DEFAULTS) -> DataFrame:
    """Occurrences, latest amount (the lowest of its day), only category, monthly cadence."""
    monthly = F.col("gap_days").between(cfg.cadence_min_days, cfg.cadence_max_days)
    profile = cadence_gaps(days).groupBy("pattern", "cluster_head").agg(
        F.sum("n_rows").alias("occurrences"),
        F.max_by("amount", "transaction_date").alias("latest_amount"),
        F.min("low_category").alias("low"),
        F.max("high_category").alias("high"),
        F.coalesce(F.max(monthly), F.lit(False)).alias("is_monthly"),
    )
    return profile.select(
        "pattern",
        "cluster_head",
        "occurrences",
        "latest_amount",
        F.when(F.col("low") == F.col("high"), F.col("low")).alias("category"),
        "is_monthly",
    )


def one_suggestion_per_pattern(
    profiles: DataFrame, suggestions: DataFrame, cfg: s.Settings = s.DEFAULTS
) -> DataFrame:
    """The monthly cluster with the lowest amounts per pattern that was never suggested before."""
    found = profiles.where(
        F.col("is_monthly") & (F.col("occurrences") >= cfg.min_occurrences) & (F.col("pattern") != "")
    )
    first = found.groupBy("pattern").agg(
        F.min(F.struct("cluster_head", "occurrences", "latest_amount", "category")).alias("first")
    )
    known = suggestions.select(F.col("description_pattern").alias("pattern")).distinct()
    return first.join(known, "pattern", "left_anti").select(
        F.col("pattern").alias("description_pattern"),
        F.col("first.latest_amount").alias("suggested_amount"),
        F.col("first.category").alias("suggested_category"),
        F.col("first.occurrences").alias("occurrence_count"),
    )


def representatives(rows: DataFrame) -> DataFrame:
    """The most recent row of each pattern, the smallest id on the same day."""
    latest = F.struct(
        F.col("transaction_date"), (-F.col("transaction_id")).alias("minus_id"), "category", "llm_category"
    )
    return (
        rows.where("pattern <> ''")
        .groupBy("pattern")
        .agg(F.max(latest).alias("last"))
        .select(
            "pattern", (-F.col("last.minus_id")).alias("id"), "last.category", "last.llm_category"
        )
    )


def merged_patterns(rows: DataFrame, vectors: DataFrame, cfg: s.Settings = s.DEFAULTS) -> DataFrame:
    """(pattern, merged): patterns whose latest rows' vectors are alike share the smallest name."""
    reps = cut(representatives(rows))
    groups = reps.join(vectors.select("id", "vector"), "id")
    component = connected_components(similar_links(groups, cfg.vector_threshold, cfg.llm_boost))
    placed = reps.join(component, reps["id"] == component["node"]).select("pattern", "component")
    names = placed.groupBy("component").agg(F.min("pattern").alias("merged"))
    return placed.join(names, "component").select("pattern", "merged")


def detect_recurring(
    ledger: DataFrame,
    matches: DataFrame,
    suggestions: DataFrame,
    vectors: DataFrame | None = None,
    cfg: s.Settings = s.DEFAULTS,
) -> DataFrame:
    """New suggestions: unmatched rows by pattern, optionally merged by vectors, clustered by
    amount, kept when some cluster shows a monthly gap."""
    rows = cut(
        with_pattern(unmatched(ledger, matches))
        .where("pattern <> ''")
        .select("transaction_id", "pattern", "transaction_date", "amount", "category", "llm_category")
    )
    if vectors is not None:
        merged = merged_patterns(rows, vectors, cfg)
        rows = rows.join(merged, "pattern", "left").withColumn(
            "pattern", F.coalesce("merged", "pattern")
        ).drop("merged")
    rows = rows.select("pattern", "transaction_date", "amount", "category")
    days = cluster_days(amount_clusters(rows, cfg))
    return one_suggestion_per_pattern(cluster_profiles(days, cfg), suggestions, cfg)
