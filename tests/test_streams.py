"""Streams against the batch form of the same job."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerloom import runtime
from ledgerloom.catalog import load
from ledgerloom.operators import recurring
from ledgerloom.sources import statements as st
from ledgerloom.sources.bindings import bind
from ledgerloom.streaming import jobs


def test_one_file_of_rows_matches_like_the_batch(spark, sf_dir, tmp_path):
    rows = bind(spark, sf_dir, "ledger").select("transaction_id", "transaction_date", "description", "amount")
    payments, matches = bind(spark, sf_dir, "payments"), bind(spark, sf_dir, "matches")
    inbox = str(tmp_path / "in")
    rows.coalesce(1).write.parquet(inbox)
    stream = jobs.file_stream(spark, inbox, "*.parquet", rows.schema)
    got = jobs.stream_recurring_matches(stream, payments, matches, str(tmp_path / "out"), str(tmp_path / "cp"))
    want = recurring.match_by_text(rows, payments, matches)
    columns = [f.name for f in jobs.MATCHES.fields]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_a_cycle_taken_in_one_batch_is_taken_in_the_next(spark, tmp_path):
    rows = "transaction_id bigint, transaction_date date, description string, amount decimal(18,2)"
    inbox = str(tmp_path / "in")
    for n in (1, 2):
        spark.createDataFrame([(n, dt.date(2027, 3, n), "GYM", D("5.00"))], rows).coalesce(1).write.mode("append").parquet(inbox)
    payments = spark.createDataFrame(
        [(1, "gym", D("5.00"), "monthly", None, 2, True)],
        "payment_id bigint, name string, expected_amount decimal(18,2), frequency string, due_month int, due_day int, is_trusted boolean",
    )
    none = spark.createDataFrame([], "payment_id bigint, cycle_period string, status string")
    stream = jobs.file_stream(spark, inbox, "*.parquet", spark.read.parquet(inbox).schema)
    got = jobs.stream_recurring_matches(stream, payments, none, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert got.count() == 1


def test_statement_files_arrive_once(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.pdf").write_bytes(b"one")
    (inbox / "b.pdf").write_bytes(b"one")
    (inbox / "c.txt").write_bytes(b"no statement")
    (inbox / "_trash.pdf").write_bytes(b"gone")
    listed = st.list_files(spark, str(inbox)).select(st.content_hash(F.col("content"))).collect()
    assert len(listed) == 2 and len(set(listed)) == 1

    def run(files, known):
        first = files.groupBy("content_hash").agg(F.min("file_id").alias("statement_id"))
        seen = known.select("content_hash", F.lit(True).alias("seen"))
        return files.join(first, "content_hash").join(seen, "content_hash", "left").select(
            "file_id",
            F.when(F.col("seen").isNull() & (F.col("file_id") == F.col("statement_id")), "processed")
            .otherwise("skipped_duplicate").alias("outcome"),
            F.lit(None).cast("string").alias("reason"),
            "statement_id",
            F.lit(None).cast("int").alias("n_transactions"),
        )

    stream = jobs.statement_file_stream(spark, str(inbox), files=1).select(
        F.col("path").alias("file_id"), st.content_hash(F.col("content")).alias("content_hash")
    )
    got = jobs.stream_statements(stream, run, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r["outcome"] for r in got.collect()) == ["processed", "skipped_duplicate"]


def test_monthly_totals_equal_the_batch(spark, sf_dir):
    queries, _ = load()
    assert queries["stream_monthly_totals"](spark, sf_dir).count() > 50


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "yarn"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                class Inner:
                    @staticmethod
                    def getCheckpointDir():
                        class Nothing:
                            @staticmethod
                            def isDefined():
                                return False

                        return Nothing()

                return Inner()

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            @staticmethod
            def get(_key, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Session())
    Session.conf.get = staticmethod(lambda _key, default=None: "/shared/cp/")
    assert runtime.shared_dir(Session()) == "/shared/cp"


def test_many_folders_are_listed_in_few_tasks(spark, tmp_path):
    for i in range(st.LISTERS + 30):
        (tmp_path / "inbox" / f"box={i}").mkdir(parents=True)
        (tmp_path / "inbox" / f"box={i}" / "a.txt").write_text(str(i))
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(setting)
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        listed = st.list_files(spark, str(tmp_path / "inbox"), "txt")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [stage for job in tracker.getJobIdsForGroup("listing") for stage in tracker.getJobInfo(job).stageIds]
    assert stages and max(tracker.getStageInfo(stage).numTasks for stage in stages) <= st.LISTERS
    assert spark.conf.get(setting) == before
    assert listed.count() == st.LISTERS + 30
