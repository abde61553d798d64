"""Registered queries next to their SQL on the smallest tables.

A selection by theme; LEDGERLOOM_ALL=1 runs them all, as tools/verify.py does on larger ones.
"""

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as entry
from ledgerloom.sources.bindings import TABLES
from verify import rows_of

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
CHOSEN = (
    "filter_composite", "page", "recent_activity", "dash_category_trends", "top_series_other", "resolve_conversion",
    "statement_gate", "repair_ambiguous_dates", "parse_batch_labels", "fuzzy_match_best", "embedding_match_best",
    "categorize", "recategorize", "match_recurring", "detect_recurring", "merge_groups", "apply_proposals",
    "curate_training_set", "export_ledger_csv", "constraint_audit", "ingest_ledger", "stream_statements",
)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def test_every_query_is_registered_once_and_named_plainly():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 140
    assert all("\n" in sql or sql.strip() for sql in ORACLES.values())


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("LEDGERLOOM_ALL") else CHOSEN)
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    mine = QUERIES[name](spark, sf_dir).toArrow()
    theirs = duck.sql(ORACLES[name]).to_arrow_table()
    columns = sorted(mine.column_names)
    assert columns == sorted(theirs.column_names)
    assert rows_of(mine, columns) == rows_of(theirs, columns)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
