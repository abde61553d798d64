"""The registered queries over the whole smallest tables, next to their SQL or a brute-force version."""

import hashlib
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from test_bin_packing import check  # noqa: E402
from test_pii_offsets import brute  # noqa: E402
from verify import rows_of  # noqa: E402

from ledgerloom.llm import pii_offsets, queries, secret_forest  # noqa: E402


def documents(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    mine, theirs = queries.QUERIES[name](spark, sf_dir).toArrow(), con.sql(queries.ORACLES[name]).to_arrow_table()
    columns = sorted(mine.column_names)
    assert columns == sorted(theirs.column_names)
    assert rows_of(mine, columns) == rows_of(theirs, columns)


def test_every_number_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_base_spans_of_all_documents(spark, sf_dir):
    found = {r.doc_id: r for r in queries.QUERIES["op8_offset_deobfuscation"](spark, sf_dir).collect()}
    for doc, text in documents(spark, sf_dir):
        spans = brute(text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k in pii_offsets.KINDS for a, b in spans[k])
        assert found[doc].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [found[doc][f"n_{k}"] for k in pii_offsets.KINDS] == [len(spans[k]) for k in pii_offsets.KINDS]
        assert found[doc].spans == joined


def test_findings_of_all_documents(spark, sf_dir):
    found = queries.QUERIES["op9_secret_forest"](spark, sf_dir).collect()
    expected = [(doc, a, b) for doc, text in documents(spark, sf_dir) for a, b in secret_forest.candidates(text or "")]
    assert sorted((r.doc_id, r.start, r.end) for r in found) == sorted(expected)
    texts = dict(documents(spark, sf_dir))
    for r in found:
        run, before = texts[r.doc_id][r.start : r.end], texts[r.doc_id][max(0, r.start - 12) : r.start]
        if run.startswith("AKIA") or before.endswith(("password=", 'token = "')):
            assert r.is_secret
        if run.isdigit():
            assert not r.is_secret


def test_packing_of_all_documents(spark, sf_dir):
    by_sequence, total = check(documents(spark, sf_dir), queries.QUERIES["op10_minimum_bin_slack"](spark, sf_dir).collect())
    assert len(by_sequence) <= -(-total // 1024) * 1.02 + 2


def test_toxicity_of_all_documents(spark, sf_dir):
    found = queries.QUERIES["op5_compression_distance"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in found) == sorted(doc for doc, _ in documents(spark, sf_dir))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
