"""Archives: a round trip over hostile payloads, read in parts of any size."""

import base64
import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import warc_chain
from ledgerloom.runtime import scratch_path

QUOTED = (
    "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:999>\r\nContent-Type: text/html\r\n"
    "Content-Length: {}\r\n\r\nquoted\r\n\r\n"
)


def hostile(n: int) -> list[tuple]:
    payloads = [
        "", None, "plain", "\r\n", "\r\n\r\n", "a\r\nb\r\n\r\nc", "WARC/1.1", "WARC/1.1\r\n\r\n", "x" * 9000 + "\r\n" + "y" * 5000,
        QUOTED.format(6), "before\r\n" + QUOTED.format(6), QUOTED.format(100000), QUOTED.format(0) * 20, "é漢\r\nЖ", "plain",
        "ends\r\n", "\n" * 50, "WARC/1.1\r\nContent-Length: 4", "line\r\n" * 700,
    ]
    return [(i * 3 + 1, f"http://h{i}.example/\r\nx", payloads[i % len(payloads)]) for i in range(n)]


def expected(rows):
    first = {}
    for page, _, html in rows:
        first[html or ""] = min(page, first.get(html or "", page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        own = first[html or ""] == page
        out.append((page, len(data), digest, "response" if own else "revisit", None if own else first[html or ""]))
    return sorted(out)


@pytest.mark.parametrize("part", [700, 2048, 5000, 1 << 20])
def test_round_trip_in_parts(spark, part):
    rows = hostile(60)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2, "page_id")
    path = scratch_path(spark, "warc")
    warc_chain.write(pages, path)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", part)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        found = sorted(tuple(r) for r in warc_chain.read(spark, path).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == expected(rows)


def test_repeated_rows_and_missing_ids(spark):
    rows = [(1, None, "a"), (1, "u", "a"), (None, "u", "a"), (None, "u", "b"), (2, "u", "a")]
    path = scratch_path(spark, "warc")
    warc_chain.write(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    found = [(r.page_id, r.record_type, r.refers_to) for r in warc_chain.read(spark, path).collect()]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(found, key=key) == sorted(
        [(1, "response", None), (1, "response", None), (None, "revisit", 1), (None, "response", None), (2, "revisit", 1)], key=key
    )


def test_empty_table_and_other_columns(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string, record string, size int, file string")
    path = scratch_path(spark, "warc")
    warc_chain.write(pages, path)
    assert warc_chain.read(spark, path).count() == 0


def test_pointers_reach_only_the_chain(spark):
    chain = [(f"f{f}", i * 10, i * 10 + 10) for f in range(2) for i in range(37)]
    strays = [("f0", 15, 20), ("f0", 25, 1000), ("f1", 3, 7)]
    edges = spark.createDataFrame(chain + strays, "file string, at long, to long")
    found = {(r.file, r["at"]) for r in warc_chain.reachable(edges).collect()}
    assert found == {(f, at) for f, at, _ in chain}


def test_base32_in_columns(spark):
    texts = ["", "a", "é", uuid.uuid4().hex]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", warc_chain.sha1_base32(F.col("t").cast("binary")).alias("d"))
    for r in rows.collect():
        assert r.d == base64.b32encode(hashlib.sha1(r.t.encode()).digest()).decode()


@pytest.mark.parametrize("part", [1500, 1 << 20])
def test_urls_longer_than_a_part(spark, part):
    rows = hostile(18)
    for i in (14,):
        rows[i] = (rows[i][0], "data:text/html," + "x" * 100_000 + f":{i}", rows[i][2])
    path = scratch_path(spark, "warc")
    warc_chain.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1), path)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", part)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        found = sorted(tuple(r) for r in warc_chain.read(spark, path).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == expected(rows)
