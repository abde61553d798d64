"""The pipeline against a brute-force version of every stage, on the smallest tables."""

import importlib
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import mixing, queries, secret_forest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from test_jaccard_join import brute as components_of  # noqa: E402

corpus_pipeline = importlib.import_module("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    results = [docs]
    for _, stage in corpus_pipeline.STAGES:
        from ledgerloom.runtime import cut

        results.append(cut(stage(spark, results[-1], sf_dir)))
    return results


def rows(frame):
    return sorted((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in frame.collect())


def test_stages_keep_the_columns_of_documents(stages):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality_equals_its_sql(stages, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    kept = {doc for doc, ok in con.sql(f"SELECT doc_id, kept FROM ({queries.OP3_SQL})").fetchall() if ok}
    assert rows(stages[1]) == [r for r in rows(stages[0]) if r[0] in kept]


def test_one_document_of_each_group_stays(stages):
    before = rows(stages[1])
    stay = {i for i, _, component in components_of([(r[0], r[1]) for r in before], 5, 80) if i == component}
    assert rows(stages[2]) == [r for r in before if r[0] in stay]


def test_secrets_are_replaced_and_nothing_else(stages):
    flagged = {}
    for r in secret_forest.scan(stages[2]).where("is_secret").collect():
        flagged.setdefault(r.doc_id, []).append((r.start, r.end))
    for before, after in zip(rows(stages[2]), rows(stages[3]), strict=True):
        spans = sorted(flagged.get(before[0], []))
        expected, at = "", 0
        for a, b in spans:
            expected += before[1][at:a] + secret_forest.PLACEHOLDER
            at = b
        assert after == (before[0], expected + before[1][at:], *before[2:])


def test_mixing_equals_its_sql(stages):
    con = duckdb.connect()
    con.register("documents", stages[3].toArrow())
    sql = queries.OP2_SQL.replace(f"* {queries.EPOCHS} AS capacity", "* 1 AS capacity").replace(
        f"* {queries.BUDGET_PERCENT} // 100", f"* {corpus_pipeline.BUDGET_PERCENT} // 100"
    )
    taken = sorted(r[0] for r in con.sql(f"SELECT doc_id FROM ({sql})").fetchall())
    assert rows(stages[4]) == [r for r in rows(stages[3]) if r[0] in set(taken)]
    assert 0 < len(taken) < len(rows(stages[3])) and mixing.LEAF == ["domain", "lang", "source"]


def test_packing_holds_every_token_once(stages, spark, sf_dir):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = []
    for doc, text, *_ in rows(stages[4]):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        bounds = [0, *range(first, len(ids) + 1, 1024)]
        expected += [
            (doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))
        ]
    packed = stages[5].collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == sorted(expected)
    ends = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 1024
    assert len(ends) <= -(-sum(ends.values()) // 1024) * 1.02 + 2
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole) == sorted((r[0], r[1], r[4]) for r in expected)


WORDS = "the of and is to in house garden tree water light stone river cloud bread window paper music winter summer".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n)) + "."


ODD_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, epoch int, row string, `a.b` int, kept boolean, node long, n int, `word` string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, one id with unlike texts, clashing names."""
    more = (5, "r", 6, False, 7, 8, "w")
    rows = [
        (1, prose(1, 300), "en", "src1", 9, *more), (1, prose(2, 300), "en", "src1", 9, *more), (2, prose(3, 300), "en", "src2", 9, *more),
        (3, prose(4, 200), "de", "src3", 9, *more), (3, prose(4, 200), "de", "src3", 9, *more), (4, prose(4, 200) + " end", None, None, None, *more),
        (5, None, "en", "src1", None, *more), (6, "", "en", "src1", 0, *more), (None, prose(5, 150), "fr", "src1", 9, *more),
        (7, prose(6, 40_000), "en", "src4", 9, *more), (8, prose(7, 120) + " password=0d82db9a40de89a262", "en", "src5", 9, *(None,) * 7),
    ]
    return spark.createDataFrame(rows, ODD_COLUMNS).repartition(3)


def all_rows(frame):
    return sorted(map(str, (tuple(r) for r in frame.collect())))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows(spark, odd, name, sf_dir):
    stage = dict(corpus_pipeline.STAGES)[name]
    found = stage(spark, odd, sf_dir)
    if name == "pack":
        texts = [r.text for r in odd.collect()]
        packed = found.collect()
        assert sum(r.piece == 0 for r in packed) == len(texts)
        assert max(r.offset + r.length for r in packed) <= 1024
        return
    assert found.columns == odd.columns
    rows, before = all_rows(found), all_rows(odd)
    if name == "secrets":
        assert len(rows) == len(before) and sum("[SECRET]" in r for r in rows) == 1
        assert [r for r in rows if "[SECRET]" not in r] == [r for r in before if "password=" not in r]
        return
    assert set(rows) <= set(before)
    if name == "near_copies":
        # of 3, its repeated row and 4 one stays; all unlike texts do, with or without an id or shingles
        assert sorted(str(r.doc_id) for r in found.collect()) == ["1", "1", "2", "3", "5", "6", "7", "8", "None"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_an_empty_table(spark, name, sf_dir):
    docs = spark.createDataFrame([], ODD_COLUMNS)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir).collect() == []
