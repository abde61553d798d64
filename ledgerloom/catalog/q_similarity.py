"""Text and vector similarity, categorization and re-scan."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from ledgerloom.catalog import sql_text as sql
from ledgerloom.catalog.inputs import categories, ledger
from ledgerloom.catalog.registry import query
from ledgerloom.functions import text, vectors
from ledgerloom.functions.amounts import amounts_in_range
from ledgerloom.functions.indel import indel_score
from ledgerloom.operators import filters as flt
from ledgerloom.operators import neighbours, similarity
from ledgerloom.operators.textjoin import similar_texts
from ledgerloom.runtime import cut
from ledgerloom.settings import DEFAULTS
from ledgerloom.sources.bindings import bind

NOISY = "concat(description, ' OTHR-QR', CAST(transaction_id % 10 AS VARCHAR(5)), ' dy', CAST(transaction_id AS VARCHAR(20)), 'Et  ', CAST(custkey % 100 AS VARCHAR(5)))"


@query("normalize_noise", f"SELECT transaction_id, {sql.normalize_noise('noisy')} AS clean FROM (SELECT transaction_id, {NOISY} AS noisy FROM ledger) t")
def normalize_noise(spark, sf):
    noisy = ledger(spark, sf).select("transaction_id", F.expr(NOISY).alias("noisy"))
    return noisy.select("transaction_id", text.normalize_noise(F.col("noisy")).alias("clean"))


@query("pattern_key", f"SELECT transaction_id, {sql.pattern_key('description')} AS pattern FROM ledger")
def pattern_key(spark, sf):
    return ledger(spark, sf).select("transaction_id", text.pattern_key(F.col("description")).alias("pattern"))


KEY = sql.token_key(sql.normalize_noise("description"))
ALL_KEYS = f"SELECT DISTINCT {KEY} AS k FROM ledger"


@query("token_sort_ratio", f""", {sql.pairs('scored', ALL_KEYS, ALL_KEYS)}
SELECT l AS left_key, r AS right_key, round(score, 6) AS score FROM scored""")
def token_sort_ratio(spark, sf):
    keys = ledger(spark, sf).select(similarity.match_key(F.col("description")).alias("key")).distinct()
    return similar_texts(keys, keys).select("left_key", "right_key", F.round("score", 6).alias("score"))


# The score itself, row by row: a matched row's cleaned text and the name of its payment.
SCORED_ROWS = f"""SELECT m.match_id, {sql.token_key(sql.normalize_noise('l.description'))} AS a, {sql.token_key('upper(p.name)')} AS b
  FROM matches m JOIN ledger l USING (transaction_id) JOIN payments p ON p.payment_id = m.payment_id"""


@query("indel_score", f""", texts AS ({SCORED_ROWS}), {sql.pairs('scored', 'SELECT a AS k FROM texts', 'SELECT b AS k FROM texts', 0)}
SELECT match_id, round(score, 6) AS score FROM texts JOIN scored ON l = a AND r = b""")
def indel_score_rows(spark, sf):
    matches, payments = bind(spark, sf, "matches"), bind(spark, sf, "payments")
    rows = matches.join(ledger(spark, sf).select("transaction_id", "description"), "transaction_id").join(
        payments.select("payment_id", "name"), "payment_id"
    )
    score = indel_score(similarity.match_key(F.col("description")), text.token_key(F.upper("name")))
    return rows.select("match_id", F.round(score, 6).alias("score"))


@query("amounts_in_range", """SELECT l.transaction_id, p.payment_id,
  abs(amount - expected_amount) <= 5 OR (least(amount, expected_amount) > 0
    AND greatest(amount, expected_amount) <= 1.15 * least(amount, expected_amount)) AS in_range
FROM ledger l JOIN payments p ON p.category_id = l.category_id AND p.due_day = day(l.transaction_date)""")
def amounts_in_range_query(spark, sf):
    rows, payments = ledger(spark, sf), bind(spark, sf, "payments")
    on = (rows["category_id"] == payments["category_id"]) & (
        payments["due_day"] == F.dayofmonth(rows["transaction_date"])
    )
    gate = amounts_in_range(F.col("amount"), F.col("expected_amount"), DEFAULTS.trusted_ratio, DEFAULTS.trusted_floor)
    return rows.join(payments, on).select("transaction_id", "payment_id", gate.alias("in_range"))


@query("cosine_similarity", """SELECT a.vec_id AS a, b.vec_id AS b,
  round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_similarity(spark, sf):
    a = bind(spark, sf, "embeddings").select(F.col("vec_id").alias("a"), F.col("embedding").alias("va"))
    b = bind(spark, sf, "embeddings").select(F.col("vec_id").alias("b"), F.col("embedding").alias("vb"))
    score = vectors.cosine_similarity(F.col("va"), F.col("vb"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(score, 6).alias("score"))


COSINES = """cosines AS (SELECT a.vec_id AS a, b.vec_id AS b,
  list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a CROSS JOIN embeddings b)"""


@query("llm_boost", f""", {COSINES}
SELECT a, b, round(CASE WHEN x.llm_category = y.category THEN least(1.0, score + 0.05) ELSE score END, 6) AS score
FROM cosines JOIN vectors x ON x.vec_id = a JOIN vectors y ON y.vec_id = b WHERE b = a + 1""")
def llm_boost(spark, sf):
    v = bind(spark, sf, "vectors")
    a = v.select(F.col("vec_id").alias("a"), F.col("embedding").alias("va"), "llm_category")
    b = v.select(F.col("vec_id").alias("b"), F.col("embedding").alias("vb"), "category")
    score = vectors.boosted(
        vectors.cosine_similarity(F.col("va"), F.col("vb")), F.col("category"), F.col("llm_category"), DEFAULTS.llm_boost
    )
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(score, 6).alias("score"))


@query("knn_topk", f""", {COSINES}
SELECT a AS query_id, b AS neighbour_id, round(score, 6) AS score, CAST(place AS INTEGER) AS place
FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS place FROM cosines WHERE a <> b) t
WHERE place <= 5""")
def knn_topk(spark, sf):
    rows = bind(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return neighbours.nearest_neighbours(rows, rows).select(
        "query_id", "neighbour_id", F.round("score", 6).alias("score"), "place"
    )


LOOSE = dataclasses.replace(DEFAULTS, vector_threshold=0.30)


@query("pairwise_cosine_pairs", f""", {COSINES}, near AS (
  SELECT a, b, CASE WHEN x.llm_category = y.category OR y.llm_category = x.category THEN least(1.0, score + 0.05)
                 ELSE score END AS score
  FROM cosines JOIN vectors x ON x.vec_id = a JOIN vectors y ON y.vec_id = b WHERE a <> b)
SELECT v.vec_id AS id, count(n.a) OVER (PARTITION BY v.vec_id) AS n_similar, round(max(n.score) OVER (PARTITION BY v.vec_id), 6) AS best_score,
  n.b AS partner, round(n.score, 6) AS score
FROM vectors v LEFT JOIN near n ON n.a = v.vec_id AND n.score >= 0.30""")
def pairwise_cosine_pairs(spark, sf):
    v = bind(spark, sf, "vectors").withColumnRenamed("vec_id", "id").withColumnRenamed("embedding", "vector")
    return neighbours.similar_partners(v, 0.30).select(
        "id", "n_similar", F.round("best_score", 6).alias("best_score"), "partner", F.round("score", 6).alias("score")
    )


# --- categorization --------------------------------------------------------------------------


def _candidates(spark, sf):
    return flt.eligible_candidates(ledger(spark, sf), categories(spark, sf))


def _incoming(spark, sf):
    return flt.unsure_rows(ledger(spark, sf)).select("transaction_id", "description", "amount", "llm_category")


def _with_vectors(spark, sf, rows):
    v = bind(spark, sf, "ledger_vectors").select("transaction_id", F.col("embedding").alias("vector"))
    return rows.join(v, "transaction_id")


def _vector_inputs(spark, sf):
    """Incoming rows with vectors, the index and the candidates, as stored tables."""
    candidates = cut(_candidates(spark, sf))
    incoming = cut(_with_vectors(spark, sf, _incoming(spark, sf)))
    index = cut(_with_vectors(spark, sf, candidates).select(F.col("transaction_id").alias("id"), "vector"))
    return incoming, index, candidates


IN_RANGE = "(abs(i.amount - c.amount) <= 5 OR greatest(i.amount, c.amount) <= 4.0 * least(i.amount, c.amount))"
KEYED = f""", keyed AS (SELECT transaction_id, amount, category, category_source, llm_category, {KEY} AS k FROM ledger),
incoming AS (SELECT * FROM keyed WHERE category_source = 'unsure'),
known AS (SELECT * FROM keyed WHERE category_source <> 'unsure'),
{sql.pairs('scored', 'SELECT k FROM known', 'SELECT k FROM incoming')},
text_best AS (
  SELECT transaction_id, match_id, match_category, match_source, score FROM (
    SELECT i.transaction_id, c.transaction_id AS match_id, c.category AS match_category,
           c.category_source AS match_source, s.score,
           row_number() OVER (PARTITION BY i.transaction_id
             ORDER BY c.category_source = 'manual' DESC, s.score DESC, c.transaction_id) AS place
    FROM incoming i JOIN scored s ON s.r = i.k JOIN known c ON c.k = s.l AND {IN_RANGE}) t WHERE place = 1)"""


@query("fuzzy_match_best", f"""{KEYED}
SELECT transaction_id, match_id, match_category, match_source, round(score, 6) AS score FROM text_best""")
def fuzzy_match_best(spark, sf):
    best = similarity.best_text_match(_incoming(spark, sf), _candidates(spark, sf))
    return best.withColumn("score", F.round("score", 6))


VEC_BEST = f""", {COSINES},
placed AS (SELECT transaction_id, vec_id FROM ledger_vectors),
neighbours AS (
  SELECT q_vec, id, score, row_number() OVER (PARTITION BY q_vec ORDER BY score DESC, id) AS place FROM (
    SELECT s.a AS q_vec, p.transaction_id AS id, s.score
    FROM (SELECT DISTINCT vec_id FROM placed JOIN incoming USING (transaction_id)) q
    JOIN cosines s ON s.a = q.vec_id JOIN placed p ON p.vec_id = s.b
    JOIN known k ON k.transaction_id = p.transaction_id) t QUALIFY place <= 5),
raised AS (
  SELECT i.transaction_id, n.place, c.transaction_id AS match_id, c.category AS match_category,
         c.category_source AS match_source,
         CASE WHEN i.llm_category <> 'UNSURE' AND i.llm_category = c.category THEN least(1.0, n.score + 0.05)
              ELSE n.score END AS s
  FROM incoming i JOIN placed p ON p.transaction_id = i.transaction_id
  JOIN neighbours n ON n.q_vec = p.vec_id JOIN known c ON c.transaction_id = n.id AND {IN_RANGE}),
vector_best AS (
  SELECT transaction_id, match_id, match_category, match_source, round(s * 100, 2) AS score FROM raised
  WHERE s >= THRESHOLD
  QUALIFY row_number() OVER (PARTITION BY transaction_id
    ORDER BY match_source = 'manual' DESC, round(s * 100, 2) DESC, place) = 1)"""


def _register_vector_match(name, cfg):
    body = KEYED + VEC_BEST.replace("THRESHOLD", str(cfg.vector_threshold))

    @query(name, body + " SELECT transaction_id, match_id, match_category, match_source, round(score, 2) AS score FROM vector_best")
    def vector_match(spark, sf):
        best = similarity.best_vector_match(*_vector_inputs(spark, sf), cfg)
        return best.withColumn("score", F.round("score", 2))


_register_vector_match("embedding_match_best", DEFAULTS)
_register_vector_match("embedding_match_loose", LOOSE)


def _decision(matches: str) -> str:
    return f"""SELECT i.transaction_id,
  CASE WHEN clash THEN 'UNSURE' ELSE coalesce(match_category, opinion, 'UNSURE') END AS category,
  CASE WHEN clash THEN 'unsure' WHEN match_category IS NOT NULL THEN 'similarity'
       WHEN opinion IS NOT NULL THEN 'llm' ELSE 'unsure' END AS source,
  CASE WHEN NOT clash THEN match_id END AS precedent_id, opinion AS llm_suggested, clash AS disagrees,
  CASE WHEN clash THEN match_category END AS similarity_category,
  CASE WHEN clash THEN round(score, 2) END AS similarity_score
FROM (SELECT i.transaction_id, m.match_id, m.match_category, m.score, nullif(i.llm_category, 'UNSURE') AS opinion,
        coalesce(match_category <> nullif(i.llm_category, 'UNSURE'), false) AS clash
      FROM incoming i LEFT JOIN {matches} m USING (transaction_id)) i"""


@query("decide_category", KEYED + _decision("text_best"))
def decide_category(spark, sf):
    return similarity.categorize(_incoming(spark, sf), _candidates(spark, sf))


@query("categorize", KEYED + VEC_BEST.replace("THRESHOLD", "0.82") + """, either AS (
  SELECT * FROM vector_best UNION ALL
  SELECT * FROM text_best WHERE transaction_id NOT IN (SELECT transaction_id FROM vector_best))
""" + _decision("either"))
def categorize(spark, sf):
    incoming, index, candidates = _vector_inputs(spark, sf)
    return similarity.categorize(incoming, candidates, index)


@query("select_best", f"""{KEYED}
SELECT transaction_id, match_id, match_source FROM text_best WHERE match_source = 'manual'""")
def select_best(spark, sf):
    best = similarity.best_text_match(_incoming(spark, sf), _candidates(spark, sf))
    return best.where("match_source = 'manual'").select("transaction_id", "match_id", "match_source")


def _corrected(spark, sf):
    rows = ledger(spark, sf).where(flt.source_is("manual"))
    return rows.select(
        F.col("transaction_id").alias("job_id"),
        "transaction_id",
        "description",
        "amount",
        F.col("category").alias("category_name"),
        "category_source",
    )


def _where_there_is_one(spark, sf, rows):
    """Vectors for the rows that have one; every seventh ten of rows has none."""
    v = bind(spark, sf, "ledger_vectors").select("transaction_id", F.col("embedding").alias("vector"))
    return rows.join(v.where("floor(transaction_id / 10) % 7 <> 3"), "transaction_id", "left")


RESCAN = f""", {COSINES},
placed AS (SELECT transaction_id, vec_id FROM ledger_vectors WHERE floor(transaction_id / 10) % 7 <> 3),
keyed AS (SELECT l.transaction_id, amount, category, category_source, llm_category, vec_id, {KEY} AS k
  FROM ledger l LEFT JOIN placed p ON p.transaction_id = l.transaction_id),
incoming AS (SELECT * FROM keyed WHERE category_source = 'unsure'),
known AS (SELECT * FROM keyed WHERE category_source = 'manual'),
{sql.pairs('scored', 'SELECT k FROM known', 'SELECT k FROM incoming')},
near AS (SELECT * FROM cosines WHERE score >= 0.75),
compared AS (SELECT i.transaction_id, c.transaction_id AS job_id, c.category AS proposed_category, t.score AS by_text,
    CASE WHEN v.score IS NOT NULL AND i.llm_category <> 'UNSURE' AND i.llm_category = c.category THEN least(1.0, v.score + 0.05)
      ELSE v.score END AS by_vector
  FROM incoming i JOIN known c ON {IN_RANGE}
  LEFT JOIN scored t ON t.r = i.k AND t.l = c.k LEFT JOIN near v ON v.a = i.vec_id AND v.b = c.vec_id
  WHERE t.score IS NOT NULL OR v.score IS NOT NULL),
found AS (SELECT transaction_id, job_id, proposed_category,
    CASE WHEN by_vector >= 0.82 THEN round(by_vector * 100, 2) ELSE by_text END AS score FROM compared),
hits AS (SELECT *, min(CASE WHEN score >= 97 THEN job_id END) OVER (PARTITION BY transaction_id) AS settled_by
  FROM found WHERE score IS NOT NULL),
proposed AS (SELECT transaction_id, job_id, proposed_category, round(score, 2) AS match_score,
    CASE WHEN score >= 97 THEN 'auto_applied' ELSE 'pending' END AS status
  FROM hits WHERE settled_by IS NULL OR job_id <= settled_by)"""


@query("rescan_from_precedent", RESCAN + " SELECT * FROM proposed")
def rescan_from_precedent(spark, sf):
    return similarity.rescan(
        _where_there_is_one(spark, sf, _incoming(spark, sf)), _where_there_is_one(spark, sf, _corrected(spark, sf))
    )


@query("recategorize", RESCAN + """
SELECT l.transaction_id, coalesce(p.proposed_category, l.category) AS category,
  CASE WHEN p.proposed_category IS NOT NULL THEN 'similarity' ELSE l.category_source END AS category_source
FROM ledger l LEFT JOIN proposed p ON p.transaction_id = l.transaction_id AND p.status = 'auto_applied'""")
def recategorize(spark, sf):
    return similarity.apply_rescan(
        ledger(spark, sf).select("transaction_id", "category", "category_source"), rescan_from_precedent(spark, sf)
    )
