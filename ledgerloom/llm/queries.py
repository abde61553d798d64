"""Queries of the subpackage on the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bin_packing, hard_negatives, jaccard_join, mixing, nn_descent, pii_offsets, quality_divergence, quality_nbsvm, secret_forest, spelling_kdtree, toxicity_zstd, url_trust, warc_chain
from ledgerloom.runtime import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^ \t-\r]+')"
_ASCII_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(_table(spark, sf_dir, "documents"), width=3, percent=90)


OP1_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, {WORDS.format(text=_ASCII_LOWER)} AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) END) AS s FROM words
), sizes AS (SELECT doc_id, len(s) AS n FROM sets),
shingles AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= 90 * (p.n + q.n - c)
), reach AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT s.doc_id, CAST(n AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(y), s.doc_id)) AS component_id
FROM sizes s LEFT JOIN reach ON x = s.doc_id GROUP BY s.doc_id, n
"""


BUDGET_PERCENT, EPOCHS = 60, 2
WEIGHTS = {
    "domain": {"domain0": 1, "domain1": 4, "domain2": 3, "domain3": 2},
    "lang": {"en": 4, "de": 2, "fr": 3, "es": 1},
}


def op2_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = mixing.source_domain()
    counted, leaves = mixing.plan(_table(spark, sf_dir, "documents"), domain, BUDGET_PERCENT, EPOCHS, WEIGHTS)
    return mixing.copies(counted.withColumnRenamed("domain", "of"), leaves, F.col("of")).select(
        "row.doc_id", F.col("row.of").alias("domain"), "row.lang", "row.source", "row.n_tokens", "epoch"
    )


def _level_sql(name: str, parent: list[str], before: str) -> str:
    """CTEs that split the budgets of ``before`` among the children at ``name``."""
    by = f"PARTITION BY {', '.join(parent)}" if parent else ""
    keys = ", ".join([*parent, name])
    weight = "CASE " + " ".join(f"WHEN {name} = '{k}' THEN {w}" for k, w in WEIGHTS[name].items()) + " ELSE 1 END" if name in WEIGHTS else "1"
    return f"""
{name}_nodes AS (
  SELECT {keys}, sum(capacity) AS capacity, {weight} AS weight FROM leaves GROUP BY {keys}
), {name}_asked AS (
  SELECT *, least(budget, sum(capacity) OVER ({by})) AS goal,
    sum(capacity) OVER w AS held, sum(weight) OVER ({by}) - sum(weight) OVER w AS above
  FROM {name}_nodes {f"JOIN {before} USING ({', '.join(parent)})" if parent else f"CROSS JOIN {before}"}
  WINDOW w AS ({by} ORDER BY capacity / weight, {name} ROWS UNBOUNDED PRECEDING)
), {name}_full AS (SELECT *, (goal - held) * weight >= capacity * above AS is_full FROM {name}_asked),
{name}_rest AS (
  SELECT *, goal - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER ({by}) AS rest,
    sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({by}) AS open_weight FROM {name}_full
), {name}_part AS (SELECT *, CASE WHEN is_full THEN 0 ELSE rest * weight // open_weight END AS part FROM {name}_rest),
{name}_budget AS (
  SELECT {keys}, CASE WHEN is_full THEN capacity
    ELSE part + CASE WHEN row_number() OVER ({by} ORDER BY is_full, {name}) <= rest - sum(part) OVER ({by}) THEN 1 ELSE 0 END
    END AS budget FROM {name}_part
)"""


OP2_SQL = f"""
WITH counted AS (
  SELECT doc_id, 'domain' || (coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]+)', 1) AS BIGINT), 0) % 4) AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CAST(len({WORDS.format(text="text")}) AS BIGINT) AS n_tokens FROM documents
), leaves AS (
  SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * {EPOCHS} AS capacity FROM counted GROUP BY ALL
), root AS (SELECT sum(tokens) * {BUDGET_PERCENT} // 100 AS budget FROM leaves),
{_level_sql("domain", [], "root")},
{_level_sql("lang", ["domain"], "domain_budget")},
{_level_sql("source", ["domain", "lang"], "lang_budget")},
quota AS (
  SELECT domain, lang, source, budget // tokens AS epochs, budget % tokens AS rest
  FROM leaves JOIN source_budget USING (domain, lang, source) WHERE budget > 0
), placed AS (
  SELECT c.*, epochs, rest, coalesce(sum(n_tokens) OVER (
    PARTITION BY domain, lang, source ORDER BY md5('{mixing.SEED}:' || epochs || ':' || doc_id)
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM counted c JOIN quota USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, n_tokens,
  unnest(range(CAST(epochs + CASE WHEN before < rest THEN 1 ELSE 0 END AS BIGINT))) AS epoch FROM placed
"""


def op3_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_divergence.assess(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _distance_sql(pairs: str) -> str:
    """Jensen-Shannon distance of a list of [p, q]."""
    side = "CASE WHEN x[{0}] > 0 THEN x[{0}] * log2(2 * x[{0}] / (x[1] + x[2])) ELSE 0 END"
    terms = f"list_transform({pairs}, lambda x: {side.format(1)} + {side.format(2)})"
    return f"sqrt(greatest(list_sum({terms}), 0) / 2)"


_q = quality_divergence
_CLASS_COUNTS = "[" + ", ".join(
    f"length(regexp_replace(packed, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g'))" for pattern in _q.CLASSES.values()
) + ", strlen(packed) - length(packed)]"
_SHARES = "list_transform({0}, lambda n: n / {1})"
_REST = "greatest(0.0, 1 - list_sum({0}))"
OP3_SQL = f"""
WITH words AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, {WORDS.format(text="text")} AS w FROM documents
), packed AS (SELECT *, len(w) AS n, array_to_string(w, '') AS packed FROM words),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words),
dup_lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS d FROM lines WHERE regexp_matches(line, '[^ \t-\r]') GROUP BY doc_id
), windows AS (
  SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT doc_id, w, unnest(range(1, n - 1)) AS i FROM packed)
), places AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT i + k) AS r FROM places, range(3) t(k) GROUP BY doc_id
), totals AS (
  SELECT lang, sum(n) AS total, sum(length(packed)) AS chars,
    [{", ".join(f"sum(c[{i + 1}])" for i in range(len(_q.CLASSES) + 1))}] AS own
  FROM (SELECT lang, n, packed, {_CLASS_COUNTS} AS c FROM packed WHERE lang IS NOT NULL) GROUP BY lang
  HAVING sum(n) >= {_q.MIN_REFERENCE}
), common AS (
  SELECT lang, word, count(*) / any_value(total) AS share
  FROM (SELECT lang, unnest(w) AS word FROM packed) JOIN totals USING (lang)
  GROUP BY lang, word HAVING count(*) * {_q.COMMON} >= any_value(total)
), refs AS (
  SELECT lang, list(word ORDER BY word) AS word, list(share ORDER BY word) AS share FROM common GROUP BY lang
), judged AS (
  SELECT p.*, word, share, {_SHARES.format(_CLASS_COUNTS, "nullif(length(packed), 0)")} AS mine_c,
    {_SHARES.format("own", "nullif(chars, 0)")} AS ref_c,
    list_transform(word, lambda c: len(list_filter(w, lambda x: x = c)) / n) AS mine_w
  FROM packed p LEFT JOIN totals USING (lang) LEFT JOIN refs USING (lang)
), distances AS (
  SELECT *,
    CASE WHEN n >= {_q.MIN_WORDS_CLASSES} AND ref_c IS NOT NULL THEN {_distance_sql(
      f"list_transform(list_zip(list_append(mine_c, {_REST.format('mine_c')}), list_append(ref_c, {_REST.format('ref_c')})), lambda z: [z[1], z[2]])"
    )} END AS by_class,
    CASE WHEN n >= {_q.MIN_WORDS_COMMON} AND share IS NOT NULL THEN {_distance_sql(
      f"list_transform(list_zip(list_append(mine_w, {_REST.format('mine_w')}), list_append(share, {_REST.format('share')})), lambda z: [z[1], z[2]])"
    )} END AS by_word
  FROM judged
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(length(packed) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(d, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words,
  n < {_q.MIN_WORDS} OR 100 * coalesce(r, 0) > {_q.MAX_REPEAT_PERCENT} * n AS base_failed,
  NOT (n < {_q.MIN_WORDS} OR 100 * coalesce(r, 0) > {_q.MAX_REPEAT_PERCENT} * n)
    AND coalesce(by_class, 0) <= {_q.MAX_DISTANCE_CLASSES} AND coalesce(by_word, 0) <= {_q.MAX_DISTANCE_COMMON} AS kept
FROM distances LEFT JOIN dup_lines USING (doc_id) LEFT JOIN repeats USING (doc_id)
"""

def op4_boundary_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc_chain.write(_table(spark, sf_dir, "pages"), path)
    return warc_chain.read(spark, path)


_B32 = " || ".join(
    f"substr('{warc_chain._BASE32}', ((('0x' || substr(d, {5 * g + 1}, 5))::INT >> {s}) & 31) + 1, 1)"
    for g in range(8)
    for s in (15, 10, 5, 0)
)
OP4_SQL = f"""
WITH payloads AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS d FROM pages
), firsts AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM payloads)
SELECT page_id, payload_bytes, {_B32} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts
"""


def op5_compression_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_zstd.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.98)


OP6_SQL = """
WITH RECURSIVE unit AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS norm
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), usable AS (
  SELECT * FROM unit WHERE norm > 0 AND isfinite(norm) AND len(list_filter(v, lambda x: x IS NULL)) = 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98
), reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
degrees AS (SELECT x, count(*) AS n FROM links GROUP BY x),
lowest AS (SELECT x, min(y) AS low FROM reach GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
  vec_id <= coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN degrees d ON d.x = vec_id LEFT JOIN lowest l ON l.x = vec_id
"""


def op7_link_graph_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _rule_sql(column: str) -> str:
    rules = sorted(url_trust.RULES, key=lambda r: -len(r.name))
    fits = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
    value = (lambda r: r.name) if column == "rule" else (lambda r: r.action)
    return "CASE " + " ".join(f"WHEN {fits.format(r.host, r.path)} THEN '{value(r)}'" for r in rules) + " END"


_u = url_trust
_HOST = f"translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_u.UPPER}', '{_u.LOWER}')"
_LINKS = _u.LINKS.replace("'", "''")
OP7_SQL = f"""
WITH RECURSIVE cut AS (
  SELECT page_id, html, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, html, {_HOST} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), ruled AS (SELECT page_id, host, path, {_rule_sql("rule")} AS rule, {_rule_sql("action")} AS action FROM parts),
links AS (
  SELECT src, dst, count(*) AS n FROM (
    SELECT host AS src, translate(unnest(regexp_extract_all(html, '{_LINKS}', 1)), '{_u.UPPER}', '{_u.LOWER}') AS dst
    FROM parts WHERE host <> '') WHERE src <> dst GROUP BY ALL
), names AS (SELECT host FROM parts WHERE host <> '' UNION SELECT dst FROM links),
chains AS (
  SELECT string_split(host, '.') AS l, unnest(range(1, len(string_split(host, '.')) - 1)) AS i FROM names
  WHERE len(string_split(host, '.')) >= 3
), steps AS (
  SELECT DISTINCT array_to_string(l[i:], '.') AS a, array_to_string(l[i + 1:], '.') AS b FROM chains
), edges AS (
  SELECT src, dst, sum(n) AS n FROM (
    SELECT * FROM links UNION ALL SELECT a, b, 1 FROM steps UNION ALL SELECT b, a, 1 FROM steps) GROUP BY ALL
), directed AS (
  SELECT 'allow' AS kind, src, dst, n FROM edges UNION ALL SELECT 'block', dst, src, n FROM edges
), shares AS (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS share FROM directed),
seeds AS (
  SELECT action AS kind, host, count(*) / sum(count(*)) OVER (PARTITION BY action) AS seed
  FROM ruled WHERE host <> '' AND action IS NOT NULL GROUP BY action, host
), moves AS (
  SELECT kind, src, dst, share FROM shares
  UNION ALL SELECT DISTINCT kind, host, host, 1.0 FROM (
    SELECT kind, host FROM seeds UNION SELECT kind, dst FROM directed) t
  WHERE NOT EXISTS (SELECT 1 FROM shares s WHERE s.kind = t.kind AND s.src = t.host)
), walk AS (
  SELECT 0 AS step, kind, host, seed AS rank FROM seeds
  UNION ALL
  SELECT step, kind, host, sum(rank) AS rank FROM (
    SELECT step + 1 AS step, w.kind, dst AS host, rank * share * {_u.DAMPING} AS rank
    FROM walk w JOIN moves m ON m.kind = w.kind AND m.src = w.host WHERE step < {_u.ROUNDS}
    UNION ALL
    SELECT step + 1, s.kind, s.host, seed * (1 - {_u.DAMPING})
    FROM seeds s, (SELECT DISTINCT step FROM walk) t WHERE step < {_u.ROUNDS}
  ) GROUP BY step, kind, host
), hosts AS (
  SELECT host, round(coalesce(max(rank) FILTER (kind = 'allow'), 0), {_u.DIGITS}) AS trust,
    round(coalesce(max(rank) FILTER (kind = 'block'), 0), {_u.DIGITS}) AS distrust
  FROM walk WHERE step = {_u.ROUNDS} GROUP BY host
)
SELECT page_id, r.host, path, rule,
  coalesce(action, CASE WHEN distrust > {_u.BIAS} * trust THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r LEFT JOIN hosts h ON h.host = r.host
"""


def op8_offset_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_offsets.find(_table(spark, sf_dir, "documents"))


def op9_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_forest.scan(_table(spark, sf_dir, "documents"))


def op10_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_packing.pack(_table(spark, sf_dir, "documents"))


def op11_four_russians(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding"
    )
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH relabelled AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST(embedding AS DOUBLE[]) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), usable AS (
  SELECT vec_id, label, list_transform(x, lambda c: floor(256 * c)) AS v FROM relabelled
  WHERE label IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor, other AS positive, score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5
)
SELECT p.anchor AS anchor_id, positive AS positive_id, other AS negative_id, p.score AS positive_score, s.score AS negative_score,
  CAST(row_number() OVER (PARTITION BY p.anchor, positive ORDER BY s.score DESC, other) AS INT) AS rank
FROM positives p JOIN scored s ON s.anchor = p.anchor AND NOT same
  AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
QUALIFY rank <= 5
"""


def op12_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_nbsvm.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_kdtree_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_kdtree.variants(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_hierarchical_mixing": op2_hierarchical_mixing,
    "op3_distribution_divergence": op3_distribution_divergence,
    "op4_boundary_chain": op4_boundary_chain,
    "op5_compression_distance": op5_compression_distance,
    "op6_nn_descent": op6_nn_descent,
    "op7_link_graph_trust": op7_link_graph_trust,
    "op8_offset_deobfuscation": op8_offset_deobfuscation,
    "op9_secret_forest": op9_secret_forest,
    "op10_minimum_bin_slack": op10_minimum_bin_slack,
    "op11_four_russians": op11_four_russians,
    "op12_nbsvm_quality": op12_nbsvm_quality,
    "op13_kdtree_spelling": op13_kdtree_spelling,
}

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": OP1_SQL,
    "op2_hierarchical_mixing": OP2_SQL,
    "op3_distribution_divergence": OP3_SQL,
    "op4_boundary_chain": OP4_SQL,
    "op6_nn_descent": OP6_SQL,
    "op7_link_graph_trust": OP7_SQL,
    "op11_four_russians": OP11_SQL,
}
