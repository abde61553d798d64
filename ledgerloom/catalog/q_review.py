"""Review decisions, pending lists, training sets, exports and the audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom import settings as s
from ledgerloom.catalog.inputs import TODAY, categories, converted, ledger
from ledgerloom.catalog.registry import query
from ledgerloom.operators import audit as aud
from ledgerloom.operators import categories as cats
from ledgerloom.operators import filters as flt
from ledgerloom.operators import paging, review, training
from ledgerloom.runtime import scratch_path
from ledgerloom.sources import exports
from ledgerloom.sources import statements as st
from ledgerloom.sources.bindings import bind


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- pending lists ---------------------------------------------------------------------------


@query("proposals_enriched", """SELECT p.proposal_id, p.job_id, p.match_score, l.description, l.amount, l.category,
  c.name AS proposed_category, j.source_transaction_id
FROM proposals p JOIN ledger l USING (transaction_id) JOIN categories c ON c.category_id = p.proposed_category_id
JOIN jobs j ON j.job_id = p.job_id WHERE p.status = 'pending'""")
def proposals_enriched(spark, sf):
    rows = review.proposals_enriched(
        bind(spark, sf, "proposals"), ledger(spark, sf), categories(spark, sf), bind(spark, sf, "jobs")
    )
    return rows.select(
        "proposal_id", "job_id", "match_score", "description", "amount", "category", "proposed_category",
        "source_transaction_id",
    )


@query("disagreements_enriched", """SELECT d.disagreement_id, l.description, l.amount, a.name AS similarity, b.name AS llm, r.name AS resolved
FROM disagreements d JOIN ledger l USING (transaction_id) JOIN categories a ON a.category_id = d.similarity_category_id
JOIN categories b ON b.category_id = d.llm_category_id LEFT JOIN categories r ON r.category_id = d.resolved_category_id
WHERE d.status = 'pending'""")
def disagreements_enriched(spark, sf):
    rows = review.disagreements_enriched(bind(spark, sf, "disagreements"), ledger(spark, sf), categories(spark, sf))
    return rows.select("disagreement_id", "description", "amount", "similarity", "llm", "resolved")


@query("matches_enriched", """SELECT m.match_id, m.cycle_period, m.amount_at_match, p.name AS payment_name, l.description, l.category
FROM matches m JOIN payments p USING (payment_id) JOIN ledger l ON l.transaction_id = m.transaction_id WHERE m.status = 'pending'""")
def matches_enriched(spark, sf):
    rows = review.matches_enriched(bind(spark, sf, "matches"), bind(spark, sf, "payments"), ledger(spark, sf))
    return rows.select("match_id", "cycle_period", "amount_at_match", "payment_name", "description", "category")


query("pending_counts", """SELECT (SELECT count(*) FROM proposals WHERE status = 'pending')
  + (SELECT count(*) FROM disagreements WHERE status = 'pending') AS pending_count""")(
    lambda spark, sf: review.pending_counts(bind(spark, sf, "proposals"), bind(spark, sf, "disagreements"))
)
query("latest_instance_pick", "SELECT run_id, started_at, status FROM runs ORDER BY started_at DESC LIMIT 1")(
    lambda spark, sf: review.latest_instance(bind(spark, sf, "runs"), "started_at", "run_id", "started_at", "status")
)

# --- decisions -------------------------------------------------------------------------------

CORRECTIONS = """SELECT transaction_id AS decision_id, CASE WHEN transaction_id % 6 = 5 THEN -transaction_id ELSE transaction_id END AS transaction_id,
  CASE transaction_id % 4 WHEN 0 THEN 'promo' WHEN 1 THEN 'large' WHEN 2 THEN 'missing' ELSE 'small' END AS category_id
FROM ledger WHERE priority = '4-NOT SPECIFIED'"""


def derived(spark, sf, binding: str, text: str):
    """A decisions table computed from one binding by SQL that both engines read."""
    return spark.sql(text.replace(f"FROM {binding}", "FROM {src}"), src=bind(spark, sf, binding))


CORRECTED = f"""outcomes AS (SELECT d.decision_id, d.transaction_id,
    CASE WHEN l.transaction_id IS NULL THEN 'transaction not found' WHEN c.name IS NULL THEN 'category not found'
         WHEN NOT c.active THEN 'category inactive' END AS reason, c.name
  FROM ({CORRECTIONS}) d LEFT JOIN ledger l ON l.transaction_id = d.transaction_id LEFT JOIN categories c ON c.category_id = d.category_id)"""


@query("apply_corrections", f""", {CORRECTED} SELECT decision_id, transaction_id, reason, CASE WHEN reason IS NULL THEN name END AS category,
  CASE WHEN reason IS NULL THEN 'manual' END AS category_source, CASE WHEN reason IS NULL THEN decision_id END AS job_id FROM outcomes""")
def apply_corrections(spark, sf):
    return review.apply_corrections(
        derived(spark, sf, "ledger", CORRECTIONS), ledger(spark, sf), categories(spark, sf)
    )


@query("corrected_ledger", f""", {CORRECTED} SELECT l.transaction_id, coalesce(o.name, l.category) AS category,
  CASE WHEN o.name IS NOT NULL THEN 'manual' ELSE category_source END AS category_source
FROM ledger l LEFT JOIN outcomes o ON o.transaction_id = l.transaction_id AND o.reason IS NULL""")
def corrected_ledger(spark, sf):
    rows = ledger(spark, sf).select("transaction_id", "category", "category_source")
    return review.corrected_ledger(rows, apply_corrections(spark, sf))


PROPOSAL_DECISIONS = """SELECT proposal_id AS decision_id, CASE WHEN proposal_id % 7 = 3 THEN -proposal_id ELSE proposal_id END AS proposal_id,
  CASE WHEN match_score > 90 THEN 'approve' ELSE 'reject' END AS action FROM proposals
UNION ALL SELECT proposal_id + 1000000000 AS decision_id, proposal_id, 'approve' AS action FROM proposals"""


def _judged(decisions: str, key: str, state: str, wanted: str) -> str:
    return f"""judged AS (SELECT d.*, s.* EXCLUDE ({key}), CASE WHEN s.status IS NULL THEN 'not found'
    WHEN s.status <> '{wanted}' OR d.decision_id > min(d.decision_id) OVER (PARTITION BY d.{key}) THEN 'not {wanted}' END AS refused
  FROM ({decisions}) d LEFT JOIN {state} s ON s.{key} = d.{key})"""


@query("apply_proposals", f""", {_judged(PROPOSAL_DECISIONS, 'proposal_id', 'proposals', 'pending')},
v AS (SELECT *, refused IS NULL AND action = 'approve' AS yes FROM judged)
SELECT decision_id, proposal_id, refused AS reason,
  CASE WHEN refused IS NOT NULL THEN status WHEN yes THEN 'approved' ELSE 'rejected' END AS status,
  CASE WHEN yes THEN transaction_id END AS transaction_id, CASE WHEN yes THEN proposed_category_id END AS category_id,
  CASE WHEN yes THEN 'similarity' END AS category_source FROM v""")
def apply_proposals(spark, sf):
    return review.apply_proposals(derived(spark, sf, "proposals", PROPOSAL_DECISIONS), bind(spark, sf, "proposals"))


DISAGREEMENT_DECISIONS = """SELECT disagreement_id AS decision_id, CASE WHEN disagreement_id % 11 = 0 THEN -disagreement_id ELSE disagreement_id END AS disagreement_id,
  CASE WHEN similarity_score > 97 THEN 'reject' ELSE 'choose' END AS action,
  CASE WHEN similarity_score < 88 THEN llm_category_id WHEN similarity_score < 95 THEN similarity_category_id ELSE 'others' END AS chosen_category_id
FROM disagreements"""


@query("apply_disagreements", f""", {_judged(DISAGREEMENT_DECISIONS, 'disagreement_id', 'disagreements', 'pending')},
w AS (SELECT *, CASE WHEN action = 'choose' THEN CASE chosen_category_id WHEN similarity_category_id THEN 'similarity' WHEN llm_category_id THEN 'llm' END END AS origin FROM judged),
v AS (SELECT *, coalesce(refused, CASE WHEN action = 'choose' AND origin IS NULL THEN 'not one of the two categories' END) AS reason FROM w)
SELECT decision_id, disagreement_id, reason,
  CASE WHEN reason IS NOT NULL THEN status WHEN action = 'reject' THEN 'rejected' ELSE 'resolved' END AS status,
  CASE WHEN reason IS NULL AND action = 'choose' THEN chosen_category_id END AS category_id,
  CASE WHEN reason IS NULL THEN origin END AS category_source FROM v""")
def apply_disagreements(spark, sf):
    return review.apply_disagreements(
        derived(spark, sf, "disagreements", DISAGREEMENT_DECISIONS), bind(spark, sf, "disagreements")
    )


MATCH_DECISIONS = """SELECT match_id AS decision_id, CASE WHEN match_id % 9 = 4 THEN -match_id ELSE match_id END AS match_id,
  CASE WHEN amount_at_match > 300000 THEN 'reject' ELSE 'approve' END AS action FROM matches"""
MATCHES_JUDGED = f"""{_judged(MATCH_DECISIONS, 'match_id', 'matches', 'pending')},
outcomes AS (SELECT decision_id, match_id, payment_id, refused AS reason,
  CASE WHEN refused IS NOT NULL THEN status WHEN action = 'approve' THEN 'approved' ELSE 'rejected' END AS status FROM judged)"""


@query("apply_match_decisions", f", {MATCHES_JUDGED} SELECT * FROM outcomes")
def apply_match_decisions(spark, sf):
    return review.apply_match_decisions(derived(spark, sf, "matches", MATCH_DECISIONS), bind(spark, sf, "matches"))


@query("trusted_payments", f""", {MATCHES_JUDGED} SELECT payment_id, is_trusted OR payment_id IN
  (SELECT payment_id FROM outcomes WHERE reason IS NULL AND status = 'approved') AS is_trusted FROM payments""")
def trusted_payments(spark, sf):
    return review.trusted_payments(bind(spark, sf, "payments"), apply_match_decisions(spark, sf)).select(
        "payment_id", "is_trusted"
    )


SUGGESTION_DECISIONS = """SELECT suggestion_id AS decision_id, suggestion_id, CASE WHEN occurrence_count % 3 = 0 THEN 'dismiss' ELSE 'add' END AS action,
  CASE WHEN occurrence_count % 2 = 0 THEN lower(description_pattern) END AS name,
  CASE WHEN occurrence_count % 5 = 0 THEN CAST(9.99 AS DECIMAL(18,2)) END AS expected_amount,
  CASE WHEN occurrence_count % 4 = 0 THEN 'annual' WHEN occurrence_count % 7 = 0 THEN 'weekly' END AS frequency,
  CASE WHEN occurrence_count % 8 = 0 THEN 6 END AS due_month,
  CASE WHEN occurrence_count % 6 = 1 THEN 40 WHEN occurrence_count % 6 = 2 THEN 17 END AS due_day,
  CASE WHEN occurrence_count % 2 = 1 THEN 'promo' END AS category_id FROM suggestions"""


@query("apply_suggestion_decisions", f""", {_judged(SUGGESTION_DECISIONS, 'suggestion_id', 'suggestions', 'new')},
w AS (SELECT *, coalesce(frequency, 'monthly') AS f, coalesce(due_day, 1) AS dd FROM judged),
v AS (SELECT *, coalesce(refused, CASE WHEN action = 'add' THEN CASE WHEN f = 'weekly' THEN 'unknown frequency'
    WHEN f = 'annual' AND due_month IS NULL THEN 'annual without due month' WHEN f = 'monthly' AND due_month IS NOT NULL THEN 'monthly with due month'
    WHEN dd NOT BETWEEN 1 AND 31 THEN 'due day out of range' END END) AS reason FROM w)
SELECT decision_id, suggestion_id, reason, CASE WHEN reason IS NOT NULL THEN status WHEN action = 'add' THEN 'added' ELSE 'dismissed' END AS status,
  CASE WHEN yes THEN coalesce(name, description_pattern) END AS name, CASE WHEN yes THEN coalesce(expected_amount, suggested_amount) END AS expected_amount,
  CASE WHEN yes THEN f END AS frequency, CASE WHEN yes THEN due_month END AS due_month, CASE WHEN yes THEN dd END AS due_day,
  CASE WHEN yes THEN coalesce(category_id, suggested_category_id) END AS category_id
FROM (SELECT *, reason IS NULL AND action = 'add' AS yes FROM v) u""")
def apply_suggestion_decisions(spark, sf):
    return review.apply_suggestion_decisions(
        derived(spark, sf, "suggestions", SUGGESTION_DECISIONS), bind(spark, sf, "suggestions"), TODAY
    )


EDITS = """SELECT category_id AS edit_id, 'remove' AS action, category_id, CAST(NULL AS VARCHAR(20)) AS new_name FROM categories
UNION ALL SELECT concat('r-', category_id), 'rename', category_id, concat(name, '2') FROM categories
UNION ALL SELECT concat('d-', category_id), 'rename', category_id, 'PROMO' FROM categories
UNION ALL SELECT concat('x-', category_id), 'rename', concat('no-', category_id), 'ANY' FROM categories
UNION ALL SELECT concat('a-', category_id), 'add', CAST(NULL AS VARCHAR(20)), CASE WHEN active THEN name ELSE concat('NEW ', name) END FROM categories
UNION ALL SELECT concat('a2-', category_id), 'add', CAST(NULL AS VARCHAR(20)), 'TWICE' FROM categories
UNION ALL SELECT concat('z-', category_id), 'add', CAST(NULL AS VARCHAR(20)), name FROM categories"""


@query("apply_category_edits", f""", used AS (SELECT category_id, count(*) AS n FROM ledger GROUP BY 1), judged AS (
  SELECT e.*, CASE WHEN action = 'remove' AND edit_id > concat('r-', e.category_id) AND NOT t.is_reserved THEN concat(t.name, '2')
      ELSE t.name END AS old_name,
    CASE WHEN edit_id LIKE 'z-%' AND h.is_reserved THEN 'duplicate name' WHEN edit_id LIKE 'z-%' THEN NULL
    WHEN edit_id LIKE 'a2-%' AND row_number() OVER (PARTITION BY new_name ORDER BY edit_id) > 1 THEN 'duplicate name'
    WHEN action = 'add' AND h.category_id IS NOT NULL THEN 'duplicate name'
    WHEN action <> 'add' AND t.name IS NULL THEN 'not found' WHEN action <> 'add' AND t.is_reserved THEN 'reserved'
    WHEN action = 'rename' AND h.category_id <> e.category_id THEN 'duplicate name'
    WHEN action = 'remove' AND u.n > 0 THEN 'in use' END AS reason
  FROM ({EDITS}) e LEFT JOIN categories t ON t.category_id = e.category_id LEFT JOIN categories h ON h.name = e.new_name
  LEFT JOIN used u ON u.category_id = e.category_id)
SELECT edit_id, action, category_id, reason, CASE WHEN reason IS NULL AND action <> 'remove' THEN new_name ELSE old_name END AS name,
  CASE WHEN reason IS NULL THEN action <> 'remove' END AS active FROM judged""")
def apply_category_edits(spark, sf):
    return cats.apply_category_edits(
        categories(spark, sf), derived(spark, sf, "categories", EDITS), ledger(spark, sf)
    )


@query("seed_categories", """SELECT category_id, name, active, is_reserved FROM categories
UNION ALL SELECT lower(name), name, true, false FROM (SELECT DISTINCT o_orderpriority AS name FROM orders) v
WHERE name NOT IN (SELECT name FROM categories)""")
def seed_categories(spark, sf):
    """The priorities of the orders as the names to seed, with one that exists."""
    names = bind(spark, sf, "orders").select(F.col("o_orderpriority").alias("name"))
    known = categories(spark, sf).where(F.col("name") == s.UNSURE).select("name")
    return cats.seed_categories(categories(spark, sf), names.unionByName(known))


RENAMED = "SELECT payment_id, CASE WHEN is_trusted THEN concat(name, ' x') ELSE name END AS name FROM payments"


@query("reset_embedding_status", "SELECT payment_id, CASE WHEN is_trusted THEN concat(name, ' x') ELSE name END AS name, "
       "CASE WHEN is_trusted THEN 'pending' ELSE 'completed' END AS embedding_status FROM payments")
def reset_embedding_status(spark, sf):
    old = bind(spark, sf, "payments").withColumn("embedding_status", F.lit("completed"))
    return review.reset_embedding_status(old, derived(spark, sf, "payments", RENAMED))


@query("mark_embedded", """SELECT transaction_id, CASE WHEN category_source <> 'unsure' OR transaction_id IN (SELECT vec_id FROM embeddings)
  THEN 'completed' ELSE 'pending' END AS embedding_status FROM ledger""")
def mark_embedded(spark, sf):
    rows = ledger(spark, sf).select(
        "transaction_id",
        F.when(F.col("category_source") == "unsure", "pending").otherwise("completed").alias("embedding_status"),
    )
    return review.mark_embedded(rows, bind(spark, sf, "embeddings").select(F.col("vec_id").alias("id")))


@query("upsert_embeddings", """, n AS (SELECT count(*) AS n FROM embeddings), every AS (
  SELECT vec_id AS id, embedding, 1 AS version FROM embeddings
  UNION ALL SELECT (vec_id + n.n // 2) AS id, embedding, label + 2 AS version FROM embeddings, n)
SELECT id, round(v[1], 6) AS first_value, round(list_sum(list_transform(v, lambda x, i: x * i)), 4) AS all_values, version
FROM (SELECT id, arg_max(embedding, version)::DOUBLE[] AS v, CAST(max(version) AS INTEGER) AS version FROM every GROUP BY id) t""")
def upsert_embeddings(spark, sf):
    stored = bind(spark, sf, "embeddings")
    n = stored.agg(F.count("*")).scalar()
    existing = stored.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.lit(1).alias("version"))
    updates = stored.select(
        (F.col("vec_id") + F.floor(n / 2)).alias("id"),
        F.col("embedding").alias("vector"),
        (F.col("label") + 2).alias("version"),
    )
    merged = review.upsert_vectors(existing, updates)
    # every component counts, by its place
    weighted = F.transform("vector", lambda x, i: x.cast("double") * (i + 1))
    return merged.select(
        "id",
        F.round(F.col("vector")[0].cast("double"), 6).alias("first_value"),
        F.round(F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x), 4).alias("all_values"),
        F.col("version").cast("int").alias("version"),
    )


# --- training --------------------------------------------------------------------------------

ELIGIBLE = """eligible AS (SELECT transaction_id, description, converted_sgd AS amount_sgd, category, category_source FROM converted
  WHERE category_source = 'manual' OR (category_source = 'similarity' AND transaction_id IN (SELECT transaction_id FROM proposals WHERE status = 'approved'))),
usable AS (SELECT *, row_number() OVER (ORDER BY transaction_id) <= CAST(floor(count(*) OVER () * 0.85::DOUBLE) AS BIGINT) AS first_part FROM eligible WHERE amount_sgd IS NOT NULL)"""
WHITELIST = "(SELECT string_agg(name, ', ' ORDER BY name) FROM categories WHERE active AND name <> 'UNSURE')"


def _eligible(spark, sf):
    return training.eligible_for_training(converted(spark, sf), bind(spark, sf, "proposals"))


def _usable(spark, sf):
    return _eligible(spark, sf).where(F.col("amount_sgd").isNotNull())


query("eligible_for_training", f", {ELIGIBLE} SELECT * FROM eligible")(_eligible)
query("source_breakdown", f""", {ELIGIBLE} SELECT category_source, count(amount_sgd) AS usable,
  count(*) - count(amount_sgd) AS excluded FROM eligible GROUP BY 1""")(
    lambda spark, sf: training.source_breakdown(_eligible(spark, sf))
)


@query("train_val_split", f", {ELIGIBLE} SELECT transaction_id, CASE WHEN first_part THEN 'train' ELSE 'val' END AS split FROM usable")
def train_val_split(spark, sf):
    return training.train_val_split(_usable(spark, sf)).select("transaction_id", "split")


PROMPT_SQL = "concat(" + ", ".join(
    part for pair in zip(
        [quoted(p).replace("\n", "' || chr(10) || '") for p in s.SINGLE_PROMPT.split("%s")],
        [WHITELIST, "description", "CAST(amount_sgd AS VARCHAR) || ' SGD'", "''"],
        strict=True,
    ) for part in pair
) + ")"


@query("sft_jsonl", f""", {ELIGIBLE} SELECT transaction_id, CASE WHEN first_part THEN 'train' ELSE 'val' END AS split,
  {PROMPT_SQL} AS prompt, category AS answer, description AS kept_description, CAST(amount_sgd AS VARCHAR) AS kept_amount FROM usable""")
def sft_jsonl(spark, sf):
    """Examples written as JSON lines per split and read back."""
    path = scratch_path(spark, "sft")
    split = training.train_val_split(_usable(spark, sf))
    training.sft_examples(split, flt.active_whitelist(categories(spark, sf))).select(
        "split", "example"
    ).write.partitionBy("split").text(path)
    doc = "messages array<struct<role:string,content:string>>, _transaction_id string, _description string, _amount_sgd string"
    lines = spark.read.text(path).withColumn("doc", F.from_json("value", doc))
    return lines.select(
        F.col("doc._transaction_id").cast("bigint").alias("transaction_id"),
        "split",
        F.col("doc.messages")[0]["content"].alias("prompt"),
        F.col("doc.messages")[1]["content"].alias("answer"),
        F.col("doc._description").alias("kept_description"),
        F.col("doc._amount_sgd").alias("kept_amount"),
    )


@query("chat_parts", f""", {ELIGIBLE} SELECT transaction_id, 0 AS pos, 'user' AS role, 'text' AS type, {PROMPT_SQL} AS text FROM usable
UNION ALL SELECT transaction_id, 1, 'assistant', 'text', category FROM usable""")
def chat_parts(spark, sf):
    examples = training.sft_examples(_usable(spark, sf), flt.active_whitelist(categories(spark, sf)))
    return training.chat_parts(examples).select(
        "transaction_id", F.posexplode("messages").alias("pos", "m")
    ).select("transaction_id", "pos", "m.role", F.explode("m.content").alias("part")).select(
        "transaction_id", "pos", "role", "part.type", "part.text"
    )


@query("curate_training_set", f""", {ELIGIBLE} SELECT count(*) FILTER (first_part) AS train_count, count(*) FILTER (NOT first_part) AS val_count,
  count(*) FILTER (category_source = 'manual') AS manual_count, count(*) FILTER (category_source = 'similarity') AS similarity_count,
  (SELECT count(*) FROM eligible WHERE amount_sgd IS NULL) AS excluded_count FROM usable""")
def curate_training_set(spark, sf):
    from ledgerloom.plans.curate import curate

    return curate(_eligible(spark, sf), flt.active_whitelist(categories(spark, sf)), scratch_path(spark, "curated"))


query("confusion_matrix", "SELECT truth, predicted, count(*) AS n FROM predictions GROUP BY 1, 2")(
    lambda spark, sf: training.confusion_matrix(bind(spark, sf, "predictions"))
)
EVAL = """SELECT count(*) AS n, round(avg(CASE WHEN predicted = truth THEN 1.0::DOUBLE ELSE 0 END), 9) AS accuracy,
  round(avg(CASE WHEN predicted = live THEN 1.0::DOUBLE ELSE 0 END), 9) AS agreement FROM predictions"""
query("eval_scores", EVAL)(
    lambda spark, sf: training.eval_scores(bind(spark, sf, "predictions")).select(
        "n", F.round("accuracy", 9).alias("accuracy"), F.round("agreement", 9).alias("agreement")
    )
)


@query("evaluate_predictions", f"""SELECT c.truth, c.predicted, c.n AS n_pairs, e.accuracy, e.agreement
FROM (SELECT truth, predicted, count(*) AS n FROM predictions GROUP BY 1, 2) c, ({EVAL}) e""")
def evaluate_predictions(spark, sf):
    from ledgerloom.plans.curate import evaluate

    return evaluate(bind(spark, sf, "predictions"))


# --- exports and prompts ---------------------------------------------------------------------

EXPORT = ", ".join(
    f'CAST({c} AS VARCHAR) AS "{h}"'
    for c, h in zip(
        ("transaction_date", "description", "out_flow", "in_flow", "bank_name", "category", "currency", "converted_sgd"),
        s.EXPORT_HEADER, strict=True,
    )
)


@query("export_ledger_csv", f"SELECT {EXPORT} FROM converted")
def export_ledger_csv(spark, sf):
    path = scratch_path(spark, "export")
    exports.write_csv(exports.export_rows(converted(spark, sf)), path)
    return spark.read.option("header", True).option("escape", '"').csv(path)


BACKUP = {
    "id": "transaction_id", "bank_statement_id": "custkey", "converted_amount_sgd": "converted_sgd",
    "conversion_is_approximate": "is_approximate", "conversion_unavailable": "is_unavailable",
    "fx_rate_used_id": "fx_rate", "created_at": "transaction_date", "updated_at": "transaction_date",
}


@query("backup_snapshot", "SELECT " + ", ".join(
    f"CAST({BACKUP.get(c, c)} AS VARCHAR) AS {c}" for c in s.BACKUP_COLUMNS) + " FROM converted")
def backup_snapshot(spark, sf):
    path = scratch_path(spark, "backup")
    rows = converted(spark, sf).select(*[F.col(BACKUP.get(c, c)).alias(c) for c in s.BACKUP_COLUMNS])
    exports.write_csv(exports.backup_rows(rows), path)
    return spark.read.option("header", True).option("escape", '"').csv(path)


@query("context_csv", """, newest AS (SELECT *, count(*) OVER (PARTITION BY custkey) > 3000 AS more FROM converted
  QUALIFY row_number() OVER (PARTITION BY custkey ORDER BY transaction_date DESC, transaction_id) <= 3000)
SELECT custkey, any_value(more) AS truncated, count(*) AS n_rows, 'date,description,direction,amount,currency,converted_sgd,bank,category' || chr(10) || string_agg(
  concat(transaction_date, ',"', replace(description, '"', '""'), '",', CASE WHEN out_flow IS NOT NULL THEN 'out' ELSE 'in' END, ',',
    amount, ',', currency, ',', coalesce(CAST(converted_sgd AS VARCHAR), ''), ',', bank_name, ',', category), chr(10)
  ORDER BY transaction_date DESC, transaction_id) AS context FROM newest GROUP BY custkey""")
def context_csv(spark, sf):
    return exports.context_csv(converted(spark, sf), "custkey")


def _statement_amounts(spark, sf):
    """Statement lines with their amounts in the reporting currency, as prompts show them."""
    amounts = converted(spark, sf).select("transaction_id", F.col("converted_sgd").alias("amount_sgd"))
    return bind(spark, sf, "statement_lines").join(amounts, "transaction_id")


FIRST_AMOUNTS = """firsts AS (SELECT statement_id, l.description, first(c.converted_sgd ORDER BY pos) AS amount_sgd
  FROM statement_lines l JOIN converted c USING (transaction_id) GROUP BY 1, 2)"""


BATCH_PARTS = s.BATCH_PROMPT.replace("%d", "%s").split("%s")
BATCH_SQL = "concat(" + ", ".join(
    part for pair in zip(
        [quoted(p).replace("\n", "' || chr(10) || '") for p in BATCH_PARTS],
        ["count(*)", WHITELIST, "string_agg(concat(slot + 1, '. ', description, ' (amount: ', coalesce(CAST(amount_sgd AS VARCHAR) || ' SGD', 'unknown'), ')'), chr(10) ORDER BY slot)", "''"],
        strict=True,
    ) for part in pair
) + ")"


@query("classification_prompts", f""", {FIRST_AMOUNTS}
SELECT statement_id, chunk, {BATCH_SQL} AS prompt FROM label_items JOIN firsts USING (statement_id, description) GROUP BY 1, 2""")
def classification_prompts(spark, sf):
    items = exports.prompt_items(_statement_amounts(spark, sf))
    return exports.batch_prompts(items, flt.active_whitelist(categories(spark, sf)))


query("first_amount_per_description", f", {FIRST_AMOUNTS} SELECT * FROM firsts")(
    lambda spark, sf: exports.first_amounts(_statement_amounts(spark, sf)).select("statement_id", "description", "amount_sgd")
)
query("distinct_descriptions", "SELECT DISTINCT description FROM ledger")(
    lambda spark, sf: ledger(spark, sf).select("description").dropDuplicates()
)

# --- audit -----------------------------------------------------------------------------------

_LEDGER_RULES = {
    "one_positive_flow": "NOT ((out_flow IS NULL) <> (in_flow IS NULL) AND coalesce(out_flow, in_flow) > 0)",
    "unavailable_has_no_amount": "is_unavailable AND (converted_sgd IS NOT NULL OR fx_rate IS NOT NULL)",
    "not_both_flags": "is_unavailable AND is_approximate",
    "known_source": "category_source NOT IN ('similarity', 'llm', 'manual', 'unsure')",
}


def _repeats(table, rule, source, keys):
    return f"SELECT '{table}' AS \"table\", '{rule}' AS rule, count(*) AS violations FROM (SELECT 1 FROM {source} GROUP BY {keys} HAVING count(*) > 1) x"


AUDIT = " UNION ALL ".join(
    [f"SELECT 'ledger' AS \"table\", '{n}' AS rule, count(*) AS violations FROM converted WHERE {r}" for n, r in _LEDGER_RULES.items()]
    + [
        _repeats("ledger", "unique_id", "converted", "transaction_id"),
        "SELECT 'run_files', 'failed_has_reason', count(*) FROM run_files WHERE outcome = 'failed' AND failure_reason IS NULL",
        "SELECT 'runs', 'one_active_run', CAST(count(*) > 1 AS BIGINT) FROM runs WHERE status = 'running'",
        "SELECT 'payments', 'due_month_fits_frequency', count(*) FROM payments WHERE (frequency = 'annual') <> (due_month IS NOT NULL)",
        "SELECT 'payments', 'due_day_in_month', count(*) FROM payments WHERE due_day NOT BETWEEN 1 AND 31",
        _repeats("categories", "unique_name", "categories", "name"),
        _repeats("files", "unique_hash", "(SELECT sha256(text) AS h FROM files)", "h"),
        _repeats("fx_rates", "unique_pair_and_day", "fx_rates", "from_currency, to_currency, rate_date"),
        _repeats("suggestions", "unique_pattern", "suggestions", "description_pattern"),
        _repeats("matches", "one_live_match", "(SELECT * FROM matches WHERE status <> 'rejected')", "payment_id, cycle_period"),
        _repeats("proposals", "one_pending", "(SELECT * FROM proposals WHERE status = 'pending')", "transaction_id, job_id"),
        "SELECT 'disagreements', 'resolved_by_offered_category', count(*) FROM disagreements WHERE status = 'resolved' AND resolved_category_id NOT IN (similarity_category_id, llm_category_id)",
        _repeats("backups", "one_per_day", "(SELECT CAST(started_at AS DATE) AS d FROM runs)", "d"),
        "SELECT 'backups', 'category_fits_outcome', count(*) FROM run_files r WHERE (outcome = 'failed') <> (failure_reason IS NOT NULL)",
    ]
)


@query("constraint_audit", AUDIT)
def constraint_audit(spark, sf):
    files = bind(spark, sf, "files").select(st.content_hash(F.col("text")).alias("content_hash"))
    tables = {
        "ledger": converted(spark, sf),
        "files": files,
        **{
            n: bind(spark, sf, n)
            for n in ("run_files", "runs", "payments", "categories", "fx_rates", "suggestions", "matches", "proposals", "disagreements")
        },
    }
    backups = bind(spark, sf, "runs").select(
        F.to_date("started_at").alias("backup_date"), F.lit("completed").alias("outcome"), F.lit(None).cast("string").alias("failure_category")
    )
    return aud.audit({**tables, "backups": backups})
