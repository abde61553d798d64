"""Composite jobs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.catalog import q_extraction as qx
from ledgerloom.catalog import q_recurring
from ledgerloom.catalog import sql_text as sql
from ledgerloom.catalog.inputs import categories, converted, ledger
from ledgerloom.catalog.q_similarity import _decision
from ledgerloom.catalog.registry import query
from ledgerloom.operators import filters as flt
from ledgerloom.plans import ingest as plan
from ledgerloom.runtime import cut, scratch_path, unsent
from ledgerloom.sources import statements as st
from ledgerloom.sources.bindings import bind, table
from ledgerloom.streaming import jobs as streams


def _files(spark, sf):
    """Every statement delivered twice, in two folders."""
    answers = cut(qx.statement_answers(spark, sf))
    both = answers.withColumn("folder", F.explode(F.array(F.lit("a"), F.lit("b"))))
    return both.select(
        F.concat_ws("/", "folder", "statement_id").alias("file_id"),
        st.content_hash(F.col("raw")).alias("content_hash"),
        "raw",
    )


def _known(files):
    """Statements of the first months were processed by an earlier run."""
    early = F.col("file_id").rlike("^a/[0-9]+/1995-0[1-6]/")
    return files.where(early).select("content_hash", F.col("file_id").alias("statement_id"))


def _books(spark, sf, files):
    return plan.Books(
        candidates=flt.eligible_candidates(ledger(spark, sf), categories(spark, sf)),
        categories=cut(categories(spark, sf)),
        rates=cut(bind(spark, sf, "fx_rates")),
        payments=cut(bind(spark, sf, "payments")),
        matches=bind(spark, sf, "matches"),
        known=_known(files),
    )


def _labels(spark, sf):
    labels = qx.merge_label_sources(spark, sf)
    return cut(labels.withColumn("statement_id", F.concat(F.lit("a/"), "statement_id")))


JUDGED = f"""{qx.GATE},
sizes AS (SELECT statement_id, CAST(count(*) AS INTEGER) AS n FROM kept GROUP BY 1),
deliveries AS (SELECT j.*, f AS folder, month < '1995-07' AS earlier, z.n FROM judged j CROSS JOIN (VALUES ('a'), ('b')) v(f) LEFT JOIN sizes z USING (statement_id))"""


@query("ingest_statements", f""", {JUDGED}
SELECT concat(folder, '/', statement_id) AS file_id,
  CASE WHEN earlier THEN 'skipped_duplicate' WHEN reason IS NOT NULL THEN 'failed' WHEN folder = 'a' THEN 'processed' ELSE 'skipped_duplicate' END AS outcome,
  CASE WHEN NOT earlier THEN reason END AS reason,
  CASE WHEN earlier OR reason IS NULL THEN concat('a/', statement_id) END AS statement_id,
  CASE WHEN NOT earlier AND reason IS NULL AND folder = 'a' THEN n END AS n_transactions FROM deliveries""", recursive=True)
def ingest_statements(spark, sf):
    files = _files(spark, sf)
    known = _known(files)
    return plan.file_outcomes(files, plan.extract(files, known, qx.AS_OF), known)


NEW_ROWS = f""", {JUDGED}, {qx.LABELS},
labels AS (SELECT i.statement_id, i.description, coalesce(b.label, CASE WHEN i.slot <> 3 AND w.active AND w.name <> 'UNSURE' THEN w.name END, 'UNSURE') AS label
  FROM label_items i LEFT JOIN batch b ON b.statement_id = i.statement_id AND b.description = i.description LEFT JOIN categories w ON w.name = i.llm_category),
incoming AS (SELECT printf('a/%s#%06d', k.statement_id, k.new_pos) AS transaction_id, k.final AS transaction_date, k.description, k.amount,
    j.currency, k.printed_sgd, coalesce(x.label, 'UNSURE') AS llm_category, {sql.token_key(sql.normalize_noise('k.description'))} AS k
  FROM kept k JOIN judged j ON j.statement_id = k.statement_id AND j.reason IS NULL AND j.month >= '1995-07'
  LEFT JOIN labels x ON x.statement_id = k.statement_id AND x.description = k.description),
known AS (SELECT transaction_id, amount, category, category_source, {sql.token_key(sql.normalize_noise('description'))} AS k FROM ledger WHERE category_source <> 'unsure'),
{sql.pairs('scored', 'SELECT k FROM known', 'SELECT k FROM incoming')},
reach AS (SELECT i.transaction_id, c.transaction_id AS match_id, c.category AS match_category, s.score, c.category_source
  FROM incoming i JOIN scored s ON s.r = i.k JOIN known c ON c.k = s.l
   AND (abs(i.amount - c.amount) <= 5 OR greatest(i.amount, c.amount) <= 4.0 * least(i.amount, c.amount))),
text_best AS (SELECT transaction_id, match_id, match_category, score FROM reach
  QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY category_source = 'manual' DESC, score DESC, match_id) = 1),
decided AS ({_decision('text_best')})"""


@query("ingest_ledger", NEW_ROWS + """
SELECT i.transaction_id, i.transaction_date, i.description, i.amount,
  CAST(CASE WHEN printed_sgd IS NOT NULL THEN printed_sgd WHEN currency = 'SGD' THEN amount ELSE round_even(amount * f.rate, 2) END AS DECIMAL(18,2)) AS converted_sgd,
  d.category, d.source AS category_source, o.category_id AS llm_suggested_category_id
FROM incoming i JOIN decided d USING (transaction_id) LEFT JOIN categories o ON o.name = d.llm_suggested
ASOF LEFT JOIN fx_rates f ON f.from_currency = i.currency AND i.transaction_date >= f.rate_date""", recursive=True)
def ingest_ledger(spark, sf):
    files = _files(spark, sf)
    books = _books(spark, sf, files)
    rows, _ = plan.ledger_rows(plan.extract(files, books.known, qx.AS_OF), _labels(spark, sf), books)
    return rows.select(
        "transaction_id", "transaction_date", "description", "amount", "converted_sgd", "category", "category_source",
        "llm_suggested_category_id",
    )


def _run(spark, sf):
    files = _files(spark, sf)
    return plan.ingest(files, _labels(spark, sf), _books(spark, sf, files), qx.AS_OF)


# Each row may follow any row before it, which SQL can only say row by row: tests compare with a loop.
@query("ingest_run")
def ingest_run(spark, sf):
    """The rows of a whole run, each a precedent for those after it, and the cycles of payments that they take."""
    done = _run(spark, sf)
    taken = done.matches.select("transaction_id", "payment_id", "cycle_period")
    return unsent(done.ledger).join(taken, "transaction_id", "left").select(
        "transaction_id", "transaction_date", "description", "amount", "converted_sgd", "category", "category_source", "payment_id", "cycle_period"
    )


@query("ingest_disagreements")
def ingest_disagreements(spark, sf):
    return _run(spark, sf).disagreements


@query("list_statement_files", """, boxed AS (SELECT concat(lang, '/', doc_id // 50) AS folder,
    string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS content FROM documents GROUP BY 1)
SELECT folder, CAST(strlen(content) AS BIGINT) AS length, sha256(content) AS content_hash FROM boxed""")
def list_statement_files(spark, sf):
    """The documents written as files and listed again: a file for every fifty ids of a language, in their order."""
    path = scratch_path(spark, "inbox")
    boxed = bind(spark, sf, "documents").select("lang", F.floor(F.col("doc_id") / 50).alias("box"), "doc_id", "text")
    boxed = boxed.repartition("lang", "box").sortWithinPartitions("lang", "box", "doc_id")
    boxed.drop("doc_id").write.partitionBy("lang", "box").text(path)
    listed = st.list_files(spark, path, "txt")
    folder = F.regexp_replace(F.regexp_extract("path", "(lang=[^/]+/box=[0-9]+)", 1), "(lang|box)=", "")
    return listed.select(folder.alias("folder"), "length", st.content_hash(F.col("content")).alias("content_hash"))


# --- streams ---------------------------------------------------------------------------------


@query("stream_statements", f""", {JUDGED}
SELECT concat('a/', statement_id) AS file_id, CASE WHEN reason IS NULL THEN 'processed' ELSE 'failed' END AS outcome, reason,
  CASE WHEN reason IS NULL THEN n END AS n_transactions FROM deliveries WHERE folder = 'a'
UNION ALL SELECT concat('b/', statement_id), CASE WHEN reason IS NULL THEN 'skipped_duplicate' ELSE 'failed' END, reason, NULL FROM deliveries WHERE folder = 'b'""", recursive=True)
def stream_statements(spark, sf):
    """Both deliveries as one stream, the second after the first."""
    inbox = scratch_path(spark, "statements")
    files = _files(spark, sf)
    schema = files.schema
    out, checkpoint = streams.paths(spark, "stream-statements")

    def run(batch, known):
        return plan.file_outcomes(batch, plan.extract(batch, known, qx.AS_OF), known)

    for folder in ("a", "b"):
        files.where(F.col("file_id").startswith(f"{folder}/")).write.mode("append").parquet(inbox)
        arrived = streams.file_stream(spark, inbox, "*.parquet", schema, files=1000)
        done = streams.stream_statements(arrived, run, out, checkpoint)
    return done.select("file_id", "outcome", "reason", "n_transactions")


@query("stream_recurring_match", q_recurring.BY_TEXT)
def stream_recurring_match(spark, sf):
    """The ledger in two deliveries, the lower ids first, so what arrives first is what the batch form takes."""
    inbox = scratch_path(spark, "ledger")
    rows = cut(ledger(spark, sf).select("transaction_id", "transaction_date", "description", "amount"))
    low, high = rows.agg(F.min("transaction_id"), F.max("transaction_id")).first()
    early = F.col("transaction_id") <= (low + high) // 2
    out, checkpoint = streams.paths(spark, "stream-matches")
    payments, matches = cut(bind(spark, sf, "payments")), cut(bind(spark, sf, "matches"))
    for part in (early, ~early):
        rows.where(part).write.mode("append").parquet(inbox)
        arrived = streams.file_stream(spark, inbox, "*.parquet", rows.schema, files=1000)
        done = streams.stream_recurring_matches(arrived, payments, matches, out, checkpoint)
    return done


@query("stream_log_tail", "SELECT event_id AS line_id, user_id AS run_id, event_type AS level FROM events")
def stream_log_tail(spark, sf):
    out, checkpoint = streams.paths(spark, "stream-log")
    lines = streams.file_stream(spark, sf, "events.parquet", table(spark, sf, "events").schema).select(
        F.col("event_id").alias("line_id"), F.col("user_id").alias("run_id"), F.col("event_type").alias("level")
    )
    return streams.stream_log_tail(lines, out, checkpoint)


@query("stream_monthly_totals", """SELECT month, income_sgd, expense_sgd, CAST(income_sgd - expense_sgd AS DECIMAL(28,2)) AS net_sgd
FROM (SELECT strftime(transaction_date, '%Y-%m') AS month,
    CAST(coalesce(sum(converted_sgd) FILTER (in_flow IS NOT NULL), 0) AS DECIMAL(28,2)) AS income_sgd,
    CAST(coalesce(sum(converted_sgd) FILTER (out_flow IS NOT NULL), 0) AS DECIMAL(28,2)) AS expense_sgd
  FROM converted WHERE NOT is_unavailable GROUP BY 1) t""")
def stream_monthly_totals(spark, sf):
    inbox = scratch_path(spark, "converted")
    rows = converted(spark, sf).select("transaction_date", "in_flow", "out_flow", "converted_sgd", "is_unavailable")
    rows.write.parquet(inbox)
    out, checkpoint = streams.paths(spark, "stream-months")
    return streams.stream_monthly_totals(
        streams.file_stream(spark, inbox, "*.parquet", rows.schema), out, checkpoint
    )
