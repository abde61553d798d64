"""The driver's tables seen as the tables of a ledger.

Each binding is one SQL text that Spark and DuckDB read alike; ``{name}`` marks a parquet
table. Bindings refer to each other by name and are emitted as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

AS_OF = "2001-08-01"

# What the head of a statement says, by the block of its account.
HEAD_FACTS = {
    "bank": """CASE block % 5 WHEN 0 THEN 'AFRICA' WHEN 1 THEN 'AMERICA' WHEN 2 THEN 'ASIA' WHEN 3 THEN 'EUROPE'
            ELSE 'MIDDLE EAST' END""",
    "currency": "CASE block % 4 WHEN 0 THEN 'SGD' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' ELSE 'MYR' END",
    "confidence": "CASE WHEN block % 10 = 3 THEN 'low' WHEN block % 10 = 5 THEN 'medium' ELSE 'high' END",
}

BINDINGS: dict[str, str] = {
    "main_part": """
SELECT l_orderkey, min(l_partkey) AS partkey FROM {lineitem} GROUP BY l_orderkey""",
    "base": """
SELECT o.o_orderkey AS transaction_id,
       CAST(o.o_orderdate AS DATE) AS transaction_date,
       CASE WHEN o.o_orderkey % 97 = 0 THEN 'BALANCE BROUGHT FORWARD'
            ELSE concat(upper(coalesce(p.p_name, 'misc')), ' ', c.c_mktsegment, ' #',
                        CAST(100000 + o.o_orderkey AS VARCHAR(20))) END AS description,
       CAST(o.o_totalprice AS DECIMAL(18,2)) AS amount,
       CASE WHEN o.o_orderstatus = 'P' THEN 'in' ELSE 'out' END AS direction,
       CASE c.c_nationkey % 4 WHEN 0 THEN 'SGD' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' ELSE 'MYR' END AS currency,
       r.r_name AS bank_name,
       coalesce(p.p_type, 'OTHERS') AS type_name,
       o.o_custkey AS custkey,
       o.o_orderstatus AS state,
       o.o_orderpriority AS priority
FROM {orders} o
JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey
JOIN {region} r ON n.n_regionkey = r.r_regionkey
LEFT JOIN main_part m ON m.l_orderkey = o.o_orderkey
LEFT JOIN {part} p ON p.p_partkey = m.partkey""",
    "fx_rates": """
SELECT cur AS from_currency, 'SGD' AS to_currency, d AS rate_date,
       CAST(CASE cur WHEN 'USD' THEN 1.30 ELSE 1.45 END
            + dayofyear(d) % 50 * 0.001 AS DECIMAL(18,8)) AS rate
FROM (SELECT DISTINCT 'USD' AS cur, CAST(o_orderdate AS DATE) AS d FROM {orders}
      UNION ALL SELECT DISTINCT 'EUR' AS cur, CAST(o_orderdate AS DATE) AS d FROM {orders}) x
WHERE dayofyear(d) % 3 = 0""",
    "ledger": """
SELECT transaction_id, transaction_date, description, amount, direction,
       CASE WHEN direction = 'out' THEN amount END AS out_flow,
       CASE WHEN direction = 'in' THEN amount END AS in_flow,
       currency, bank_name,
       CASE WHEN transaction_id % 10 = 1 THEN 'unsure' ELSE lower(type_name) END AS category_id,
       CASE WHEN transaction_id % 10 = 1 THEN 'UNSURE' ELSE type_name END AS category,
       CASE WHEN transaction_id % 10 = 0 THEN 'manual' WHEN transaction_id % 10 = 1 THEN 'unsure'
            WHEN transaction_id % 10 IN (2, 3) THEN 'llm' ELSE 'similarity' END AS category_source,
       CASE transaction_id % 3 WHEN 0 THEN type_name
            WHEN 1 THEN CASE WHEN type_name = 'PROMO' THEN 'SMALL' ELSE 'PROMO' END
            ELSE 'UNSURE' END AS llm_category,
       CASE WHEN transaction_id % 50 = 7 THEN CAST(amount * 1.3 AS DECIMAL(18,2)) END AS printed_sgd,
       custkey, state, priority
FROM base""",
    # For the SQL side only; Spark resolves conversions with the FX operators.
    "converted": """
SELECT l.*, CASE WHEN printed_sgd IS NOT NULL THEN 'printed' WHEN currency = 'SGD' THEN 'identity'
                 WHEN f.rate_date = transaction_date THEN 'exact' WHEN f.rate_date IS NOT NULL THEN 'asof'
                 ELSE 'unavailable' END AS conversion_source,
       CAST(CASE WHEN printed_sgd IS NOT NULL THEN printed_sgd WHEN currency = 'SGD' THEN amount
                 ELSE round_even(CAST(amount AS DECIMAL(18,2)) * f.rate, 2) END AS DECIMAL(18,2)) AS converted_sgd,
       printed_sgd IS NULL AND currency <> 'SGD' AND f.rate_date IS NOT NULL
         AND f.rate_date < transaction_date AS is_approximate,
       printed_sgd IS NULL AND currency <> 'SGD' AND f.rate_date IS NULL AS is_unavailable,
       CASE WHEN printed_sgd IS NULL AND currency <> 'SGD' THEN f.rate END AS fx_rate
FROM ledger l ASOF LEFT JOIN fx_rates f
  ON l.currency = f.from_currency AND l.transaction_date >= f.rate_date""",
    "categories": """
SELECT lower(name) AS category_id, name, name <> 'LARGE' AS active, name = 'UNSURE' AS is_reserved
FROM (SELECT DISTINCT p_type AS name FROM {part}
      UNION SELECT 'OTHERS' AS name UNION SELECT 'UNSURE' AS name) t""",
    "payments": """
SELECT min(p_partkey) AS payment_id,
       concat(p_name, ' ', segment, ' #1000') AS name,
       CAST(max(p_retailprice) * 200 AS DECIMAL(18,2)) AS expected_amount,
       CASE WHEN min(p_partkey) % 5 = 0 THEN 'annual' ELSE 'monthly' END AS frequency,
       CASE WHEN min(p_partkey) % 5 = 0 THEN CAST(min(p_partkey) % 12 + 1 AS INTEGER) END AS due_month,
       CAST(min(p_partkey) % 31 + 1 AS INTEGER) AS due_day,
       lower(min(p_type)) AS category_id,
       min(p_type) AS category,
       min(p_partkey) % 2 = 0 AS is_trusted
FROM (SELECT p_partkey, p_name, p_type, p_retailprice,
             CASE p_partkey % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE'
                  WHEN 3 THEN 'HOUSEHOLD' ELSE 'MACHINERY' END AS segment
      FROM {part}) t
GROUP BY p_name, segment""",
    "matches": """
SELECT l.transaction_id AS match_id, p.payment_id, l.transaction_id,
       substr(CAST(l.transaction_date AS VARCHAR(10)), 1,
              CASE WHEN p.frequency = 'annual' THEN 4 ELSE 7 END) AS cycle_period,
       CASE l.state WHEN 'F' THEN 'approved' WHEN 'O' THEN 'rejected' ELSE 'pending' END AS status,
       l.amount AS amount_at_match,
       CAST(l.transaction_date AS TIMESTAMP) AS created_at
FROM ledger l JOIN payments p
  ON substr(l.description, 1, length(l.description) - length(CAST(100000 + l.transaction_id AS VARCHAR(20))))
     = substr(upper(p.name), 1, length(p.name) - 4)
WHERE l.priority = '1-URGENT'""",
    "jobs": """
SELECT transaction_id AS job_id, transaction_id AS source_transaction_id,
       CASE WHEN llm_category = 'UNSURE' THEN 'running' ELSE 'completed' END AS status,
       CAST(transaction_date AS TIMESTAMP) AS created_at,
       CASE WHEN llm_category <> 'UNSURE' THEN CAST(transaction_date + INTERVAL '1' DAY AS TIMESTAMP) END AS completed_at
FROM ledger WHERE category_source = 'manual'""",
    "proposals": """
SELECT transaction_id AS proposal_id, transaction_id, transaction_id - transaction_id % 10 AS job_id,
       CASE WHEN llm_category = 'UNSURE' THEN 'promo' ELSE lower(llm_category) END AS proposed_category_id,
       CAST(85 + transaction_id % 15 AS DECIMAL(5,2)) AS match_score,
       CASE state WHEN 'F' THEN 'approved' WHEN 'O' THEN 'rejected' ELSE 'pending' END AS status,
       CAST(transaction_date AS TIMESTAMP) AS created_at
FROM ledger WHERE category_source IN ('unsure', 'similarity') AND priority = '2-HIGH'""",
    "disagreements": """
SELECT transaction_id AS disagreement_id, transaction_id, category_id AS similarity_category_id,
       lower(llm_category) AS llm_category_id,
       CAST(85 + transaction_id % 15 AS DECIMAL(5,2)) AS similarity_score,
       CASE state WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'rejected' ELSE 'pending' END AS status,
       CASE WHEN state = 'F' THEN CASE WHEN transaction_id % 2 = 0 THEN category_id ELSE lower(llm_category) END
       END AS resolved_category_id,
       CAST(transaction_date AS TIMESTAMP) AS created_at
FROM ledger
WHERE category <> 'UNSURE' AND llm_category <> 'UNSURE' AND category <> llm_category""",
    "suggestions": """
SELECT min(p_partkey) AS suggestion_id, concat(upper(p_name), ' BUILDING') AS description_pattern,
       CAST(max(p_retailprice) * 200 AS DECIMAL(18,2)) AS suggested_amount,
       lower(min(p_type)) AS suggested_category_id,
       count(*) AS occurrence_count,
       CASE min(p_partkey) % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'dismissed' ELSE 'added' END AS status
FROM {part} GROUP BY p_name""",
    "runs": """
SELECT user_id AS run_id, min(ts) AS started_at,
       CASE WHEN max_by(event_type, ts) <> 'signup' THEN max(ts) END AS completed_at,
       CASE WHEN max_by(event_type, ts) = 'signup' THEN 'running' ELSE 'completed' END AS status
FROM {events} GROUP BY user_id""",
    "run_files": """
SELECT user_id AS run_id, event_id AS file_id, ts AS processed_at,
       CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped_duplicate' ELSE 'processed' END AS outcome,
       CASE WHEN event_type = 'error' THEN 'Zero transactions extracted' END AS failure_reason
FROM {events}""",
    "vectors": """
SELECT vec_id, embedding, label, concat('group-', CAST(label AS VARCHAR(5))) AS category,
       concat('group-', CAST((label + vec_id) % 10 AS VARCHAR(5))) AS llm_category
FROM {embeddings}""",
    "ledger_vectors": """
SELECT l.transaction_id, v.vec_id, v.embedding
FROM (SELECT transaction_id, CAST(floor(transaction_id / 10) AS BIGINT) % (SELECT count(*) FROM {embeddings}) AS slot
      FROM ledger) l
JOIN {embeddings} v ON v.vec_id = l.slot""",
    "statement_lines": """
SELECT concat(CAST(block AS VARCHAR(20)), '/', month, '/', CAST(volume AS VARCHAR(20))) AS statement_id,
       CAST(block AS INTEGER) AS block, month, transaction_id, amount, direction,
       CASE WHEN block % 10 = 7 AND month LIKE '%-01' THEN 'BALANCE BROUGHT FORWARD'
            WHEN transaction_id % 13 = 0 THEN 'PAYMENT BY INTERNET' ELSE description END AS description,
       transaction_date AS printed_date, llm_category, printed_sgd,
       row_number() OVER (PARTITION BY block, month, volume ORDER BY transaction_date, transaction_id) - 1 AS pos,
       CAST(max(transaction_date) OVER (PARTITION BY block, month, volume) + INTERVAL '3' DAY AS DATE) AS statement_date
FROM (SELECT l.*, CAST(floor(custkey / 75) AS BIGINT) AS block,
             substr(CAST(transaction_date AS VARCHAR(10)), 1, 7) AS month,
             CAST(floor(transaction_id / 100000) AS BIGINT) AS volume
      FROM ledger l) t""",
    "read_lines": """
SELECT statement_id, block, month, transaction_id, amount, direction, description, llm_category, printed_sgd, pos,
       statement_date, day,
       CASE WHEN block % 10 = 0 OR (block % 10 = 1 AND CAST(substr(CAST(day AS VARCHAR(10)), 9, 2) AS INTEGER) <= 12)
            THEN concat(substr(CAST(day AS VARCHAR(10)), 1, 5), substr(CAST(day AS VARCHAR(10)), 9, 2), '-',
                        substr(CAST(day AS VARCHAR(10)), 6, 2))
            ELSE CAST(day AS VARCHAR(10)) END AS read_date
FROM (SELECT s.*, CASE WHEN description = 'PAYMENT BY INTERNET' THEN statement_date ELSE printed_date END AS day
      FROM statement_lines s) t""",
    "statement_heads": f"""
SELECT DISTINCT statement_id, block, month, statement_date,
       {",\n       ".join(f"{fact} AS {name}" for name, fact in HEAD_FACTS.items())}
FROM statement_lines""",
    "label_items": """
SELECT statement_id, CAST(floor((rn - 1) / 10) AS BIGINT) AS chunk, (rn - 1) % 10 AS slot, description, amount, llm_category
FROM (SELECT u.*, row_number() OVER (PARTITION BY statement_id ORDER BY first_pos) AS rn
      FROM (SELECT statement_id, description, min(pos) AS first_pos, min_by(amount, pos) AS amount,
                   min_by(llm_category, pos) AS llm_category
            FROM statement_lines GROUP BY statement_id, description) u) t""",
    "predictions": """
SELECT CAST(doc_id AS VARCHAR(20)) AS example_id, CAST(quality AS VARCHAR(5)) AS truth,
       CAST(toxic AS VARCHAR(5)) AS predicted, CAST(doc_id % 2 AS VARCHAR(5)) AS live
FROM {labels}""",
    "files": """
SELECT doc_id AS file_id, source AS folder, text, length(text) > 60 AS readable FROM {documents}""",
    "import_lines": """
SELECT p_partkey AS line_id,
       concat('  ', p_name, ' , ', CASE WHEN p_partkey % 9 = 0 THEN 'about 50' ELSE CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR(30)) END,
              CASE WHEN p_partkey % 5 = 0 THEN concat(', Annual, ', CAST(p_partkey % 14 + 1 AS VARCHAR(5)), ' ,')
                   WHEN p_partkey % 7 = 0 THEN ', weekly,' ELSE ', Monthly ,' END,
              CASE WHEN p_partkey % 10 = 3 THEN '32' WHEN p_partkey % 17 = 0 THEN '' ELSE CAST(p_partkey % 28 + 1 AS VARCHAR(5)) END) AS line
FROM {part}""",
}


def _needed(names: tuple[str, ...] | list[str], text: str) -> list[str]:
    """Bindings used by ``text`` or named outright, in order of definition."""
    wanted = set(names)
    frontier = [text, *(BINDINGS[n] for n in names)]
    while frontier:
        words = set(re.findall(r"(?<![{\w.])[a-z_]+(?![}\w])", frontier.pop()))
        for name in BINDINGS:
            if name in words and name not in wanted:
                wanted.add(name)
                frontier.append(BINDINGS[name])
    return [n for n in BINDINGS if n in wanted]


def with_bindings(body: str, recursive: bool = False) -> str:
    """``body`` for DuckDB, preceded by the bindings it mentions.

    ``body`` starts with ``SELECT``, or with ``, name AS (...)`` for further expressions.
    """
    parts = [f"{n} AS ({BINDINGS[n].format_map({t: t for t in TABLES})})" for n in _needed((), body)]
    body = body.strip()
    head = "WITH RECURSIVE " if recursive else "WITH "
    if not parts:
        return head + body[1:] if body.startswith(",") else body
    return head + ",\n".join(parts) + "\n" + body


_schemas: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables; its schema is read from the files once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A binding as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    names = _needed((name,), "")
    used = {t for n in names for t in TABLES if "{" + t + "}" in BINDINGS[n]}
    text = "WITH " + ",\n".join(f"{n} AS ({BINDINGS[n]})" for n in names) + f"\nSELECT * FROM {name}"
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})
