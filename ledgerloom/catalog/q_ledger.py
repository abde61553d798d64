"""Scans, filters, sorts, pages, FX and dashboards of the ledger."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.catalog.inputs import TODAY, categories, converted, ledger
from ledgerloom.catalog.registry import query
from ledgerloom.functions import amounts, dates
from ledgerloom.operators import categories as cats
from ledgerloom.operators import dashboards as dash
from ledgerloom.operators import filters as flt
from ledgerloom.operators import fx, paging
from ledgerloom.runtime import cut
from ledgerloom.sources.bindings import bind

FROM, TO = dt.date(1996, 3, 1), dt.date(2000, 9, 30)
RANGE = "transaction_date BETWEEN DATE '1996-03-01' AND DATE '2000-09-30'"
SHORT = ("transaction_id", "transaction_date", "description", "out_flow", "in_flow", "currency", "bank_name", "category")
COLS = ", ".join(SHORT)


def one(name, keep, where):
    """A filter on its own."""
    query(name, f"SELECT {COLS} FROM ledger WHERE {where}")(
        lambda spark, sf: ledger(spark, sf).where(keep()).select(*SHORT)
    )


query("scan_ledger", f"SELECT {COLS}, category_source, amount FROM ledger")(
    lambda spark, sf: ledger(spark, sf).select(*SHORT, "category_source", "amount")
)
one("filter_date_range", lambda: flt.date_range(F.col("transaction_date"), FROM, TO), RANGE)
one("filter_bank", lambda: flt.predicate(flt.LedgerFilter(bank="ASIA")), "bank_name = 'ASIA'")
one("filter_flow_direction", lambda: flt.flow_direction("in"), "in_flow IS NOT NULL")
one("filter_currency", lambda: flt.currency_is("USD"), "currency = 'USD'")
one("filter_text_search", lambda: flt.text_contains("red%build"), "description ILIKE '%red%build%'")
one("filter_category_source", lambda: flt.source_is("manual"), "category_source = 'manual'")
one("drop_balance_lines", lambda: ~flt.is_balance_line(F.col("description")),
    "NOT regexp_matches(description, '(?i)\\bbalance\\s+(brought|carried)\\s+forward\\b')")
one("drop_future_dated", lambda: F.col("transaction_date") <= F.lit(dt.date(2000, 6, 30)),
    "transaction_date <= DATE '2000-06-30'")


@query("filter_category", f"SELECT {COLS} FROM ledger WHERE category = 'PROMO'")
def filter_category(spark, sf):
    return flt.by_category_name(ledger(spark, sf), categories(spark, sf), "PROMO").select(*SHORT)


@query("filter_composite", f"""
SELECT {COLS} FROM ledger WHERE {RANGE} AND bank_name = 'EUROPE' AND category = 'SMALL'
  AND out_flow IS NOT NULL AND currency = 'EUR' AND description ILIKE '%bolt%' AND category_source = 'similarity'""")
def filter_composite(spark, sf):
    record = flt.LedgerFilter(FROM, TO, "EUROPE", "SMALL", "out", "EUR", "bolt", "similarity")
    return flt.apply_filter(ledger(spark, sf), categories(spark, sf), record).select(*SHORT)


@query("amount_projection", "SELECT transaction_id, coalesce(out_flow, in_flow) AS magnitude FROM ledger")
def amount_projection(spark, sf):
    return flt.amount_projection(ledger(spark, sf)).select("transaction_id", "magnitude")


@query("direction_split", """SELECT transaction_id, CASE WHEN direction = 'out' THEN amount END AS out_flow,
  CASE WHEN direction = 'in' THEN amount END AS in_flow FROM base""")
def direction_split(spark, sf):
    lines = bind(spark, sf, "base").select("transaction_id", "amount", "direction")
    return flt.direction_split(lines).select("transaction_id", "out_flow", "in_flow")


@query("month_key", "SELECT transaction_id, strftime(transaction_date, '%Y-%m') AS month FROM ledger")
def month_key(spark, sf):
    return ledger(spark, sf).select("transaction_id", dates.month_key(F.col("transaction_date")).alias("month"))


@query("month_bounds", """SELECT month, strptime(month || '-01', '%Y-%m-%d')::DATE AS first_day,
  last_day(strptime(month || '-01', '%Y-%m-%d')::DATE) AS last_day
FROM (SELECT DISTINCT strftime(transaction_date, '%Y-%m') AS month FROM ledger) t""")
def month_bounds(spark, sf):
    months = ledger(spark, sf).select(dates.month_key(F.col("transaction_date")).alias("month")).distinct()
    first, last = dates.month_bounds(F.col("month"))
    return months.select("month", first.alias("first_day"), last.alias("last_day"))


@query("context_window", """
, days AS (SELECT transaction_date AS d, count(*) AS n, sum(amount) AS total FROM ledger GROUP BY 1)
SELECT l.transaction_id, CAST(sum(d.n) AS BIGINT) AS rows_near, CAST(sum(d.total) AS DECIMAL(28,2)) AS amount_near
FROM ledger l JOIN days d ON d.d BETWEEN l.transaction_date - 30 AND l.transaction_date + 30
WHERE l.category_source = 'manual' GROUP BY 1""")
def context_window(spark, sf):
    rows = ledger(spark, sf).select("transaction_id", "transaction_date", "amount", "category_source")
    near = flt.context_window(rows, rows.where(flt.source_is("manual")))
    return near.select(
        "transaction_id",
        F.col("rows_near").cast("bigint").alias("rows_near"),
        F.col("amount_near").cast("decimal(28,2)").alias("amount_near"),
    )


@query("context_window_rows", """, days AS (SELECT DISTINCT transaction_date AS anchor_date FROM ledger WHERE category_source = 'unsure')
SELECT anchor_date, l.transaction_id, l.transaction_date, l.amount FROM days JOIN ledger l
  ON l.transaction_date BETWEEN anchor_date - 30 AND anchor_date + 30""")
def context_window_rows(spark, sf):
    """What stands around the days of undecided rows: the rows themselves, to tell the other side of a transfer."""
    rows = ledger(spark, sf)
    return flt.context_rows(rows.select("transaction_id", "transaction_date", "amount"), flt.unsure_rows(rows))


@query("default_range", """SELECT count(*) AS n, min(transaction_date) AS first_day, max(transaction_date) AS last_day
FROM ledger WHERE transaction_date >= date_trunc('month', DATE '2001-08-01' - INTERVAL 5 MONTH) AND transaction_date <= DATE '2001-08-01'""")
def default_range(spark, sf):
    low, high = flt.default_range(TODAY)
    day = F.col("transaction_date")
    return ledger(spark, sf).where((day >= low) & (day <= high)).agg(
        F.count("*").alias("n"), F.min(day).alias("first_day"), F.max(day).alias("last_day")
    )


query("unsure_rows", f"SELECT {COLS} FROM ledger WHERE category_source = 'unsure'")(
    lambda spark, sf: flt.unsure_rows(ledger(spark, sf)).select(*SHORT)
)


@query("eligible_candidates", """SELECT transaction_id, description, category AS category_name, category_source, amount
FROM ledger WHERE category_source <> 'unsure'""")
def eligible_candidates(spark, sf):
    return flt.eligible_candidates(ledger(spark, sf), categories(spark, sf))


query("active_whitelist", "SELECT name FROM categories WHERE active AND name <> 'UNSURE'")(
    lambda spark, sf: flt.active_whitelist(categories(spark, sf))
)


@query("scope_check", f"SELECT {COLS} FROM ledger WHERE transaction_date BETWEEN DATE '2001-05-01' AND DATE '2001-08-01'")
def scope_check(spark, sf):
    flt.check_scope(TODAY.replace(month=5), TODAY, everything=False)
    return flt.question_scope(ledger(spark, sf), TODAY).select(*SHORT)


# --- joins with categories -------------------------------------------------------------------


@query("join_category", """SELECT transaction_id, name AS category_name, active
FROM ledger JOIN categories USING (category_id)""")
def join_category(spark, sf):
    return cats.with_category(ledger(spark, sf), categories(spark, sf)).select(
        "transaction_id", "category_name", "active"
    )


USAGE = """SELECT name, active, count(transaction_id) AS n_transactions
FROM categories c LEFT JOIN ledger l USING (category_id) GROUP BY name, active"""


@query("category_usage", USAGE)
def category_usage(spark, sf):
    return cats.category_usage(categories(spark, sf), ledger(spark, sf)).select("name", "active", "n_transactions")


@query("category_use_guard", f"""SELECT name, n_transactions, CASE WHEN name = 'UNSURE' THEN 'reserved'
  WHEN n_transactions > 0 THEN 'in use' END AS blocked_by FROM ({USAGE}) t""")
def category_use_guard(spark, sf):
    return cats.use_guard(categories(spark, sf), ledger(spark, sf)).select("name", "n_transactions", "blocked_by")


@query("category_menu_order", f"""
, usage AS ({USAGE}), ranked AS (SELECT *, row_number() OVER (ORDER BY n_transactions DESC, name) AS r FROM usage)
SELECT name, n_transactions, row_number() OVER (ORDER BY least(r, 4), name) AS menu_rank FROM ranked""")
def category_menu_order(spark, sf):
    usage = cats.category_usage(categories(spark, sf), ledger(spark, sf))
    return paging.category_menu_order(usage, top=3).select(
        "name", "n_transactions", F.col("menu_rank").cast("bigint").alias("menu_rank")
    )


@query("sort_join_outer", f"SELECT {COLS}, row_number() OVER (ORDER BY category, transaction_id) AS rank FROM ledger")
def sort_join_outer(spark, sf):
    return paging.with_rank(paging.sort_by_category(ledger(spark, sf), categories(spark, sf)).select(*SHORT))


@query("lookup_by_ids", """SELECT l.transaction_id, description, amount FROM ledger l
JOIN matches m ON m.transaction_id = l.transaction_id WHERE l.category_source <> 'unsure'""")
def lookup_by_ids(spark, sf):
    wanted = bind(spark, sf, "matches").select("transaction_id")
    return cats.lookup_by_ids(
        flt.eligible_candidates(ledger(spark, sf), categories(spark, sf)), wanted
    ).select("transaction_id", "description", "amount")


@query("names_to_ids", """SELECT transaction_id, c.category_id, o.category_id AS llm_category_id
FROM ledger l JOIN categories c ON c.name = l.category
LEFT JOIN categories o ON o.name = nullif(l.llm_category, 'UNSURE')""")
def names_to_ids(spark, sf):
    decided = ledger(spark, sf).select("transaction_id", "category", "llm_category")
    return cats.names_to_ids(decided, categories(spark, sf)).select(
        "transaction_id", "category_id", "llm_category_id"
    )


# --- FX --------------------------------------------------------------------------------------


@query("fx_exact", """SELECT transaction_id, currency, rate FROM ledger JOIN fx_rates
  ON currency = from_currency AND transaction_date = rate_date WHERE to_currency = 'SGD'""")
def fx_exact(spark, sf):
    return fx.exact_rates(ledger(spark, sf), bind(spark, sf, "fx_rates")).select("transaction_id", "currency", "rate")


@query("fx_asof", """SELECT transaction_id, currency, rate, rate_date FROM ledger ASOF LEFT JOIN fx_rates
  ON currency = from_currency AND transaction_date >= rate_date""")
def fx_asof(spark, sf):
    rows = ledger(spark, sf).select("transaction_id", "transaction_date", "currency")
    return fx.asof_rates(rows, bind(spark, sf, "fx_rates")).select("transaction_id", "currency", "rate", "rate_date")


@query("resolve_conversion", """SELECT transaction_id, conversion_source, converted_sgd, is_approximate,
  is_unavailable, fx_rate FROM converted""")
def resolve_conversion(spark, sf):
    return converted(spark, sf).select(
        "transaction_id", "conversion_source", "converted_sgd", "is_approximate", "is_unavailable", "fx_rate"
    )


# --- dashboards and groups -------------------------------------------------------------------

TRENDS = f"""SELECT category, strftime(transaction_date, '%Y-%m') AS month,
  CAST(sum(converted_sgd) AS DECIMAL(28,2)) AS total_sgd
FROM converted WHERE {RANGE} AND NOT is_unavailable AND out_flow IS NOT NULL GROUP BY 1, 2"""


@query("dash_category_trends", TRENDS)
def dash_category_trends(spark, sf):
    return dash.category_trends(dash.scope(converted(spark, sf), FROM, TO))


@query("dash_cash_flow", f"""SELECT month, income_sgd, expense_sgd,
  CAST(income_sgd - expense_sgd AS DECIMAL(28,2)) AS net_sgd
FROM (SELECT strftime(transaction_date, '%Y-%m') AS month,
    CAST(coalesce(sum(converted_sgd) FILTER (in_flow IS NOT NULL), 0) AS DECIMAL(28,2)) AS income_sgd,
    CAST(coalesce(sum(converted_sgd) FILTER (out_flow IS NOT NULL), 0) AS DECIMAL(28,2)) AS expense_sgd
  FROM converted WHERE {RANGE} AND NOT is_unavailable GROUP BY 1) t""")
def dash_cash_flow(spark, sf):
    return dash.cash_flow(dash.scope(converted(spark, sf), FROM, TO))


@query("dash_bank_breakdown", f"""SELECT bank_name, strftime(transaction_date, '%Y-%m') AS month,
  CAST(sum(coalesce(converted_sgd, 0)) AS DECIMAL(28,2)) AS total_sgd
FROM converted WHERE {RANGE} AND NOT is_unavailable AND currency = 'USD' GROUP BY 1, 2""")
def dash_bank_breakdown(spark, sf):
    return dash.bank_breakdown(dash.scope(converted(spark, sf), FROM, TO, "USD"))


@query("dash_disclosure", f"""SELECT count(*) FILTER (is_approximate) AS approximate_count,
  count(*) FILTER (is_unavailable) AS excluded_count FROM converted WHERE {RANGE}""")
def dash_disclosure(spark, sf):
    return dash.disclosure_counts(dash.scope(converted(spark, sf), FROM, TO))


@query("dash_excluded_rows", f"SELECT transaction_id FROM converted WHERE {RANGE} AND is_unavailable")
def dash_excluded_rows(spark, sf):
    return dash.excluded_rows(dash.scope(converted(spark, sf), FROM, TO))


@query("top_series_other", f"""
, points AS ({TRENDS}), best AS (SELECT category FROM points GROUP BY 1 ORDER BY sum(total_sgd) DESC, 1 LIMIT 3),
folded AS (SELECT coalesce(b.category, 'Other') AS series, month, sum(total_sgd) AS v
  FROM points p LEFT JOIN best b USING (category) GROUP BY 1, 2)
SELECT s.series, m.month, CAST(coalesce(v, 0) AS DECIMAL(28,2)) AS value
FROM (SELECT DISTINCT series FROM folded) s CROSS JOIN (SELECT DISTINCT month FROM points) m
LEFT JOIN folded f ON f.series = s.series AND f.month = m.month""")
def top_series_other(spark, sf):
    points = dash_category_trends(spark, sf).select(
        F.col("category").alias("series"), "month", F.col("total_sgd").alias("value")
    )
    return dash.top_series(points, keep=3)


GROUPS = {
    "category": "category",
    "bank": "bank_name",
    "month": "strftime(transaction_date, '%Y-%m')",
    "category_source": "category_source",
}


def _group_sql(key: str) -> str:
    return f"""SELECT {GROUPS[key]} AS group_key,
  CAST(coalesce(sum(out_flow), 0) AS DECIMAL(28,2)) AS subtotal_out_flow_sgd,
  CAST(coalesce(sum(in_flow), 0) AS DECIMAL(28,2)) AS subtotal_in_flow_sgd, count(*) AS transaction_count
FROM ledger GROUP BY 1"""


for _key in GROUPS:
    query(f"group_by_{_key}", _group_sql(_key))(
        lambda spark, sf, key=_key: dash.group_summaries(ledger(spark, sf), key)
    )

query("groups_by_count", _group_sql("category"))(
    lambda spark, sf: dash.groups_by_count(dash.group_summaries(ledger(spark, sf), "category"))
)
query("group_label", "SELECT DISTINCT category_source AS group_key, category_source AS group_label FROM ledger")(
    lambda spark, sf: ledger(spark, sf).select(
        F.col("category_source").alias("group_key"), F.col("category_source").alias("group_label")
    ).distinct()
)
query("distinct_banks", "SELECT DISTINCT bank_name FROM ledger")(
    lambda spark, sf: ledger(spark, sf).select("bank_name").distinct().orderBy("bank_name")
)
query("total_count", f"SELECT count(*) AS total_count FROM ledger WHERE {RANGE}")(
    lambda spark, sf: ledger(spark, sf)
    .where(flt.date_range(F.col("transaction_date"), FROM, TO))
    .agg(F.count("*").alias("total_count"))
)
query("bank_category_menus", """SELECT DISTINCT 'bank' AS menu, bank_name AS entry FROM ledger
UNION ALL SELECT 'category', name FROM categories WHERE active""")(
    lambda spark, sf: paging.bank_and_category_menus(ledger(spark, sf), categories(spark, sf))
)

# --- sorts, pages ----------------------------------------------------------------------------

for _key, _sql in (("date", "transaction_date"), ("amount", "amount"), ("category", "category"), ("bank", "bank_name")):
    # All rows; the rank shows the order.
    query(f"sort_by_{_key}", f"SELECT {COLS}, row_number() OVER (ORDER BY {_sql} DESC, transaction_id) AS rank FROM ledger")(
        lambda spark, sf, key=_key: paging.with_rank(paging.sort_ledger(ledger(spark, sf), key).select(*SHORT))
    )

query("page", f"SELECT {COLS} FROM ledger ORDER BY transaction_date DESC, transaction_id LIMIT 50 OFFSET 100")(
    lambda spark, sf: paging.page(paging.sort_ledger(ledger(spark, sf)), 3).select(*SHORT)
)
@query("deep_page", f"""SELECT {COLS} FROM ledger ORDER BY transaction_date DESC, transaction_id
LIMIT 50 OFFSET (SELECT count(*) // 2 // 50 * 50 FROM ledger)""")
def deep_page(spark, sf):
    """The page in the middle of the ledger."""
    # Counted and narrowed several times: the joins behind the ledger are done once.
    rows = cut(ledger(spark, sf).select(*SHORT))
    number = rows.count() // 2 // 50 + 1
    return paging.deep_page(rows, [-F.unix_date("transaction_date"), F.col("transaction_id")], number, bound=2000)


query("limit_with_truncation", f"""SELECT {COLS}, true AS truncated FROM ledger
ORDER BY transaction_date DESC, transaction_id LIMIT 1000""")(
    lambda spark, sf: paging.limit_with_truncation(ledger(spark, sf).select(*SHORT), 1000)
)
query("cursor_tail", """SELECT event_id AS line_id, user_id AS run_id, props AS message FROM events
WHERE user_id = 7 AND event_id > 1000 ORDER BY event_id LIMIT 500""")(
    lambda spark, sf: paging.cursor_tail(
        bind(spark, sf, "events").select(
            F.col("event_id").alias("line_id"), F.col("user_id").alias("run_id"), F.col("props").alias("message")
        ),
        run_id=7,
        cursor=1000,
    )
)
query("run_history", "SELECT * FROM runs ORDER BY started_at DESC, run_id LIMIT 20 OFFSET 20")(
    lambda spark, sf: paging.run_history(bind(spark, sf, "runs"), 2, 20)
)
query("run_files", "SELECT * FROM run_files WHERE run_id = 3")(
    lambda spark, sf: paging.run_files(bind(spark, sf, "run_files"), 3)
)
query("pending_batch", """SELECT transaction_id, transaction_date AS created_at FROM ledger
WHERE category_source = 'unsure' ORDER BY created_at, transaction_id LIMIT 50""")(
    lambda spark, sf: paging.pending_batch(
        ledger(spark, sf).select(
            "transaction_id",
            F.col("transaction_date").alias("created_at"),
            F.when(F.col("category_source") == "unsure", "pending").otherwise("completed").alias("embedding_status"),
        )
    ).select("transaction_id", "created_at")
)
query("recent_activity", """SELECT * FROM (
  SELECT 'ingestion_run' AS kind, run_id AS item_id, completed_at AS happened_at FROM runs WHERE completed_at IS NOT NULL
  UNION ALL SELECT 'recategorization_job', job_id, completed_at FROM jobs WHERE completed_at IS NOT NULL) t
ORDER BY happened_at DESC, kind, item_id LIMIT 10""")(
    lambda spark, sf: paging.recent_activity(bind(spark, sf, "runs"), bind(spark, sf, "jobs"))
)
query("current_activity", """SELECT * FROM (
  SELECT 'ingestion_run' AS kind, run_id AS item_id, started_at AS happened_at FROM runs WHERE status = 'running'
  UNION ALL SELECT 'recategorization_job', job_id, created_at FROM jobs WHERE status = 'running') t
ORDER BY happened_at DESC, kind, item_id LIMIT 1""")(
    lambda spark, sf: paging.current_activity(bind(spark, sf, "runs"), bind(spark, sf, "jobs"))
)

# --- scalar functions over the ledger --------------------------------------------------------

BUCKETS = "CASE " + " ".join(
    f"WHEN abs(amount) <= {high} THEN '${low} to ${high}'"
    for low, high in ((0, 1), (1, 5), (5, 10), (10, 20), (20, 50), (50, 100), (100, 200), (200, 500),
                      (500, 1000), (1000, 2000), (2000, 5000))
) + " ELSE '$5000+' END"

query("price_bucket", f"SELECT vec_id, bucket FROM (SELECT p_partkey AS vec_id, {BUCKETS} AS bucket FROM "
      "(SELECT p_partkey, CAST(p_retailprice AS DECIMAL(18,2)) * CAST(p_size AS DECIMAL(4,0)) / 100 AS amount FROM part) t) u")(
    lambda spark, sf: bind(spark, sf, "part").select(
        F.col("p_partkey").alias("vec_id"),
        amounts.price_bucket(
            F.col("p_retailprice").cast("decimal(18,2)") * F.col("p_size").cast("decimal(4,0)") / 100
        ).alias("bucket"),
    )
)
query("embedding_text", f"SELECT transaction_id, description || ' | ' || {BUCKETS} AS embedding_text FROM ledger")(
    lambda spark, sf: ledger(spark, sf).select(
        "transaction_id", amounts.embedding_text(F.col("description"), F.col("amount")).alias("embedding_text")
    )
)
query("amount_label", """SELECT transaction_id, CASE WHEN converted_sgd IS NULL THEN 'unknown'
  ELSE CAST(converted_sgd AS VARCHAR) || ' SGD' END AS label FROM converted""")(
    lambda spark, sf: converted(spark, sf).select(
        "transaction_id", amounts.amount_label(F.col("converted_sgd")).alias("label")
    )
)
