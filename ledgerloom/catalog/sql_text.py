"""SQL pieces for DuckDB: noise removal, text keys and brute-force indel scores."""

from __future__ import annotations


def normalize_noise(column: str) -> str:
    """DuckDB's regular expressions have no look-ahead, so mixed words are tested one by one."""
    return rf"""trim(regexp_replace(array_to_string(list_transform(
      regexp_extract_all(regexp_replace({column}, '\b\d{{3,}}\b', ' ', 'g'), '[A-Za-z0-9]+|[^A-Za-z0-9]+'),
      lambda w: CASE WHEN length(w) <= 12 AND regexp_full_match(w, '[A-Za-z0-9]+')
                      AND regexp_matches(w, '[A-Za-z]') AND regexp_matches(w, '[0-9]') THEN ' ' ELSE w END), ''),
      '\s+', ' ', 'g'))"""


def token_key(text: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split({text}, ' '), lambda w: w <> '')), ' ')"


def pattern_key(column: str) -> str:
    return rf"trim(regexp_replace(upper(trim({column})), '\s*#?\d{{3,}}\s*$', ''))"


def pairs(name: str, left: str, right: str, threshold: int = 85) -> str:
    """CTEs giving ``name`` (l, r, score): all pairs of the distinct texts of two queries (column k)."""
    return f"""{name}_masks AS (
  SELECT k, map(list(ch), list(m)) AS masks FROM (
    SELECT k, ch, CAST(sum(CAST(1 AS HUGEINT) << CAST(p AS HUGEINT)) AS HUGEINT) AS m FROM (
      SELECT k, unnest(string_split(k, '')) AS ch, generate_subscripts(string_split(k, ''), 1) - 1 AS p
      FROM (SELECT DISTINCT k FROM ({left}) x) y) z GROUP BY k, ch) w GROUP BY k),
{name}_lcs AS (
  SELECT a.k AS l, b.k AS r, (CAST(1 AS HUGEINT) << CAST(length(a.k) AS HUGEINT)) - 1 AS full_set,
         length(a.k) + length(b.k) AS total,
         list_transform(string_split(b.k, ''), lambda c: coalesce(a.masks[c], CAST(0 AS HUGEINT))) AS steps
  FROM {name}_masks a JOIN (SELECT DISTINCT k FROM ({right}) x) b
    ON 200 * least(length(a.k), length(b.k)) >= {threshold} * (length(a.k) + length(b.k))),
{name} AS (
  SELECT l, r, CASE WHEN total = 0 THEN 100.0 ELSE (1.0::DOUBLE - (total - 2 * lcs)::DOUBLE / total::DOUBLE) * 100.0::DOUBLE END AS score
  FROM (SELECT l, r, total, length(l) - bit_count(list_reduce(steps,
          lambda s, m: ((s + (s & m)) | (s - (s & m))) & full_set, full_set)) AS lcs FROM {name}_lcs) t
  WHERE 200 * lcs >= {threshold} * total)"""
