"""The operators over their whole tables, by query name, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webcorpus.llm import (
    decontaminate,
    fill_middle,
    html_text,
    language,
    licenses,
    mixing,
    neighbours,
    quality,
    secrets,
    simhash,
    suffix_tree,
    token_counts,
    whitening,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": lambda s, d: quality.op1(_table(s, d, "documents"), _table(s, d, "labels")),
    "op2_secrets": lambda s, d: secrets.op2(_table(s, d, "documents")),
    "op3_neighbours": lambda s, d: neighbours.op3(_table(s, d, "embeddings")),
    "op4_suffix_tree": lambda s, d: suffix_tree.op4(_table(s, d, "documents")),
    "op5_licenses": lambda s, d: licenses.op5(_table(s, d, "documents")),
    "op6_mixing": lambda s, d: mixing.op6(_table(s, d, "documents")),
    "op7_decontaminate": lambda s, d: decontaminate.op7(_table(s, d, "documents"), _table(s, d, "benchmark")),
    "op8_language": lambda s, d: language.op8(_table(s, d, "documents")),
    "op9_simhash": lambda s, d: simhash.op9(_table(s, d, "documents")),
    "op10_html_text": lambda s, d: html_text.op10(_table(s, d, "pages")),
    "op11_whitening": lambda s, d: whitening.op11(_table(s, d, "embeddings")),
    "op12_token_counts": lambda s, d: token_counts.op12(_table(s, d, "documents")),
    "op13_fill_middle": lambda s, d: fill_middle.op13(_table(s, d, "documents")),
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _matches(kind: int, rule: secrets.Rule) -> str:
    """Each match's place, by cutting the text at the matches and adding up lengths."""
    pattern = _quoted(rule.pattern)
    return f"""
        SELECT rid, {kind} AS kind, '{rule.kind}' AS name, pos, gap, size, held FROM (
            SELECT rid, unnest(range(1, len(found) + 1)) AS pos, unnest(list_transform(gaps[1:len(found)], lambda x: length(x))) AS gap,
                   unnest(list_transform(found, lambda x: length(x))) AS size, unnest(list_transform(groups, lambda x: length(x))) AS held
            FROM (SELECT rid, regexp_extract_all(t, {pattern}, 0) AS found, regexp_extract_all(t, {pattern}, {rule.group}) AS groups,
                         string_split_regex(t, {pattern}) AS gaps
                  FROM d WHERE regexp_matches(t, {pattern}))
        )"""


SQL: dict[str, str] = {
    "op2_secrets": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_matches(k, r) for k, r in enumerate(secrets.RULES))}),
s AS (SELECT *, sum(gap + size) OVER (PARTITION BY rid, kind ORDER BY pos) AS fin FROM m),
g AS (
    SELECT rid, kind, name || ':' || (fin - size)::BIGINT || ':' || fin::BIGINT AS item, fin - size AS start FROM s
    WHERE {" OR ".join(f"(kind = {k} AND held >= {r.least})" for k, r in enumerate(secrets.RULES))}
),
l AS (
    SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
           coalesce(string_agg(item, ',' ORDER BY start, kind) FILTER (kind < {len(secrets.BASE)}), '') AS base,
           string_agg(item, ',' ORDER BY start, kind) AS spans
    FROM g GROUP BY rid
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN l ON d.rid = l.rid""",
    "op13_fill_middle": fill_middle.SQL,
}
