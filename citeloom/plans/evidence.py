"""Queries of the evidence operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import evidence as ev
from ..operators import verify
from ..operators.graph import checkpointed
from .relations import CLAIMS, claims, read

QUESTIONS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def quote_grounding(spark, d):
    return verify.ground_exact(read(spark, d, "benchmark"), read(spark, d, "documents"))


def quote_sources(spark, d):
    return verify.sources(quote_grounding(spark, d))


def evidence_dedup(spark, d):
    return whole_sums(ev.deduplicate(claims(spark, d)).groupBy("entity", "question").agg(F.count("*").alias("n"), F.sum(F.col("ord").cast("decimal(19,0)")).alias("ords")), "ords")


def whole_sums(df, column):
    """df with a decimal column as bigint, as in SQL, where all of it fits; where SQL's own cast would fail, it stays decimal."""
    df = checkpointed(df)  # a row a cell
    low, high = df.agg(F.min(column), F.max(column)).first()
    fits = low is None or (low >= -(2**63) and high < 2**63)
    return df.withColumn(column, F.col(column).cast("bigint")) if fits else df


def cells(spark, d):
    out = ev.aggregate_cells(claims(spark, d), spark.createDataFrame([("LARGE",)], "question string"), fuzzy=False)
    return out.withColumn("values", F.array_join("values", "|")).withColumn("source_urls", F.array_join("source_urls", "|")).withColumn("verification_score", F.round("verification_score", 4))


def cells_fuzzy(spark, d):
    out = ev.aggregate_cells(claims(spark, d), fuzzy=True)
    return out.select("entity", "question", F.array_join("values", "|").alias("values"), "num_unique_values", "has_conflict")


def evidence_ranked(spark, d):
    return ev.ranked(claims(spark, d), 5).select("entity", "question", "rank", "ord", "match_type", F.round("semantic", 4).alias("semantic"))


def claim_ledger(spark, d):
    return ev.claim_ids(claims(spark, d)).select("ord", "entity", "question", "claim_id", text.match_label(F.col("verified"), F.col("score")).alias("label"))


def claim_anchors(spark, d):
    return ev.claim_index(ev.claim_ids(claims(spark, d)).where("value is not null"))


def best_candidates(spark, d):
    return ev.attestation(claims(spark, d))


def list_union(spark, d):
    part = read(spark, d, "part")
    rows = part.select(F.col("p_brand").alias("entity"), F.col("p_type").alias("question"), F.regexp_replace("p_name", " ", ", ").alias("value"), F.col("p_partkey").alias("ord"))
    return ev.union_lists(rows)


def matrix_pivot(spark, d):
    c = ev.aggregate_cells(claims(spark, d), fuzzy=False)
    return ev.matrix(c, QUESTIONS, most=5)


def entity_summary(spark, d):
    return ev.entity_summary(claims(spark, d))


def digest_top(spark, d):
    themes = claims(spark, d).where("value is not null").groupBy("entity", "question", F.col("value").alias("theme")).agg(F.count("*").alias("n_items"))
    return ev.digest(themes)


def ledger_depth(spark, d):
    log = read(spark, d, "orders").select(F.concat(F.lit("https://orders.example.com/"), (F.col("o_orderkey") % 35).cast("string")).alias("page_url"), (F.col("o_custkey") % 4).cast("int").alias("depth"), F.col("o_orderkey").alias("ord"))
    out = ev.with_depth(claims(spark, d).select("entity", "source_url"), log)
    return out.groupBy("entity", "depth").agg(F.count("*").alias("n"))


def theme_claims(spark, d):
    ledger = ev.claim_ids(claims(spark, d)).where("value is not null")
    groups = ledger.groupBy("entity", "question").agg(F.array_sort(F.collect_set("value")).alias("values")).withColumn("theme", F.element_at("values", -1))
    out = ev.theme_refs(groups, ev.claim_index(ledger))
    return out.withColumn("claim_ids", F.array_join("claim_ids", ","))


QUERIES = {f.__name__: f for f in (quote_grounding, quote_sources, evidence_dedup, cells, cells_fuzzy, evidence_ranked, claim_ledger, claim_anchors, best_candidates, list_union, matrix_pivot, entity_summary, digest_top, ledger_depth, theme_claims)}

_CELLS = f"""{CLAIMS},
dd AS (SELECT * FROM normed QUALIFY row_number() OVER (PARTITION BY entity, question, norm, coalesce(quote, ''), coalesce(source_url, '') ORDER BY ord) = 1),
rl AS (SELECT *, norm LIKE 'none (not disclosed%' AS sentinel, bool_or(norm NOT LIKE 'none (not disclosed%') OVER (PARTITION BY entity, question) AS real FROM dd),
kept AS (SELECT * FROM rl WHERE NOT sentinel OR NOT real),
vals AS (SELECT entity, question, norm, sentinel, arg_min(value, ord) AS value, min(ord) AS ord FROM kept GROUP BY ALL),
shown AS (SELECT entity, question, string_agg(value, '|' ORDER BY ord) FILTER (NOT sentinel) AS v, count(*) FILTER (NOT sentinel) AS n, arg_min(value, ord) FILTER (sentinel) AS marker,
          list(value ORDER BY ord) FILTER (NOT sentinel) AS lv FROM vals GROUP BY ALL),
src AS (SELECT entity, question, string_agg(DISTINCT source_url, '|' ORDER BY source_url) AS u, count(DISTINCT source_url) AS k FROM normed GROUP BY ALL),
facts AS (SELECT entity, question, count(*) AS num_evidence, bool_and(verified) AS verified, round(avg(score), 4) AS verification_score FROM kept GROUP BY ALL),
cells AS (SELECT entity, question, coalesce(v, marker) AS values, coalesce(lv, [marker]) AS lv, num_evidence, verified, verification_score, n > 1 AS many, k AS num_sources, coalesce(n, 0) AS num_unique_values, u AS source_urls
  FROM facts JOIN shown USING (entity, question) LEFT JOIN src USING (entity, question))"""
_LEDGER = f"""{CLAIMS}, ledger AS (SELECT *, 'C' || CASE WHEN n < 10000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END AS claim_id FROM (SELECT *, row_number() OVER (ORDER BY ord) AS n FROM claims))"""

ORACLES = {
    "quote_grounding": """SELECT item_id, doc_id, strpos(d.text, b.text) - 1 AS char_start, strpos(d.text, b.text) - 1 + length(b.text) AS char_end, 'exact' AS match_type, 100.0::DOUBLE AS score
FROM benchmark b JOIN documents d ON strpos(d.text, b.text) > 0""",
    "quote_sources": """SELECT item_id, count(*) AS num_sources, min(doc_id) AS first_doc, true AS verified FROM benchmark b JOIN documents d ON strpos(d.text, b.text) > 0 GROUP BY 1""",
    "evidence_dedup": f"""WITH {CLAIMS}, dd AS (SELECT * FROM normed QUALIFY row_number() OVER (PARTITION BY entity, question, norm, coalesce(quote, ''), coalesce(source_url, '') ORDER BY ord) = 1)
SELECT entity, question, count(*) AS n, sum(ord)::BIGINT AS ords FROM dd GROUP BY ALL""",
    "cells": f"""WITH {_CELLS} SELECT entity, question, values, num_evidence, verified, verification_score, many AND question <> 'LARGE' AS has_conflict, num_sources, num_unique_values, source_urls FROM cells""",
    "evidence_ranked": f"""WITH {CLAIMS} SELECT entity, question, row_number() OVER w AS rank, ord, match_type, round(semantic, 4) AS semantic FROM claims
WINDOW w AS (PARTITION BY entity, question ORDER BY CASE match_type WHEN 'exact' THEN 0 WHEN 'fuzzy' THEN 1 ELSE 2 END, coalesce(semantic, -1) DESC, ord) QUALIFY rank <= 5""",
    "claim_ledger": f"""WITH {_LEDGER} SELECT ord, entity, question, claim_id, CASE WHEN verified AND score >= 100 THEN 'exact' WHEN verified THEN 'fuzzy' ELSE 'none' END AS label FROM ledger""",
    "claim_anchors": f"""WITH {_LEDGER}, n AS (SELECT *, trim(regexp_replace(lower(value), '\\s+', ' ', 'g')) AS norm FROM ledger WHERE value IS NOT NULL)
SELECT entity, question, norm, claim_id FROM n QUALIFY row_number() OVER (PARTITION BY entity, question, norm ORDER BY verified DESC, ord) = 1""",
    "best_candidates": f"""WITH {CLAIMS}, per AS (SELECT entity, question, norm, count(*) AS n, arg_min(value, ord) AS value, min(ord) AS ord, bool_or(verified) AS v FROM normed GROUP BY ALL)
SELECT entity, question, value AS best, n AS attested, v AS verified, candidates FROM (SELECT *, count(*) OVER (PARTITION BY entity, question) AS candidates, row_number() OVER (PARTITION BY entity, question ORDER BY v DESC, n DESC, ord) AS r FROM per) WHERE r = 1""",
    "list_union": """WITH i AS (SELECT p_brand AS entity, p_type AS question, p_partkey AS ord, unnest(string_split(p_name, ' ')) AS item, generate_subscripts(string_split(p_name, ' '), 1) AS pos FROM part),
f AS (SELECT entity, question, lower(item) AS key, min({'ord': ord, 'pos': pos, 'item': item}) AS f FROM i GROUP BY ALL)
SELECT entity, question, string_agg(f.item, ', ' ORDER BY f.ord, f.pos) AS items, count(*) AS n_items FROM f GROUP BY ALL""",
    "matrix_pivot": f"""WITH {_CELLS}, t AS (SELECT entity, question, CASE WHEN many THEN '(sources conflict)' || chr(10) ELSE '' END || CASE WHEN verified THEN '' ELSE '(unverified)' || chr(10) END || '- ' || array_to_string(lv[1:5], chr(10) || '- ')
  || CASE WHEN len(lv) > 5 THEN chr(10) || '[+' || (len(lv) - 5) || ' more items — see Provenance]' ELSE '' END AS text FROM cells)
SELECT entity, """
    + ", ".join(f"coalesce(max(text) FILTER (question = '{q}'), 'No data found') AS \"{q}\"" for q in QUESTIONS)
    + " FROM t GROUP BY entity",
    "entity_summary": f"""WITH {CLAIMS} SELECT entity, count(DISTINCT source_url) AS pages, count(*) AS claims, count(*) FILTER (verified) AS verified, count(*) FILTER (NOT verified) AS unverified, count(*) FILTER (value IS NULL) AS no_data FROM claims GROUP BY 1""",
    "digest_top": f"""WITH {CLAIMS}, t AS (SELECT entity, question, value AS theme, count(*) AS n FROM claims WHERE value IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY entity, question ORDER BY n DESC, theme) AS k FROM t)
SELECT entity, question, sum(n)::BIGINT AS items, count(*) AS themes, sum(n)::BIGINT || ' items across ' || count(*) || ' themes. Top: ' || string_agg(theme || ' (' || n || ' items)', '; ' ORDER BY k) FILTER (k <= 3) AS digest FROM r GROUP BY ALL""",
    "ledger_depth": f"""WITH {CLAIMS}, log AS (SELECT 'https://orders.example.com/' || (o_orderkey % 35) AS page_url, arg_max(o_custkey % 4, o_orderkey)::INT AS depth FROM orders GROUP BY 1)
SELECT entity, coalesce(depth, 0) AS depth, count(*) AS n FROM claims LEFT JOIN log ON source_url = page_url GROUP BY ALL""",
    "theme_claims": f"""WITH {_LEDGER}, n AS (SELECT *, trim(regexp_replace(lower(value), '\\s+', ' ', 'g')) AS norm FROM ledger WHERE value IS NOT NULL),
ix AS (SELECT entity, question, norm, value, claim_id FROM n QUALIFY row_number() OVER (PARTITION BY entity, question, norm ORDER BY verified DESC, ord) = 1)
SELECT entity, question, max(value) AS theme, string_agg(claim_id, ',' ORDER BY value) AS claim_ids, arg_max(claim_id, value) AS anchor FROM ix GROUP BY ALL""",
}
