"""The corpus queries: each applies one operator, with its production parameters, to a whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, masked_lm, quality, substring_dedup, token_counts
from ._common import checkpoint, held_out, shared_folder, table
from .decontamination import decontaminate
from .main_text import extract
from .mixing import mix_sources
from .near_duplicates import near_duplicates
from .similarity_join import similarity_join


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, train_where=~held_out("id", 3, 1))
    return language.identify(docs, model).withColumn("held_out", held_out("doc_id", 3, 1)).select("doc_id", "held_out", "lang_pred", "score", "n_languages", "languages", "proportions")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op3_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after a feed of changes: inserts in two batches, one with provisional counts, their revision, a batch
    delivered twice, and the deletion of documents without words."""
    counts = checkpoint(token_counts.count_tokens(table(spark, sf_dir, "documents"), *token_counts.default_vocabulary()))
    rollup = token_counts.Rollup(spark, f"{shared_folder(spark)}/token-rollup-{uuid.uuid4().hex}")
    late = F.coalesce(held_out("id", 4, 0), F.lit(False))
    bpe, words = "byte_bpe_50k", "words"
    sure, guessed, empty = counts.where(~late), counts.where(late), counts.where("words = 0")
    first = token_counts.change(sure, 1, bpe, "tokens").union(token_counts.change(counts, 1, words, "words"))
    rollup.commit("inserts-1", first)
    rollup.commit("inserts-2", token_counts.change(guessed, 1, bpe, F.ceil(F.col("chars") / 4)))
    rollup.commit("inserts-1", first)
    rollup.commit("revised", token_counts.change(guessed, -1, bpe, F.ceil(F.col("chars") / 4)).union(token_counts.change(guessed, 1, bpe, "tokens")))
    rollup.commit("deletes", token_counts.change(empty, -1, bpe, "tokens").union(token_counts.change(empty, -1, words, "words")))
    return rollup.totals()


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), spans=False, clean_text=False)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), train_where=~held_out("id", 4, 2))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return masked_lm.score(docs, *masked_lm.fit(docs))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language": op1_language,
    "op2_main_text": op2_main_text,
    "op3_similarity_join": op3_similarity_join,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_token_counts": op5_token_counts,
    "op6_decontamination": op6_decontamination,
    "op7_quality": op7_quality,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_mixing": op9_mixing,
    "op10_substring_dedup": op10_substring_dedup,
}

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS6 = r"regexp_extract_all(" + _FOLD + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op3_similarity_join": """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
l AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.9),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
k AS (SELECT a, count(*) AS n FROM l GROUP BY 1), m AS (SELECT a, min(b) AS m FROM r GROUP BY 1)
SELECT vec_id, coalesce(k.n, 0) AS n_links, least(vec_id, coalesce(m.m, vec_id)) AS component_id, vec_id <= coalesce(m.m, vec_id) AS kept
FROM embeddings LEFT JOIN k ON k.a = vec_id LEFT JOIN m ON m.a = vec_id""",
    "op4_near_duplicates": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id, d.doc_id <= coalesce(min(r.b), d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id, n.n""",
    "op6_decontamination": f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS6.format("text")}, []) AS w FROM documents),
b AS (SELECT item_id, coalesce({_WORDS6.format("text")}, []) AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS p
       FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
hits AS (SELECT d.doc_id, i, n, item_id FROM
          (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
           FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)) d
          JOIN bw USING (n, p)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op9_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((k - 1) % 3 + 1)::INT] AS weight, source_size * 2 AS cap FROM s),
f AS (SELECT *, cap / weight AS fill FROM w),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(cap) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / (sum(weight) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM f),
m AS (SELECT *, max(CASE WHEN level <= fill THEN level END) OVER () AS water FROM l),
t AS (SELECT source, source_size, CASE WHEN water IS NULL OR water * weight >= cap THEN cap::DOUBLE ELSE water * weight END AS target FROM m),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio FROM t),
p AS (SELECT *, floor(ratio)::BIGINT AS copies, ratio - floor(ratio) AS p FROM r),
u AS (SELECT d.doc_id, d.source, d.size, p.source_size, p.target, p.copies, p.p, target - copies * p.source_size AS room,
             (('0x' || substr(md5(d.doc_id::VARCHAR || ':1'), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
q AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM u),
k AS (SELECT *, floor(q / (1 + q) * 281474976710656.0::DOUBLE)::BIGINT AS key FROM q),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
             sum(size) OVER (PARTITION BY source, key) AS tied FROM k)
SELECT doc_id, size, source_size, target,
       (size * (copies + CASE WHEN key IS NOT NULL AND upto - tied + upto <= 2 * room THEN 1 ELSE 0 END))::BIGINT AS taken FROM c""",
}
