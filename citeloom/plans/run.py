"""A whole evidence run: request → pages → routed chunks → evidence → cells → themes → summaries → tables.

Fetching, embedding, extraction and summarising are functions that the caller gives; everything between is
DataFrames. Errors are rows of the log, never failed tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import acquire, evidence, extract, group, routing, summary, verify
from ..operators.graph import checkpointed
from ..sources import request as requests
from ..sources import tables


def embed(rows: DataFrame, column: str, model: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """rows with vector, each distinct text embedded once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f["body_of"].tolist()
            vectors = [v for i in range(0, len(texts), batch) for v in model(texts[i : i + batch])]
            yield pd.DataFrame({"body_of": texts, "vector": vectors})

    known = rows.select(F.col(column).alias("body_of")).where("body_of is not null").distinct().mapInPandas(run, "body_of string, vector array<double>")
    return rows.join(known, rows[column] == known["body_of"], "left").drop("body_of")


def run(
    spark: SparkSession,
    request: dict,
    backend: Callable[[str], dict],
    extractor: Callable[[str, list[dict], list[str]], dict],
    embedder: Callable[[list[str]], list[list[float]]] | None = None,
    model: Callable[[str], str] | None = None,
    cache: DataFrame | None = None,
    delay: float = acquire.DELAY,
) -> dict[str, DataFrame]:
    """The tables of a run: log, routed, ledger, cells, themes, summaries, matrix."""
    given = requests.relations(spark, request)
    questions = request["questions"]
    names = [q["question"] for q in questions]
    nothing = spark.createDataFrame([], "key string, text string, fetched_at int")
    fetched = checkpointed(acquire.acquire(given["urls"], nothing if cache is None else cache, backend, delay=delay))
    owners = given["urls"].select("url", F.explode("entities").alias("entity"))
    pages = fetched.where("status in ('ok', 'cached') and coalesce(text, '') <> ''").select("url", "text")
    chunks = extract.page_chunks(pages)
    routed = None
    if embedder:
        asked = given["questions"].withColumn("query", text.query_text(F.col("question"), F.col("instruction")))
        pieces = pages.select("url", F.explode(text.paragraph_chunks(F.col("text"))).alias("piece"))
        scores = routing.question_scores(embed(pieces, "piece", embedder).select("url", "vector"), embed(asked, "query", embedder).select("question", "vector"))
        routed = routing.route(scores, routing.keyword_hits(pages, routing.question_keywords(given["questions"])))
    parts = []
    # entities that share a list of pages are asked together; a request has few entities
    for entity in request["entities"]:
        own = chunks.join(owners.where(F.col("entity") == entity).select("url"), "url", "left_semi")
        parts.append(extract.merge(extract.extract(own, questions, [entity], extractor), questions, [entity]))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    if routed is not None:
        found = found.join(routed.where("included").select("url", "question"), ["url", "question"], "left_semi")
    checked = verify.verify_quotes(found.join(pages.withColumnRenamed("text", "page_text"), "url")).drop("page_text")
    ledger = checked.select("entity", "question", "value", "quote", F.col("url").alias("source_url"), "verified", "score", "match_type", F.lit(None).cast("double").alias("semantic"), (F.abs(F.xxhash64("url")) % 1_000_000 * 1_000_000_000 + F.col("ord")).alias("ord"))
    ledger = checkpointed(evidence.claim_ids(ledger))
    cells = evidence.aggregate_cells(ledger, given["questions"].where("is_list").select("question"))
    good = ledger.where("verified")
    out = {"log": fetched.select("url", "status", "backend", "rendered", "passed", "reason", "fetch_ms"), "ledger": ledger, "cells": cells, "matrix": evidence.matrix(cells, names)}
    if routed is not None:
        out["routed"] = routed
    index = evidence.claim_index(good)
    if embedder:
        values = good.groupBy("entity", "question", "value").agg(F.min("ord").alias("ord"))
        themes = group.themes(embed(values, "value", embedder))
    else:
        themes = good.groupBy("entity", "question").agg(F.array_sort(F.collect_set("value")).alias("values")).select("entity", "question", F.lit("(all items)").alias("theme"), F.size("values").alias("n_items"), "values", F.lit(1).alias("place"))
    refs = evidence.theme_refs(themes, index)
    out["themes"] = themes.join(refs, ["entity", "question", "theme"], "left").withColumn("claim_ids", F.coalesce("claim_ids", F.array().cast("array<string>")))
    cited = index.join(good.select("claim_id", "value", "ord"), "claim_id").select("entity", "question", "claim_id", "value", "ord")
    out["summaries"] = summary.summarise(cited, out["themes"], model)
    return out


def save(result: dict[str, DataFrame], path: str) -> None:
    tables.write_tables(result, path)
