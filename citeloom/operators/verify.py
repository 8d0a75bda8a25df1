"""Grounding of quotes in page texts: exact spans first, edit similarity for the rest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.similarity import partial_ratio

# The scores from which a quote counts as found, also for long quotes whose ends occur literally.
FUZZY, SOFT, LONG_QUOTE, ANCHOR = 70.0, 68.0, 100, 20


#: Characters of a quote that meet those of a page.
ANCHORED = 24


def _automaton_hits(quotes: DataFrame, docs: DataFrame, most: int) -> DataFrame:
    """(item_id, doc_id, quote, at) of quotes in documents by an automaton of most quotes at a time."""
    passes = -(-quotes.count() // most)
    sc = docs.sparkSession.sparkContext
    out = None
    for k in range(passes):
        part = quotes if passes == 1 else quotes.where(F.pmod(F.xxhash64("item_id", "quote"), F.lit(passes)) == k)
        held: dict[str, list] = {}
        for r in part.select("item_id", "quote").toLocalIterator():  # about most rows
            held.setdefault(r["quote"], []).append(r["item_id"])
        table = sc.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            found = ahocorasick.Automaton()
            for quote in table.value:
                found.add_word(quote, quote)
            found.make_automaton()
            for batch in batches:
                rows: list[tuple] = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    first: dict[str, int] = {}
                    for end, quote in found.iter(text):
                        first.setdefault(quote, end - len(quote) + 2)
                    rows += [(item, doc, quote, at) for quote, at in first.items() for item in table.value[quote]]
                columns = zip(*rows, strict=True) if rows else ([],) * 4
                yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        kinds = {"item_id": quotes.schema["item_id"].dataType, "doc_id": docs.schema["doc_id"].dataType}
        spark_schema = T.StructType([T.StructField(n, t) for n, t in (*kinds.items(), ("quote", T.StringType()), ("at", T.IntegerType()))])
        schema = to_arrow_schema(spark_schema)
        hits = docs.select("doc_id", "text").mapInArrow(run, spark_schema)
        out = hits if out is None else out.union(hits)
    return out


def ground_exact(quotes: DataFrame, docs: DataFrame, max_broadcast: int = 100_000) -> DataFrame:
    """(item_id, doc_id, char_start, char_end, match_type, score) of every document that holds a quote literally, wherever it begins.

    A quote's anchor is its first word of which it holds the start, with what follows, 24 characters in all; wherever the
    quote stands, its anchor stands at the start of a word there. Quotes and documents meet on the hash of anchors: each
    document gives its windows of that length at the starts of words, so no pair is compared that does not share one.
    Quotes without an anchor are looked for by an automaton that goes to every task, max_broadcast of them at a time.
    """
    q = quotes.select("item_id", F.col("text").alias("quote")).where("quote is not null and quote <> ''")
    anchor = F.regexp_extract("quote", r"(?Us)\W(\w.{%d})" % (ANCHORED - 1), 1)
    d = docs.where("text is not null").select("doc_id", "text")
    keys = q.where(anchor != "").select("item_id", "quote", F.xxhash64(anchor).alias("key"))
    starts = F.regexp_extract_all("text", F.lit(r"(?Us)\b(?=(\w.{%d}))" % (ANCHORED - 1)), 1)
    seen = d.select("doc_id", F.explode(F.array_distinct(F.transform(starts, lambda s: F.xxhash64(s)))).alias("key"))
    hits = seen.join(keys, "key").select("doc_id", "item_id", "quote").distinct()
    found = hits.join(d, "doc_id").select("item_id", "doc_id", "quote", F.instr("text", F.col("quote")).alias("at")).where("at > 0")
    odd = q.where(anchor == "")
    if not odd.isEmpty():
        found = found.union(_automaton_hits(odd, d, max_broadcast))
    at = F.col("at")
    return found.select("item_id", "doc_id", (at - 1).cast("bigint").alias("char_start"), (at - 1 + F.length("quote")).cast("bigint").alias("char_end"), F.lit("exact").alias("match_type"), F.lit(100.0).alias("score"))


def sources(grounded: DataFrame) -> DataFrame:
    return grounded.groupBy("item_id").agg(F.count("*").alias("num_sources"), F.min("doc_id").alias("first_doc"), F.lit(True).alias("verified"))


def verify_quotes(pairs: DataFrame) -> DataFrame:
    """pairs (quote, page_text, ...) with verified, score, char_start, char_end and match_type; exact pairs never reach Python."""
    at = F.instr("page_text", F.col("quote"))
    pairs = pairs.withColumn("at", F.when(F.coalesce("quote", F.lit("")) != "", at).otherwise(0))
    exact = pairs.where("at > 0").select("*", F.lit(True).alias("verified"), F.lit(100.0).alias("score"), (F.col("at") - 1).cast("int").alias("char_start"), (F.col("at") - 1 + F.length("quote")).cast("int").alias("char_end"), F.lit("exact").alias("match_type")).drop("at")
    rest = pairs.where("at is null or at <= 0").drop("at")
    names = rest.columns
    clean = r"[|#*()/\\]+"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        tidy = lambda s: " ".join(re.sub(clean, " ", s).split()).lower()
        for frame in frames:
            rows = []
            for quote, page in zip(frame["quote"], frame["page_text"], strict=True):
                if not quote:
                    rows.append((False, None, "none"))
                    continue
                score = partial_ratio(tidy(quote), tidy(page or ""))
                soft = len(quote) >= LONG_QUOTE and quote[:ANCHOR] in (page or "") and quote[-ANCHOR:] in (page or "") and score >= SOFT
                rows.append((score >= FUZZY or soft, score, "fuzzy" if score >= FUZZY else "fuzzy_soft" if soft else "none"))
            out = frame.copy()
            out["verified"], out["score"], out["match_type"] = [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]
            out["char_start"] = out["char_end"] = None
            yield out[[*names, "verified", "score", "char_start", "char_end", "match_type"]]

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields), "verified boolean, score double, char_start int, char_end int, match_type string"])
    return exact.union(rest.mapInPandas(run, schema))


def verify_cells(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """A cell is verified if all its evidence is; its score is the mean of those known."""
    return evidence.groupBy(*keys).agg(F.bool_and(F.coalesce("verified", F.lit(False))).alias("verified"), F.avg("score").alias("verification_score"), F.count("*").alias("num_quotes"))
