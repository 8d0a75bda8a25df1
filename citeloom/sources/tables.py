"""Readers and writers of evidence tables: caches, ledgers, matrices, ground truth, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, url

# Other names of ledger columns.
LEDGER_NAMES = {"Claim": "value", "Value": "value", "Verbatim Quote": "quote", "Quote": "quote", "Source URL": "source_url", "URL": "source_url", "Entity": "entity", "Question": "question", "Column": "question", "Verified": "verified", "Verification Score": "score", "Match Type": "match_type"}


def ledger(rows: DataFrame) -> DataFrame:
    """A ledger under its own names, whatever of the known names its columns have; rows without entity or question go."""
    found = {}
    for c in rows.columns:
        own = LEDGER_NAMES.get(c.strip())
        if own and own not in found:
            found[own] = F.col(f"`{c}`")
    out = rows.select(*(v.cast("string").alias(k) for k, v in found.items()))
    out = out.withColumns({k: F.lit(None).cast("string") for k in set(LEDGER_NAMES.values()) - set(found)})
    out = out.withColumns({"verified": text.to_bool(F.col("verified")), "score": F.expr("try_cast(score as double)")})
    return out.where("trim(coalesce(entity, '')) <> '' and trim(coalesce(question, '')) <> ''")


def matrix_cells(matrix: DataFrame, questions: list[str]) -> DataFrame:
    """(entity, question, status, ord, value, verified) from rendered cells: bullets, the unverified section, the marks."""
    long = matrix.unpivot(["entity"], questions, "question", "text").where("text is not null")
    conflict, loose = F.col("text").startswith("(sources conflict)"), F.col("text").rlike(r"(?m)^\(unverified\)$")
    lines = long.select("entity", "question", conflict.alias("conflict"), loose.alias("loose"), F.posexplode(F.split("text", "\n")).alias("ord", "line"), "text")
    section = F.max(F.col("line").rlike(r"^-- Unverified --$").cast("int")).over(Window.partitionBy("entity", "question").orderBy("ord"))
    values = lines.withColumn("open", section).where(~F.col("line").rlike(r"^(\(|\[|-- )") & (F.trim("line") != ""))
    value = F.trim(F.regexp_replace("line", r"^[-*•]\s+", ""))
    status = F.when(value == "No data found", "NO_DATA").when(F.lower(value).contains("not disclosed"), "ND").when(F.col("conflict"), "CONFLICT").otherwise("VALUE")
    return values.select("entity", "question", status.alias("status"), "ord", value.alias("value"), (~F.col("loose") & (F.col("open") == 0)).alias("verified"))


def flat_truth(rows: DataFrame) -> DataFrame:
    """Ground truth rows with an order, without incomplete ones; is_list is read from any truthy cell."""
    out = rows.where("trim(coalesce(entity, '')) <> '' and trim(coalesce(question, '')) <> '' and trim(coalesce(value, '')) <> ''")
    return out.withColumn("is_list", text.to_bool(F.col("is_list").cast("string")))


def unpivot_truth(matrix: DataFrame, entity: str, order: str, questions: list[str], comma: tuple[str, ...] = ()) -> DataFrame:
    """A matrix of answers as rows: blank entities continue the one above, cells split into items, lists inferred."""
    filled = F.last(F.when(F.trim(F.coalesce(F.col(entity), F.lit(""))) != "", F.trim(entity)), True).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    long = matrix.withColumn("entity", filled).unpivot(["entity", order], questions, "question", "cell").where("entity is not null")
    items = F.when(F.col("question").isin(*comma), text.split_cell(F.col("cell"), True)).otherwise(text.split_cell(F.col("cell"))) if comma else text.split_cell(F.col("cell"))
    rows = long.select("entity", "question", order, F.posexplode(items).alias("pos", "value"), F.size(items).alias("n"))
    rows = rows.withColumn("value", F.when(text.null_marker(F.col("value")), "None (not disclosed)").otherwise(F.col("value")))
    many = rows.groupBy("question").agg(F.max((F.col("n") > 1).cast("int")).alias("m"))
    return rows.join(F.broadcast(many), "question").select("entity", "question", "value", (F.col("m") == 1).alias("is_list"), order, "pos")  # many: a row a question


def from_cache(urls: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with text, misses) of a page cache (key, text, fetched_at); the latest entry counts."""
    last = cache.groupBy("key").agg(F.max_by("text", "fetched_at").alias("text"))
    keyed = urls.withColumn("key", url.cache_key(F.col("url")))
    return keyed.join(last, "key").drop("key"), keyed.join(last, "key", "left_anti").drop("key")


def to_cache(pages: DataFrame, path: str) -> None:
    """Adds pages (url, text, fetched_at) with text to a cache, dealt over 256 folders by key."""
    rows = pages.where("trim(coalesce(text, '')) <> ''").select(url.cache_key(F.col("url")).alias("key"), "url", "text", "fetched_at")
    rows.withColumn("part", F.substring("key", 1, 2)).repartition("part").write.mode("append").partitionBy("part").parquet(path)


def pinned_pages(log: DataFrame, keep: tuple[str, ...] = ("ok", "cached")) -> DataFrame:
    """Pages of an earlier run's log as seeds of depth 0, each entity and page once."""
    return log.where(F.col("status").isin(*keep)).select("entity", F.col("page_url").alias("url")).distinct().withColumn("depth", F.lit(0))


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """One folder of Parquet files a table."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_workbook(tables: dict[str, DataFrame], most_rows: int = 100_000) -> bytes:
    """A workbook of tables that people read; larger tables belong into write_tables."""
    from .workbook import write_sheets

    sheets = {}
    for name, df in tables.items():
        rows = df.limit(most_rows + 1).collect()
        if len(rows) > most_rows:
            raise ValueError(f"{name} has more than {most_rows} rows")
        sheets[name] = [df.columns, *([v if isinstance(v, int | float | bool | str) or v is None else str(v) for v in r] for r in rows)]
    return write_sheets(sheets)


def resolved_csv(results: DataFrame, path: str) -> None:
    results.withColumn("confidence", F.format_string("%.3f", F.col("confidence"))).write.mode("overwrite").option("header", True).csv(path)


def company_csv(spark: SparkSession, path: str) -> DataFrame:
    """Company rows; header names in any case and spacing."""
    raw = spark.read.option("header", True).csv(path)
    return raw.toDF(*(c.strip().lower() for c in raw.columns)).where("trim(coalesce(company, '')) <> ''")
