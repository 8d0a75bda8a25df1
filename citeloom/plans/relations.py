"""Relations of an evidence run, read from the tables at hand, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def claims(spark: SparkSession, d: str) -> DataFrame:
    """Evidence rows: a supplier answers what brand its parts of a type have, an order line is the source."""
    line = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")
    part = read(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    rows = line.join(part, line["l_partkey"] == part["p_partkey"])
    return rows.select(
        F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")).alias("entity"),
        F.col("p_type").alias("question"),
        F.when(F.col("l_discount") == 0.1, "None (not disclosed on site)").when(F.col("l_discount") == 0.0, F.lit(None)).otherwise(F.concat(F.col("p_brand"), F.lit("  x"))).alias("value"),
        F.col("p_name").alias("quote"),
        F.concat(F.lit("https://orders.example.com/"), (F.col("l_orderkey") % 40).cast("string")).alias("source_url"),
        (F.col("l_quantity") > 10).alias("verified"),
        (F.col("l_quantity") * 2).alias("score"),
        F.when(F.col("l_quantity") >= 50, "exact").when(F.col("l_quantity") > 10, "fuzzy").otherwise("none").alias("match_type"),
        F.when(F.col("l_tax") > 0, F.col("l_tax") * 10).alias("semantic"),
        ((((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")) * 100 + F.col("l_quantity").cast("bigint")).alias("ord"),
    )


CLAIMS = """claims AS (SELECT 'Supplier ' || l_suppkey AS entity, p_type AS question,
  CASE WHEN l_discount = 0.1 THEN 'None (not disclosed on site)' WHEN l_discount = 0.0 THEN NULL ELSE p_brand || '  x' END AS value,
  p_name AS quote, 'https://orders.example.com/' || (l_orderkey % 40) AS source_url, l_quantity > 10 AS verified, l_quantity * 2 AS score,
  CASE WHEN l_quantity >= 50 THEN 'exact' WHEN l_quantity > 10 THEN 'fuzzy' ELSE 'none' END AS match_type,
  CASE WHEN l_tax > 0 THEN l_tax * 10 END AS semantic, (((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey) * 100 + l_quantity::BIGINT AS ord
  FROM lineitem JOIN part ON l_partkey = p_partkey),
normed AS (SELECT *, trim(regexp_replace(lower(value), '\\s+', ' ', 'g')) AS norm FROM claims WHERE value IS NOT NULL AND value <> '')"""
