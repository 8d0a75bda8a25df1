"""Mixing sources to target weights: Pareto order sampling.

Sources, in order of code points with null last, weigh 3, 1, 2 and so on; their targets share a multiple of all
words by weight, no target above max_copies times its source, and what that cuts off is shared again among the
others. A document is expected target / source size times: the whole part is taken with certainty, and for
the rest, the inclusion probability p, documents are ranked by the odds of a uniform number of their id over
the odds p / (1 - p), times a priority where one is given. Each source takes its lowest ranks until its words
come nearest to what is left of its target.

That cut is found without sorting: ranks are 48-bit integers, and four passes of histograms of 12 bits each
narrow the cut of every source to one rank. No pass shuffles more than a row for each source, bin and task, so
a source that holds a third of all rows costs no more than any other.

Defined cases: a null text has size 0 and is taken 0 times; a null source is a source of its own; rows that share
an id share a rank and are taken or left together, as do documents whose ranks tie; a null id has no rank and gets whole
copies alone; a source without words has target 0; a very long text is one document like others, so its source's words
come within half of it; an empty table gives an empty result; other columns, clashing names among them, are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import checkpoint, numbered, pick

WEIGHTS = (3, 1, 2)
WORDS = r"[^\x20\x09-\x0D]+"
_BITS, _STEP = 48, 12


def targets(sizes: DataFrame, *, share: float = 1.5, max_copies: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) with target, copies and p. One row a source: small beside the documents."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_copies)
    s = s.withColumn("fill", F.col("cap") / F.col("weight"))
    rising = Window.orderBy("fill", F.col("source").asc_nulls_last())
    before, after = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    # beyond the first source that stays below its cap, levels only fall
    level = F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(whole)
    s = s.withColumn("target", F.when(level.isNull() | (level * F.col("weight") >= F.col("cap")), F.col("cap").cast("double")).otherwise(level * F.col("weight")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return s.select("source", "source_size", "target", F.floor(ratio).alias("copies"), (ratio - F.floor(ratio)).alias("p"))


def rank_key(id_col: Column, p: Column, seed: int, priority: Column | None = None) -> Column:
    """The Pareto rank as an integer of 48 bits."""
    drawn = F.conv(F.substring(F.md5(F.concat(id_col.cast("string"), F.lit(f":{seed}"))), 1, 12), 16, 10).cast("bigint")
    p = F.when((p > 0) & (p < 1), p)
    u = (drawn + F.lit(0.5)) / F.lit(float(1 << _BITS))
    q = (u / (1 - u)) / (p / (1 - p))
    q = q / priority if priority is not None else q
    return F.floor(q / (1 + q) * F.lit(float(1 << _BITS)))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, max_copies: int = 2, weights: tuple[int, ...] = WEIGHTS, seed: int = 1, priority_col: str | None = None, max_broadcast_sources: int = 100_000, keep: bool = False) -> DataFrame:
    """(id, source, size, source_size, target, copies) of every document; copies is how often the mix takes it.

    keep: instead all columns of docs, with size_of, target_of and copies_of behind them in place of any of these names.
    """
    extra = {"priority": priority_col} if priority_col else {}
    narrow = pick(docs, id=id_col, text=text_col, source=source_col, **extra)
    narrow = checkpoint(narrow.select("id", "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("bigint").alias("size"), *extra))
    plan = checkpoint(targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), share=share, max_copies=max_copies, weights=weights))
    small = plan.count() <= max_broadcast_sources
    hint = F.broadcast if small else lambda df: df

    def with_source(df: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
        facts = facts.withColumnRenamed("source", "own")
        return df.join(hint(facts), F.col("source").eqNullSafe(F.col("own")), how).drop("own")

    keyed = with_source(narrow, plan.select("source", "p")).where("p > 0")
    keyed = keyed.select("source", "size", rank_key(F.col("id"), F.col("p"), seed, F.col("priority") if priority_col else None).alias("key")).where("key is not null")
    # cut: of each source, the high bits found so far and the words that ranks below them take
    cut = plan.where("p > 0").select("source", F.lit(0).cast("bigint").alias("high"), F.lit(0).cast("bigint").alias("below"), (F.col("target") - F.col("copies") * F.col("source_size")).alias("room"))
    for shift in range(_BITS - _STEP, -1, -_STEP):
        inside = with_source(keyed, cut).where(F.shiftright("key", shift + _STEP) == F.col("high"))
        bins = inside.groupBy("source", "high", "below", "room", F.shiftright("key", shift).alias("bin")).agg(F.sum("size").alias("words"))
        running = Window.partitionBy("source").orderBy("bin")
        bins = bins.withColumn("upto", F.col("below") + F.sum("words").over(running))
        last = F.row_number().over(Window.partitionBy("source").orderBy(F.col("bin").desc())) == 1
        # the first bin that reaches the room, else the last one
        reach = bins.withColumn("last", last).where((F.col("upto") >= F.col("room")) | F.col("last"))
        first = F.min_by(F.struct("bin", (F.col("upto") - F.col("words")).alias("below"), "upto", "room"), "bin").alias("x")
        cut = checkpoint(reach.groupBy("source").agg(first).select("source", F.col("x.bin").alias("high"), F.col("x.below").alias("below"), F.col("x.upto").alias("upto"), F.col("x.room").alias("room")))
        if shift:
            cut = cut.drop("upto")
    # the rank at the cut is in if that brings the words nearer to the room
    cut = cut.select("source", F.when(F.col("below") + F.col("upto") <= 2 * F.col("room"), F.col("high")).otherwise(F.col("high") - 1).alias("cut"))
    base = narrow
    if keep:
        flat, at = numbered(docs, id=id_col, text=text_col, source=source_col, **extra)
        size = F.coalesce(F.regexp_count(at["text"], F.lit(WORDS)), F.lit(0)).cast("bigint").alias("size")
        base = flat.select(*flat.columns, size, *(F.col(c).alias(k) for k, c in at.items() if k != "text"))
    out = with_source(with_source(base, plan), cut, "left")
    key = rank_key(F.col("id"), F.col("p"), seed, F.col("priority") if priority_col else None)
    picked = F.when((F.col("p") > 0) & (key <= F.col("cut")), 1).otherwise(0)
    if keep:
        added = ["size_of", "target_of", "copies_of"]
        left = [(c, name) for c, name in zip(flat.columns, docs.columns, strict=True) if name.lower() not in added]
        return out.select(*(c for c, _ in left), "size", "target", (F.col("copies") + picked).cast("bigint")).toDF(*(name for _, name in left), *added)
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", (F.col("copies") + picked).cast("bigint").alias("copies"))
