"""Statistics of scores and labels: rank AUC, correlations, sweeps, bins, rankings, parity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_ranks(rows: DataFrame, group: list[str], score: str, out: str = "avg_rank") -> DataFrame:
    """(*group, score, n, below, avg_rank) of each distinct score: ranks of ties are averaged.

    Rows are counted by score before any ordering, so a group's window holds its distinct scores only.
    """
    by_score = rows.groupBy(*group, score).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return by_score.withColumn("below", before).withColumn(out, F.col("below") + (F.col("n") + 1) / 2)


def auc(rows: DataFrame, group: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """(*group, positives, negatives, auc): probability that a positive outranks a negative; null with one class only."""
    by = rows.groupBy(*group, score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("p"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by = by.withColumn("rank", before + (F.col("n") + 1) / 2)
    per = by.groupBy(*group).agg(F.sum("p").alias("positives"), (F.sum("n") - F.sum("p")).alias("negatives"), F.sum(F.col("p") * F.col("rank")).alias("s"))
    p, q = F.col("positives"), F.col("negatives")
    return per.select(*group, "positives", "negatives", F.when((p > 0) & (q > 0), (F.col("s") - p * (p + 1) / 2) / F.when(p * q > 0, p * q)).alias("auc"))


def correlations(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(x, y, n, pearson, spearman) of named column pairs."""
    out = None
    for x, y in pairs:
        both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        rx = average_ranks(both, [], "x", "rx").select("x", "rx")
        ry = average_ranks(both, [], "y", "ry").select("y", "ry")
        # counted by pair first: ranks join on distinct values
        pair = both.groupBy("x", "y").agg(F.count("*").alias("n")).join(rx, "x").join(ry, "y")
        w = lambda a, b: F.sum(F.col("n") * F.col(a) * F.col(b))

        def r(a: str, b: str) -> Column:
            n = F.sum("n")
            sa, sb = F.sum(F.col("n") * F.col(a)), F.sum(F.col("n") * F.col(b))
            top = w(a, b) - sa * sb / n
            low = F.sqrt((w(a, a) - sa * sa / n) * (w(b, b) - sb * sb / n))
            return F.when(low > 0, top / F.when(low > 0, low))

        one = pair.agg(F.lit(x).alias("x_name"), F.lit(y).alias("y_name"), F.sum("n").alias("n"), r("x", "y").alias("pearson"), r("rx", "ry").alias("spearman"))
        out = one if out is None else out.union(one)
    return out


def threshold_sweep(rows: DataFrame, group: list[str], thresholds: list[float], score: str = "score", label: str = "label") -> DataFrame:
    """(*group, threshold, tp, fp, fn, precision, recall, f1) where a score at or above the threshold counts as positive."""
    counted = rows.groupBy(*group, score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("p"))
    each = counted.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    hit = F.col(score) >= F.col("threshold")
    per = each.groupBy(*group, "threshold").agg(F.sum(F.when(hit, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("n") - F.col("p")).otherwise(0)).alias("fp"), F.sum(F.when(hit, 0).otherwise(F.col("p"))).alias("fn"))
    over = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)
    p, r = over(F.col("tp"), F.col("tp") + F.col("fp")), over(F.col("tp"), F.col("tp") + F.col("fn"))
    return per.select(*group, "threshold", "tp", "fp", "fn", F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"), F.round(over(2 * p * r, p + r), 3).alias("f1"))


def best_threshold(sweep: DataFrame, group: list[str]) -> DataFrame:
    """The row with the best F1; among equals the lowest threshold."""
    names = [c for c in sweep.columns if c not in group]
    best = sweep.groupBy(*group).agg(F.max_by(F.struct(*names), F.struct("f1", (-F.col("threshold")).alias("t"))).alias("b"))
    return best.select(*group, *(F.col(f"b.{c}").alias(c) for c in names))


def operating_points(rows: DataFrame, recalls: list[float], score: str = "score", label: str = "label") -> DataFrame:
    """(recall, threshold, skipped): the highest threshold that keeps each recall, and the share of rows below it."""
    by = rows.groupBy(score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("p"))
    down = Window.orderBy(F.desc(score))
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("kept", F.sum("p").over(down)).withColumn("rows_kept", F.sum("n").over(down)).withColumn("all_p", F.sum("p").over(whole)).withColumn("all_n", F.sum("n").over(whole))
    each = by.withColumn("recall", F.explode(F.array(*map(F.lit, recalls)))).where(F.col("kept") >= F.col("recall") * F.col("all_p"))
    return each.groupBy("recall").agg(F.max(score).alias("threshold"), (1 - F.max_by("rows_kept", score) / F.max("all_n")).alias("skipped"))


def score_bins(rows: DataFrame, score: str, measures: list[str], edges: tuple[float, ...] = (0.0, 0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    """Averages per score bin; empty bins have rows, too."""
    n = len(edges)
    bins = rows.sparkSession.createDataFrame([(i, float(e)) for i, e in enumerate(edges)], "bin int, low double")
    which = F.lit(n - 1)
    for i in range(n - 2, -1, -1):
        which = F.when(F.col(score) < edges[i + 1], i).otherwise(which)
    per = rows.where(F.col(score).isNotNull()).groupBy(which.alias("bin")).agg(F.count("*").alias("n"), *(F.avg(m).alias(f"avg_{m}") for m in measures))
    return bins.join(per, "bin", "left").select("bin", "low", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), *(F.coalesce(f"avg_{m}", F.lit(0.0)).alias(f"avg_{m}") for m in measures))


def rankings(rows: DataFrame, named: dict[str, Column], key: str, most: int = 20) -> DataFrame:
    """(ranking, rank, key, measure): the top rows under several measures."""
    out = None
    for name, measure in named.items():
        top = rows.select(F.lit(name).alias("ranking"), F.col(key).alias("key"), measure.alias("measure")).where("measure is not null")
        top = top.orderBy(F.desc("measure"), "key").limit(most)
        top = top.withColumn("rank", F.row_number().over(Window.partitionBy("ranking").orderBy(F.desc("measure"), "key")))
        out = top if out is None else out.union(top)
    return out.select("ranking", "rank", "key", "measure")


def misjudged(rows: DataFrame, score: str, gain: str, high: float = 0.6, low: float = 0.4) -> DataFrame:
    """Rows with a high score and a gain of at most the mean, or a low score and a gain above it."""
    mean = rows.agg(F.avg(gain).alias("mean_gain"))
    both = rows.join(F.broadcast(mean))  # one row
    kind = F.when((F.col(score) >= high) & (F.col(gain) <= F.col("mean_gain")), "false_positive").when((F.col(score) <= low) & (F.col(gain) > F.col("mean_gain")), "false_negative")
    return both.withColumn("kind", kind).where("kind is not null").drop("mean_gain")


def parity(base: DataFrame, candidate: DataFrame, key: list[str]) -> DataFrame:
    """Per question: filled cells in both runs, kept, lost and gained. Frames: (*key, value); key holds question."""
    filled = lambda df: df.select(*key, (~F.lower(F.trim(F.coalesce("value", F.lit("")))).isin("", "no data found", "nan", "none")).alias("f"))
    both = filled(base).withColumnRenamed("f", "x").join(filled(candidate).withColumnRenamed("f", "y"), key, "full_outer").fillna(False, ["x", "y"])
    per = both.groupBy("question").agg(F.count_if("x").alias("base"), F.count_if("y").alias("candidate"), F.count_if(F.col("x") & F.col("y")).alias("kept"), F.count_if(F.col("x") & ~F.col("y")).alias("lost"), F.count_if(~F.col("x") & F.col("y")).alias("gained"))
    return per.withColumn("retention", F.when(F.col("base") > 0, F.round(F.col("kept") / F.when(F.col("base") > 0, F.col("base")), 4)).otherwise(1.0))


def confusion(rows: DataFrame, said: Column, label: Column, by: list[str]) -> DataFrame:
    """Agreement and the four counts of two yes/no columns, by group and overall (a null group)."""
    rows = rows.select(*by, said.alias("said"), label.alias("label"))
    count = lambda a, b: F.count_if((F.col("said") == a) & (F.col("label") == b))
    return rows.groupingSets([by, []], *by).agg(count(True, True).alias("tp"), count(True, False).alias("fp"), count(False, True).alias("fn"), count(False, False).alias("tn"), F.round(F.avg((F.col("said") == F.col("label")).cast("int")), 4).alias("agreement"))


def auc_difference(rows: DataFrame, group: list[str], a: str, b: str, label: str = "label", resamples: int = 2000, seed: int = 42, max_rows: int = 1_000_000) -> DataFrame:
    """(*group, delta, low, high, winner): AUC of b minus that of a with a 95 % interval of paired resamples.

    A group's labelled scores are resampled together in one task, so groups beyond max_rows are refused.
    """
    largest = rows.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    if largest > max_rows:
        raise ValueError(f"a group of {largest} rows; resampling holds at most {max_rows}")

    def one(y: np.ndarray, s: np.ndarray) -> float:
        ranks = pd.Series(s).rank().to_numpy()
        p = y.sum()
        q = len(y) - p
        return (ranks[y].sum() - p * (p + 1) / 2) / (p * q) if p and q else np.nan

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([a, b, label])
        y, x, z = frame[label].to_numpy(bool), frame[a].to_numpy(float), frame[b].to_numpy(float)
        rng = np.random.default_rng(seed)
        deltas = []
        for _ in range(resamples):
            k = rng.integers(0, len(y), len(y))
            deltas.append(one(y[k], z[k]) - one(y[k], x[k]))
        low, high = np.nanpercentile(deltas, [2.5, 97.5]) if np.isfinite(deltas).any() else (np.nan, np.nan)
        winner = "b" if low > 0 else "a" if high < 0 else "none"
        return pd.DataFrame([[*key, one(y, z) - one(y, x), low, high, winner]], columns=[*group, "delta", "low", "high", "winner"])

    schema = ", ".join([*(f"{g} {rows.schema[g].dataType.simpleString()}" for g in group), "delta double, low double, high double, winner string"])
    return rows.select(*group, a, b, label).groupBy(*group).applyInPandas(run, schema)
