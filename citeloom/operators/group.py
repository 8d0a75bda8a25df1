"""Themes of a cell's values: centred vectors, greedy centroid clusters, medoid labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# From how many values a cell is clustered, and how similar a value and a centroid must be.
LEAST_VALUES, SIMILAR = 6, 0.15
CELL = ["entity", "question"]


def center(vectors: DataFrame, group: list[str], key: str = "value", vector: str = "vector") -> DataFrame:
    """Vectors less their group's mean; where that leaves nothing, as they were."""
    parts = vectors.select(*group, key, F.posexplode(vector).alias("pos", "x"))
    means = parts.groupBy(*group, "pos").agg(F.avg("x").alias("m")).groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))
    both = vectors.join(means, group)
    moved = F.zip_with(vector, "mean", lambda x, m: x.cast("double") - m)
    size = F.sqrt(F.aggregate(moved, F.lit(0.0), lambda t, x: t + x * x))
    return both.withColumn(vector, F.when(size < 1e-9, F.transform(vector, lambda x: x.cast("double"))).otherwise(moved)).drop("mean")


def clusters(values: list[str], vectors: dict[str, np.ndarray], least: float = SIMILAR) -> list[list[str]]:
    """Values in order join the first cluster whose running centroid is similar enough, else open one."""
    groups: list[list[str]] = []
    sums: list[np.ndarray] = []
    for v in sorted(values):
        x = vectors[v]
        for k, s in enumerate(sums):
            size = np.linalg.norm(x) * np.linalg.norm(s)
            if size and float(x @ s) / size >= least:
                groups[k].append(v)
                sums[k] = s + x
                break
        else:
            groups.append([v])
            sums.append(x.copy())
    return groups


def medoid(members: list[str], vectors: dict[str, np.ndarray]) -> str:
    """The member most similar to the others on average; of two at most, the one that sorts first."""
    if len(members) <= 2:
        return min(members)
    m = np.array([vectors[v] for v in members])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    m = m / np.where(n > 0, n, 1)
    mean = (m @ m.sum(0) - (m * m).sum(1)) / (len(members) - 1)
    return min(members, key=lambda v: (-round(float(mean[members.index(v)]), 12), v))


def themes(values: DataFrame, least_values: int = LEAST_VALUES, similar: float = SIMILAR, most: int = 100_000) -> DataFrame:
    """(entity, question, theme, n_items, values, place) from distinct values (entity, question, value, vector, ord).

    Clustering takes a cell's values in order, so a cell is one task; cells with more than most values are refused.
    """
    largest = values.groupBy(*CELL).count().agg(F.max("count")).first()[0] or 0
    if largest > most:
        raise ValueError(f"a cell of {largest} values; clustering in order holds at most {most}")
    centred = center(values, CELL)

    def run(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["ord", "value"])
        order = {v: k for k, v in enumerate(cell["value"])}
        if len(cell) < least_values:
            groups = [("(all items)", list(order))]
        else:
            vectors = {v: np.asarray(x, np.float64) for v, x in zip(cell["value"], cell["vector"], strict=True)}
            groups = [(medoid(m, vectors), sorted(m, key=order.get)) for m in clusters(list(order), vectors, similar)]
        groups.sort(key=lambda g: (-len(g[1]), g[0]))
        return pd.DataFrame([(*key, label, len(m), m, k + 1) for k, (label, m) in enumerate(groups)], columns=[*CELL, "theme", "n_items", "values", "place"])

    return centred.select(*CELL, "value", "vector", "ord").groupBy(*CELL).applyInPandas(run, "entity string, question string, theme string, n_items int, values array<string>, place int")


def theme_sources(groups: DataFrame, evidence: DataFrame) -> DataFrame:
    """Distinct sources behind each theme's values."""
    members = groups.select(*CELL, "theme", F.explode("values").alias("value"))
    per = members.join(evidence.select(*CELL, "value", "source_url").distinct(), [*CELL, "value"])
    return per.groupBy(*CELL, "theme").agg(F.count_distinct("source_url").alias("sources"))
