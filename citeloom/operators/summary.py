"""Summaries of cells with citations: routes, deterministic answers, the citation gate, judging and planted errors.

Claims of a cell: (entity, question, claim_id, value, ord); themes: (entity, question, theme, n_items, claim_ids, place).
"""

from __future__ import annotations

import json
import random
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

# Claims shown for a theme, answers on a line, lines of a cell, and the length of a short answer.
CLAIMS_PER_THEME, PER_LINE, LINES, SHORT = 15, 8, 3, 80
MORE = " (more in Provenance)"
VERDICTS = ("faithful", "unsupported", "contradicted")
CELL = ["entity", "question"]
# Abbreviations that do not end a sentence.
_ABBREVIATION = re.compile(r"(?:\b(?:Inc|Ltd|Corp|Co|LLC|GmbH|No|Dr|Mr|Ms|Mrs|St|Jr|Sr|vs|approx|est)|\be\.g|\bi\.e|\bU\.S|\bU\.K)\.$", re.I)
_CITED = re.compile(r"\[[^\[\]]*?C\d{4,}[^\[\]]*?\]")


def yes_no(value: Column) -> Column:
    bare = F.lower(F.trim(F.regexp_replace(value, r"[\s.,;:!]+$", "")))
    return F.when(bare.isin("yes", "y", "true"), "Yes").when(bare.isin("no", "n", "false"), "No")


def answers(claims: DataFrame) -> DataFrame:
    """(entity, question, n, n_other, longest, line): the verdict first, then up to eight values word for word, all cited.

    line is null where a value is too long to stand for itself.
    """
    w = Window.partitionBy(*CELL).orderBy("ord")
    rows = claims.withColumn("side", yes_no(F.col("value")))
    others = rows.where("side is null").withColumn("k", F.row_number().over(w)).where(F.col("k") <= PER_LINE)
    shown = others.groupBy(*CELL).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "value", "claim_id"))), lambda x: F.concat(x["value"], F.lit(" ["), x["claim_id"], F.lit("]"))), "; ").alias("shown"))
    ids = lambda side: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("ord", "claim_id")))), lambda x: x["claim_id"]), ", ")
    per = rows.groupBy(*CELL).agg(F.count("*").alias("n"), F.count_if(F.col("side").isNull()).alias("n_other"), F.max(F.length("value")).alias("longest"), ids("Yes").alias("yes"), ids("No").alias("no"))
    per = per.join(shown, CELL, "left")
    said = (
        F.when((F.col("yes") != "") & (F.col("no") != ""), F.concat(F.lit("Conflicting: Yes ["), "yes", F.lit("] / No ["), "no", F.lit("]")))
        .when(F.col("yes") != "", F.concat(F.lit("Yes ["), "yes", F.lit("]")))
        .when(F.col("no") != "", F.concat(F.lit("No ["), "no", F.lit("]")))
    )
    line = F.concat(F.concat_ws("; ", said, "shown"), F.when(F.col("n_other") > PER_LINE, MORE).otherwise(""))
    return per.select(*CELL, "n", "n_other", "longest", F.when(F.col("longest") <= SHORT, line).alias("line"))


def routes(lines: DataFrame) -> DataFrame:
    """deterministic for short cells with one value at most besides yes and no, merge for other short cells, else prose."""
    short = F.col("longest") <= SHORT
    return lines.withColumn("route", F.when(short & (F.col("n_other") <= 1), "deterministic").when(short, "merge").otherwise("prose"))


def theme_fallback(themes: DataFrame, most: int = LINES) -> DataFrame:
    """A cell's largest themes by their labels, with their claims; a mark if there are more."""
    w = Window.partitionBy(*CELL).orderBy("place")
    rows = themes.where(F.size("claim_ids") > 0).withColumn("k", F.row_number().over(w))
    line = F.concat("theme", F.lit(" ["), F.array_join("claim_ids", ", "), F.lit("]"))
    per = rows.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.when(F.col("k") <= most, F.struct("k", line.alias("l"))))).alias("l"), F.max("k").alias("n"))
    return per.select(*CELL, F.concat(F.array_join(F.transform("l", lambda x: x["l"]), "\n"), F.when(F.col("n") > most, MORE).otherwise("")).alias("fallback"))


def split_units(body: str) -> list[str]:
    """Lines without bullets, else sentences; a sentence does not end after an abbreviation."""
    body = body or ""
    if "\n" in body.strip():
        return [re.sub(r"^[•\-*]\s+", "", x.strip()) for x in body.splitlines() if x.strip()]
    out: list[str] = []
    for part in (p.strip() for p in re.split(r"(?<=[.!?])\s+", body) if p.strip()):
        if out and _ABBREVIATION.search(out[-1]):
            out[-1] += " " + part
        else:
            out.append(part)
    return out


def units(summaries: DataFrame, key: list[str], column: str = "summary") -> DataFrame:
    """(*key, unit, body, cited) of each sentence or line."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(*k, i + 1, u) for *k, s in f[[*key, column]].itertuples(index=False) for i, u in enumerate(split_units(s))]
            yield pd.DataFrame(rows, columns=[*key, "unit", "body"])

    schema = ", ".join([*(f"{k} {summaries.schema[k].dataType.simpleString()}" for k in key), "unit int, body string"])
    out = summaries.select(*key, column).mapInPandas(run, schema)
    return out.withColumn("cited", text.has_citation(F.col("body")) | F.col("body").rlike(r"(?i)^\(?\s*more in provenance\s*\)?\s*[.!]?$"))


def gate(summaries: DataFrame, shown: DataFrame, themes: DataFrame, tops: int = 3) -> DataFrame:
    """(entity, question, passed, invented, uncited, missed): no id that was not shown, every unit cited, each top theme cited.

    shown: (entity, question, ids array<string>).
    """
    u = units(summaries, CELL).groupBy(*CELL).agg(F.count("*").alias("n_units"), F.count_if(~F.col("cited")).alias("uncited"))
    rows = summaries.join(shown, CELL, "left").join(u, CELL, "left").withColumn("cites", F.array_distinct(text.cited_ids(F.col("summary"))))
    rows = rows.withColumn("invented", F.array_sort(F.array_except("cites", F.coalesce("ids", F.array().cast("array<string>")))))
    top = themes.where((F.col("place") <= tops) & (F.size("claim_ids") > 0)).join(rows.select(*CELL, "cites"), CELL)
    missed = top.where(~F.arrays_overlap("claim_ids", "cites")).groupBy(*CELL).agg(F.array_sort(F.collect_list("theme")).alias("missed"))
    rows = rows.join(missed, CELL, "left").withColumns({"missed": F.coalesce("missed", F.array().cast("array<string>")), "uncited": F.coalesce("uncited", F.lit(0)), "n_units": F.coalesce("n_units", F.lit(0))})
    passed = (F.size("invented") == 0) & (F.col("uncited") == 0) & (F.size("missed") == 0) & (F.col("n_units") > 0)
    return rows.select(*CELL, passed.alias("passed"), "invented", "uncited", "missed")


def summarise(claims: DataFrame, themes: DataFrame, model: Callable[[str], str] | None = None) -> DataFrame:
    """(entity, question, route, summary, error): deterministic where that is enough, else the model, else the fallback."""
    lines = routes(answers(claims)).join(theme_fallback(themes), CELL, "left")
    shown = claims.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("ord", "claim_id", "value"))).alias("claims"))
    easy = lines.where("route = 'deterministic'").select(*CELL, "route", F.col("line").alias("summary"), F.lit(None).cast("string").alias("error"))
    hard = lines.where("route <> 'deterministic'").join(shown, CELL).select(*CELL, "route", F.coalesce("line", "fallback").alias("instead"), F.transform("claims", lambda c: F.concat(F.lit("["), c["claim_id"], F.lit("] "), c["value"])).alias("values"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for e, q, r, instead, values in f.itertuples(index=False):
                try:
                    rows.append((e, q, r, model(prompt(e, q, r, list(values))), None) if model else (e, q, r, instead, None))
                except Exception as x:  # the row says so
                    rows.append((e, q, r, instead, f"{type(x).__name__}: {x}"[:500]))
            yield pd.DataFrame(rows, columns=[*CELL, "route", "summary", "error"])

    return easy.union(hard.mapInPandas(run, "entity string, question string, route string, summary string, error string"))


def prompt(entity: str, question: str, route: str, values: list[str]) -> str:
    """What a model is asked: one line of distinct answers, or a short text; every part cites its claims."""
    task = f"Join the distinct answers in one line with '; ', at most {PER_LINE}, each with the ids of all claims that say the same." if route == "merge" else f"Write at most {LINES} sentences. Each ends with the ids of its claims."
    return f"{entity} — {question}\n{task}\nUse only these claims and only their ids in square brackets:\n" + "\n".join(values)


def parse_verdicts(raw: str, n: int) -> dict[int, str] | None:
    """A judge's verdict on each of n units; anything less is none."""
    try:
        data = {int(k): v.strip().lower() for k, v in json.loads(re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", raw or "")).items()}
    except (ValueError, AttributeError, TypeError):
        return None
    return data if set(data) == set(range(1, n + 1)) and set(data.values()) <= set(VERDICTS) else None


def judge(summaries: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """(entity, question, unit, verdict); a failed judge gives a row with unit 0."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for e, q, s in f[[*CELL, "summary"]].itertuples(index=False):
                parts = split_units(s)
                try:
                    got = parse_verdicts(model("\n".join(f"{k + 1}. {p}" for k, p in enumerate(parts))), len(parts))
                except Exception:
                    got = None
                rows += [(e, q, k, v) for k, v in got.items()] if got else [(e, q, 0, "judge_failed")]
            yield pd.DataFrame(rows, columns=[*CELL, "unit", "verdict"])

    return summaries.mapInPandas(run, "entity string, question string, unit int, verdict string")


# Errors planted in summaries, to measure judges: each gives the new text and the units that are wrong, or None.


def _join(parts: list[str], like: str) -> str:
    return ("\n" if "\n" in like.strip() else " ").join(parts)


def swap_number(summary: str, others: list[str], rng: random.Random) -> tuple[str, set[int]] | None:
    parts = split_units(summary)
    at = [(k, m) for k, p in enumerate(parts) for m in re.finditer(r"\b\d[\d,.]*\b", _CITED.sub(lambda c: " " * len(c[0]), p))]
    if not at:
        return None
    k, m = at[0]
    digits = re.sub(r"\D", "", m[0])
    parts[k] = parts[k][: m.start()] + str(int(digits) + 1 + rng.randrange(9)) + parts[k][m.end() :]
    return _join(parts, summary), {k + 1}


def swap_entity(summary: str, others: list[str], rng: random.Random) -> tuple[str, set[int]] | None:
    parts = split_units(summary)
    for k, p in enumerate(parts):
        for e in others[1:]:
            if others[0] in p and e != others[0]:
                parts[k] = p.replace(others[0], e)
                return _join(parts, summary), {k + 1}
    return None


def inject_fact(summary: str, others: list[str], rng: random.Random) -> tuple[str, set[int]] | None:
    parts = split_units(summary)
    cites = _CITED.findall(summary)
    if not parts or not cites:
        return None
    new = f"It also opened {rng.randrange(3, 40)} sites last year {cites[0]}."
    return _join([*parts, new], summary), {len(parts) + 1}


def reattach_citation(summary: str, others: list[str], rng: random.Random) -> tuple[str, set[int]] | None:
    parts = split_units(summary)
    found = [(k, m[0]) for k, p in enumerate(parts) if (m := _CITED.search(p))]
    for (a, x), (b, y) in zip(found, found[1:], strict=False):
        if x != y:
            parts[a], parts[b] = parts[a].replace(x, y, 1), parts[b].replace(y, x, 1)
            return _join(parts, summary), {a + 1, b + 1}
    return None


def delete_first(summary: str, others: list[str], rng: random.Random) -> tuple[str, set[int]] | None:
    parts = split_units(summary)
    return (_join(parts[1:], summary), set()) if len(parts) > 1 else None


CORRUPTIONS = {"swap_number": swap_number, "swap_entity": swap_entity, "inject_fact": inject_fact, "reattach_citation": reattach_citation, "delete_first": delete_first}


def plant(summaries: DataFrame, seed: int = 13) -> DataFrame:
    """(entity, question, kind, summary, wrong array<int>): every summary with each error that it can hold."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for e, q, s in f[[*CELL, "summary"]].itertuples(index=False):
                for kind, make in CORRUPTIONS.items():
                    got = make(s or "", [e, "Another Company"], random.Random(f"{seed}{e}{q}{kind}"))
                    if got:
                        rows.append((e, q, kind, got[0], sorted(got[1])))
            yield pd.DataFrame(rows, columns=[*CELL, "kind", "summary", "wrong"])

    return summaries.mapInPandas(run, "entity string, question string, kind string, summary string, wrong array<int>")


def detection(planted: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(kind, total, hits): an error counts as found if any of its units was judged unfaithful; a failed judge misses."""
    bad = verdicts.where("verdict in ('unsupported', 'contradicted')").groupBy(*CELL, "kind").agg(F.collect_set("unit").alias("bad"))
    rows = planted.join(bad, [*CELL, "kind"], "left")
    return rows.groupBy("kind").agg(F.count("*").alias("total"), F.count_if(F.coalesce(F.arrays_overlap("wrong", "bad"), F.lit(False))).alias("hits"))
