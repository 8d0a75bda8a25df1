"""Fetching pages: cache first, robots and politeness per site, static before rendered, errors as rows.

Backends are functions url -> (text, html); they run on executors, one site in one task at a time.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from urllib.robotparser import RobotFileParser
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url
from ..sources import tables

Backend = Callable[[str], tuple[str, str | None]]
# Seconds between requests to one site, characters of a usable page, and limits of the rescue.
DELAY, LEAST, MOST_RESCUED, FEW_LINKS = 2.0, 200, 12_000, 3
RESULT = "url string, text string, html string, backend string, rendered boolean, passed boolean, reason string, status string, fetch_ms int"


def robots_allow(robots: str | None, page: str, agent: str = "*") -> bool:
    """Whether a robots.txt lets a page be fetched; an unreadable one allows."""
    if robots is None:
        return True
    p = RobotFileParser()
    p.parse(robots.splitlines())
    return p.can_fetch(agent, page)


def hybrid(page: str, static: Backend, render: Backend, gate: Callable[[str, str | None], tuple[bool, str]], allowed: bool = True) -> dict:
    """Static text if it passes the gate, else the rendered one if it passes or is no shorter, else what there is."""
    if not allowed:
        return {"text": "", "html": None, "backend": "robots", "rendered": False, "passed": False, "reason": "robots"}
    error = None
    try:
        text, body = static(page)
    except Exception as e:
        text, body, error = "", None, e
    ok, reason = gate(text, body)
    if ok:
        return {"text": text, "html": body, "backend": "static", "rendered": False, "passed": True, "reason": ""}
    try:
        again, shown = render(page)
    except Exception:
        if not text:
            raise error or RuntimeError("nothing fetched") from None
        again, shown = "", None
    ok2, reason2 = gate(again, shown)
    if again and (ok2 or not text or len(again) >= len(text)):
        rescued = not ok2 and LEAST <= len(again.strip()) <= MOST_RESCUED
        return {"text": again, "html": shown, "backend": "render", "rendered": True, "passed": ok2 or rescued, "reason": f"rescued: {reason2}" if rescued else reason2}
    rescued = LEAST <= len(text.strip()) <= MOST_RESCUED
    return {"text": text, "html": body, "backend": "static", "rendered": False, "passed": rescued, "reason": f"rescued: {reason}" if rescued else reason}


def fetch(pages: DataFrame, backend: Callable[[str], dict], robots: DataFrame | None = None, delay: float = DELAY) -> DataFrame:
    """One row a page (url). A site's pages are fetched in one task, one after another, delay seconds apart.

    robots: (domain, robots); pages that it forbids are not fetched. A backend that fails makes a row with its error.
    """
    rows = pages.select("url").distinct().withColumn("domain", url.domain(F.col("url")))
    rows = rows.join(robots, "domain", "left") if robots is not None else rows.withColumn("robots", F.lit(None).cast("string"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for f in frames:
            out = []
            for u, site, rules in zip(f["url"], f["domain"], f["robots"], strict=True):
                base = {"url": u, "text": "", "html": None, "backend": None, "rendered": False, "passed": None, "reason": "", "status": "ok", "fetch_ms": 0}
                if not robots_allow(rules, u):
                    out.append(base | {"status": "gate_failed", "passed": False, "reason": "robots"})
                    continue
                time.sleep(max(0.0, last.get(site, 0.0) + delay - time.monotonic()))
                began = last[site] = time.monotonic()
                try:
                    got = backend(u)
                    out.append(base | got | {"status": "ok" if got.get("passed") is not False else "gate_failed"})
                except Exception as e:
                    out.append(base | {"status": "error", "reason": f"{type(e).__name__}: {e}"[:300]})
                out[-1]["fetch_ms"] = int(1000 * (time.monotonic() - began))
            yield pd.DataFrame(out, columns=["url", "text", "html", "backend", "rendered", "passed", "reason", "status", "fetch_ms"])

    return rows.repartition("domain").sortWithinPartitions("domain", "url").mapInPandas(run, RESULT)


def acquire(pages: DataFrame, cache: DataFrame, backend: Callable[[str], dict], **options) -> DataFrame:
    """Pages from the cache where it has them, else fetched."""
    hits, misses = tables.from_cache(pages.select("url").distinct(), cache)
    cached = hits.select("url", "text", F.lit(None).cast("string").alias("html"), F.lit("cache").alias("backend"), F.lit(False).alias("rendered"), F.lit(None).cast("boolean").alias("passed"), F.lit("").alias("reason"), F.lit("cached").alias("status"), F.lit(0).alias("fetch_ms"))
    return cached.union(fetch(misses, backend, **options))


def from_table(pages: dict[str, tuple[str, str | None]]) -> Backend:
    """A backend that knows some pages; for replays and tests."""

    def get(page: str) -> tuple[str, str | None]:
        if page not in pages:
            raise LookupError(f"no page {page}")
        return pages[page]

    return get


def needs_render(depth: Column, backend: Column, n_links: Column) -> Column:
    """A seed whose static or cached page shows hardly any new link is worth rendering for discovery."""
    return (depth == 0) & backend.isin("static", "cache") & (n_links < FEW_LINKS)


def thin(text: Column, least: int = LEAST) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < least


def run_summary(log: DataFrame) -> DataFrame:
    """(entity, pages, usable, failed, cached, dead): a seed's pages by outcome; dead if none is usable."""
    ok = F.col("status").isin("ok", "cached")
    return log.groupBy("entity").agg(F.count("*").alias("pages"), F.count_if(ok).alias("usable"), F.count_if(~ok).alias("failed"), F.count_if(F.col("status") == "cached").alias("cached"), (F.count_if(ok) == 0).alias("dead"))


def backend_advice(results: DataFrame, least: int = 500, times: float = 1.5, gain: int = 300) -> DataFrame:
    """(url, static, rendered, category) from extraction results (url, kind static or rendered, ok, chars)."""
    best = lambda kind: F.max(F.when((F.col("kind") == kind) & F.col("ok"), F.col("chars")))
    per = results.groupBy("url").agg(best("static").alias("static"), best("rendered").alias("rendered"))
    s, r = F.coalesce("static", F.lit(0)), F.coalesce("rendered", F.lit(0))
    category = (
        F.when(F.col("static").isNull() & F.col("rendered").isNull(), "FETCH_FAILED")
        .when(F.greatest(s, r) < least, "LOW_TEXT_YIELD")
        .when((r >= least) & ((s == 0) | ((r >= s * times) & (r - s >= gain))), "NEEDS_RENDER")
        .otherwise("STATIC_OK")
    )
    return per.withColumn("category", category)


def same_host_name(a: str, b: str) -> bool:
    return urlsplit(a).netloc.replace("www.", "") == urlsplit(b).netloc.replace("www.", "")
