"""Links of pages: discovery, scope, relevance and the crawl frontier."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, url

# The parameters of the relevance formula and the weights of question and instruction words.
K1, B = 1.5, 0.75
QUESTION_WEIGHT, INSTRUCTION_WEIGHT = 3.0, 1.0
LINKS_PER_PAGE, FALLBACK_LINKS = 30, 2

_ANCHOR = re.compile(r"<a\b([^>]*)>(.*?)</a\s*>", re.I | re.S)
_HREF = re.compile(r"""href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_MARKDOWN = re.compile(r"\[([^\]]*)\]\((\S+?)\)")


def _links(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = set()
                found = _MARKDOWN.finditer(body or "") if kind == "markdown" else _ANCHOR.finditer(body or "")
                for m in found:
                    if kind == "markdown":
                        anchor, href = m[1], m[2]
                        context = (body[max(0, m.start() - 120) : m.end() + 120]).strip()
                    else:
                        h = _HREF.search(m[1])
                        href = html.unescape(h[1] or h[2] or h[3] or "") if h else ""
                        anchor = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", m[2])).split())
                        context = anchor[:240]
                    if not href or href.startswith(("#", "mailto:", "tel:", "javascript:")):
                        continue
                    try:
                        target = urljoin(page, href.strip())
                        ok = urlsplit(target).scheme in ("http", "https")
                    except ValueError:
                        ok = False
                    if ok and target not in seen:
                        seen.add(target)
                        rows.append((page, target, anchor, context, len(seen)))
            cols = list(zip(*rows, strict=True)) or [(), (), (), (), ()]
            yield pa.record_batch({"page": pa.array(cols[0], pa.string()), "target": pa.array(cols[1], pa.string()), "anchor": pa.array(cols[2], pa.string()), "context": pa.array(cols[3], pa.string()), "ord": pa.array(cols[4], pa.int64())})

    return run


def discover(pages: DataFrame, kind: str = "html", same_site: bool = True, drop_blocked: bool = False) -> DataFrame:
    """(page, target, anchor, context, ord): a page's links in scope, each normalised target once, no assets."""
    found = pages.select("url", "body").mapInArrow(_links(kind), "page string, target string, anchor string, context string, ord bigint")
    found = found.withColumn("target", url.normalise(F.col("target"))).where(~url.asset_link(F.col("target")))
    scope = url.same_site if same_site else url.same_host
    found = found.where(scope(F.col("page"), F.col("target")))
    found = found.where(~url.blocked_page(F.col("target"))) if drop_blocked else found
    first = found.groupBy("page", "target").agg(F.min_by(F.struct("anchor", "context", "ord"), "ord").alias("f"))
    return first.select("page", "target", "f.anchor", "f.context", "f.ord")


def crawl_query(questions: DataFrame) -> DataFrame:
    """(term, weight): words of question names weigh more than those of instructions; the highest weight counts."""
    name = questions.select(F.explode(text.ascii_tokens(F.col("question"))).alias("term"), F.lit(QUESTION_WEIGHT).alias("weight"))
    instruction = questions.select(F.explode(text.ascii_tokens(F.coalesce("instruction", F.lit("")))).alias("term"), F.lit(INSTRUCTION_WEIGHT).alias("weight"))
    return name.union(instruction).groupBy("term").agg(F.max("weight").alias("weight"))


def relevance(docs: DataFrame, query: DataFrame, group: list[str], max_terms: int = 10_000) -> DataFrame:
    """(*group, id, raw, score): term weights times inverse frequency and saturated counts; score is raw over the group's best.

    docs: (*group, id, body). Only words of the query are counted for terms; lengths and frequencies are per group.
    """
    tokens = docs.select(*group, "id", text.ascii_tokens(F.col("body")).alias("tokens"))
    sizes = tokens.select(*group, "id", F.size("tokens").alias("len"))
    stats = sizes.groupBy(*group).agg(F.count("*").alias("n"), F.avg("len").alias("mean_len"))
    terms = tokens.select(*group, "id", F.explode("tokens").alias("term"))
    small = query.limit(max_terms + 1).count() <= max_terms
    tf = terms.join(F.broadcast(query) if small else query, "term").groupBy(*group, "id", "term", "weight").agg(F.count("*").alias("tf"))
    df = tf.groupBy(*group, "term").agg(F.count("*").alias("df"))
    scored = tf.join(df, [*group, "term"]).join(stats, group).join(sizes, [*group, "id"])
    idf = F.greatest(F.lit(0.0), F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = F.col("weight") * idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean_len")))
    raw = sizes.join(scored.groupBy(*group, "id").agg(F.sum(part).alias("raw")), [*group, "id"], "left").select(*group, "id", F.coalesce("raw", F.lit(0.0)).alias("raw"))
    best = raw.groupBy(*group).agg(F.max("raw").alias("best"))
    return raw.join(best, group).select(*group, "id", "raw", F.when(F.col("best") > 0, F.col("raw") / F.when(F.col("best") > 0, F.col("best"))).otherwise(0.0).alias("score"))


def follow(scored: DataFrame, least: float, depth: int, most: int = LINKS_PER_PAGE) -> DataFrame:
    """A page's links to follow: those that score enough, up to most; near the start the best two if none does."""
    w = Window.partitionBy("page").orderBy(F.desc("score"), "ord")
    out = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    some = out.where(F.col("score") >= least)
    if depth > 1:
        return some
    pages = some.select("page").distinct()
    return some.union(out.where(F.col("rank") <= FALLBACK_LINKS).join(pages, "page", "left_anti").select(*some.columns))


def page_type_factor(score, informative, transactional, alpha: float = 0.4):
    """A link's score raised where its page reads as informative rather than transactional."""
    return score * (1 + F.lit(alpha) * (informative - transactional))


def crawl(edges: DataFrame, seeds: DataFrame, max_depth: int, budget: int, best_first: bool = False) -> DataFrame:
    """(seed, url, depth): pages reached from each seed within max_depth and a page budget per seed.

    One wave a depth over the whole edge table; a wave keeps a page's least depth and drops what the seed has seen.
    Within a wave, pages come in order of score (best_first) or of arrival, and the budget cuts the last wave. Where the
    edges have fewer targets than the budget, it can cut nothing: then no order is kept.
    """
    from .graph import checkpointed

    if edges.select("target").distinct().count() + 1 <= budget:
        return _reached(edges, seeds, max_depth)
    seen = checkpointed(seeds.select(F.col("url").alias("seed"), "url", F.lit(0).alias("depth"), F.lit(1.0).alias("score"), F.lit(0).cast("bigint").alias("place")))
    wave = seen
    for depth in range(1, max_depth + 1):
        out = wave.select("seed", F.col("url").alias("page"), F.col("place").alias("from_place")).join(edges, "page")
        out = out.groupBy("seed", F.col("target").alias("url")).agg(F.max("score").alias("score"), F.min(F.struct("from_place", "ord")).alias("first"))
        out = out.join(seen.select("seed", "url"), ["seed", "url"], "left_anti")
        used = seen.groupBy("seed").agg(F.count("*").alias("used"))
        order = [F.desc("score"), "first", "url"] if best_first else ["first", "url"]
        out = out.join(used, "seed").withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy(*order)))
        wave = checkpointed(out.where(F.col("used") + F.col("rank") <= budget).select("seed", "url", F.lit(depth).alias("depth"), "score", F.col("rank").cast("bigint").alias("place")))
        seen = seen.union(wave)
        if wave.isEmpty():
            break
    return seen.select("seed", "url", "depth")


def _reached(edges: DataFrame, seeds: DataFrame, max_depth: int, longest: int = 10_000, least_parts: int = 256) -> DataFrame:
    """crawl() without a budget. A page's targets travel as arrays to the tasks of their seeds, and the last wave is kept nowhere.

    Targets, and with them what a seed has seen, are dealt over parts by their hash if an array would hold more than
    longest, or if there are fewer seeds than tasks.
    """
    from .graph import checkpointed

    seen = checkpointed(seeds.select(F.col("url").alias("seed"), "url", F.lit(0).alias("depth")).distinct())
    most = edges.groupBy("page").count().agg(F.max("count")).first()[0] or 0
    parts = max(-(-most // longest), -(-least_parts // max(1, seen.count())))
    part = F.pmod(F.xxhash64("url"), F.lit(parts)) if parts > 1 else F.lit(0)
    links = edges.where("page is not null").select("page", F.col("target").alias("url")).withColumn("part", part)
    # collect_set passes over a null target
    none = F.array(F.lit(None).cast(links.schema["url"].dataType))
    links = links.groupBy("page", "part").agg(F.concat(F.collect_set("url"), F.when(F.count_if(F.col("url").isNull()) > 0, none).otherwise(F.slice(none, 1, 0))).alias("urls"))
    links = checkpointed(links) if max_depth > 1 else links
    for depth in range(1, max_depth + 1):
        steps = seen.where(F.col("depth") == depth - 1).select("seed", F.col("url").alias("page")).join(links, "page").select("seed", "part", F.lit(depth).alias("depth"), "urls")
        rows = steps.union(seen.withColumn("part", part).select("seed", "part", "depth", F.array("url"))).repartition("seed", "part")
        found = rows.select("seed", "part", "depth", F.explode("urls").alias("url")).groupBy("seed", "part", "url").agg(F.min("depth").alias("depth")).select("seed", "url", "depth")
        if depth == max_depth:
            return found
        seen = checkpointed(found)
        if seen.where(F.col("depth") == depth).isEmpty():
            break
    return seen


def locale_variants(pages: DataFrame) -> DataFrame:
    """Pages of one locale key, with the first of them; the others are copies in another language."""
    keyed = pages.withColumn("key", url.locale_key(F.col("url")))
    return keyed.groupBy("key").agg(F.min_by("url", "ord").alias("first"), F.count("*").alias("variants"))


def quality_gate(pages: DataFrame, least_chars: int = 200, most_links: float = 0.60, least_share: float = 0.10) -> DataFrame:
    """(url, content_chars, body_chars, link_chars, passed, reason): the first rule that a page breaks is its reason."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for u, content, body in zip(f["url"], f["content"], f["body"], strict=True):
                bare = re.sub(r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " ", body or "")
                inner = re.search(r"(?is)<body\b[^>]*>(.*)", bare)
                bare = inner[1] if inner else bare
                plain = html.unescape(re.sub(r"(?s)<!--.*?-->|<[^>]*>", "", bare))
                linked = sum(len(html.unescape(re.sub(r"<[^>]*>", "", m[2]))) for m in _ANCHOR.finditer(bare))
                rows.append((u, len((content or "").strip()), max(1, len(plain.replace(" ", ""))), linked))
            yield pd.DataFrame(rows, columns=["url", "content_chars", "body_chars", "link_chars"])

    sizes = pages.select("url", "content", "body").mapInPandas(run, "url string, content_chars int, body_chars int, link_chars int")
    density, share = F.col("link_chars") / F.col("body_chars"), F.col("content_chars") / F.col("body_chars")
    reason = F.when(F.col("content_chars") < least_chars, "content_chars").when(density > most_links, "link_density").when(share < least_share, "content_ratio").otherwise("")
    return sizes.withColumn("reason", reason).withColumn("passed", F.col("reason") == "")


def rescue(gated: DataFrame, full_chars, least: int = 200, most: int = 12_000) -> DataFrame:
    """Failed pages whose whole text is of a moderate length pass with it."""
    ok = ~F.col("passed") & full_chars.between(least, most)
    return gated.withColumn("rescued", ok).withColumn("passed", F.col("passed") | ok)


# Weights of the extended scorer, and words of navigation.
TITLE, QUESTION, INSTRUCTION, PENALTY = 0.25, 1.0, 0.45, 0.35


def embedding_scores(links: DataFrame, questions: DataFrame, informative: list[float], transactional: list[float], alpha: float = 0.4) -> DataFrame:
    """(page, target, score): a link's best cosine with a question, raised where it reads as informative.

    links: (page, target, vector); questions: (question, vector), a request's own few.
    """
    from ..functions import vector

    q = questions.select(F.col("vector").alias("q"))
    best = links.join(F.broadcast(q)).groupBy("page", "target").agg(F.max(vector.cosine(F.col("vector"), F.col("q"))).alias("topic"), F.first("vector").alias("vector"))
    ref = lambda v: F.array(*(F.lit(float(x)) for x in v))
    factor = page_type_factor(F.col("topic"), vector.cosine(F.col("vector"), ref(informative)), vector.cosine(F.col("vector"), ref(transactional)), alpha)
    return best.select("page", "target", factor.alias("score"))


def structural_penalty(anchor, context, target, navigation: list[str]):
    """What speaks against a link by its form: no or few words, images, navigation words, deep or numbered paths; at most 1."""
    anchors, words = text.ascii_tokens(F.coalesce(anchor, F.lit(""))), text.ascii_tokens(F.coalesce(context, F.lit("")))
    whole = F.lower(F.concat_ws(" ", anchor, context, url.path(target)))
    parts = F.filter(F.split(F.lower(url.path(target)), "/"), lambda s: s != "")
    names = F.array(*map(F.lit, navigation)) if navigation else F.array().cast("array<string>")
    rules = [
        F.when(F.size(anchors) == 0, 0.25).when((F.size(anchors) <= 2) & (F.size(words) <= 6), 0.15).otherwise(0.0),
        F.when(whole.contains("![") | whole.contains("base64-image-removed"), 0.30).otherwise(0.0),
        F.when(F.arrays_overlap(F.split(whole, r"[^a-z0-9]+"), names), 0.25).otherwise(0.0),
        F.when(F.size(parts) >= 4, 0.10).otherwise(0.0),
        F.when(F.arrays_overlap(parts, names), 0.20).otherwise(0.0),
        F.when(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")).rlike("^[0-9]$"), 0.05).otherwise(0.0),
    ]
    total = rules[0]
    for r in rules[1:]:
        total = total + F.coalesce(r, F.lit(0.0))
    return F.least(F.lit(1.0), total)


def blended_score(question, instruction, title, penalty, has_instructions: bool = True, floor: float = 0.0):
    """Cosines with questions, instructions and the title, weighted, less a share of the penalty."""
    w = INSTRUCTION if has_instructions else 0.0
    raw = (QUESTION * question + w * instruction + TITLE * title) / (QUESTION + w + TITLE)
    return F.greatest(F.lit(floor), raw * (1 - PENALTY * penalty))


def clean_for_scoring(body, boilerplate: list[str]):
    """Text without markdown images, link targets, punctuation and boilerplate words."""
    t = F.regexp_replace(F.regexp_replace(F.lower(body), r"!\[[^\]]*\]\([^)]*\)", " "), r"\]\([^)]*\)", " ")
    words = F.filter(F.split(F.regexp_replace(t, r"(?U)[^\w\s]", " "), r"(?U)\s+"), lambda w: (w != "") & ~w.isin(boilerplate) if boilerplate else w != "")
    return F.array_join(words, " ")


def link_title(anchor, target):
    """A short anchor, else the last two parts of the path."""
    parts = F.filter(F.split(url.path(target), "/"), lambda s: s != "")
    tail = F.regexp_replace(F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), 2), " "), "[-_]", " ")
    words = F.size(F.split(F.trim(F.coalesce(anchor, F.lit(""))), r"\s+"))
    return F.when((F.trim(F.coalesce(anchor, F.lit(""))) != "") & (words <= 14), F.trim(anchor)).otherwise(tail)


def table_rows(pages: DataFrame) -> DataFrame:
    """(page, place, row, cells) of all HTML tables of pages (url, body)."""
    tag = lambda names: re.compile(rf"<(?:{names})\b[^>]*>(.*?)(?=</(?:{names})\s*>|<(?:{names})\b|</table|\Z)", re.I | re.S)
    rows_of, cells_of = tag("tr"), tag("td|th")
    plain = lambda s: " ".join(html.unescape(re.sub(r"<[^>]*>", " ", s)).split())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for u, body in zip(f["url"], f["body"], strict=True):
                for t, table in enumerate(re.findall(r"(?is)<table\b[^>]*>(.*?)(?:</table\s*>|\Z)", body or "")):
                    for r, row in enumerate(rows_of.findall(table)):
                        out.append((u, t, r, [plain(c) for c in cells_of.findall(row)]))
            yield pd.DataFrame(out, columns=["page", "place", "row", "cells"])

    return pages.select("url", "body").mapInPandas(run, "page string, place int, row int, cells array<string>")
