"""Requests: entities, seed URLs, questions and settings from a workbook or from tables, checked row by row."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, url
from . import workbook

# Settings that a request may change, with their types.
SETTINGS = {
    "extract_tool": str, "crawl_scorer": str, "fetch_backend": str, "crawl_scope": str, "crawl_max_pages": int, "crawl_max_depth": int,
    "filter_threshold": float, "crawl_min_score": float, "filter_enabled": bool, "summarize": bool, "use_cache": bool,
}


def _header(rows: list[list], wanted: tuple[str, ...], scan: int = 15) -> int:
    """The first of the leading rows that holds all wanted names."""
    for k, row in enumerate(rows[:scan]):
        if set(wanted) <= {str(c).strip().lower() for c in row if c is not None}:
            return k
    raise ValueError(f"no header row with {', '.join(wanted)}")


def records(rows: list[list], wanted: tuple[str, ...] = (), aliases: dict[str, str] | None = None) -> list[dict]:
    """Rows under a header as dictionaries with lower-case names; names in aliases are renamed; blank rows go."""
    if not rows:
        return []
    at = _header(rows, wanted) if wanted else 0
    names = [str(c).strip().lower() if c is not None else "" for c in rows[at]]
    names = [(aliases or {}).get(n, n) for n in names]
    out = []
    for k, row in enumerate(rows[at + 1 :], at + 2):
        r = {n: row[i] if i < len(row) else None for i, n in enumerate(names) if n}
        if any(v is not None and str(v).strip() for v in r.values()):
            out.append(r | {"_row": k})
    return out


def depth(value) -> int:
    if value is None or str(value).strip() == "":
        return 0
    d = int(float(value))
    if d < 0:
        raise ValueError(f"depth {value} is negative")
    return d


def setting(key: str, value):
    """A setting in its type; unknown keys are refused."""
    if key not in SETTINGS:
        raise ValueError(f"unknown setting {key!r}")
    kind = SETTINGS[key]
    if kind is bool:
        return str(value).strip().lower() in ("true", "1", "1.0", "yes", "y")
    return kind(float(value)) if kind is int else kind(value)


def read_request(data: bytes) -> dict:
    """entities, urls (url, depth, entities, context), questions (question, instruction), settings of a workbook.

    Without an entity sheet each URL is an entity of its own; a blank entity list means all.
    """
    sheets = {k.strip().lower(): v for k, v in workbook.read_sheets(data).items()}
    first = next(iter(sheets.values()), [])
    named = "entities" in sheets
    entities = list(dict.fromkeys(str(r["entity"]).strip() for r in records(sheets.get("entities", [])) if r.get("entity") and str(r["entity"]).strip()))
    urls = []
    for r in records(sheets.get("urls", first)):
        column = next((k for k in r if "url" in k or "link" in k), None)
        value = str(r.get(column) or "").strip() if column else ""
        if not value:
            continue
        value = value if re.match("(?i)https?://", value) else f"https://{value}"
        if not re.match(r"(?i)https?://[^/\s]+\.[^/\s]+", value):
            raise ValueError(f"row {r['_row']}: {value!r} is no URL")
        own = [x.strip() for x in str(r.get("entities") or "").split(",") if x.strip()]
        unknown = [x for x in own if named and x not in entities]
        if unknown:
            raise ValueError(f"row {r['_row']}: unknown entities {unknown}")
        urls.append({"url": value, "depth": depth(r.get("depth")), "entities": (own or entities) if named else [value], "context": str(r.get("context") or "")})
    questions: list[dict] = []
    for r in records(sheets.get("questions", [])):
        q = str(r.get("question") or "").strip()
        if q and q in {x["question"] for x in questions}:
            raise ValueError(f"row {r['_row']}: question {q!r} twice")
        if q:
            questions.append({"question": q, "instruction": str(r.get("instructions") or "").strip()})
    settings = {k: setting(k, r["value"]) for r in records(sheets.get("config", [])) if (k := str(r.get("setting") or "").strip().lower())}
    return {"entities": entities if named else [u["url"] for u in urls], "urls": urls, "questions": questions, "settings": settings}


def relations(spark: SparkSession, request: dict) -> dict[str, DataFrame]:
    """A request's relations with their order as ord."""
    e = [(x, i) for i, x in enumerate(request["entities"])]
    u = [(x["url"], x["depth"], x["entities"], x["context"], i) for i, x in enumerate(request["urls"])]
    q = [(x["question"], x["instruction"], i) for i, x in enumerate(request["questions"])]
    out = {
        "entities": spark.createDataFrame(e, "entity string, ord int"),
        "urls": spark.createDataFrame(u, "url string, depth int, entities array<string>, context string, ord int"),
        "questions": spark.createDataFrame(q, "question string, instruction string, ord int"),
    }
    out["questions"] = out["questions"].withColumn("is_list", text.list_question(F.col("instruction")))
    return out


def bind(defaults: dict, environment: dict, request: dict) -> dict:
    """Settings: the request's over the environment's over the defaults."""
    env = {k: setting(k, v) for k, v in environment.items() if k in SETTINGS}
    return defaults | env | request


def bad_urls(urls: DataFrame) -> DataFrame:
    """Rows of a large URL table whose URL cannot be repaired, with the reason."""
    fixed = url.with_scheme(F.trim("url"))
    reason = F.when(F.coalesce(F.trim("url"), F.lit("")) == "", "blank").when(~fixed.rlike(r"^(?i)https?://[^/\s]+\.[^/\s]+"), "no host")
    return urls.withColumn("reason", reason).where("reason is not null")


def parse_questions(items: list[str]) -> list[dict]:
    """Questions given as name or name: instruction."""
    return [{"question": a.strip(), "instruction": b.strip()} for a, _, b in (x.partition(":") for x in items)]
