"""Readings of cell texts as numbers, in column expressions.

A cell is scanned once into its words outside parentheses, its notes inside them and the hedge before its number. The
three readings, a yes or no, a count and an amount of money, are choices over that scan, so a whole column is read without
Python and without a join. A reading is a struct: ok, value, its bounds lo and hi (null where open), vintage, sorted flags, reason.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rates to US dollars, words that guard a number, currency marks, scales and hedges.
RATES = {"USD": 1.0, "GBP": 1.27, "EUR": 1.08, "CHF": 1.10, "SEK": 0.095}
GUARDS = {
    "subset": ["engineers", "designers", "experts", "specialists", "staff of", "team of", "r&d", "scientists"],
    "not_current": ["planned", "within next", "target", "projected", "by 20"],
    "forecast": ["outlook", "forecast", "projected", "guidance", "target"],
    "partial_period": ["first half", "second half", "half of", "h1", "h2", "q1", "q2", "q3", "q4", "quarter"],
}
CURRENCIES = {"$": "USD", "usd": "USD", "us$": "USD", "£": "GBP", "gbp": "GBP", "€": "EUR", "eur": "EUR", "chf": "CHF", "sek": "SEK", "msek": "SEK"}
SCALES = {"billion": 1e9, "bn": 1e9, "b": 1e9, "million": 1e6, "m": 1e6, "mio": 1e6, "msek": 1e6}
AT_LEAST = ["over", "above", "more than", "at least", "exceeding"]
ABOUT = ["around", "about", "approx", "approximately", "circa", "c.", "~"]

_NOTE = r"\(([^)]*)\)"
_YEAR = "(?:19|20)[0-9]{2}"
_COUNT = r"\d[\d,\s]*"
_MONEY = r"(?i)([$£€]|usd|gbp|eur|chf|sek|us\$)?\s*(\d[\d,]*(?:\.\d+)?)\s*(billion|million|bn|mio|b|msek|m)?\s*(usd|gbp|eur|chf|sek)?"


@dataclass
class Guide:
    """What readings depend on: the year of the run, currency rates, guard words and keyword lists."""

    year: int = 2026
    rates: dict[str, float] = field(default_factory=lambda: dict(RATES))
    guards: dict[str, list[str]] = field(default_factory=lambda: {k: list(v) for k, v in GUARDS.items()})
    phrases: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def read(cls, rows: DataFrame, year: int = 2026) -> Guide:
        """A guide from rows (kind, name, value): rate, guard and phrase; kinds without a row keep their defaults. A spec of a few rows."""
        got: dict[str, dict[str, list[str]]] = {}
        for r in rows.where("kind is not null and name is not null and value is not null").orderBy("kind", "name", "value").collect():
            got.setdefault(r["kind"].strip().lower(), {}).setdefault(r["name"].strip(), []).append(r["value"].strip())
        guide = cls(year)
        if "rate" in got:
            guide.rates = {k.upper(): float(v[0]) for k, v in got["rate"].items()}
        if "guard" in got:
            guide.guards |= {k: [w.lower() for w in v] for k, v in got["guard"].items()}
        guide.phrases = got.get("phrase", {})
        return guide


def _tidy(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def _names(c: Column, words: list[str]) -> Column:
    """Whether the text holds one of the words anywhere."""
    return c.rlike("|".join(map(re.escape, words))) if words else F.lit(False)


def _either(words: list[str], after: str = "") -> str:
    return "(?:" + "|".join(re.escape(w) + after for w in words) + ")"


def _with(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[,\s]", "").try_cast("double")


def _lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key) if table else F.lit(None)


def notes(raw: Column, guide: Guide) -> Column:
    """The notes in parentheses as structs of kind (not_current, forecast, partial, year or company) and year."""

    def one(n: Column) -> Column:
        year = F.regexp_extract(n, _YEAR, 0).try_cast("int")
        letters = F.regexp_replace(n, f"fy|fiscal year|as of|year|{_YEAR}", "").rlike("[a-z]")
        kind = F.when(year.isNotNull() & ~letters, "year").otherwise("company")
        for name, guard in (("partial", "partial_period"), ("forecast", "forecast"), ("not_current", "not_current")):
            kind = F.when(_names(n, guide.guards.get(guard, [])), name).otherwise(kind)
        return F.struct(kind.alias("kind"), year.alias("year"))

    return F.transform(F.transform(F.regexp_extract_all(raw, F.lit(_NOTE), 1), _tidy), one)


def vintage(found: Column, kinds: list[str]) -> Column:
    """The last year note, or the first year of a note of another of the kinds since then."""
    step = lambda at, n: F.when(n["kind"] == "year", n["year"]).when(n["kind"].isin(kinds), F.coalesce(at, n["year"])).otherwise(at)
    return F.aggregate(found, F.lit(None).cast("int"), step)


def outside(raw: Column) -> Column:
    """The text outside of parentheses, in lower case with single spaces."""
    return _tidy(F.regexp_replace(raw, _NOTE, " "))


def hedge(body: Column) -> Column:
    """A struct of the body without its hedge (bare), whether there is one (hedged), and whether it leaves the upper end open."""
    least, about = f"^{_either(AT_LEAST, ' ')}", f"^{_either(ABOUT)}"

    def one(b: Column) -> Column:
        plus = b.endswith("+") | b.rlike(r"\d\+")
        bare = F.when(b.endswith("+"), F.trim(F.regexp_replace(b, r"\+$", ""))).otherwise(F.regexp_replace(b, r"(?<=\d)\+", ""))
        return F.struct(bare.alias("bare"), (body.rlike(f"{least}|{about}") | plus).alias("hedged"), (body.rlike(least) | plus).alias("open"))

    return _with(F.trim(F.regexp_replace(body, f"{least}|{about}", "")), one)


def scan(raw: Column, guide: Guide) -> Column:
    """A struct of the text in order (tidy), its notes, its words outside of them (whole), and these without their hedge."""
    start = F.struct(_tidy(raw).alias("tidy"), notes(raw, guide).alias("notes"), outside(raw).alias("whole"))
    return _with(start, lambda s: F.struct(s["tidy"].alias("tidy"), s["notes"].alias("notes"), s["whole"].alias("whole"), hedge(s["whole"]).alias("hedge")))


def _reading(ok: Column, value: Column, lo: Column, hi: Column, year: Column, flags: list[tuple[Column, str]], more: list[Column], reason: Column) -> Column:
    named = F.array_compact(F.array(*(F.when(c, name) for c, name in flags))) if flags else F.array().cast("array<string>")
    kept = lambda c, kind: F.when(ok, c).cast(kind)
    return F.struct(
        F.coalesce(ok, F.lit(False)).alias("ok"), kept(value, "double").alias("value"), kept(lo, "double").alias("lo"), kept(hi, "double").alias("hi"), kept(year, "int").alias("vintage"),
        F.array_sort(F.array_distinct(F.concat(named, *more))).alias("flags"), F.when(ok, "").otherwise(reason).alias("reason"),
    )


def binary(raw: Column) -> Column:
    """Yes and true are 1, no and false 0; any other text is no reading."""
    word = F.regexp_replace(_tidy(raw), r"\.+$", "")
    value = F.when(word.isin("yes", "true"), 1.0).when(word.isin("no", "false"), 0.0)
    return _with(value, lambda v: _reading(v.isNotNull(), v, v, v, F.lit(None), [], [], F.lit("not a bare yes or no")))


def count(raw: Column, max_age: Column, guide: Guide) -> Column:
    """A number of heads: one number or a range; words that name a part of the staff or a plan are no reading."""
    span = rf"^({_COUNT}?)\s*(?:-|–|to)\s*({_COUNT})$"

    def numbers(s: Column) -> Column:
        body = s["hedge"]["bare"]
        low, high = (_digits(F.regexp_extract(body, span, k)) for k in (1, 2))
        guarded = F.lit(None).cast("string")
        for name in ("not_current", "subset"):
            guarded = F.when(_names(s["tidy"], guide.guards.get(name, [])), f"{name} guard").otherwise(guarded)
        single = F.when(F.regexp_replace(body, r"[,\s]", "").rlike(r"^\d+(\.\d+)?$"), _digits(body))
        return F.struct(s.alias("s"), body.rlike(span).alias("ranged"), low.alias("low"), high.alias("high"), single.alias("single"), guarded.alias("guarded"), vintage(s["notes"], ["forecast", "partial"]).alias("year"))

    def read(x: Column) -> Column:
        has = lambda kind: F.exists(x["s"]["notes"], lambda n: n["kind"] == kind)
        ranged, single = x["ranged"], x["single"]
        value = F.when(ranged, (x["low"] + x["high"]) / 2).otherwise(single)
        reason = F.coalesce(x["guarded"], F.when(has("not_current"), "not_current annotation"), F.when(value.isNull(), "not a count"))
        ok = reason.isNull()
        # a text that is no count has no flags
        flags = [(ok & c, name) for c, name in ((x["s"]["hedge"]["hedged"], "QUALIFIED"), (ranged, "RANGE"), (has("company"), "ANNOTATION"), (has("forecast"), "FORECAST"), (has("partial"), "PARTIAL"), (~ranged & (F.lit(guide.year) - x["year"] > max_age), "STALE"))]
        return _reading(ok, value, F.when(ranged, x["low"]).otherwise(single), F.when(ranged, x["high"]).when(~x["s"]["hedge"]["open"], single), x["year"], flags, [], reason)

    return _with(_with(scan(raw, guide), numbers), read)


def _amount(fragment: Column, guide: Guide) -> Column:
    """A struct of the first amount in US dollars, null if there is none or its currency has no rate, and whether it names no currency (bare)."""

    def one(p: Column) -> Column:
        mark = F.when(p["scale"] == "msek", p["scale"]).when(p["before"] != "", p["before"]).otherwise(p["behind"])
        rate = _lookup(guide.rates, F.coalesce(_lookup(CURRENCIES, mark), F.lit("USD")))
        return F.struct((_digits(p["number"]) * F.coalesce(_lookup(SCALES, p["scale"]), F.lit(1.0)) * rate).alias("usd"), (mark == "").alias("bare"))

    parts = F.struct(*(F.lower(F.regexp_extract(fragment, _MONEY, k)).alias(name) for k, name in enumerate(("before", "number", "scale", "behind"), 1)))
    return _with(parts, one)


def money(raw: Column, max_age: Column, guide: Guide) -> Column:
    """An amount of money in US dollars, or a range of two; a note that names a company makes it that company's."""
    # thousands that were typed with a space behind the comma
    joined = F.regexp_replace(raw, r"(?<=\d),\s+(?=\d{3})", ",")

    def amounts(s: Column) -> Column:
        ends = F.transform(F.split(s["hedge"]["bare"], r"\s+to\s+|\s-\s"), lambda e: _amount(e, guide))
        return F.struct(s.alias("s"), ends.alias("ends"), _amount(s["hedge"]["bare"], guide).alias("one"), vintage(s["notes"], ["forecast", "partial", "not_current"]).alias("year"))

    def read(x: Column) -> Column:
        s, one, low, high = x["s"], x["one"], F.get(x["ends"], F.lit(0)), F.get(x["ends"], F.lit(1))
        ranged = F.coalesce((F.size(x["ends"]) == 2) & low["usd"].isNotNull() & high["usd"].isNotNull(), F.lit(False))
        kinds = F.transform(F.filter(s["notes"], lambda n: ~n["kind"].isin("year", "company")), lambda n: F.upper(n["kind"]))
        flags = [
            (s["hedge"]["hedged"], "QUALIFIED"), (ranged, "RANGE"), (F.when(ranged, low["bare"] | high["bare"]).otherwise(one["bare"] & one["usd"].isNotNull()), "NO_CURRENCY"),
            (F.exists(s["notes"], lambda n: n["kind"] == "company"), "PARENT_ATTRIBUTED"), (_names(s["whole"], guide.guards.get("forecast", [])), "FORECAST"),
            (_names(s["whole"], guide.guards.get("partial_period", [])), "PARTIAL"), (~ranged & one["usd"].isNotNull() & (F.lit(guide.year) - x["year"] > max_age), "STALE"),
        ]
        value = F.when(ranged, (low["usd"] + high["usd"]) / 2).otherwise(one["usd"])
        hi = F.when(ranged, F.greatest(low["usd"], high["usd"])).when(~s["hedge"]["open"], one["usd"])
        return _reading(value.isNotNull(), value, F.when(ranged, F.least(low["usd"], high["usd"])).otherwise(one["usd"]), hi, x["year"], flags, [kinds], F.lit("no amount"))

    return _with(_with(scan(joined, guide), amounts), read)


def reading(parser: Column, raw: Column, max_age: Column, guide: Guide | None = None) -> Column:
    """The reading of raw by the parser of its row; null for a null text."""
    guide = guide or Guide()
    unknown = _reading(F.lit(False), F.lit(None), F.lit(None), F.lit(None), F.lit(None), [], [], F.lit("unknown parser"))
    chosen = F.when(parser == "binary", binary(raw)).when(parser == "count", count(raw, max_age, guide)).when(parser == "money", money(raw, max_age, guide)).otherwise(unknown)
    return F.when(raw.isNotNull(), chosen)
