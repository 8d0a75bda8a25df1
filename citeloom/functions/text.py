"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning for link scoring, and for question routing.
LINK_STOPWORDS = [
    "the", "and", "or", "of", "in", "to", "for", "with", "on", "at", "by", "an", "as", "is", "are", "be", "not",
    "from", "that", "this", "it", "its", "your", "our", "their", "you", "we", "they", "was", "were", "has", "have",
    "had", "more", "read", "view", "all", "shop", "buy", "learn",
]
# Instruction words that ask for a list, and the prefix of an explicit "no data" answer.
LIST_KEYWORDS = ["comma-separated", "deduplicated", "list", "for each"]
NULL_PREFIX = "none (not disclosed"
#: Characters that a worksheet cell holds, and the mark of a cut cell.
CELL_LIMIT = 32_767
CUT_MARK = "[truncated — full list in Provenance]"


def normalise_value(x: Column) -> Column:
    """Trimmed, lower case, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(x), r"(?U)\s+", " "))


def strip_markup(x: Column) -> Column:
    """Markdown punctuation and white space runs as one space; case kept."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[|#*()/\\]+", " "), r"(?U)\s+", " "))


def words_only(x: Column) -> Column:
    """Lower case, all but word characters and white space as spaces, runs collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def normalise_entity(x: Column) -> Column:
    return F.regexp_replace(normalise_value(x), r"^[\s.,:;…]+|[\s.,:;…]+$", "")


def null_sentinel(normalised: Column) -> Column:
    return normalised.startswith(NULL_PREFIX)


def list_question(instruction: Column) -> Column:
    text = F.lower(F.coalesce(instruction, F.lit("")))
    named = F.lit(False)
    for k in LIST_KEYWORDS:
        named = named | text.contains(k)
    return named | text.rlike(r"\bone\b.{1,30}\bper\b")


def ascii_tokens(x: Column, least: int = 3, stop: list[str] | None = None) -> Column:
    """Runs of a-z and 0-9 in the lower-cased text, of at least least characters and not among the stop words."""
    tokens = F.regexp_extract_all(F.lower(x), F.lit("([a-z0-9]+)"), 1)
    stop = LINK_STOPWORDS if stop is None else stop
    return F.filter(tokens, lambda w: (F.length(w) >= least) & ~w.isin(stop))


def keywords(x: Column, stop: list[str] | None = None) -> Column:
    return F.array_distinct(ascii_tokens(x, 4, stop))


def space_tokens(x: Column) -> Column:
    return F.filter(F.split(F.lower(x), r"(?U)\s+"), lambda w: w != "")


def token_dice(a: Column, b: Column) -> Column:
    """Twice the shared distinct tokens over the sum of distinct tokens; 0 if either has none."""
    x, y = F.array_distinct(space_tokens(a)), F.array_distinct(space_tokens(b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def chunk_windows(x: Column, size: int = 8000, overlap: int = 200, most: int | None = None) -> Column:
    """Windows of size characters that overlap; a text of at most size is one window. most: keep only so many."""
    step = size - overlap
    n = F.when(F.length(x) <= size, 1).otherwise(F.ceil((F.length(x) - size) / step) + 1)
    return F.transform(F.sequence(F.lit(0), (n if most is None else F.least(n, F.lit(most))).cast("int") - 1), lambda i: F.substring(x, i * step + 1, F.lit(size)))


def paragraph_chunks(x: Column, size: int = 1000, most: int | None = None) -> Column:
    """Paragraphs packed into chunks of about size characters; a longer paragraph is split hard. most: keep only so many."""
    paragraphs = F.filter(F.transform(F.split(x, r"\n"), lambda p: F.regexp_replace(p, r"^(?U)\s+|(?U)\s+$", "")), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, p: Column) -> Column:
        done, open_ = state["done"], state["open"]
        closed = F.when(open_ == "", done).otherwise(F.array_append(done, open_))
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / size).cast("int")), lambda i: F.substring(p, i * size + 1, F.lit(size)))
        fits = (open_ != "") & (F.length(open_) + 1 + F.length(p) <= size)
        return (
            F.when(F.length(p) > size, F.struct(F.concat(closed, pieces).alias("done"), F.lit("").alias("open")))
            .when(fits, F.struct(done.alias("done"), F.concat_ws("\n", open_, p).alias("open")))
            .otherwise(F.struct(closed.alias("done"), p.alias("open")))
        )

    out = F.aggregate(paragraphs, start, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"])))
    return out if most is None else F.slice(out, 1, most)


def cited_ids(x: Column) -> Column:
    """All C#### inside square brackets, in order."""
    inside = F.regexp_extract_all(x, F.lit(r"\[([^\]]*)\]"), 1)
    return F.flatten(F.transform(inside, lambda b: F.regexp_extract_all(b, F.lit(r"(C\d{4,})"), 1)))


def has_citation(x: Column) -> Column:
    return x.rlike(r"\[[^\]]*C\d{4,}[^\]]*\]")


def strip_citations(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\s*\[[^\]]*C\d{4,}[^\]]*\]", ""), r"\s*\(\+?\d* ?more in Provenance\)", ""))


def bool_class(x: Column) -> Column:
    bare = F.regexp_replace(normalise_value(x), r"[.!]+$", "")
    return F.when(bare.isin("yes", "true"), "yes").when(bare.isin("no", "false"), "no")


def binary_value(x: Column) -> Column:
    c = bool_class(x)
    return F.when(c == "yes", True).when(c == "no", False)


def numeric_value(x: Column) -> Column:
    """A number with thousands separators and nothing else; null otherwise."""
    bare = F.regexp_replace(F.trim(x), r"^(?i)(about|approximately|approx\.?|around|circa|c\.|~)\s*", "")
    return F.when(bare.rlike(r"^[+-]?(\d{1,3}(,\d{3})+|\d+)(\.\d+)?%?$"), F.regexp_replace(bare, "[,%]", "").cast("double"))


def annotations(x: Column) -> Column:
    """Contents of all parentheses."""
    return F.regexp_extract_all(x, F.lit(r"\(([^()]*)\)"), 1)


def without_annotations(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\([^()]*\)", " "), r"\s+", " "))


def split_cell(x: Column, comma: bool = False) -> Column:
    """Items of a cell: lines and semicolon parts (commas on request), bullets stripped, blanks dropped."""
    parts = F.split(x, r"[\n;,]" if comma else r"[\n;]")
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"^\s*[-*•·]\s*", ""))), lambda p: p != "")


def null_marker(x: Column) -> Column:
    return normalise_value(x).isin("n/a", "na", "none", "nil", "null", "-", "–", "—", "not disclosed", "not found", "no data") | normalise_value(x).startswith(NULL_PREFIX)


def strip_json_fence(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"^\s*```[a-zA-Z]*\s*", ""), r"\s*```\s*$", ""))


def query_text(name: Column, instruction: Column) -> Column:
    return F.when(F.trim(F.coalesce(instruction, F.lit(""))) != "", F.concat(name, F.lit(". "), F.trim(instruction))).otherwise(name)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def clamp_cell(x: Column, limit: int = CELL_LIMIT) -> Column:
    """At most limit characters, cut at a line end, with a mark on a line of its own."""
    head = F.substring(x, 1, limit - len(CUT_MARK) - 1)
    return F.when(F.length(x) > limit, F.concat(F.regexp_replace(head, r"\n[^\n]*$", ""), F.lit("\n" + CUT_MARK))).otherwise(x)


def page_title(x: Column) -> Column:
    """The first heading, else the first line of at most 14 words; cut to 180 characters."""
    lines = F.filter(F.transform(F.split(x, "\n"), lambda p: F.trim(p)), lambda p: p != "")
    heading = F.element_at(F.filter(lines, lambda p: p.startswith("#")), 1)
    short = F.element_at(F.filter(lines, lambda p: F.size(F.split(p, r"\s+")) <= 14), 1)
    return F.substring(F.coalesce(F.trim(F.regexp_replace(heading, "^#+", "")), short, F.lit("")), 1, 180)


def page_character(x: Column) -> Column:
    """empty, too_short, good, nav_heavy or mixed, by the words of its lines."""
    lines = F.filter(F.split(x, "\n"), lambda p: F.trim(p) != "")
    words = F.transform(lines, lambda p: F.size(F.split(F.trim(p), r"\s+")))
    n = F.size(lines)
    total = F.aggregate(words, F.lit(0), lambda t, w: t + w)
    long_, short = F.size(F.filter(words, lambda w: w >= 8)), F.size(F.filter(words, lambda w: w <= 3))
    return F.when((n == 0) | x.isNull(), "empty").when(total < 80, "too_short").when(long_ / n >= 0.25, "good").when(short / n >= 0.65, "nav_heavy").otherwise("mixed")


def elapsed(ms: Column) -> Column:
    """Milliseconds as 850ms, 12.3s or 4m 05s."""
    s = ms / 1000
    return (
        F.when(ms < 1000, F.format_string("%dms", ms.cast("bigint")))
        .when(s < 60, F.format_string("%.1fs", s.cast("double")))
        .otherwise(F.format_string("%dm %02ds", F.floor(s / 60).cast("bigint"), F.floor(s % 60).cast("bigint")))
    )


def to_bool(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x)).isin("true", "yes", "y", "1", "1.0", "x"), F.lit(False))


def whole_number_text(x: Column) -> Column:
    """A number as text, whole ones without a decimal point."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def match_label(verified: Column, score: Column) -> Column:
    """The label that a ledger shows: exact at 100, fuzzy if verified, else none."""
    return F.when(verified & (score >= 100), "exact").when(verified, "fuzzy").otherwise("none")


def elapsed_long(seconds: Column) -> Column:
    """Seconds as 1d 2h 3m 4s without leading zero parts."""
    s = F.floor(seconds).cast("bigint")
    d, h, m = F.floor(s / 86_400), F.floor(s / 3_600) % 24, F.floor(s / 60) % 60
    part = lambda when, x, unit: F.when(when, F.concat(x.cast("bigint").cast("string"), F.lit(unit)))
    return F.concat_ws(" ", part(d > 0, d, "d"), part(s >= 3_600, h, "h"), part(s >= 60, m, "m"), part(F.lit(True), s % 60, "s"))


def search_query(name: Column, categories: Column) -> Column:
    """What to ask a search engine for a company's home page."""
    first = F.trim(F.element_at(F.split(F.coalesce(categories, F.lit("")), "[,;|]"), 1))
    return F.concat_ws(" ", F.trim(name), F.lit("official website"), F.when(first != "", first))


def digest_claims(line: Column) -> Column:
    """The part of a digest line that states something: after Top, without item counts; null without a citation."""
    at = F.instr(line, "Top: ")
    top = F.trim(F.regexp_replace(F.substring(line, at + 5, F.length(line)), r"\s*\(\d+ items\)", ""))
    return F.when((at > 0) & has_citation(line), top)


def natural_question(name: Column, instruction: Column) -> Column:
    """The instruction's first sentence that asks, else the name."""
    asked = F.regexp_extract(F.coalesce(instruction, F.lit("")), r"(?:^|[.!?]\s+)([^.!?]*\?)", 1)
    return F.when(F.trim(asked) != "", F.trim(asked)).otherwise(name)


def hypothesis(question: Column, entity: Column, value: Column) -> Column:
    """A statement to hold against a quote; yes and no give the question's polarity."""
    said = bool_class(value)
    return (
        F.when(said == "yes", F.concat(F.lit("For "), entity, F.lit(" it is true: "), question))
        .when(said == "no", F.concat(F.lit("For "), entity, F.lit(" it is not true: "), question))
        .otherwise(F.concat(F.lit("For "), entity, F.lit(", the answer to '"), question, F.lit("' is "), value, F.lit(".")))
    )


def classify(raw: Column, rules: list[tuple[str, list[str]]], other: str) -> Column:
    """The name of the first rule of which the text holds a word, in any case."""
    out = F.lit(other)
    for name, words in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.upper(F.coalesce(raw, F.lit(""))).contains(w.upper())
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def first_url(raw: Column) -> Column:
    found = F.regexp_extract(F.coalesce(raw, F.lit("")), r"(https?://[^\s,;)>\]]+)", 1)
    return F.when(found != "", found)
