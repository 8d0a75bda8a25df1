"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that never change a page.
JUNK_PARAMETERS = ["hslang", "gclid", "fbclid", "msclkid"]
# Second-level labels under country codes.
SECOND_LEVEL = ["co", "com", "org", "net", "gov", "edu", "ac"]
# Suffixes of two labels, for company resolution.
TWO_PART_SUFFIXES = [
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "ltd.uk", "plc.uk", "com.au", "net.au", "org.au", "edu.au", "gov.au",
    "co.nz", "co.za", "co.in", "co.jp", "co.kr", "co.il", "co.id", "co.th", "com.br", "com.cn", "com.mx", "com.tr",
    "com.sg", "com.hk", "com.tw", "com.my", "com.ar", "com.co", "com.ua", "com.ph", "com.sa", "com.eg", "or.jp", "ne.jp",
    "go.jp",
]
# File endings of assets.
ASSET_ENDINGS = [
    "png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "avif", "heic", "heif", "bmp", "tif", "tiff", "jxl", "apng",
    "css", "js", "mp4", "webm", "pdf", "zip",
]
# Patterns of whole path segments for legal pages and for endpoints that are no pages.
LEGAL_SEGMENTS = [
    r"privacy([-_]?(policy|policies|notice|notices|statement))?",
    r"cookies?([-_]?(policy|policies|notice|settings|preferences|consent))?",
    r"terms([-_]?(of[-_]?(use|service|sale|business|purchase)|and[-_]?conditions|conditions))?",
    r"tos",
    r"legal([-_]?(notice|notices|information|disclaimer|mentions))?",
    r"disclaimer",
    r"imprint",
    r"impressum",
    r"mentions[-_]?legales",
    r"agb",
    r"datenschutz(erklaerung|erklarung|erklärung)?",
    r"data[-_]?protection",
    r"gdpr",
    r"ccpa",
    r"accessibility([-_]?statement)?",
]
BLOCKED_SEGMENTS = [r"cdn-cgi", r"wp-json", r"xmlrpc", r"\{\{.*\}\}"]
_LOCALE = r"^[a-z]{2}([_-][a-z]{2})?$"


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def domain(url: Column) -> Column:
    """Host in lower case without www."""
    return F.regexp_replace(F.lower(host(url)), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def normalise(url: Column) -> Column:
    """Without fragment, tracking parameters and trailing slashes."""
    bare = F.element_at(F.split(url, "#"), 1)
    kept = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~F.lower(F.element_at(F.split(p, "="), 1)).startswith("utm_") & ~F.lower(F.element_at(F.split(p, "="), 1)).isin(JUNK_PARAMETERS))
    base = F.element_at(F.split(bare, r"\?"), 1)
    joined = F.when(query(url) == "", bare).when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)
    return F.regexp_replace(joined, "/+$", "")


def site_domain(netloc: Column) -> Column:
    """Registered domain for crawl scope: three labels under a country code with a generic second level, else two."""
    labels = F.split(F.element_at(F.split(F.lower(netloc), ":"), 1), r"\.")
    n = F.size(labels)
    three = (n >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.when(n >= 2, F.element_at(labels, -2)).isin(SECOND_LEVEL)
    return F.when(three, F.array_join(F.slice(labels, -3, 3), ".")).when(n >= 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(F.lower(netloc))


def registrable_domain(url: Column) -> Column:
    """Registered domain for company resolution; a URL without scheme counts as one with it."""
    full = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("http://"), url))
    bare = F.regexp_replace(F.regexp_replace(domain(full), "^[^@]*@", ""), ":[0-9]*$", "")
    labels = F.filter(F.split(F.regexp_replace(bare, r"^www\.", ""), r"\."), lambda x: x != "")
    two = F.array_join(F.slice(labels, -2, 2), ".")
    n = F.size(labels)
    return F.when(n <= 2, F.array_join(labels, ".")).when(two.isin(TWO_PART_SUFFIXES), F.array_join(F.slice(labels, -3, 3), ".")).otherwise(two)


def brand_label(registrable: Column) -> Column:
    """The label before the suffix."""
    labels = F.split(registrable, r"\.")
    two = F.when(F.size(labels) >= 3, F.array_join(F.slice(labels, -2, 2), "."))
    return F.when(two.isin(TWO_PART_SUFFIXES), F.element_at(labels, -3)).otherwise(F.element_at(labels, 1))


def same_site(start: Column, candidate: Column) -> Column:
    return site_domain(F.regexp_replace(host(start), r"www\.", "")) == site_domain(F.regexp_replace(host(candidate), r"www\.", ""))


def same_host(start: Column, candidate: Column) -> Column:
    return F.regexp_replace(host(start), r"www\.", "") == F.regexp_replace(host(candidate), r"www\.", "")


def locale_key(url: Column) -> Column:
    """One key for the language variants of a page: locale segments and a locale subdomain become a mark."""
    segments = F.transform(
        F.split(path(url), "/"),
        lambda s: F.when((s != "") & F.lower(F.regexp_replace(s, r"\.html$", "")).rlike(_LOCALE), F.when(s.endswith(".html"), "{locale}.html").otherwise("{locale}")).otherwise(s),
    )
    netloc = F.regexp_replace(host(url), r"www\.", "")
    labels = F.split(netloc, r"\.")
    netloc = F.when((F.size(labels) >= 3) & F.lower(F.element_at(labels, 1)).rlike(_LOCALE), F.concat(F.lit("{locale}."), F.array_join(F.slice(labels, 2, 1_000), "."))).otherwise(netloc)
    return F.concat(netloc, F.array_join(segments, "/"), F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise(""))


def path_segments(url: Column) -> Column:
    """Path segments without a page's file ending."""
    return F.transform(F.filter(F.split(path(url), "/"), lambda s: s != ""), lambda s: F.regexp_replace(s, r"(?i)\.(html?|php|aspx?|jsp|cfm)$", ""))


def _any_segment(url: Column, patterns: list[str]) -> Column:
    pattern = "(?i)^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")$"
    return F.exists(path_segments(url), lambda s: s.rlike(pattern))


def legal_page(url: Column) -> Column:
    return _any_segment(url, LEGAL_SEGMENTS)


def blocked_page(url: Column) -> Column:
    return _any_segment(url, BLOCKED_SEGMENTS)


def asset_link(url: Column) -> Column:
    return F.lower(path(url)).rlike(r"\.(" + "|".join(ASSET_ENDINGS) + r")/*$")


def cache_key(url: Column) -> Column:
    return F.sha2(url, 256)


def with_scheme(url: Column) -> Column:
    """A URL without scheme gets https."""
    return F.when(url.rlike("(?i)^https?://"), url).otherwise(F.concat(F.lit("https://"), url))
