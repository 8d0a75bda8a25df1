"""Text, URL, similarity and vector functions."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeloom.functions import similarity, text, url, vector


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def naive(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcé ", max_size=30), st.text("abcé ", max_size=30))
def test_common_subsequence_equals_naive(a, b):
    assert similarity.common(a, b) == naive(a, b)


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=8), st.text("abc", min_size=1, max_size=16))
def test_partial_ratio_equals_all_windows(a, b):
    x, y = (a, b) if len(a) <= len(b) else (b, a)
    m = len(x)
    windows = [y[i : i + m] for i in range(len(y) - m + 1)] + [y[:k] for k in range(1, m)] + [y[-k:] for k in range(1, m)]
    best = max(similarity.ratio(x, w) for w in windows)
    assert similarity.partial_ratio(a, b) == pytest.approx(100.0 if x in y else best)


def test_token_ratios():
    assert similarity.token_sort_ratio("north america acme", "acme north america") == 100
    assert similarity.token_set_ratio("a b", "a b c") == 100 and similarity.token_set_ratio("", "a") == 0
    assert similarity.ratio("", "") == 100 and similarity.ratio("abcd", "bcde") == 75


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("https://t.com/services?hsLang=en", "https://t.com/services"),
        ("https://t.com/a?utm_source=x&id=5", "https://t.com/a?id=5"),
        ("https://t.com/a?gclid=abc#frag", "https://t.com/a"),
        ("https://t.com/a/", "https://t.com/a"),
    ],
)
def test_normalised_urls(spark, raw, want):
    assert one(spark, raw, url.normalise) == want


def test_domains(spark):
    site = lambda h: one(spark, h, url.site_domain)
    assert site("www.automatic.com.hk") == "automatic.com.hk" and site("sub.bbc.co.uk") == "bbc.co.uk" and site("a.b.example.com") == "example.com"
    reg = lambda u: one(spark, u, url.registrable_domain)
    assert reg("https://www.acme.co.uk/x") == "acme.co.uk" and reg("shop.acme.com") == "acme.com"
    assert one(spark, "acme.co.uk", url.brand_label) == "acme" and one(spark, "acme.com", url.brand_label) == "acme"


def test_locale_keys(spark):
    key = lambda u: one(spark, u, url.locale_key)
    assert key("https://b.com/fr.html") == key("https://b.com/de.html")
    assert key("https://q.com/de/de") == key("https://q.com/jp/ja")
    assert key("https://a.com/us_en/contact") != key("https://a.com/us_en/products")
    assert key("https://es.acme.com/x") == key("https://fr.acme.com/x")


def test_paths(spark):
    legal = lambda u: one(spark, u, url.legal_page)
    assert legal("https://x.com/privacypolicy") and legal("https://x.com/en/cookie-policy.html") and legal("https://x.com/Impressum.php")
    assert not legal("https://x.com/privacy-first-manufacturing") and not legal("https://x.com/news/cookie-factory-opens")
    assert one(spark, "https://x.com/wp-json/a", url.blocked_page) and one(spark, "https://x.com/A.AVIF/", url.asset_link)


def test_list_questions(spark):
    is_list = lambda s: one(spark, s, text.list_question)
    for yes in ("comma-separated values only", "deduplicated entries", "For each claim return one concise sentence", "return one entry per item"):
        assert is_list(yes)
    for no in ("Name the parent company only", None, ""):
        assert not is_list(no)


def test_values(spark):
    number = lambda s: one(spark, s, text.numeric_value)
    assert number("2,003") == 2003.0 and number("2003 employees") is None and number("about 1,200.5%") == 1200.5
    assert one(spark, "Yes.", text.binary_value) is True and one(spark, "maybe", text.binary_value) is None
    assert one(spark, "x [C0183, C0184] y [C0001]", text.cited_ids) == ["C0183", "C0184", "C0001"]
    assert one(spark, "- a; b\n* c", text.split_cell) == ["a", "b", "c"]
    assert one(spark, "x" * 40_000, text.clamp_cell).endswith(text.CUT_MARK) and len(one(spark, "x\n" * 40_000, text.clamp_cell)) <= text.CELL_LIMIT


def windows(t, size, overlap, most):
    out, at = [], 0
    while True:
        out.append(t[at : at + size])
        if at + size >= len(t) or len(out) == most:
            return out
        at += size - overlap


def pack(t, size):
    out, now = [], ""
    for p in (x.strip() for x in t.split("\n")):
        if not p:
            continue
        if len(p) > size:
            out += [now] if now else []
            now = ""
            out += [p[i : i + size] for i in range(0, len(p), size)]
        elif now and len(now) + 1 + len(p) > size:
            out.append(now)
            now = p
        else:
            now = f"{now}\n{p}" if now else p
    return out + ([now] if now else [])


def test_chunks(spark):
    rng = random.Random(1)
    for n in (0, 1, 99, 100, 101, 180, 181, 500):
        t = "".join(rng.choice("ab ") for _ in range(n))
        assert one(spark, t, lambda x: text.chunk_windows(x, 100, 20, 5)) == windows(t, 100, 20, 5)
    for _ in range(5):
        t = "\n".join("".join(rng.choice("ab") for _ in range(rng.randrange(0, 70))) for _ in range(12))
        assert one(spark, t, lambda x: text.paragraph_chunks(x, 50)) == pack(t, 50)


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(vector.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0]


def test_small_texts(spark):
    assert spark.range(1).select(text.elapsed_long(F.lit(93784)), text.elapsed_long(F.lit(59))).first()[:] == ("1d 2h 3m 4s", "59s")
    assert spark.range(1).select(text.search_query(F.lit(" Acme "), F.lit("robots, tools"))).first()[0] == "Acme official website robots"
    assert one(spark, "3 items across 2 themes. Top: Oslo [C0001] (2 items); Rome (1 items)", text.digest_claims) == "Oslo [C0001]; Rome" and one(spark, "no top", text.digest_claims) is None
    assert one(spark, "Be brief. Where is it? Say so.", lambda x: text.natural_question(F.lit("HQ"), x)) == "Where is it?" and one(spark, None, lambda x: text.natural_question(F.lit("HQ"), x)) == "HQ"
    assert one(spark, "see Dead link https://x.org/a, ok", text.first_url) == "https://x.org/a"
    assert one(spark, "dead link", lambda x: text.classify(x, [("broken", ["dead", "404"]), ("moved", ["moved"])], "ok")) == "broken"
    assert one(spark, "no", lambda x: text.hypothesis(F.lit("Public?"), F.lit("Acme"), x)) == "For Acme it is not true: Public?"
    assert one(spark, "one.two", text.slug) == "one-two" and one(spark, "```json\n{}\n```", text.strip_json_fence) == "{}"
