"""Queries of the URL, text and link functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, url
from ..operators import links
from .relations import read

QUESTION_ROWS = [("Thing of the article", "one of the things in an article"), ("Heading", "the heading with its article"), ("Andthe shore", None)]


def pages(spark, d):
    return read(spark, d, "pages")


def url_normalise(spark, d):
    return pages(spark, d).select("page_id", url.normalise(F.col("url")).alias("normal"))


def url_domains(spark, d):
    u = F.col("url")
    return pages(spark, d).select("page_id", url.site_domain(url.host(u)).alias("site"), url.registrable_domain(u).alias("registrable"), url.brand_label(url.registrable_domain(u)).alias("brand"), url.domain(u).alias("domain"), url.cache_key(u).alias("cache_key"))


def locale_key_dedup(spark, d):
    return links.locale_variants(pages(spark, d).select("url", F.col("page_id").alias("ord")))


def path_classes(spark, d):
    u = F.concat("url", F.when(F.col("page_id") % 5 == 0, "/privacy-policy.html").when(F.col("page_id") % 5 == 1, "/wp-json/x").when(F.col("page_id") % 5 == 2, "/logo.PNG/").otherwise("/news"))
    u = F.regexp_replace(u, r"[?#][^/]*", "")
    return pages(spark, d).select("page_id", url.legal_page(u).alias("legal"), url.blocked_page(u).alias("blocked"), url.asset_link(u).alias("asset"), F.array_join(url.path_segments(u), "|").alias("segments"))


def page_links(spark, d):
    body = pages(spark, d).select("url", F.col("html").alias("body"))
    return links.discover(body).groupBy("page").agg(F.count("*").alias("n_links"), F.min("target").alias("least"))


def link_relevance(spark, d):
    body = pages(spark, d).select("url", F.col("html").alias("body"))
    found = links.discover(body)
    docs = found.select("page", F.col("target").alias("id"), F.concat_ws(" ", "anchor", "context", url.path(F.col("target"))).alias("body"))
    query = found.select(F.explode(text.ascii_tokens(F.col("anchor"))).alias("term")).groupBy("term").agg(F.count("*").alias("c")).where("c > 3").select("term", F.lit(1.0).alias("weight"))
    out = links.relevance(docs, query, ["page"])
    return out.select("page", F.col("id").alias("target"), F.round("score", 6).alias("score"))


def bm25_documents(spark, d):
    query = links.crawl_query(spark.createDataFrame(QUESTION_ROWS, "question string, instruction string"))
    query = query.union(spark.createDataFrame([("the", 1.0), ("thing", 2.0)], "term string, weight double").where("term <> 'the'")).groupBy("term").agg(F.max("weight").alias("weight"))
    docs = read(spark, d, "documents").select("source", F.col("doc_id").alias("id"), F.col("text").alias("body"))
    out = links.relevance(docs, query, ["source"])
    return out.select("source", F.col("id").alias("doc_id"), F.round("raw", 6).alias("raw"), F.round("score", 6).alias("score"))


def top_links(spark, d):
    scored = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("target"), (F.col("l_quantity") / 50).alias("score"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("ord"))
    return links.follow(scored, least=0.9, depth=1, most=3).select("page", "target", "score", "rank")


def crawl_depth(spark, d):
    edges = read(spark, d, "lineitem").select(F.col("l_partkey").alias("page"), F.col("l_suppkey").alias("target"), F.lit(1.0).alias("score"), F.col("l_orderkey").alias("ord"))
    seeds = read(spark, d, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("url"))
    return links.crawl(edges, seeds, max_depth=3, budget=10_000_000)


def chunk_windows(spark, d):
    chunks = read(spark, d, "documents").select("doc_id", F.posexplode(text.chunk_windows(F.col("text"), 800, 20)).alias("chunk", "body"))
    return chunks.select("doc_id", "chunk", F.length("body").alias("n_chars"), F.md5("body").alias("digest"))


def paragraph_chunks(spark, d):
    chunks = read(spark, d, "documents").select("doc_id", F.posexplode(text.paragraph_chunks(F.col("text"), 1000)).alias("chunk", "body"))
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max(F.length("body")).alias("longest"), F.sum(F.length("body")).alias("chars"))


def value_normalise(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", F.md5(text.normalise_value(t)).alias("norm"), F.md5(text.strip_markup(t)).alias("plain"), F.size(text.ascii_tokens(t)).alias("tokens"), F.size(text.keywords(t)).alias("keywords"))


def token_dice(spark, d):
    c = read(spark, d, "conversations")
    pairs = c.alias("a").join(c.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.turn") + 1 == F.col("b.turn")))
    return pairs.select(F.col("a.conv_id").alias("conv_id"), F.col("a.turn").alias("turn"), F.round(text.token_dice(F.col("a.text"), F.col("b.text")), 6).alias("dice"))


def page_characters(spark, d):
    return read(spark, d, "documents").groupBy("source", text.page_character(F.col("text")).alias("character")).agg(F.count("*").alias("n"))


def typed_values(spark, d):
    part = read(spark, d, "part")
    raw = F.when(F.col("p_size") % 4 == 0, F.format_string("about %,d", (F.col("p_size") * 1000).cast("bigint"))).when(F.col("p_size") % 4 == 1, F.format_string("%d.5%%", F.col("p_size"))).when(F.col("p_size") % 4 == 2, F.lit("Yes.")).otherwise(F.col("p_name"))
    return part.select("p_partkey", text.numeric_value(raw).alias("number"), F.coalesce(text.binary_value(raw), F.lit(False)).alias("binary"), text.slug(F.col("p_name")).alias("slug"))


def citations(spark, d):
    n = F.col("o_orderkey").cast("string")
    raw = F.concat(F.lit("Value "), n, F.lit(" holds ["), F.concat(F.lit("C"), F.lpad(n, 6, "0")), F.lit(", C0002] and [note]."), F.when(F.col("o_orderkey") % 2 == 0, " [C0001]").otherwise(""))
    return read(spark, d, "orders").select("o_orderkey", F.array_join(text.cited_ids(raw), ",").alias("ids"), text.has_citation(raw).alias("cited"), text.strip_citations(raw).alias("bare"))


QUERIES = {f.__name__: f for f in (url_normalise, url_domains, locale_key_dedup, path_classes, page_links, link_relevance, bm25_documents, top_links, crawl_depth, chunk_windows, paragraph_chunks, value_normalise, token_dice, page_characters, typed_values, citations)}

_STOP = ", ".join(f"'{w}'" for w in text.LINK_STOPWORDS)
_TOK = "list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda w: length(w) >= {} AND w NOT IN ({}))"
_PARTS = r"""u AS (SELECT page_id, url, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q FROM pages)"""
ORACLES = {
    "url_normalise": rf"""WITH {_PARTS}, k AS (SELECT *, list_filter(string_split(q, '&'), lambda p: p <> '' AND NOT lower(p) LIKE 'utm\_%' ESCAPE '\' AND lower(split_part(p, '=', 1)) NOT IN ('hslang', 'gclid', 'fbclid', 'msclkid')) AS kept FROM u)
SELECT page_id, rtrim(CASE WHEN q = '' THEN split_part(url, '#', 1) WHEN len(kept) > 0 THEN split_part(split_part(url, '#', 1), '?', 1) || '?' || array_to_string(kept, '&') ELSE split_part(split_part(url, '#', 1), '?', 1) END, '/') AS normal FROM k""",
    "url_domains": rf"""WITH {_PARTS}, l AS (SELECT *, string_split(lower(host), '.') AS h, string_split(regexp_replace(lower(host), '^www\.', ''), '.') AS r FROM u)
SELECT page_id, array_to_string(h[-2:], '.') AS site, array_to_string(r[-2:], '.') AS registrable, r[-2:][1] AS brand, array_to_string(r, '.') AS domain, sha256(url) AS cache_key FROM l""",
    "locale_key_dedup": rf"""WITH {_PARTS}, s AS (SELECT *, list_transform(string_split(path, '/'), lambda s: CASE WHEN s <> '' AND regexp_full_match(lower(regexp_replace(s, '\.html$', '')), '[a-z]{{2}}([_-][a-z]{{2}})?') THEN CASE WHEN s LIKE '%.html' THEN '{{locale}}.html' ELSE '{{locale}}' END ELSE s END) AS seg, string_split(replace(host, 'www.', ''), '.') AS h FROM u),
k AS (SELECT page_id, url, CASE WHEN len(h) >= 3 AND regexp_full_match(lower(h[1]), '[a-z]{{2}}([_-][a-z]{{2}})?') THEN '{{locale}}.' || array_to_string(h[2:], '.') ELSE array_to_string(h, '.') END || array_to_string(seg, '/') || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS key FROM s)
SELECT key, arg_min(url, page_id) AS first, count(*) AS variants FROM k GROUP BY 1""",
    "path_classes": r"""WITH v AS (SELECT page_id, regexp_replace(url || CASE page_id % 5 WHEN 0 THEN '/privacy-policy.html' WHEN 1 THEN '/wp-json/x' WHEN 2 THEN '/logo.PNG/' ELSE '/news' END, '[?#][^/]*', '', 'g') AS url FROM pages),
p AS (SELECT page_id, list_transform(list_filter(string_split(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> ''), lambda s: regexp_replace(s, '\.(html?|php|aspx?|jsp|cfm)$', '', 'i')) AS s FROM v)
SELECT page_id, len(list_filter(s, lambda x: lower(x) = 'privacy-policy')) > 0 AS legal, len(list_filter(s, lambda x: x = 'wp-json')) > 0 AS blocked, lower(s[-1]) LIKE '%.png' AS asset, array_to_string(s, '|') AS segments FROM p""",
    "page_links": rf"""WITH {_PARTS}, a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS root FROM pages),
t AS (SELECT DISTINCT page_id, url, rtrim(root || href, '/') AS target FROM a)
SELECT url AS page, count(DISTINCT target) AS n_links, min(target) AS least FROM t WHERE NOT regexp_matches(lower(target), '\.(png|jpg|jpeg|gif|svg|webp|ico|css|js|mp4|webm|pdf|zip)$') GROUP BY 1""",
    "bm25_documents": f"""WITH q AS (SELECT unnest(['thing', 'article', 'heading', 'andthe', 'shore', 'one', 'things']) AS term, unnest([3.0, 3.0, 3.0, 3.0, 3.0, 1.0, 1.0]) AS weight),
t AS (SELECT source, doc_id, {_TOK.format("text", 3, _STOP)} AS tok FROM documents), s AS (SELECT source, doc_id, len(tok) AS len FROM t),
st AS (SELECT source, count(*) AS n, avg(len) AS mean_len FROM s GROUP BY 1), e AS (SELECT source, doc_id, unnest(tok) AS term FROM t),
tf AS (SELECT source, doc_id, term, weight, count(*) AS tf FROM e JOIN q USING (term) GROUP BY ALL), df AS (SELECT source, term, count(*) AS df FROM tf GROUP BY ALL),
r AS (SELECT s.source, s.doc_id, coalesce(sum(weight * greatest(0.0, ln(1 + (n - df + 0.5) / (df + 0.5))) * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * len / mean_len))), 0.0) AS raw
  FROM s JOIN st USING (source) LEFT JOIN tf USING (source, doc_id) LEFT JOIN df USING (source, term) GROUP BY ALL)
SELECT source, doc_id, round(raw, 6)::DOUBLE AS raw, round(CASE WHEN max(raw) OVER (PARTITION BY source) > 0 THEN raw / max(raw) OVER (PARTITION BY source) ELSE 0.0 END, 6)::DOUBLE AS score FROM r""",
    "top_links": """WITH s AS (SELECT l_orderkey AS page, l_partkey AS target, l_quantity / 50 AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity / 50 DESC, l_linenumber * 1000000 + l_partkey) AS rank FROM lineitem),
g AS (SELECT *, max(score) OVER (PARTITION BY page) AS best FROM s)
SELECT page, target, score, rank::INT AS rank FROM g WHERE (rank <= 3 AND score >= 0.9) OR (best < 0.9 AND rank <= 2)""",
    "crawl_depth": """WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS page, l_suppkey AS target FROM lineitem),
w AS (SELECT p_partkey AS seed, p_partkey AS url, 0 AS depth FROM part WHERE p_partkey % 50 = 0 UNION SELECT seed, target, depth + 1 FROM w JOIN e ON w.url = e.page WHERE depth < 3)
SELECT seed, url, min(depth)::INT AS depth FROM w GROUP BY 1, 2""",
    "chunk_windows": """WITH n AS (SELECT doc_id, text, CASE WHEN length(text) <= 800 THEN 1 ELSE ceil((length(text) - 800) / 780.0)::INT + 1 END AS n FROM documents),
c AS (SELECT doc_id, text, unnest(range(n))::INT AS chunk FROM n)
SELECT doc_id, chunk, length(substring(text, chunk * 780 + 1, 800))::INT AS n_chars, md5(substring(text, chunk * 780 + 1, 800)) AS digest FROM c""",
    "token_dice": r"""WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS w FROM conversations)
SELECT a.conv_id, a.turn, round(CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0 ELSE 2.0::DOUBLE * len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w)) END, 6) AS dice FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn""",
    "value_normalise": f"""SELECT doc_id, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS norm, md5(trim(regexp_replace(regexp_replace(text, '[|#*()/\\\\]+', ' ', 'g'), '\\s+', ' ', 'g'))) AS plain,
len({_TOK.format("text", 3, _STOP)})::INT AS tokens, len(list_distinct({_TOK.format("text", 4, _STOP)}))::INT AS keywords FROM documents""",
    "page_characters": r"""WITH l AS (SELECT doc_id, source, list_transform(list_filter(string_split(text, chr(10)), lambda p: trim(p) <> ''), lambda p: len(regexp_split_to_array(trim(p), '\s+'))) AS w FROM documents),
c AS (SELECT source, CASE WHEN len(w) = 0 THEN 'empty' WHEN list_sum(w) < 80 THEN 'too_short' WHEN len(list_filter(w, lambda x: x >= 8)) / len(w) >= 0.25 THEN 'good' WHEN len(list_filter(w, lambda x: x <= 3)) / len(w) >= 0.65 THEN 'nav_heavy' ELSE 'mixed' END AS character FROM l)
SELECT source, character, count(*) AS n FROM c GROUP BY ALL""",
    "typed_values": """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size * 1000.0::DOUBLE WHEN 1 THEN p_size + 0.5::DOUBLE END AS number, p_size % 4 = 2 AS binary, replace(p_name, ' ', '-') AS slug FROM part""",
    "citations": """SELECT o_orderkey, 'C' || lpad(o_orderkey::VARCHAR, 6, '0') || ',C0002' || CASE WHEN o_orderkey % 2 = 0 THEN ',C0001' ELSE '' END AS ids, true AS cited, 'Value ' || o_orderkey || ' holds and [note].' AS bare FROM orders""",
}
