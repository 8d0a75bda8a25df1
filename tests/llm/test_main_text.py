"""HTML extraction: whole pages against their article, odd markup, defined cases."""

import html
import re

from citeloom.llm import main_text as mt
from citeloom.llm._common import table
from citeloom.llm.main_text import extract, main_text

LONG = "This is a paragraph of the article that is long enough to surge above the rest of the page. "


def test_all_pages_give_their_article(spark):
    pages = {r["page_id"]: r["html"] for r in table(spark, "/root/testdata/sf0.01", "pages").collect()}
    got = extract(table(spark, "/root/testdata/sf0.01", "pages")).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r["text"] == "\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"])


def test_all_pages_without_telling_tags_and_classes(spark):
    """With every container a plain div, windows alone find the article; lines that stand in it without a surge may go."""
    pages = [r["html"] for r in table(spark, "/root/testdata/sf0.01", "pages").collect()]
    same = 0
    for page in pages:
        bare = re.sub(r"<(/?)(article|main|nav|aside|footer|header|menu|form|section)\b", r"<\1div", page)
        bare = re.sub(r"\s(class|id|role)=(\"[^\"]*\"|[^\s>]+)", "", bare)
        same += main_text(bare) == main_text(page)
    assert same >= 0.85 * len(pages)


def test_windows_surges_and_dives_decide(monkeypatch):
    page = f"<body><div><p>Home<p>News<p>About</div><div><p>A short offer.</div><div><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div><div><p>Share<p>Print</div><div>All rights reserved by the owner of this page.</div>"
    assert main_text(page) == f"Title\n{LONG.strip()}\n{LONG.strip()}"
    monkeypatch.setattr(mt, "SURGE", 10**9)
    assert main_text(page) == f"Title\n{LONG.strip()}\n{LONG.strip()}"
    monkeypatch.setattr(mt, "SURGE", 20)
    monkeypatch.setattr(mt, "PART", 0.05)
    assert main_text(page).endswith("owner of this page.")


def test_an_articles_own_parts_stay():
    for part in (f"<section class='discussion'><h2>Discussion</h2><p>{LONG}</p></section>", f"<p class='search'>{LONG}</p>", f"<svg><p>{LONG}</p>"):
        assert main_text(f"<article><h1>Title</h1><p>{LONG}</p>{part}<p>End of it.</p></article>").endswith(f"{LONG.strip()}\nEnd of it.")
    assert main_text(f"<p>{LONG}{LONG}</p><div class='discussion'><p>{LONG}</p></div>") == f"{LONG}{LONG}".strip()


def test_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", f"<p>{LONG}</p>", "x", 3)], "page_id bigint, url string, html string, text string, N_chars int")
    assert extract(pages).collect()[0]["text"] == LONG.strip()


def test_page_without_article_element():
    page = f"<body><header><a href=x>Home</a></header><div class='cookie-notice'>We use cookies</div><div id=content><h1>Title &amp; more</h1><p>{LONG}<p>Second&nbsp;para <a href=q>link</a>.<ul><li>a<li>b</ul></div><aside>side</aside><div class='comments'><p>{LONG}{LONG}</p></div><form>search<input></form><footer>c</footer>"
    assert main_text(page) == f"Title & more\n{LONG.strip()}\nSecond para link.\na\nb"


def test_gap_inside_an_article_does_not_cut_it():
    page = f"<article><p>{LONG}</p><div class='ad'>buy</div><p>End.</p><section class='related'><p>{LONG}</p></section></article><footer>f</footer>"
    assert main_text(page) == f"{LONG.strip()}\nEnd."


def test_scripts_comments_and_cut_tags():
    assert main_text('<p>one <b>two</b><script>var a="</p>";</script> three<!-- x > y --> &lt;four&gt;</p><p class="x') == "one two three <four>"
    assert main_text("plain text only") == "plain text only"
    assert main_text("<style>p{}</style>") == ""


def test_defined_cases(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", f"<p>{LONG}</p>"), (4, "u", "<p>" + "word " * 200_000 + "</p>"), (4, "u", "<p>short</p>")], "page_id bigint, url string, html string")
    got = {(r["page_id"], r["n_chars"]) for r in extract(pages).collect()}
    assert got == {(1, 0), (2, 0), (None, len(LONG.strip())), (4, 999_999), (4, 5)}
    assert extract(pages.where("false")).count() == 0


def test_windows_choose_on_marked_pages():
    teasers = "<article><a href=t>Teaser</a></article><article><h2>One</h2></article>"
    assert main_text(f"<body><div><p>{LONG}</p><p>{LONG}</p></div>{teasers}") == f"{LONG.strip()}\n{LONG.strip()}"
    menu = "".join(f"<p><a href=x>Link number {k} to another long page of this site</a></p>" for k in range(4))
    assert main_text(f"<article><p>{LONG}</p>{menu}<p>tail</p></article>") == LONG.strip()
    assert main_text(f"<p>{LONG}</p><article><p>{LONG}</p></article><p>{LONG}</p>") == LONG.strip()
    assert main_text(f"<article><h1><a href=t>Title</a></h1><p>{LONG}</p></article>") == f"Title\n{LONG.strip()}"


def test_classes_and_forms_that_wrap_the_page():
    want = LONG.strip()
    assert main_text(f"<html class='no-sidebar'><body class='single has-sidebar'><article class='post tag related'><p>{LONG}</p></article></body></html>") == want
    assert main_text(f"<div id=page class='no-sidebar'><div class='form skip'><p>{LONG}</p><div class=sidebar>{LONG[:40]}</div></div></div><footer>f</footer>") == want
    assert main_text(f"<p>We use cookies on this site, and here is a line about them.</p><form><h1>Title</h1><p>{LONG}</p><div class=comments>{LONG}{LONG}</div></form>").endswith(f"Title\n{want}")
    assert main_text(f"<body><p>{LONG}</p><div class=comments><p>{LONG}{LONG}</p></div><form>{LONG}{LONG}</form>") == want
    assert main_text(f"<body><div hidden class=ad><h1>No</h1>{LONG * 9}</div><p>{LONG}</p>") == want
