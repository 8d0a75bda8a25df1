"""A whole run with given functions, and tables of pages."""

from citeloom.operators import acquire, links
from citeloom.plans import run as runs
from citeloom.sources import request, workbook

PAGES = {"https://a.com/": "Acme sits in Oslo. It makes robots and drills for many customers around the world.", "https://a.com/more": "Acme sits in Oslo. Founded 1990."}


def fetch(url):
    return {"text": PAGES[url], "backend": "static", "passed": True}


def extract(body, questions, entities):
    got = {"HQ": {"value": "Oslo", "quote": "Acme sits in Oslo"}}
    if "robots" in body:
        got["Products"] = [{"value": "robots", "quote": "makes robots"}, {"value": "lasers", "quote": "It also makes lasers of every colour"}]
    return {entities[0]: got}


def embed(texts):
    return [[float("o" in t.lower()), float(len(t) % 3), 1.0] for t in texts]


def test_run(spark):
    book = {"entities": [["entity"], ["Acme"]], "urls": [["url"], ["a.com/"], ["a.com/more"], ["a.com/gone"]], "questions": [["question", "instructions"], ["HQ", ""], ["Products", "list all"]]}
    asked = request.read_request(workbook.write_sheets(book))
    for embedder in (None, embed):
        got = runs.run(spark, asked, fetch, extract, embedder, delay=0.0)
        assert {(r["url"], r["status"]) for r in got["log"].collect()} == {("https://a.com/", "ok"), ("https://a.com/more", "ok"), ("https://a.com/gone", "error")}
        cells = {r["question"]: r for r in got["cells"].collect()}
        assert cells["HQ"]["values"] == ["Oslo"] and cells["HQ"]["num_sources"] == 2 and cells["HQ"]["verified"]
        assert sorted(cells["Products"]["values"]) == ["lasers", "robots"] and not cells["Products"]["has_conflict"] and not cells["Products"]["verified"]
        m = got["matrix"].first()
        assert m["HQ"] == "- Oslo" and m["Products"].startswith("(unverified)")
        s = {r["question"]: r["summary"] for r in got["summaries"].collect()}
        assert s["HQ"].startswith("Oslo [C0") and s["Products"].startswith("robots [C0")
        assert got["themes"].count() == 2


def test_table_rows(spark):
    page = "<table><tr><th>A<th>B &amp; C</tr><tr><td> 1 </td><td><b>2</b></td></tr></table><table><tr><td>x</table>"
    got = links.table_rows(spark.createDataFrame([("u", page), ("v", None)], "url string, body string")).orderBy("place", "row").collect()
    assert [(r["place"], r["row"], r["cells"]) for r in got] == [(0, 0, ["A", "B & C"]), (0, 1, ["1", "2"]), (1, 0, ["x"])]
    assert acquire.same_host_name("https://www.a.com/x", "https://a.com/y")
