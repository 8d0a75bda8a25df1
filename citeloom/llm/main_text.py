"""HTML extraction by line-block distribution.

Markup is stripped into lines, one for each block element; the end of a container leaves a gap of empty lines, and so do
elements that hold no article text (menus, sidebars, forms, scripts and so on, by tag, role or class). Text lengths are
summed over a sliding window of lines. A surge is a window above a threshold and above a share of the page's fullest
window, a dive is a window without any text; the lines between the dives on either side of a surge are the main text.
Where a page names its article, tags add evidence. Article and main elements are boundaries, which no run of
lines crosses, without gaps at the containers inside, and a weight: of the runs inside and those outside of them the side
with more text is kept, where text inside counts twice. No class drops html, body, main or article, and words that an
article's own parts are named by, too, drop no paragraph and nothing inside an article; another element whose class, id
or role is on a list, or a form, is a wrapper and stays if it holds half of the page's text and either a main element or a
first heading, or far more text than what surges without it. A dropped element inside is a gap shorter than a window, so
one alone never cuts an article.

Defined cases: a null or empty page, or one without text, gives an empty text; a page where nothing surges keeps its
longest run of lines by the same weight; unclosed and unopened elements, cut-off tags and unknown references are read as browsers do,
except that an unclosed drawing, object or template hides nothing; of runs of equal weight the first is kept; a very long page is
read whole, in time in proportion to its length; a null id is kept; repeated rows give repeated results; other columns,
clashing names among them, are never read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import pick

WINDOW, SURGE = 3, 60
#: A run outside of articles surges if its fullest window holds this share of the page's fullest.
PART = 0.2
#: What text inside an article or main element counts against text outside.
WEIGHT = 2
#: A wrapper without a heading outweighs this many times the text that surges outside; wrappers that share this much are one.
OUTWEIGHS, SAME = 8, 0.95
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+>|[^>]*(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:@-][a-zA-Z0-9_:.-]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TOKEN = re.compile(r"[a-z0-9]+|[A-Z][a-z0-9]*")
_BLOCKS = frozenset("address article aside blockquote body canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template svg math iframe object xmp noframes".split())
#: Those of them that hold markup: without an end tag they are read as if they weren't there.
_OPEN = frozenset("noscript template svg math object".split())
_SKIP = frozenset("nav aside footer menu dialog button select datalist head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adsbygoogle adslot banner banners sponsor sponsored sponsors promo promos promotion promotions sidebar sidebars aside "
    "comment comments commentlist commentarea discussion disqus respond reply replies cookie cookies consent gdpr notice notices notification notifications alert alerts popup popups modal overlay lightbox "
    "newsletter subscribe subscription signup signin login register share sharing sharebar social related recommended recommendations breadcrumb breadcrumbs pagination pager footer foot menu menus nav navbar navigation "
    "topbar toolbar masthead widget widgets copyright disclaimer skip form search searchbox tags taglist".split()
)
#: Those of them that an article's own parts, or its paragraphs, are named by, too.
_WEAK = frozenset("discussion search form skip social tags reply respond register login foot aside share promotion".split())
_PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption".split())
#: Elements whose end is a dive outside of articles.
_CONTAINERS = frozenset("div section table ul ol dl center details fieldset".split())
#: Containers that an unclosed paragraph does not reach out of.
_SCOPE = frozenset("article aside blockquote body button div dl fieldset figure footer form header html li main nav ol section table tbody td th thead tr ul".split())
_CLOSES = {"li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}


def _unwanted(name: str, attributes: str, inside: bool, weak: bool) -> str:
    """Why an element is no article text: "" if it may be, "soft" by form, class, id or role, "hard" if hidden; weak: whether weak words count."""
    why = "soft" if name == "form" else ""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return why
    for m in _ATTR.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            words = {w.lower() for w in _TOKEN.findall(value)}
            if words & (_WORDS if weak else _WORDS - _WEAK) or not inside and "header" in words:
                why = "soft"
        elif key == "role" and value.lower() in _ROLES:
            why = "soft"
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "hard"
    return "" if why == "soft" and name in ("main", "article") else why


@dataclass
class Wrapper:
    """An element dropped softly, by the place of its tag: the wrapper around it, the characters in it and whether it has a main element or first heading."""

    at: int
    parent: Wrapper | None
    size: int
    head: int


def lines(page: str, spared: frozenset[int] = frozenset()) -> tuple[list[str], list[int], list[bool], list[Wrapper], int]:
    """(text, characters inside links, inside an article) of each line; a gap is a run of empty lines; wrappers and the
    characters of the page. The wrappers in spared are not dropped."""
    text: list[str] = []
    links: list[int] = []
    inside: list[bool] = []
    buffer: list[str] = []
    linked = 0
    # open elements as (name, dropped, in an article, in a link, innermost wrapper if only wrappers drop it, whether it is that)
    stack: list[tuple[str, bool, bool, bool, Wrapper | None, bool]] = []
    wrappers: list[Wrapper] = []
    dropped = article = link = False
    wrapper: Wrapper | None = None
    seen = heads = 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            line = " ".join("".join(buffer).split())
            if line:
                text.append(line)
                links.append(linked)
                inside.append(article)
            buffer.clear()
        linked = 0

    def close(k: int) -> None:
        nonlocal dropped, article, link, wrapper
        for *_, own, is_own in stack[k:]:
            if is_own and own:
                own.size, own.head = seen - own.size, heads - own.head
        del stack[k:]
        within = article
        _, dropped, article, link, wrapper, _ = stack[-1] if stack else ("", False, False, False, None, False)
        if within and not article:
            gap(WINDOW)

    def gap(size: int) -> None:
        text.extend([""] * size)
        links.extend([0] * size)
        inside.extend([article] * size)

    def add(piece: str) -> None:
        nonlocal linked, seen
        seen += len(piece.strip())
        if piece and not dropped:
            piece = html.unescape(piece) if "&" in piece else piece
            buffer.append(piece)
            if link:
                linked += len(piece.strip())

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name, closing = m[2].lower(), m[1]
        if closing:
            if name in _BLOCKS:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    flush() if name in _BLOCKS else None
                    close(k)
                    if name in _CONTAINERS and not article and not dropped:
                        gap(WINDOW)
                    break
                if stack[k][0] in _SCOPE and name not in _SCOPE:
                    break
            continue
        attributes = m[3]
        if name in _RAW and not attributes.endswith("/>"):
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else at if name in _OPEN else n
            continue
        if name == "br":
            add(" ")
            continue
        if name in _BLOCKS:
            flush()
            for k in range(len(stack) - 1, -1, -1):
                own = stack[k][0]
                if own == "p" or own in _CLOSES.get(name, "").split():
                    close(k)
                    break
                if own in _SCOPE:
                    break
        if name in _VOID:
            continue
        hard = name in _SKIP or name == "header" and not article
        why = "" if name in ("html", "body") else "hard" if hard else _unwanted(name, attributes, article, name not in _PARAGRAPHS and not any(o[0] == "article" for o in stack))
        skip = why == "hard" or why == "soft" and m.start() not in spared
        if skip and not dropped:
            flush()
            gap(1 if article else WINDOW)
        if attributes.endswith("/>") and name not in _BLOCKS:
            continue
        heads += name in ("h1", "main")
        is_own = skip and why == "soft" and (not dropped or wrapper is not None)
        if is_own:
            wrapper = Wrapper(m.start(), wrapper, seen, heads)
            wrappers.append(wrapper)
        elif skip:
            wrapper = None
        dropped = dropped or skip
        if name in ("article", "main") and not dropped and not article:
            gap(WINDOW)
            article = True
        link = link or name == "a"
        stack.append((name, dropped, article, link, wrapper, is_own))
    flush()
    close(0)
    return text, links, inside, wrappers, seen


def main_text(page: str | None) -> str:
    spared: set[int] = set()
    while True:
        text, links, inside, wrappers, size = lines(page or "", frozenset(spared))
        kept, length, surge = _choose(text, links, inside)
        more: set[int] = set()
        for w in wrappers:
            if w.parent is None:
                keeps = 2 * w.size >= size > 0 and (w.head or w.size >= OUTWEIGHS * surge)
            else:
                keeps = w.parent.at in more and w.size >= SAME * w.parent.size
            if keeps:
                more.add(w.at)
        if not more:
            break
        spared |= more
    # a line of links goes, unless it stands within a run of an article
    return "\n".join(text[k] for i, j, marked, _ in kept for k in range(i, j) if text[k] and (marked or length[k]))


def _choose(text: list[str], links: list[int], inside: list[bool]) -> tuple[list[tuple[int, int, bool, int]], list[int], int]:
    """The runs (start, end, inside, characters) that are kept, each line's length, and the characters of all runs that surge."""
    length = [len(t) if 2 * k <= len(t) else 0 for t, k in zip(text, links, strict=True)]
    # runs (start, end, inside, characters) of lines, and those of them that surge
    runs, surging, i, n = [], [], 0, len(length)
    highest = max((sum(length[k : k + WINDOW]) for k in range(n)), default=0)
    while i < n:
        if not length[i]:
            i += 1
            continue
        # a run goes on until a whole window is empty
        j, empty, size, top = i, 0, 0, 0
        while j < n and empty < WINDOW:
            # a window that begins in a gap belongs to the text behind it
            top = max(top, sum(length[j : j + WINDOW])) if length[j] else top
            size += length[j]
            empty = 0 if length[j] else empty + 1
            j += 1
        a, b = i, j - empty
        if inside[i]:
            # fewer lines of links than a window at either end, such as a linked title, belong to the article
            while i - a < WINDOW and a and inside[a - 1] and text[a - 1]:
                a -= 1
            while b - (j - empty) < WINDOW and b < n and inside[b] and text[b]:
                b += 1
            a, b = a if i - a < WINDOW else i, b if b - (j - empty) < WINDOW else j - empty
        runs.append((a, b, inside[i], size))
        if top >= (SURGE if inside[i] else max(SURGE, PART * highest)):
            surging.append(runs[-1])
        i = j
    if surging:
        within, outside = (sum(r[3] for r in surging if r[2] == side) for side in (True, False))
        kept = [r for r in surging if r[2] == (within * WEIGHT >= outside and within > 0)]
    else:
        kept = [max(runs, key=lambda r: r[3] * (WEIGHT if r[2] else 1))] if runs else []
    return kept, length, sum(r[3] for r in surging)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    narrow = pick(pages, id=id_col, url=url_col, html=html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                out = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.record_batch({"id": part.column(0), "url": part.column(1), "text": pa.array(out, pa.string()), "n_chars": pa.array([len(x) for x in out], pa.int64())})

    schema = f"id {narrow.schema['id'].dataType.simpleString()}, url {narrow.schema['url'].dataType.simpleString()}, text string, n_chars bigint"
    return narrow.mapInArrow(run, schema).withColumnsRenamed({"id": id_col, "url": url_col})
