"""Main text of web pages by tag-path ratios.

A page is cut into text nodes: the text between two block-level tags, with the path of
block elements from the root down to it. Nodes of equal path are one group:

* ratios: a path's text length and its punctuation marks, each divided by its nodes;
* fusion: the geometric mean of the two, times the share of the path's text that is not
  inside links;
* smoothing: along the page, a node takes the average of its neighbours, weighted by a
  Gaussian of their distance, and by OUTSIDE for every level that the neighbour's
  container would have to be left. So a heading or a short list inside an article is lifted by
  the paragraphs beside it, while a notice before the article is not;
* threshold: a path is content if the smoothed ratio of its nodes is THRESHOLD of the
  page's best.

Paths through elements that a page marks as something else take no part: menus, headers
and footers (a header inside an article belongs to it), sidebars, forms, and elements
whose class, id or role has a word of NOT_CONTENT, unless they wrap an article. A page
without any other text has an empty text.

The tokenizer is forgiving: unclosed elements end with their parent, stray end tags are
skipped, a block tag ends an open paragraph, inline tags neither part text nor count in a
path. Every step takes time linear in the page.

Edge cases: a null html is empty; an empty page, or one without content, has the text ""
and n_chars 0; page_id and url are passed on as they are, null or repeated; a page of any
length is read whole; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import html as charrefs
import re
from math import exp, sqrt

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import table

#: elements whose content is not text of the page
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
SKIPPED = {"head", "select", "button", "svg", "math", "object", "canvas", "audio", "video", "datalist", "map"}
NOT_ARTICLE = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
ARTICLE = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "picture", "img", "wbr", "input",
}
#: open elements that end where one of the key begins, unless one of SCOPE stands between
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"),
    "tbody": ("tr", "thead", "tbody"), "tfoot": ("tr", "thead", "tbody"), "option": ("option",),
}
SCOPE = {"ul", "ol", "dl", "table"}
#: an open paragraph or heading ends where a block begins, unless one of these stands between
BLOCK_SCOPE = {"td", "th", "li", "table", "article", "section", "div"}
#: browsers nest no deeper; further elements belong to the one at this depth
MAX_DEPTH = 512
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: words of class, id or role that name what is not the article
NOT_CONTENT = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion",
    "nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar", "header", "masthead", "footer", "contentinfo",
    "sidebar", "aside", "complementary", "widget", "related", "recommended", "share", "sharing", "social", "subscribe", "newsletter", "signup", "login", "search",
    "comment", "comments", "commentlist", "respond", "disqus", "replies", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "disclaimer",
}
#: before such a word: a page layout, as in has-sidebar
LAYOUT = {"has", "with", "no", "without", "is"}
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？؟،]")
SIGMA, REACH, OUTSIDE, THRESHOLD = 2.0, 6, 0.05, 0.2
GAUSSIAN = [exp(-step * step / (2 * SIGMA * SIGMA)) for step in range(REACH + 1)]

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>""")
_LABEL = re.compile(r"""\b(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_WORDS = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _tokens(page: str):
    """(kind, name, attributes or text): kind is text, open or close."""
    at, end = 0, len(page)
    while at < end:
        start = page.find("<", at)
        if start < 0:
            yield "text", "", page[at:]
            return
        if start > at:
            yield "text", "", page[at:start]
        if page.startswith("<!--", start):
            close = page.find("-->", start + 4)
            at = close + 3 if close >= 0 else end
            continue
        follows = page[start + 1:start + 2]
        if follows in ("!", "?") or follows == "/" and not page[start + 2:start + 3].isalpha():
            close = page.find(">", start)
            at = close + 1 if close >= 0 else end
            continue
        if not (follows == "/" or follows.isascii() and follows.isalpha()):
            yield "text", "", "<"
            at = start + 1
            continue
        found = _TAG.match(page, start)
        if found:
            closing, name, attributes, at = found[1], found[2].lower(), found[3], found.end()
        else:  # a quote without its partner: the tag ends at the next bracket
            close = page.find(">", start)
            if close < 0:
                return
            parts = page[start + 1:close].lstrip("/").split(None, 1)
            closing, name, attributes, at = "/" if follows == "/" else "", parts[0].lower(), "", close + 1
        yield "close" if closing else "open", name, attributes
        if not closing and name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = close.start() if close else end


def _marked(attributes: str) -> bool:
    for found in _LABEL.finditer(attributes):
        for name in (found[1] or found[2] or found[3] or "").split():
            words = _WORDS.findall(_CAMEL.sub(" ", name).lower())
            if any(w in NOT_CONTENT and not (i and words[i - 1] in LAYOUT) for i, w in enumerate(words)):
                return True
    return False


class _Paths:
    """The tag paths of a page as a tree; a path is a number, 0 the root."""

    def __init__(self):
        self.parent, self.depth, self._known = [0], [0], {}

    def below(self, path: int, name: str) -> int:
        found = self._known.get((path, name))
        if found is None:
            found = self._known[path, name] = len(self.parent)
            self.parent.append(path)
            self.depth.append(self.depth[path] + 1)
        return found

    def levels_outside(self, path: int, container: int) -> int:
        """How many levels of ``container`` would have to be left until ``path`` lies below."""
        parent, depth, left = self.parent, self.depth, 0
        while depth[path] > depth[container]:
            path = parent[path]
        while depth[container] > depth[path]:
            container, left = parent[container], left + 1
        while path != container:
            path, container, left = parent[path], parent[container], left + 1
        return left


def text_nodes(page: str) -> tuple[list[tuple[int, str, int]], _Paths]:
    """(path, text, characters in links) of the nodes of a page that no element marks as something else, in order, and the paths."""
    nodes: list[tuple[int, str, int, tuple]] = []
    paths = _Paths()
    stack: list[tuple[str, int, tuple]] = []  # name, path, numbers of the marked elements from the root on
    wrappers: set[int] = set()
    parts: list[str] = []
    linked = number = beyond = skipping = 0
    in_link = False

    def flush() -> None:
        nonlocal linked
        text = "".join(parts)
        text = " ".join((charrefs.unescape(text) if "&" in text else text).split())
        if text:
            nodes.append((stack[-1][1] if stack else 0, text, min(linked, len(text)), stack[-1][2] if stack else ()))
        parts.clear()
        linked = 0

    def close(names, scope=()) -> None:
        for i in range(len(stack) - 1, -1, -1):
            name = stack[i][0]
            if name in names:
                del stack[i:]
                return
            if name in scope:
                return

    for kind, name, rest in _tokens(page):
        if kind == "text":
            if not skipping:
                parts.append(rest)
                if in_link:
                    linked += len(rest)
            continue
        if name in SKIPPED:
            skipping = max(0, skipping + (-1 if kind == "close" else not rest.endswith("/")))
            continue
        if name == "body":
            skipping = 0  # whatever the head left open
        if skipping or name in RAW:
            continue
        if name in INLINE:
            if name == "a":
                in_link = kind == "open"
            continue
        if name == "br":
            parts.append(" ")
            continue
        if parts:
            flush()
        in_link = False
        if kind == "close":
            if beyond:
                beyond -= 1
            else:
                close((name,))
            continue
        close(("p",), BLOCK_SCOPE)
        if name in HEADINGS:
            close(HEADINGS, BLOCK_SCOPE)
        for ended in ENDS.get(name, ()):
            close((ended,), SCOPE)
        if name in VOID:
            continue
        if len(stack) >= MAX_DEPTH:
            beyond += 1
            continue
        number += 1
        marks = stack[-1][2] if stack else ()
        if name in ARTICLE:
            wrappers.update(marks)
        elif name in NOT_ARTICLE or name == "header" and not any(s[0] in ARTICLE for s in stack) or rest and name not in ("html", "body") and _marked(rest):
            marks = (*marks, number)
        stack.append((name, paths.below(stack[-1][1] if stack else 0, name), marks))
    flush()
    return [n[:3] for n in nodes if wrappers.issuperset(n[3])], paths


def path_scores(nodes: list[tuple[int, str, int]], paths: _Paths) -> dict[int, float]:
    """The smoothed ratio of each path with text."""
    totals: dict[int, list[float]] = {}
    for path, text, linked in nodes:
        t = totals.setdefault(path, [0, 0, 0, 0])
        t[0] += 1
        t[1] += len(text)
        t[2] += len(PUNCTUATION.findall(text))
        t[3] += linked
    fused = {p: sqrt(chars * marks) / n * (1 - linked / chars) for p, (n, chars, marks, linked) in totals.items()}
    share: dict[tuple[int, int], float] = {}
    smooth = dict.fromkeys(totals, 0.0)
    for i, (path, text, _) in enumerate(nodes):
        weights = value = 0.0
        for j in range(max(0, i - REACH), min(len(nodes), i + REACH + 1)):
            other = nodes[j][0]
            if (path, other) not in share:
                share[path, other] = OUTSIDE ** paths.levels_outside(path, paths.parent[other])
            weight = GAUSSIAN[abs(j - i)] * share[path, other]
            weights += weight
            value += weight * fused[other]
        smooth[path] += len(text) * max(value / weights, fused[path])
    return {p: smooth[p] / totals[p][1] for p in totals}


def main_text(page: str | None) -> str:
    """The content nodes of a page, joined by empty lines."""
    nodes, paths = text_nodes(page or "")
    scores = path_scores(nodes, paths)
    least = THRESHOLD * max(scores.values(), default=0)
    return "\n\n".join(text for path, text, _ in nodes if scores[path] >= least)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    @F.pandas_udf("string")
    def run(html: pd.Series) -> pd.Series:
        return html.map(main_text)

    return pages.select("page_id", "url", run(F.coalesce(F.col("html").cast("string"), F.lit(""))).alias("text")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op12_extract(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op12_extract": op12_extract}
SQL: dict[str, str] = {}
