"""Scanning a detail page for its content: frames, containers by selector or by text, header blocks.
All boxes of a page are judged from counts and places made in one walk, so nesting costs nothing."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.functions.html import VOID_TAGS, Node, clean_content, main_container, parse, plain_text, render

# Words of a detail page, labels of its header, selectors, patterns of class and id.
KEYWORDS = ["公告内容", "公告标题", "项目编号", "发布时间", "发布日期", "公告时间", "公告日期", "附件列表", "物资信息", "相关公告列表"]
LABELS = ["发布日期", "发布时间", "公告时间", "公告日期", "项目名称", "项目编号", "招标编号", "采购编号", "招标单位", "采购单位", "需求单位", "截止时间", "招标类型", "采购方式", "联系人"]
DATE_LABELS = ["发布日期", "发布时间", "公告时间", "公告日期"]
DETAIL_SELECTORS = [
    "article", "main", "[role='main']",
    "#detail", ".detail", ".detail-content", ".detailCon", ".detail-con",
    ".notice-detail", ".noticeDetail", ".notice-detail-content",
    ".article", ".article.white", ".paragraph-box", ".article-materials",
    ".ccui-notice-app-container-detail", ".ccui-notice-app-container-detail-body",
    ".ccui-notice-app-container-detail-left", ".template-notice-detail-body",
    ".template-notice-detail-left", ".notice-detail-ul",
    ".notice-detail-li-con", ".notice-detail-li-con.rich-text", ".rich-text",
    "#content", ".content", "#main", ".main",
]
HEADER_SELECTORS = [
    ".ccui-notice-app-container-detail-left", ".ccui-notice-app-container-detail-body", ".ccui-notice-app-container-detail",
    ".notice-title", ".notice-project-info", ".detail-title", ".article-title", ".project-info", ".notice-info", ".base-info",
    "[class*='title']", "[class*='header']", "[class*='project-info']", "[class*='notice-info']", "[class*='meta']",
    "[id*='title']", "[id*='header']",
]
HEADER_DROPPED = ["ccui-notice-app-container-detail-right", "notice-timeout-label", "notice-timeout-value", "notice-timeout-btn"]
BOX_TAGS = ["div", "section", "main", "article"]
BLOCK_TAGS = ["div", "section", "article", "main", "table", "dl", "ul", "li", "p"]
CONTROLS = ["button", "input", "select", "textarea"]
DETAIL_NAMES = re.compile("article|paragraph|notice|detail|rich-text|content|material|attachment")
SHELL_NAMES = re.compile("header|footer|nav|breadcrumb|search|menu|help|copy-right|copyright|catalog|classes|service")
HEADER_NAMES = ["title", "header", "project-info", "notice-info", "meta"]
HEADER_BOXES = [(re.compile("ccui-notice-app-container-detail-left"), 2500), (re.compile("ccui-notice-app-container-detail-body"), 800), (re.compile(r"ccui-notice-app-container-detail\b"), 500)]
HEADER_CHROME = re.compile("right|timeout|btn|button|action")
BLOCK_NAMES = re.compile("detail|meta|info|title|header|project|notice")
BLOCK_CHROME = re.compile("nav|breadcrumb|menu|footer|sidebar|side-bar|right|timeout|btn|button|action|filter|search|pagination|pager|login|register|share")
# Weights, least and most lengths.
DETAIL = {"least": 80, "keyword": 20000, "table": 500, "link": -200, "item": -50, "detail": 3000, "shell": -6000}
HEADER = {"least": 20, "name": 2200, "label": 1800, "chrome": -5000, "control": -1500, "link": -250, "short": 60, "short_control": -5000, "long": 2000, "long_off": -1000}
BLOCK = {"least": 20, "most": 2500, "date": 5000, "label": 900, "pair": 700, "table": 120, "length": 600, "name": 1200, "chrome": -5000, "control": -2500, "link": -500, "items": 20, "item": -80, "long": 1200, "long_off": -2, "wanted": 4800}
FRAME_SOURCE, FRAME_TEXT, TOP = 500, 100, 300

_SELECTOR = re.compile(r"#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<attr>\w+)(?P<op>\*?=)'(?P<val>[^']*)'\]|(?P<tag>\w+)")
_INLINE = {"a", "abbr", "b", "em", "font", "i", "label", "s", "small", "span", "strong", "sub", "sup", "u"}
_MUTE = {"script", "style", "noscript", "template", "head", "title"}
_NONE = float("-inf")


def selects(selector: str, x: Node) -> bool:
    """Whether a selector of one step names an element: tag, #id, .class, [attr='v'], [attr*='v']."""
    for m in _SELECTOR.finditer(selector):
        if m["id"]:
            ok = x.attrs.get("id") == m["id"]
        elif m["cls"]:
            ok = m["cls"] in x.classes()
        elif m["attr"]:
            have = x.attrs.get(m["attr"])
            ok = have is not None and (m["val"] in have if m["op"] == "*=" else have == m["val"])
        else:
            ok = x.name == m["tag"]
        if not ok:
            return False
    return True


def _unseen(x: Node) -> bool:
    style = x.attrs.get("style", "").replace(" ", "").lower()
    return "hidden" in x.attrs or x.attrs.get("aria-hidden") == "true" or bool(re.search(r"display:none|visibility:hidden|opacity:0(?![.\d])", style))


class Boxes:
    """The elements that show, in order: each one's place in the page's text, its last element below,
    and how many links, items, tables and controls stand before it."""

    KINDS = ("link", "item", "table", "control")

    def __init__(self, root: Node) -> None:
        self.nodes: list[Node] = []
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.last: list[int] = []
        self.before: list[tuple[int, ...]] = [(0,) * len(self.KINDS)]
        self._walk(root)
        self._places: dict[str, tuple[list[int], list[int]]] = {}

    def _walk(self, root: Node) -> None:
        parts, at, tail = [], 0, "\n"

        def say(s: str) -> None:
            nonlocal at, tail
            s = re.sub(r"\s+", " ", s)
            if tail in " \n":
                s = s.lstrip()
            if s:
                parts.append(s)
                at, tail = at + len(s), s[-1]

        def line() -> None:
            nonlocal at, tail
            if tail == " ":
                parts[-1] = parts[-1][:-1] + "\n"
            elif tail != "\n":
                parts.append("\n")
                at += 1
            tail = "\n"

        todo: list[Node | int] = list(reversed(root.children))
        while todo:
            x = todo.pop()
            if isinstance(x, int):
                if self.nodes[x].name not in _INLINE:
                    line()
                self.ends[x], self.last[x] = at, len(self.nodes)
            elif x.name is None:
                say(x.data)
            elif x.name != "!" and x.name not in _MUTE and not _unseen(x):
                if x.name not in _INLINE:
                    line()
                todo.append(len(self.nodes))
                self.nodes.append(x)
                self.starts.append(at)
                self.ends.append(at)
                self.last.append(0)
                own = (_leads(x), x.name == "li", x.name == "table", (x.name in CONTROLS) + (x.attrs.get("role") == "button"))
                self.before.append(tuple(a + b for a, b in zip(self.before[-1], own, strict=True)))
                if x.name not in VOID_TAGS:
                    todo += reversed(x.children)
        self.text = "".join(parts)

    def span(self, i: int) -> tuple[int, int]:
        a, b = self.starts[i], self.ends[i]
        while a < b and self.text[a] in " \n":
            a += 1
        while b > a and self.text[b - 1] in " \n":
            b -= 1
        return a, b

    def size(self, i: int) -> int:
        a, b = self.span(i)
        return b - a

    def counts(self, i: int) -> dict[str, int]:
        """What stands below an element, itself left out."""
        return {k: b - a for k, a, b in zip(self.KINDS, self.before[i + 1], self.before[self.last[i]], strict=True)}

    def hits(self, a: int, b: int, patterns: list[str]) -> int:
        """How many of the patterns stand in text[a:b]."""
        n = 0
        for p in patterns:
            if p not in self._places:
                found = [m.span() for m in re.finditer(p, self.text)]
                self._places[p] = ([x for x, _ in found], [y for _, y in found])
            starts, ends = self._places[p]
            k = bisect_left(starts, a)
            n += k < len(starts) and ends[k] <= b
        return n


def _leads(x: Node) -> bool:
    href = x.attrs.get("href", "").strip().lower()
    return x.name == "a" and href not in ("", "#") and not href.startswith(("javascript:", "mailto:", "tel:"))


def _names(x: Node) -> str:
    return f"{x.attrs.get('class', '')} {x.attrs.get('id', '')}".lower()


def detail_score(page: Boxes, i: int) -> float:
    """CLN4: how much a box looks like the detail of a notice."""
    a, b = page.span(i)
    if b - a < DETAIL["least"]:
        return _NONE
    n, names = page.counts(i), _names(page.nodes[i])
    out = DETAIL["keyword"] * page.hits(a, b, KEYWORDS) + (b - a) + sum(DETAIL[k] * n[k] for k in ("table", "link", "item"))
    return out + DETAIL["detail"] * bool(DETAIL_NAMES.search(names)) + DETAIL["shell"] * bool(SHELL_NAMES.search(names))


def header_score(page: Boxes, i: int) -> float:
    """CLN4: how much a box looks like the header of a notice."""
    a, b = page.span(i)
    size, n, names = b - a, page.counts(i), _names(page.nodes[i])
    if size < HEADER["least"]:
        return _NONE
    out = size + HEADER["name"] * sum(x in names for x in HEADER_NAMES) + HEADER["label"] * page.hits(a, b, LABELS)
    out += sum(w for box, w in HEADER_BOXES if box.search(names)) + HEADER["chrome"] * bool(HEADER_CHROME.search(names))
    out += HEADER["control"] * n["control"] + HEADER["link"] * n["link"]
    return out + HEADER["short_control"] * (size < HEADER["short"] and n["control"] > 0) + HEADER["long_off"] * (size > HEADER["long"])


def block_score(page: Boxes, i: int) -> float:
    """CLN4: how much a box looks like a block of a notice's dates and numbers."""
    a, b = page.span(i)
    size = b - a
    if not BLOCK["least"] <= size <= BLOCK["most"]:
        return _NONE
    dates, labels, pairs = page.hits(a, b, DATE_LABELS), page.hits(a, b, LABELS), page.hits(a, b, [rf"{x}\s?[：:]" for x in LABELS])
    if not dates and (labels < 2 or not pairs):
        return _NONE
    n, names = page.counts(i), _names(page.nodes[i])
    out = BLOCK["date"] * dates + BLOCK["label"] * labels + BLOCK["pair"] * pairs + BLOCK["table"] * n["table"] + min(size, BLOCK["length"])
    out += BLOCK["name"] * bool(BLOCK_NAMES.search(names)) + BLOCK["chrome"] * bool(BLOCK_CHROME.search(names)) + BLOCK["control"] * n["control"] + BLOCK["link"] * n["link"]
    return out + BLOCK["item"] * max(n["item"] - BLOCK["items"], 0) + BLOCK["long_off"] * max(size - BLOCK["long"], 0)


def _best(scored: Iterator[tuple[float, int]], least: float = _NONE) -> tuple[float, int | None]:
    """The first of those that score most, if that is more than `least`."""
    top, at = least, None
    for s, i in scored:
        if s > top:
            top, at = s, i
    return top, at


def _written(x: Node, dropped: tuple[str, ...] = ()) -> str:
    """An element as HTML, without scripts and without elements of the dropped classes."""

    def copy(of: Node) -> Node:
        new = Node(of.name, of.attrs, of.data)
        todo = [(of, new)]
        while todo:
            old, made = todo.pop()
            for c in old.children:
                if c.name in ("script", "style", "noscript") or c.name and any(d in c.classes() for d in dropped):
                    continue
                twin = made.add(Node(c.name, c.attrs, c.data))
                todo.append((c, twin))
        return new

    box = Node("[document]")
    if x.name == "[document]":
        return render(copy(x))
    box.add(copy(x))
    return render(box)


def frame(root: Node) -> str:
    """The document that a frame carries, if it has a page's worth of text; that of most text."""
    best, most = "", FRAME_TEXT - 1
    for x in root.elements():
        inner = x.attrs.get("srcdoc", "") if x.name == "iframe" else ""
        if len(inner) > FRAME_SOURCE and (n := len(plain_text(inner))) > most:
            best, most = inner, n
    return best


def scan(html: str | None) -> dict[str, str]:
    """SRC1: main and header of a page as HTML, and how they stand to each other. The main box is the
    best of those that the selectors name, else of the 300 boxes of most text (SRT2), else the page;
    the header is the best of its selectors' or a block of dates and numbers that beats it. A frame's
    document, where there is one, is the whole main."""
    out = dict.fromkeys(("main", "header", "relation"), "")
    root = parse(html or "")
    if inner := frame(root):
        return out | {"main": inner}
    page = Boxes(root)
    rows = range(len(page.nodes))
    of = lambda selectors: ((s, i) for s in selectors for i in rows if selects(s, page.nodes[i]))
    _, main = _best((detail_score(page, i), i) for _, i in of(DETAIL_SELECTORS))
    if main is None:
        boxes = sorted((i for i in rows if page.nodes[i].name in BOX_TAGS), key=lambda i: -page.size(i))
        _, main = _best((detail_score(page, i), i) for i in boxes[:TOP])
    top, header = _best((header_score(page, i), i) for _, i in of(HEADER_SELECTORS))
    blocks = ((s, i) for i in rows if page.nodes[i].name in BLOCK_TAGS and (s := block_score(page, i)) >= BLOCK["wanted"])
    better, block = _best(blocks, top)
    header = header if block is None else block
    out["main"] = _written(root if main is None else page.nodes[main])
    if header is not None:
        out["header"] = _written(page.nodes[header], tuple(HEADER_DROPPED))
        out["relation"] = _relation(page, header, main)
    return out


def _relation(page: Boxes, header: int, main: int | None) -> str:
    if main is None or main < header < page.last[main]:
        return "descendant"
    if header == main:
        return "same"
    return "ancestor" if header < main < page.last[header] else "disjoint"


def joined(main: str, header: str, relation: str) -> str:
    """TXT11: the header before the main part, unless one of them holds the other."""
    if not main or not header:
        return main or header
    if relation in ("same", "ancestor", "descendant") or header in main:
        return main
    said, body = plain_text(header), plain_text(main)
    if main in header or said and body and body in said and said not in body:
        return header
    return main if not said or not body or said in body else f"<div>{header}{main}</div>"


def page_content(html: str | None) -> str:
    """SRC1: the cleaned content of a page: what the scan finds, else the named or best container.
    A page without any text gives ''."""
    found = scan(html)
    return clean_content(joined(found["main"].strip(), found["header"].strip(), found["relation"])).strip() or clean_content(main_container(html)).strip()


_SCAN = T.StructType([T.StructField(k, T.StringType()) for k in ("main", "header", "relation")])


@F.pandas_udf(_SCAN)
def scan_udf(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([scan(x if isinstance(x, str) else None) for x in s], columns=_SCAN.names)


@F.pandas_udf(T.StringType())
def page_content_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: page_content(x if isinstance(x, str) else None))
