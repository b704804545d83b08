"""HTML: cleaning, plain text, Markdown and the scoring of containers, over a small tree that the
standard library's parser builds. Arrow functions, one batch of pages at a time."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tags that hold no content, functional classes, attributes that stay, caps.
NOISE_TAGS = "script style noscript svg canvas header nav footer aside form input button select option textarea meta link title head".split()
CHROME_CLASSES = ["ccui-notice-app-container-detail-right", "notice-timeout-label", "notice-timeout-value", "notice-timeout-btn"]
DETAIL_CLASSES = ["content_body_box_body", "home_fulltext", "ccui-notice-app-container-detail-left", "ccui-notice-app-container-detail-body", "ccui-notice-app-container-detail", "notice-detail-li-con rich-text", "notice-detail-li-con", "rich-text", "notice-detail-content", "detail-content", "detailCon", "detail-con", "section-row", "contact-table", "template-notice-detail-body", "template-notice-detail-left"]
VOID_TAGS = "area base br col embed hr img input link meta param source track wbr".split()
KEPT_ATTRIBUTES = {"a": ["href"], "td": ["rowspan", "colspan"], "th": ["rowspan", "colspan"]}
SRCDOC_MIN, INPUT_CAP, DETAIL_MIN = 1000, 50_000, 30
CONTENT_WORDS, CHROME_WORDS = ["content", "article", "detail", "main", "body", "text"], ["nav", "menu", "sidebar", "footer", "header", "breadcrumb", "comment", "ads", "share"]
DEAD_LINKS = ("#", "javascript:", "mailto:", "tel:")
# Weights of a container's score: per character of links, link, list item and table; classes.
SCORE = {"min_length": 200, "link_text": -2, "link": -20, "item": -5, "table": 80, "content": 500, "chrome": -1000}


class Node:
    """An element (name set), a text (data set) or a comment (data set, name '!')."""

    __slots__ = ("attrs", "children", "data", "name", "parent")

    def __init__(self, name: str | None = None, attrs: dict[str, str] | None = None, data: str = ""):
        self.name, self.attrs, self.data = name, attrs or {}, data
        self.children: list[Node] = []
        self.parent: Node | None = None

    def add(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def walk(self) -> Iterator[Node]:
        """All nodes below, in order; without recursion, as pages nest deeply."""
        todo = [iter(self.children)]
        while todo:
            for x in todo[-1]:
                yield x
                todo.append(iter(x.children))
                break
            else:
                todo.pop()

    def elements(self) -> Iterator[Node]:
        return (x for x in self.walk() if x.name and x.name != "!")

    def swap(self, new: list[Node]) -> None:
        at = self.parent.children.index(self)
        for x in new:
            x.parent = self.parent
        self.parent.children[at : at + 1] = new

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def text(self, between: str = "") -> str:
        return between.join(x.data for x in self.walk() if x.name is None)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("[document]")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = self.at.add(Node(tag, {k: v or "" for k, v in attrs}))
        if tag not in VOID_TAGS:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.add(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not self.root and node.name != tag:
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.add(Node(data=data))

    def handle_comment(self, data: str) -> None:
        self.at.add(Node("!", data=data))


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def render(root: Node) -> str:
    out: list[str] = []
    todo: list[Node | str] = list(reversed(root.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.name is None:
            out.append(escape(x.data, quote=False))
        elif x.name == "!":
            out.append(f"<!--{x.data}-->")
        else:
            attrs = "".join(f' {k}="{escape(v)}"' for k, v in x.attrs.items())
            if x.name in VOID_TAGS:
                out.append(f"<{x.name}{attrs}/>")
            else:
                out.append(f"<{x.name}{attrs}>")
                todo.append(f"</{x.name}>")
                todo += reversed(x.children)
    return "".join(out)


def _drop(root: Node, bad: Callable[[Node], bool]) -> None:
    todo = [root]
    while todo:
        x = todo.pop()
        x.children = [c for c in x.children if not bad(c)]
        todo += x.children


def _hidden(x: Node) -> bool:
    style = x.attrs.get("style", "").replace(" ", "").lower()
    return "hidden" in x.attrs or x.attrs.get("aria-hidden") == "true" or x.attrs.get("role") == "dialog" or x.attrs.get("aria-modal") == "true" or "display:none" in style or "visibility:hidden" in style


def _embedded(root: Node) -> None:
    """Frames that carry a whole document give their place to it."""
    for frame in [x for x in root.elements() if x.name == "iframe"]:
        inner = frame.attrs.get("srcdoc", "").strip()
        if len(inner) >= SRCDOC_MIN:
            doc = parse(inner)
            body = next((x for x in doc.elements() if x.name == "body"), doc)
            box = Node("div")
            for c in body.children:
                box.add(c)
            frame.swap([box])


def _unwrap(root: Node, names: set[str]) -> None:
    for x in reversed([x for x in root.elements() if x.name in names]):
        x.swap(x.children)


def _cleaned(html: str, chrome: bool, unwrap: set[str]) -> Node:
    root = parse(html)
    _embedded(root)
    _drop(root, lambda x: x.name == "!" or x.name in NOISE_TAGS or chrome and any(c in CHROME_CLASSES for c in x.classes()))
    _drop(root, lambda x: bool(x.name) and _hidden(x))
    for img in [x for x in root.elements() if x.name == "img"]:
        alt = img.attrs.get("alt", "").strip()
        img.swap([Node(data=alt)] if alt else [])
    if chrome:
        for frame in [x for x in root.elements() if x.name == "iframe"]:
            src = frame.attrs.get("src", "").strip()
            p = Node("p")
            if src:
                p.add(Node("a", {"href": src})).add(Node(data=src))
            frame.swap([p] if src else [])
    _unwrap(root, unwrap)
    for x in root.walk():
        if x.name:
            x.attrs = {k: x.attrs[k] for k in KEPT_ATTRIBUTES.get(x.name, []) if k in x.attrs and (x.attrs[k] or k != "href")}
        else:
            x.data = x.data.replace("\xa0", " ")
    return root


def clean_for_extraction(html: str | None, cap: int = INPUT_CAP) -> tuple[str, bool]:
    """CLN1: what an extractor reads, and whether it was cut."""
    s = (html or "").strip()
    if not s:
        return "", False
    out = render(_cleaned(s, False, {"span", "font"}))
    for tag in ("strong", "p"):
        out = re.sub(rf"</{tag}>\s*<{tag}>", "", out)
    out = re.sub(r"\s*？\s*", "", out)
    return out[:cap].strip(), len(out) > cap


def clean_content(html: str | None, flatten_cells: bool = False) -> str:
    """CLN2: the content as HTML, without page chrome."""
    return render(_cleaned(html, True, {"span", "font"} | ({"td", "th"} if flatten_cells else set()))) if html else ""


def plain_text(html: str | None) -> str:
    """TXT10: text alone, white space collapsed."""
    root = parse(html or "")
    _drop(root, lambda x: x.name == "!" or x.name in ("script", "style"))
    return " ".join(root.text(" ").split())


def score(x: Node) -> float:
    """CLN4: how much an element looks like the content of its page."""
    length = len("".join(x.text().split()))
    if length < SCORE["min_length"]:
        return float("-inf")
    links = [a for a in x.elements() if a.name == "a" and a.attrs.get("href", "").strip() and not a.attrs["href"].strip().lower().startswith(DEAD_LINKS)]
    names = " ".join([*x.classes(), x.attrs.get("id", "")]).lower()
    out = length + SCORE["link_text"] * sum(len("".join(a.text().split())) for a in links) + SCORE["link"] * len(links)
    out += SCORE["item"] * sum(c.name == "li" for c in x.elements()) + SCORE["table"] * sum(c.name == "table" for c in x.elements())
    return out + SCORE["content"] * any(w in names for w in CONTENT_WORDS) + SCORE["chrome"] * any(w in names for w in CHROME_WORDS)


def main_container(html: str | None) -> str:
    """SRC1, SRC2, AGG7: the element with a detail class and most text, else the one that scores
    best, else the page."""
    root = parse(html or "")
    _drop(root, lambda x: x.name == "!" or x.name in ("script", "style", "noscript") or bool(x.name) and _hidden(x))
    wanted = [set(c.split()) for c in DETAIL_CLASSES]
    named = [x for x in root.elements() if any(w <= set(x.classes()) for w in wanted)]
    best = max(named, key=lambda x: len(x.text().strip()), default=None)
    if best is None or len(best.text().strip()) < DETAIL_MIN:
        boxes = [(score(x), -i, x) for i, x in enumerate(x for x in root.elements() if x.name in ("div", "article", "section", "main", "td", "body"))]
        top = max(boxes, key=lambda b: b[:2], default=None)
        best = top[2] if top and top[0] > float("-inf") else root
    box = Node("[document]")
    box.children = [best] if best is not root else root.children
    return render(box)


_BLOCKS = {"p", "div", "tr", "ul", "ol", "table", "section", "article", "br", "li", "blockquote", "pre", *(f"h{i}" for i in range(1, 7))}


def markdown(html: str | None) -> str:
    """CLN3: the cleaned content in plain Markdown: headings, lists, links, emphasis, table rows."""
    root = _cleaned(html or "", True, {"span", "font"})
    out: list[str] = []
    todo: list[Node | str] = list(reversed(root.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        if x.name is None:
            out.append(re.sub(r"\s+", " ", x.data))
            continue
        before, after = ("\n", "\n") if x.name in _BLOCKS else ("", "")
        if x.name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            before += "\n" + "#" * int(x.name[1]) + " "
            after += "\n"
        elif x.name == "p":
            before, after = "\n\n", "\n\n"
        elif x.name == "li":
            before += "- "
        elif x.name in ("strong", "b"):
            before = after = "**"
        elif x.name in ("em", "i"):
            before = after = "*"
        elif x.name in ("td", "th"):
            before, after = "| ", " "
        elif x.name == "tr":
            after = "|\n"
        elif x.name == "a" and x.attrs.get("href"):
            before, after = "[", f"]({x.attrs['href']})"
        out.append(before)
        todo.append(after)
        todo += reversed(x.children)
    text = re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(out))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def _strings(f: Callable[[str | None], str]):
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: f(x if isinstance(x, str) else None))

    return run


clean_content_udf = _strings(clean_content)
clean_flat_udf = _strings(lambda x: clean_content(x, True))
plain_text_udf = _strings(plain_text)
main_container_udf = _strings(main_container)
markdown_udf = _strings(markdown)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("truncated", T.BooleanType())]))
def clean_for_extraction_udf(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([clean_for_extraction(x if isinstance(x, str) else None) for x in s], columns=["text", "truncated"])
