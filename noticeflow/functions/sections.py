"""Markdown source documents: sections, title, body."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.functions.html import clean_flat_udf
from noticeflow.functions.text import WHITE, let, looks_like_html, strip

# The form of a heading, and the headings with a meaning.
HEADING = r"^\s{0,3}#{1,6}\s*(.+?)\s*$"
TITLE, BODY = "标题", "正文"
# The same form as Python says it: a dot of Java's stops at every line end.
PY_HEADING = re.compile(r"^\s{0,3}#{1,6}\s*([^\n\r\x85\u2028\u2029]+?)\s*(?=[\x85\u2028\u2029]?\Z)", re.ASCII)


def unified(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n"))


def sections(c: Column) -> Column:
    """TXT13, WIN5: heading, heading_line, content, raw of each section, in order. What stands before
    the first heading has a null heading. Sections are slices between the places of headings, so the
    work grows with the text."""

    def shaped(s: Column) -> Column:
        body = F.array_join(s["lines"], "\n")
        head = s["heading_line"]
        return F.struct(
            F.when(head.isNotNull(), strip(F.regexp_extract(head, HEADING, 1))).alias("heading"),
            F.when(head.isNotNull(), strip(head)).alias("heading_line"),
            strip(body).alias("content"),
            strip(F.concat_ws("\n", head, F.when(F.size(s["lines"]) > 0, body))).alias("raw"),
        )

    def cut(x: Column) -> Column:
        lines, heads = x["lines"], x["heads"]
        ends = F.concat(heads, F.array(F.size(lines) + 1))
        before = F.get(ends, F.lit(0)) - 1
        first = F.struct(F.lit(None).cast("string").alias("heading_line"), F.slice(lines, F.lit(1), before).alias("lines"))
        own = lambda h, k: F.struct(F.get(lines, h - 1).alias("heading_line"), F.slice(lines, h + 1, F.get(ends, k + 1) - h - 1).alias("lines"))
        none = F.array().cast("array<struct<heading_line:string,lines:array<string>>>")
        return F.transform(F.concat(F.when(before > 0, F.array(first)).otherwise(none), F.transform(heads, own)), shaped)

    places = lambda lines: F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.get(lines, i - 1).rlike(HEADING))
    return let(let(F.split(unified(c), "\n"), lambda lines: F.struct(lines.alias("lines"), places(lines).alias("heads"))), cut)


def title(parts: Column) -> Column:
    """PRJ17: the content of the title section: the heading itself, else the first that holds it and
    isn't the body's."""
    exact = F.filter(parts, lambda s: s["heading"] == TITLE)
    near = F.filter(parts, lambda s: s["heading"].contains(TITLE) & ~s["heading"].contains(BODY))
    return F.coalesce(F.get(exact, F.lit(0))["content"], F.get(near, F.lit(0))["content"], F.lit(""))


def body(parts: Column) -> Column:
    """The content of the first body section, '' if there is none."""
    return F.coalesce(F.get(F.filter(parts, lambda s: s["heading"] == BODY), F.lit(0))["content"], F.lit(""))


def cleaned_body(raw_body: Column) -> Column:
    """PRJ19: a body that is HTML, cleaned with its table cells flattened; other bodies stay, and aren't parsed."""
    html = looks_like_html(raw_body)
    cleaned = strip(clean_flat_udf(F.when(html, raw_body)))
    return F.when(html & (cleaned != ""), cleaned).otherwise(raw_body)


def rebuilt(c: Column, parts: Column, new_body: Column) -> Column:
    """PRJ19: the document with its first body section replaced."""
    at = F.array_position(F.transform(parts, lambda s: F.coalesce(s["heading"], F.lit("")) == BODY), True)
    raws = F.transform(parts, lambda s: s["raw"])
    place = F.greatest(at, F.lit(1)).cast("int")
    new = F.concat_ws("\n\n", F.get(parts, place - 1)["heading_line"], F.when(new_body != "", new_body))
    texts = F.concat(F.slice(raws, F.lit(1), place - 1), F.array(new), F.slice(raws, place + 1, F.greatest(F.size(raws) - place, F.lit(0))))
    return F.when(at == 0, unified(c)).otherwise(strip(F.array_join(F.filter(texts, lambda t: t != ""), "\n\n")))


def rows(docs: DataFrame, key: str, source: str) -> DataFrame:
    """TXT13 as a table function: key, pos, heading, heading_line, content, raw, a row a section."""
    return docs.select(key, F.posexplode(sections(F.col(source))).alias("pos", "s")).select(key, "pos", "s.*")


def section_rows(text: str | None) -> Iterator[tuple[int, str | None, str | None, str, str]]:
    """TXT13: pos, heading, heading_line, content, raw, section by section, with one line at a time."""
    s = (text or "").replace("\r\n", "\n").replace("\r", "\n").strip(WHITE)
    at, start, pos, line, head = 0, 0, 0, None, None

    def section(end: int) -> tuple[int, str | None, str | None, str, str]:
        body = s[start:end]
        return pos, head, None if line is None else line.strip(WHITE), body.strip(WHITE), (body if line is None else f"{line}\n{body}").strip(WHITE)

    while at <= len(s):
        end = s.find("\n", at)
        end = len(s) if end < 0 else end
        found = PY_HEADING.match(s[at:end]) if s.find("#", at, end) >= 0 else None
        if found:
            if line is not None or at > 0:
                yield section(max(at - 1, start))
                pos += 1
            line, head, start = s[at:end], found[1].strip(WHITE), end + 1
        at = end + 1
    yield section(len(s))


def lateral_rows(docs: DataFrame, key: str, source: str) -> DataFrame:
    """TXT13: rows as a table function joined laterally: a document's sections go out as they are found,
    so none holds all its slices at once. A null text has one empty section."""

    @F.udtf(returnType="pos int, heading string, heading_line string, content string, raw string")
    class Sections:
        def eval(self, text: str) -> Iterator[tuple]:
            yield from section_rows(text)

    return docs.select(key, source).lateralJoin(Sections(F.col(source).outer())).drop(source)


def stage_text(c: Column) -> Column:
    """PRJ18, EXT2: primary and secondary, what a stage reads of a document: the first title's and the
    first body's content under marks, and all other sections. A document without these, or with both
    empty, is primary as a whole."""
    body_of = lambda s: F.coalesce(s["heading"].contains(BODY), F.lit(False))
    title_of = lambda s: F.coalesce(s["heading"].contains(TITLE), F.lit(False)) & ~body_of(s)

    def place(parts: Column, wanted: Callable[[Column], Column]) -> Column:
        return F.array_position(F.transform(parts, wanted), True)

    def marked(mark: str, parts: Column, at: Column) -> Column:
        content = F.get(parts["content"], (at - 1).cast("int"))
        return F.when((at > 0) & (content != ""), F.concat(F.lit(f"【{mark}】\n"), content))

    def cut(x: Column) -> Column:
        parts, title_at, body_at = x["parts"], x["title_at"], x["body_at"]
        primary = F.concat_ws("\n\n", marked(TITLE, parts, title_at), marked(BODY, parts, body_at))
        others = F.filter(F.transform(parts["raw"], lambda r, i: F.when((i + 1 != title_at) & (i + 1 != body_at) & (r != ""), r)), lambda r: r.isNotNull())
        return F.struct(
            F.when(primary == "", x["whole"]).otherwise(primary).alias("primary"),
            F.when(primary == "", "").otherwise(F.array_join(others, "\n\n")).alias("secondary"),
        )

    def placed(x: Column) -> Column:
        return F.struct(x["whole"].alias("whole"), x["parts"].alias("parts"), place(x["parts"], title_of).alias("title_at"), place(x["parts"], body_of).alias("body_at"))

    return let(let(let(unified(c), lambda s: F.struct(s.alias("whole"), sections(s).alias("parts"))), placed), cut)


def primary_secondary(parts: Column) -> tuple[Column, Column]:
    """Title and body sections as they stand, and all others; what stages read is stage_text."""
    main = lambda s: F.coalesce(s["heading"].isin(TITLE, BODY) | s["heading"].contains(TITLE), F.lit(False))
    join = lambda xs: F.array_join(F.transform(xs, lambda s: s["raw"]), "\n\n")
    return join(F.filter(parts, main)), join(F.filter(parts, lambda s: ~main(s)))
