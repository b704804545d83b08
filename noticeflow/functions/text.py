"""Text columns. White space and digits are Unicode-aware, as (?U) makes Java's patterns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space of any kind (what (?U) makes of \s), texts that mean "nothing", separators of
# listed values, the caps of texts.
WHITE = " \t\n\x0b\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
EMPTY_WORDS = ["", "[]", "null", "none", "-", "无", "暂无", "不详"]
LIST_SEPARATORS = "[,，;；、\n]+"
INPUT_CAP = 50_000
RETRY_EXCERPTS = [80_000, 30_000, 8_000]
FILE_NAME_CAP = 100
_EMPTY = rf"(?i)\A(?:{'|'.join(re.escape(w) for w in EMPTY_WORDS if w)})\z"


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c computed once: an expression that names c several times would otherwise hold it
    several times, and expressions made of such would grow with each step. Not for Python functions."""
    return F.get(F.transform(F.array(c), lambda x: f(x)), F.lit(0))


def strip(c: Column) -> Column:
    """TXT1: without white space of any kind at both ends; null is ''. Only the start is left to a pattern
    (which also makes U+FFFD of bytes that aren't UTF-8): one for the end would try every place."""
    return F.coalesce(F.rtrim(F.regexp_replace(c, r"(?U)\A\s+", ""), F.lit(WHITE)), F.lit(""))


def fold_empty(c: Column) -> Column:
    """TXT1: '' for what means nothing, else the stripped text. One step, which names c once: most texts
    of a record go through here, and in a let each would be interpreted."""
    return F.regexp_replace(strip(c), _EMPTY, "")


def join_list(items: Column) -> Column:
    """TXT2: an array of texts joined by commas, without those that mean nothing."""
    return F.coalesce(F.array_join(F.filter(F.transform(items, fold_empty), lambda x: x != ""), ","), F.lit(""))


def split_list(c: Column) -> Column:
    """TXT3: the values of a text: those of a JSON array, else those between separators."""

    def values(s: Column) -> Column:
        return F.coalesce(F.when(s.startswith("["), F.from_json(s, "array<string>")), F.split(s, LIST_SEPARATORS))

    return F.filter(F.transform(let(strip(c), values), fold_empty), lambda x: x != "")


def tidy_lines(c: Column) -> Column:
    """TXT4: one kind of line end, no white space before it, at most one empty line in a row."""
    s = F.regexp_replace(c, r"\r\n?", "\n")
    s = F.regexp_replace(s, r"(?Um)[^\S\n]+$", "")
    return F.regexp_replace(s, r"\n{3,}", "\n\n")


def unescape_markdown(c: Column) -> Column:
    r"""TXT6: \n, \r and \t that aren't themselves escaped become the characters."""
    for letter, char in (("n", "\n"), ("r", "\r"), ("t", "\t")):
        c = F.regexp_replace(c, rf"(?<!\\)\\{letter}", char)
    return c


def strip_fences(c: Column) -> Column:
    """TXT7: the inside of a fenced block, else the text."""
    s = strip(c)
    inner = F.regexp_extract(s, r"(?s)^```[A-Za-z]*[ \t]*\n?(.*?)\n?```$", 1)
    return F.when(s.startswith("```") & s.endswith("```") & (F.length(s) > 6), strip(inner)).otherwise(s)


def file_name(c: Column) -> Column:
    """TXT9: a title as a file name."""
    s = strip(F.regexp_replace(c, r'[\\/:*?"<>|]', "_"))
    return F.when(F.length(s) > FILE_NAME_CAP, F.concat(F.substring(s, 1, FILE_NAME_CAP), F.lit("..."))).otherwise(s)


def byte_prefix(c: Column, most: int) -> Column:
    """TXT8: the longest prefix of at most that many UTF-8 bytes: a character has four at most, so
    one of the four longest prefixes ends with one."""
    prefixes = [F.substring(c.cast("binary"), 1, max(0, most - k)).cast("string") for k in range(4)]
    return F.when(F.octet_length(c) <= most, c).otherwise(F.coalesce(*(F.when(F.is_valid_utf8(x), x) for x in prefixes)))


def looks_like_html(c: Column) -> Column:
    """TXT12"""
    return F.coalesce(c.rlike(r"</?[A-Za-z][^>]*>"), F.lit(False))


def snake_case(c: Column) -> Column:
    """TXT14"""
    return F.lower(F.regexp_replace(c, r"(?<!^)(?=[A-Z])", "_"))


def capped(c: Column, most: int = INPUT_CAP) -> tuple[Column, Column]:
    """SRT3: a text cut to the cap, and whether it was cut."""
    return F.substring(c, 1, most), F.coalesce(F.length(c) > most, F.lit(False))


def shortened(c: Column, most: int = 600) -> Column:
    """TXT19, SRT4: at most that many characters, then dots."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def retry_excerpt(c: Column, attempt: Column) -> Column:
    """SRT4: what the attempt (from 1) of a repair is shown of a text: less each time; the last cap holds on."""
    cap = F.element_at(F.array(*map(F.lit, RETRY_EXCERPTS)), F.least(F.greatest(attempt, F.lit(1)), F.lit(len(RETRY_EXCERPTS))).cast("int"))
    return F.substr(c, F.lit(1), cap)


def render(template: str, values: dict[str, Column]) -> Column:
    """TXT16: a template with {name} places; a name without a value is an error."""
    import string

    parts = []
    for text, name, _, _ in string.Formatter().parse(template):
        parts.append(F.lit(text))
        if name is not None:
            if name not in values:
                raise KeyError(f"the template needs {name}")
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*parts)


def schema_name(c: Column) -> Column:
    """TXT18: a name of letters, digits, _ and -, of 64 characters at most; a longer one ends in a
    piece of its hash."""
    s = F.regexp_replace(c, "[^A-Za-z0-9_-]", "_")
    return F.when(F.length(s) > 64, F.concat(F.substring(s, 1, 55), F.lit("_"), F.substring(F.sha1(c.cast("binary")), 1, 8))).otherwise(s)


def site_directory(c: Column) -> Column:
    """TXT20"""
    return F.rtrim(F.regexp_replace(c, r"(?U)[^\p{Alnum} _-]", ""))
