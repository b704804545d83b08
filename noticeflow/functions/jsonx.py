"""JSON, vectors and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeflow.functions.text import strip


_END = "end of the text, 6f1d0c5e"


def lenient_object(c: Column) -> Column:
    """JSN1: the JSON object in a text, from its first { to its last }; null if there is none. Fences and
    white space around it hold no braces, so they needn't go first."""
    inner = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.when(F.get_json_object(inner, "$").isNotNull(), inner)


def first_key(c: Column, *names: str) -> Column:
    """PRJ20: the value of the first of several names of a key."""
    return F.coalesce(*(F.get_json_object(c, f"$.{n}") for n in names))


def flat_scalars(c: Column) -> Column:
    """JSN6: an object's scalars as texts: null is '', nested values go."""
    entries = F.from_json(c, "map<string,string>")
    kept = F.map_filter(entries, lambda k, v: v.isNull() | ~F.substring(F.ltrim(v), 1, 1).isin("{", "["))
    return F.transform_values(kept, lambda k, v: F.coalesce(v, F.lit("")))


def shaped_vector(c: Column, dims: int) -> Column:
    """ARR1: a vector cut or filled with zeros to a length; any length if dims is 0 or less."""
    if dims <= 0:
        return c
    return F.slice(F.concat(c, F.array_repeat(F.lit(0.0).cast("float"), dims)), 1, dims)


def url_part(c: Column, part: str) -> Column:
    return F.coalesce(F.try_parse_url(c, F.lit(part)), F.lit(""))


def valid_url(c: Column) -> Column:
    """URL1: whether a url has a web scheme and a host."""
    return url_part(c, "PROTOCOL").isin("http", "https") & (url_part(c, "HOST") != "")


def service_base(c: Column, root: str, under: str, endpoint: str) -> Column:
    """URL1: the base of a service's url: `under` is added to one that ends in `root`, an endpoint
    given by mistake goes; any other stays, without slashes at its end."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), "/+$", "")
    return F.when(s.endswith(root), F.concat(s, F.lit(under))).when(s.endswith(root + under + endpoint), F.substr(s, F.lit(1), F.length(s) - len(endpoint))).otherwise(s)


def json_or_absent(c: Column) -> Column:
    """SRC15: a response's body where it is JSON, else null. Spark's parsers stop after a first value;
    a text is whole where it and an end mark are the two items of a list."""
    marked = F.concat(F.lit("["), c, F.lit(f', "{_END}"]'))
    return F.when((F.json_array_length(marked) == 2) & (F.get_json_object(marked, "$[1]") == _END), c)


def one_body(*modes: Column) -> Column:
    """SRC15: whether a request has one kind of body at most."""
    return sum((F.when(m.isNotNull(), 1).otherwise(0) for m in modes), F.lit(0)) <= 1


def braced(c: Column) -> Column:
    """SNK7: the JSON object of a text that may lack its outer braces, and of an envelope its `data`
    where that is an object; null if there is none."""
    s = strip(c)
    whole = F.coalesce(json_or_absent(s), F.when((s != "") & ~s.startswith("{"), json_or_absent(F.concat(F.lit("{"), s, F.lit("}")))))
    inner = F.get_json_object(whole, "$.data")
    return F.when(whole.startswith("{"), F.when(inner.startswith("{") & json_or_absent(inner).isNotNull(), inner).otherwise(whole))


def on_list_page(url: Column, list_url: Column) -> Column:
    """PRJ10: same scheme, host and path, and the same fragment if either has one."""
    same = F.lit(True)
    for part in ("PROTOCOL", "HOST"):
        same &= url_part(url, part) == url_part(list_url, part)
    path = lambda c: F.regexp_replace(url_part(c, "PATH"), "/+$", "")
    return same & (path(url) == path(list_url)) & (url_part(url, "REF") == url_part(list_url, "REF"))


def detail_key(url: Column, title: Column, file_date: Column) -> Column:
    """PRJ11: the key by which a notice is known: its url, else title and date."""
    s = strip(url)
    return F.when((s != "") & (F.lower(s) != "unknown"), s).otherwise(F.concat(strip(title), F.lit("|"), F.coalesce(file_date, F.lit(""))))
