"""JSON in the texts that agents answer with."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRING_OR_ESCAPE = re.compile(r'"(?:\\.|[^"\\])*"?|\\[nrt]', re.S)
_CHARS = {r"\n": "\n", r"\r": "\r", r"\t": "\t"}


def unescape_outside_strings(text: str) -> str:
    r"""TXT5: \n, \r and \t become the characters, but not inside JSON strings."""
    return _STRING_OR_ESCAPE.sub(lambda m: _CHARS.get(m[0], m[0]), text)


def _values(text: str, kind: type):
    """Where JSON values of a kind start in a text, and what they are, from left to right."""
    decoder, at, mark = json.JSONDecoder(), 0, "{" if kind is dict else "["
    while (at := text.find(mark, at)) >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError:
            at += 1
            continue
        if isinstance(value, kind):
            yield at, value
        at = end


def first_value(text: str | None, kind: type):
    """JSN2, JSN3: the first JSON object (or list) in a text, as it is or with its escapes undone;
    trailing commas don't matter (JSN5): of an object that has one, no inner object is taken instead."""
    for s in (text or "", unescape_outside_strings(text or ""), (text or "").replace("\\n", "\n").replace("\\t", "\t").replace('\\"', '"')):
        forms = (next(_values(form, kind), None) for form in (s, re.sub(r",\s*([}\]])", r"\1", s)))
        if found := [x for x in forms if x is not None]:
            return min(found, key=lambda x: x[0])[1]
    return None


def _as_json(kind: type):
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if (v := first_value(x if isinstance(x, str) else None, kind)) is None else json.dumps(v, ensure_ascii=False))

    return run


object_udf, list_udf = _as_json(dict), _as_json(list)


def webhook_signature(secret: str, timestamp: int) -> str:
    """HSH2: the signature of an alert: an empty message under the key `timestamp, line feed, secret`."""
    return base64.b64encode(hmac.new(f"{timestamp}\n{secret}".encode(), b"", hashlib.sha256).digest()).decode()


def example(schema: dict, depth: int = 4):
    """JSN4: an instance of a JSON schema, for prompts: enums by their first value, unions by their
    first member, nesting to a depth."""
    root = schema

    def build(s: dict, left: int):
        if "$ref" in s:
            target = root
            for part in s["$ref"].lstrip("#/").split("/"):
                target = target.get(part, {})
            return build(target, left - 1) if left else None
        if s.get("enum"):
            return s["enum"][0]
        for union in ("anyOf", "oneOf", "allOf"):
            if s.get(union):
                return build(s[union][0], left)
        kind = s.get("type")
        if kind == "object" or "properties" in s:
            return {k: build(v, left - 1) for k, v in s.get("properties", {}).items()} if left else {}
        if kind == "array":
            return [build(s.get("items", {}), left - 1)] if left else []
        return {"string": "", "number": 0, "integer": 0, "boolean": False}.get(kind)

    return build(schema, depth)
