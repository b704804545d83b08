"""Operator 3: personal data.

Regular expressions propose spans, validators confirm them, and context words nearby adjust their
score. The base kinds have a fixed meaning: per kind, leftmost matches that don't overlap, dropped
(without another try in their place) if the validator fails. The other kinds count from a score of
THRESHOLD on, and only where no base span lies.

kind    proposed by                              confirmed by                   score
email   local part, @, domain                    -                              0.9
ip      four runs of digits                      parts of at most 255           0.7
card    digits with single spaces or hyphens     16 to 19 digits, Luhn          0.8
phone   + and digits with separators             8 to 15 digits                 0.7
iban    country, check digits, groups            mod 97 = 1, length             0.8
ssn     3-2-4 digits                             area, group and serial         0.45
tel     3-3-4 digits without +                   area and exchange              0.4
key     an access key id                         its alphabet and length        0.8

Words of a kind's context within CONTEXT characters of a span add 0.2, those that speak against it
take 0.2 away.

Defined results: null text counts as empty, with no spans; every row gives one row, repeated ones
too; a null id stays null. Texts are searched whole, in linear time.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, columns

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "tel", "key")
THRESHOLD, CONTEXT = 0.5, 48
_SCORES = dict(zip(KINDS, (0.9, 0.7, 0.8, 0.7, 0.8, 0.45, 0.4, 0.8), strict=True))
_FOR = {
    "email": "email e-mail mail contact write",
    "ip": "ip address host server client login",
    "card": "card visa mastercard amex credit debit payment pay",
    "phone": "phone tel telephone mobile cell call fax contact",
    "iban": "iban account bank transfer bic swift",
    "ssn": "ssn social security number",
    "tel": "phone tel telephone mobile cell call fax contact",
    "key": "key access secret token aws credentials",
}
_AGAINST = dict.fromkeys(KINDS, "example sample") | {"ip": "version release section", "card": "order tracking isbn", "phone": "order tracking isbn", "ssn": "order tracking isbn part", "tel": "order tracking isbn part"}
_FOR, _AGAINST = ({k: frozenset(v.split()) for k, v in x.items()} for x in (_FOR, _AGAINST))

_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No digit before: a run of digits is tried from its start alone, as from within it fails alike.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_TEL = re.compile(r"(?<![0-9+.-])\(?([2-9][0-9]{2})\)?[ .-]([2-9][0-9]{2})[ .-][0-9]{4}(?![0-9-])")
_KEY = re.compile(r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])")
_DIGIT, _WORD = re.compile("[0-9]"), re.compile(r"[a-z]+(?:-[a-z]+)?")


def luhn(digits: str) -> bool:
    odd, even = digits[::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def mod97(iban: str) -> bool:
    iban = iban.replace(" ", "")
    return 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the whole pattern, found from the @ outwards, so that long runs cost no more than
    their length: the local part is the run before the @, from the last match's end at most."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low:
            block = max(low, start - 64)
            others = [m.end() for m in _NOT_LOCAL.finditer(text, block, start)]
            if others:
                start = others[-1]
                break
            start = block
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            low = domain.end()
        at = text.find("@", max(at + 1, low))


def _digits(x: str) -> str:
    return "".join(_DIGIT.findall(x))


def _matches(pattern: re.Pattern, good: Callable[[re.Match], bool]) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: (m.span() for m in pattern.finditer(text) if good(m))


_FIND: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {
    "email": emails,
    "ip": _matches(_IP, lambda m: all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split("."))),
    "card": _matches(_CARD, lambda m: len(m[0]) >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)),
    "phone": _matches(_PHONE, lambda m: 8 <= len(_digits(m[0])) <= 15),
    "iban": _matches(_IBAN, lambda m: mod97(m[0])),
    "ssn": _matches(_SSN, lambda m: m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000"),
    "tel": _matches(_TEL, lambda m: not m[1].endswith("11") and not m[2].endswith("11")),
    "key": _matches(_KEY, lambda m: True),
}


def context_score(text: str, kind: str, start: int, end: int) -> float:
    near = set(_WORD.findall(f"{text[max(0, start - CONTEXT) : start]} {text[end : end + CONTEXT]}".lower()))
    return min(1.0, max(0.0, _SCORES[kind] + 0.2 * bool(near & _FOR[kind]) - 0.2 * bool(near & _AGAINST[kind])))


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind, then start; code points, end exclusive."""
    out = []
    digit = _DIGIT.search(text) is not None
    for kind in BASE:
        if "@" in text if kind == "email" else digit and (kind != "phone" or "+" in text):
            out += [(kind, s, e, context_score(text, kind, s, e)) for s, e in _FIND[kind](text)]
    taken = _merged((s, e) for _, s, e, _ in out)
    starts = [s for s, _ in taken]

    def free(s: int, e: int) -> bool:
        i = bisect_left(starts, e)  # the last span that starts before e
        return i == 0 or taken[i - 1][1] <= s

    for kind in KINDS[len(BASE) :]:
        if "AKIA" in text if kind == "key" else digit:
            for s, e in _FIND[kind](text):
                if free(s, e) and (score := context_score(text, kind, s, e)) >= THRESHOLD:
                    out.append((kind, s, e, score))
    return out


def _said(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores
    (array<double>, in the order of spans). One pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                found = [find(x or "") for x in part.column("text").to_pylist()]
                base = [[x for x in own if x[0] in BASE] for own in found]
                arrays = [part.column("id"), *(pa.array([sum(x[0] == k for x in own) for own in base], pa.int64()) for k in BASE)]
                arrays += [pa.array([hashlib.sha256(_said(x).encode()).hexdigest() for x in base]), pa.array([_said(x) for x in found]), pa.array([[x[3] for x in own] for own in found], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "scores"])

    source = columns(docs, id=id_col, text=text_col)
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} bigint" for k in BASE) + ", base_sha256 string, spans string, scores array<double>")


def redacted(text: str) -> str:
    """text with [KIND] in place of each span; of spans that overlap, the first one's kind."""
    parts, at = [], 0
    for kind, s, e, _ in sorted(find(text), key=lambda x: (x[1], -x[2])):
        if s >= at:
            parts += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*parts, text[at:]]) if parts else text


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with all rows and columns and redacted texts; length_col, where there is such a column,
    is the new length where the text has changed. Null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text_col):
                old = part.column(text_col).to_pylist()
                new = [x and redacted(x) for x in old]
                part = part.set_column(part.schema.get_field_index(text_col), text_col, pa.array(new, part.column(text_col).type))
                if length_col in part.schema.names:
                    lengths = part.column(length_col)
                    now = [n if a == b else len(b) for n, a, b in zip(lengths.to_pylist(), old, new, strict=True)]
                    part = part.set_column(part.schema.get_field_index(length_col), length_col, pa.array(now, lengths.type))
                yield part

    return docs.mapInArrow(run, docs.schema)
