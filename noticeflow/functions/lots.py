"""Lots: numbers, subjects, product rows and candidate rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeflow.functions.money import first_price, to_yuan
from noticeflow.functions.text import fold_empty, let, split_list, strip
from noticeflow.functions.types import candidate_type

# Chinese numerals, lot marks, and what separates a mark from a subject.
DIGITS = "零一二三四五六七八九"
UNIT_VALUES = {"十": 10, "百": 100, "千": 1000, "万": 10_000}
NUMERAL = r"[零〇一二三四五六七八九十百千万两\d]+"
SECTION_MARKS, PACKAGE_MARKS = "标段|标包|标", "包件|包"
MARK_SIGNS = "标包"  # every mark holds one of these
MARK_TAIL = r"\s*[：:、.．）)】-]*\s*"
TRIM = r"[\s：:、,，;；._-]+"
DEFAULT_LOT = "标段一"

PRODUCT = "struct<lotNumber:string,lotName:string,subjects:string,productCategory:string,models:string,unitPrices:double,quantities:string,quantityUnit:string>"
CANDIDATE = "struct<lotNumber:string,lotName:string,type:string,candidates:string,candidatePrices:double>"
RAW_PRODUCTS = "array<struct<lotNumber:string,lotName:string,subjects:string,description:string,productCategory:string,models:string,unitPrices:string,quantities:string,quantityUnit:string>>"
RAW_CANDIDATES = "array<struct<lotNumber:string,lotName:string,type:string,candidates:string,candidatePrices:string,winner:string,winningAmount:string>>"


def numeral_to_int(c: Column) -> Column:
    """NUM9: a number in digits or Chinese numerals; numerals without units are read digit by digit."""
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("total"), zero.alias("section"), zero.alias("number"))

    def step(acc: Column, char: Column) -> Column:
        place = F.instr(F.lit(DIGITS), char)
        unit = F.coalesce(*(F.when(char == k, F.lit(v).cast("bigint")) for k, v in UNIT_VALUES.items()), zero)
        myriad = (acc["section"] + acc["number"]) * unit
        added = acc["section"] + F.greatest(acc["number"], F.lit(1).cast("bigint")) * unit
        number = F.when(place > 0, (place - 1).cast("bigint")).otherwise(zero)
        return F.struct(
            F.when(unit == UNIT_VALUES["万"], acc["total"] + myriad).otherwise(acc["total"]).alias("total"),
            F.when(place > 0, acc["section"]).when(unit == UNIT_VALUES["万"], zero).otherwise(added).alias("section"),
            number.alias("number"),
        )

    def value(s: Column) -> Column:
        read = F.aggregate(F.split(s, ""), start, step, lambda acc: acc["total"] + acc["section"] + acc["number"])
        digits = F.translate(s, DIGITS, "0123456789").try_cast("bigint")
        return F.when(s.rlike(f"^[{DIGITS}十百千万]*[十百千万][{DIGITS}十百千万]*$"), read).when(s.rlike(rf"^(\d+|[{DIGITS}]+)$"), digits)

    return let(F.translate(strip(c), "〇两", "零二"), value)


def _section(n: Column) -> Column:
    """A number below 10000 in numerals, '' for 0."""
    parts = []
    for value, unit in ((1000, "千"), (100, "百"), (10, "十"), (1, "")):
        digit = F.pmod(F.floor(n / value), F.lit(10)).cast("int")
        parts.append(F.when(digit == 0, "零").otherwise(F.concat(F.substring(F.lit(DIGITS), digit + 1, F.lit(1)), F.lit(unit))))
    return F.regexp_replace(F.regexp_replace(F.concat(*parts), "零+", "零"), "^零|零$", "")


def int_to_numeral(n: Column) -> Column:
    """NUM10: a positive number in numerals; a zero stands before a section below 1000 if the lower
    section is below 1000 too; 10 to 19 have no leading one."""

    def said(parts: Column) -> Column:
        out, lower_small, some = _section(parts[0]), (parts[0] > 0) & (parts[0] < 1000), parts[0] > 0
        for i, mark in ((1, "万"), (2, "亿")):
            s = parts[i]
            gap = F.when(lower_small & (s < 1000), "零").otherwise("")
            out = F.concat(F.when(s > 0, F.concat(gap, _section(s), F.lit(mark))).otherwise(""), out)
            lower_small = F.when(s > 0, s < 1000).otherwise(some)
            some = some | (s > 0)
        return F.regexp_replace(F.regexp_replace(out, "^零+|零+$", ""), "^一十", "十")

    parts = let(n, lambda x: F.array(*(F.pmod(F.floor(x / 10_000**i), F.lit(10_000)).cast("int") for i in range(3))))
    one = F.substring(F.lit(DIGITS), F.pmod(n, F.lit(10)).cast("int") + 1, F.lit(1))
    return F.when(n.between(1, 9), one).when(n > 0, let(parts, said))


def _named_number(c: Column) -> Column:
    """The number of the lot that a text names; only a text with a mark is searched for one."""

    def tries(s: Column) -> Column:
        found = []
        for marks in (SECTION_MARKS, PACKAGE_MARKS):
            found.append(F.regexp_extract(s, rf"(?:{marks})\s*第?\s*({NUMERAL})", 1))
            found.append(F.regexp_extract(s, rf"第?\s*({NUMERAL})\s*(?:{marks})", 1))
        marked = reduce(or_, (s.contains(x) for x in MARK_SIGNS))
        return F.when(s == "", F.array().cast("array<string>")).when(marked, F.filter(F.array(*found, s), lambda x: x != "")).otherwise(F.array(s))

    numbers = F.transform(let(fold_empty(c), tries), numeral_to_int)
    return F.get(F.filter(numbers, lambda n: n > 0), F.lit(0))


def _lot(number: Column) -> Column:
    return let(number, lambda n: F.when(n.isNotNull(), F.concat(F.lit("标段"), int_to_numeral(n))))


def lot_number(c: Column) -> Column:
    """LOT1: the lot a text names: by section marks, then by package marks (number after the mark
    first), then as a bare number; null if none."""
    return _lot(_named_number(c))


def _lot_of_row(r: Column) -> Column:
    return F.coalesce(_lot(F.coalesce(_named_number(r["lotNumber"]), _named_number(r["lotName"]))), F.lit(DEFAULT_LOT))


def lot_subject(c: Column) -> Column:
    """LOT2: what follows a lot name's last mark, else its last colon; its first line, trimmed."""
    marks = f"{SECTION_MARKS}|{PACKAGE_MARKS}"
    mark = rf"(?s)^.*(?:(?:{marks})\s*第?\s*{NUMERAL}|第?\s*{NUMERAL}\s*(?:{marks})){MARK_TAIL}"
    after = lambda s: let(F.regexp_replace(s, mark, ""), lambda r: F.when(r != s, r).otherwise(F.regexp_replace(s, r"(?s)^.*[：:]", "")))
    rest = let(fold_empty(c), after)
    line = F.regexp_replace(rest, r"(?s)[\r\n]+.*$", "")
    return strip(F.regexp_replace(line, f"^{TRIM}|{TRIM}$", ""))


def dedupe_text(c: Column) -> Column:
    """LOT3: without white space and punctuation between parts."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), TRIM, "")


def _text(c: Column) -> Column:
    return F.array_join(split_list(c), ",")


def _any_of(r: Column, *names: str) -> Column:
    """Whether a row says something; the first field that does settles it."""
    return reduce(or_, (fold_empty(r[f]) != "" for f in names))


def products(raw: Column) -> Column:
    """LOT4, LOT5: product rows from rows of texts (RAW_PRODUCTS); rows without any value go."""
    some = lambda r: _any_of(r, "lotNumber", "lotName", "subjects", "description", "productCategory", "models", "unitPrices", "quantities", "quantityUnit")

    def row(r: Column) -> Column:
        quantity = F.coalesce(F.get(split_list(r["quantities"]), F.lit(0)), F.lit(""))
        unit = F.regexp_extract(fold_empty(r["quantities"]), r"\d+(?:\.\d+)?\s*([^\d\s]+)$", 1)
        subject = F.coalesce(F.nullif(fold_empty(r["subjects"]), F.lit("")), F.nullif(fold_empty(r["description"]), F.lit("")), lot_subject(r["lotName"]))
        return F.struct(
            _lot_of_row(r).alias("lotNumber"),
            fold_empty(r["lotName"]).alias("lotName"), subject.alias("subjects"), fold_empty(r["productCategory"]).alias("productCategory"), _text(r["models"]).alias("models"),
            first_price(r["unitPrices"]).alias("unitPrices"), F.regexp_extract(quantity, r"(\d+)", 1).alias("quantities"),
            F.coalesce(F.nullif(fold_empty(r["quantityUnit"]), F.lit("")), unit).alias("quantityUnit"),
        )

    return F.coalesce(F.transform(F.filter(raw, some), row), F.array()).cast(f"array<{PRODUCT}>")


def _settled(c: Column) -> Column:
    """The candidate rows of one lot, from its texts and lists."""
    names = F.when((F.size(c["names"]) == 0) & (c["winner"] != ""), F.array(c["winner"])).otherwise(c["names"])
    single = F.coalesce(c["price"], F.when(F.size(c["said"]) == 0, c["won"]))
    several = F.filter(F.transform(c["said"], to_yuan), lambda x: x.isNotNull())
    prices = F.when(single.isNotNull(), F.array(single)).otherwise(several)
    at = lambda xs, i: F.when(F.size(xs) == 1, F.get(xs, F.lit(0))).otherwise(F.get(xs, i))

    def rows(both: Column) -> Column:
        n = F.greatest(F.size(both["names"]), F.size(both["prices"]), F.lit(1))

        def one(i: Column) -> Column:
            name = F.coalesce(at(both["names"], i), F.lit(""))
            kind = F.when((c["kind"] == "") & (c["winner"] != ""), F.when(name == c["winner"], "中标").otherwise("中标候选人")).otherwise(c["kind"])
            return F.struct(c["lot"].alias("lotNumber"), c["name"].alias("lotName"), kind.alias("type"), name.alias("candidates"), at(both["prices"], i).alias("candidatePrices"))

        return F.transform(F.sequence(F.lit(0), n - 1), one)

    return let(F.struct(names.alias("names"), prices.alias("prices")), rows)


def candidates(raw: Column) -> Column:
    """LOT6: one row for each candidate of a lot: candidates and prices side by side, where a list
    of one holds for all; the winner of old records counts as candidate."""

    def rows(r: Column) -> Column:
        some = _any_of(r, "lotNumber", "lotName", "type", "candidates", "candidatePrices", "winner", "winningAmount")
        listed = F.struct(
            _lot_of_row(r).alias("lot"), fold_empty(r["lotName"]).alias("name"), candidate_type(r["type"]).alias("kind"), fold_empty(r["winner"]).alias("winner"),
            split_list(r["candidates"]).alias("names"), split_list(r["candidatePrices"]).alias("said"), to_yuan(r["candidatePrices"]).alias("price"), to_yuan(r["winningAmount"]).alias("won"),
        )
        return F.when(some, let(listed, _settled)).otherwise(F.array().cast(f"array<{CANDIDATE}>"))

    return F.coalesce(F.flatten(F.transform(raw, rows)), F.array()).cast(f"array<{CANDIDATE}>")


def supplemented(product_rows: Column, candidate_rows: Column) -> Column:
    """LOT8, SET2: products, and after them lots that only candidates name. A lot is known by its
    number with its subject or with its name; each one added counts for the next. A row's keys are
    made once, before the rows are gone through, which then only compares them."""
    key = lambda lot, said: F.concat_ws("\u0001", lot, said)
    known = lambda lot, c: let(dedupe_text(c), lambda s: F.when(s != "", key(lot, s)))
    own = F.flatten(F.transform(product_rows, lambda r: F.array_compact(F.array(known(r["lotNumber"], r["subjects"]), known(r["lotNumber"], r["lotName"])))))

    def read(c: Column) -> Column:
        keys = lambda s: F.array(key(c["lotNumber"], dedupe_text(s)), key(c["lotNumber"], dedupe_text(c["lotName"])))
        return let(lot_subject(c["lotName"]), lambda s: F.struct(c["lotNumber"].alias("lotNumber"), c["lotName"].alias("lotName"), s.alias("subjects"), F.when((F.coalesce(c["lotName"], F.lit("")) != "") & (s != ""), keys(s)).alias("keys")))

    def step(acc: Column, c: Column) -> Column:
        return F.when(F.arrays_overlap(acc["keys"], c["keys"]), acc).otherwise(F.struct(F.concat(acc["rows"], F.array(c)).alias("rows"), F.concat(acc["keys"], c["keys"]).alias("keys")))

    def row(c: Column) -> Column:
        new = F.struct(c["lotNumber"].alias("lotNumber"), c["lotName"].alias("lotName"), c["subjects"].alias("subjects"), F.lit("").alias("productCategory"), F.lit("").alias("models"), F.lit(None).cast("double").alias("unitPrices"), F.lit("").alias("quantities"), F.lit("").alias("quantityUnit"))
        return new.cast(PRODUCT)

    named = F.filter(F.transform(candidate_rows, read), lambda c: c["keys"].isNotNull())
    start = F.struct(F.array().cast("array<struct<lotNumber:string,lotName:string,subjects:string,keys:array<string>>>").alias("rows"), own.alias("keys"))
    return F.concat(product_rows, F.transform(F.aggregate(named, start, step, lambda acc: acc["rows"]), row))


def effective(product_rows: Column) -> Column:
    """PRJ21: rows without those that have a subject but no quantity or no model."""
    blank = lambda r: (fold_empty(r["subjects"]) != "") & (strip(r["quantities"]).isin("", "0") | (fold_empty(r["models"]) == ""))
    return F.filter(product_rows, lambda r: ~blank(r))
