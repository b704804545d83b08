"""Amounts of money, in yuan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeflow.functions.text import fold_empty, let, split_list, strip

# The forms of numbers and ranges, units and currency marks.
NUMBER = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
RANGE = r"^\d+(\.\d+)?~\d+(\.\d+)?$"
UNITS = {"亿": 100_000_000, "万": 10_000}


def _amount(s: Column) -> Column:
    """The value of a text with one number, in yuan, as decimal(38,10)."""
    number = F.regexp_extract(F.regexp_replace(s, "[,，]|人民币|[￥¥]", ""), r"(\d+(?:\.\d+)?)", 1).try_cast("decimal(28,10)")
    unit = F.when(s.contains("亿"), F.lit(UNITS["亿"])).when(s.contains("万"), F.lit(UNITS["万"])).otherwise(F.lit(1))
    return number * unit.cast("decimal(10,0)")


def to_yuan(c: Column) -> Column:
    """NUM1, NUM2: a text's amount; null for ranges, signs, several numbers or none."""

    def amount(s: Column) -> Column:
        several = F.size(F.regexp_extract_all(F.regexp_replace(s, "，", ","), F.lit(f"({NUMBER})"), 1)) > 1
        return F.when((s != "") & ~s.rlike("[~～-]") & ~several, _amount(s).cast("double"))

    return let(strip(c), amount)


def yuan_text(c: Column) -> Column:
    """NUM2: a text's amount as text, with as many decimals as the number in it has."""

    def said(s: Column) -> Column:
        decimals = F.length(F.regexp_extract(F.regexp_replace(s, "[,，]", ""), r"\d+\.(\d+)", 1))
        value = F.split(_amount(s).cast("string"), r"\.")
        return F.when(to_yuan(s).isNotNull(), F.concat_ws(".", F.get(value, F.lit(0)), F.when(decimals > 0, F.substr(F.get(value, F.lit(1)), F.lit(1), decimals))))

    return let(strip(c), said)


def estimated_range(c: Column) -> Column:
    """NUM3: `lo~hi` in yuan from a range, where a unit at one end holds for both; `x~x` from one
    amount; '' for what means nothing, any other text as it is."""
    unit = lambda x: F.when(x.contains("亿"), "亿").when(x.contains("万"), "万").when(x.contains("元"), "元").otherwise("")

    def sides(s: Column) -> Column:
        plain = F.translate(s, "～－—–", "~---")
        plain = F.when(plain.contains("~"), plain).otherwise(F.regexp_replace(plain, "[至到]", "~"))
        by_tilde = F.filter(F.transform(F.split(plain, "~"), strip), lambda x: x != "")
        by_dash = F.transform(F.split(plain, "-"), strip)
        dashed = F.when((F.size(by_dash) == 2) & F.forall(by_dash, lambda x: x.rlike("[0-9]")), by_dash)
        return F.struct(s.alias("s"), F.when(plain.contains("~"), F.when(F.size(by_tilde) == 2, by_tilde)).otherwise(dashed).alias("ends"))

    def settled(x: Column) -> Column:
        lo, hi = F.get(x["ends"], F.lit(0)), F.get(x["ends"], F.lit(1))
        units = F.concat(unit(lo), unit(hi))  # for the end that has none
        both = F.struct(*(yuan_text(F.when(unit(end) == "", F.concat(end, units)).otherwise(end)).alias(name) for name, end in (("lo", lo), ("hi", hi))), yuan_text(x["s"]).alias("one"), x["s"].alias("s"))
        return let(both, lambda b: F.when(b["lo"].isNotNull() & b["hi"].isNotNull(), F.concat(b["lo"], F.lit("~"), b["hi"])).when(b["one"].isNotNull(), F.concat(b["one"], F.lit("~"), b["one"])).otherwise(b["s"]))

    return let(let(fold_empty(c), sides), settled)


def price_list(c: Column) -> Column:
    """NUM4, NUM8: the amounts of a list of values."""
    return F.filter(F.transform(split_list(c), to_yuan), lambda x: x.isNotNull())


def first_price(c: Column) -> Column:
    """NUM8: the whole text's amount, else the first of its values that has one."""
    return F.coalesce(to_yuan(c), F.get(price_list(c), F.lit(0)))


def is_range(c: Column) -> Column:
    """NUM5: whether a text, without white space, has the form `lo~hi`."""
    return F.coalesce(F.regexp_replace(c, r"(?U)\s", "").rlike(RANGE), F.lit(False))


def non_zero(c: Column) -> Column:
    """NUM6: whether a text stands for something; one that isn't a number does."""
    s = strip(c)
    return (s != "") & F.coalesce(s.try_cast("double") != 0, F.lit(True))


def empty_quantity(c: Column) -> Column:
    """NUM7: null, 0, '' and '0', but not '0.0'."""
    return strip(c).isin("", "0")


def plain_number(c: Column) -> Column:
    """NUM12: a text as a number, thousands' commas aside; null for what isn't one."""
    return F.regexp_replace(strip(c), ",", "").try_cast("double")


def script_number(c: Column) -> Column:
    """NUM12: a number's text without commas: a whole one in digits alone, one with a point as a
    double; null for what isn't one."""
    s = F.replace(strip(c), F.lit(","), F.lit(""))
    point = F.when(s.rlike(r"^[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double").cast("string"))
    return F.coalesce(F.when(s.rlike(r"^[+-]?\d+$"), F.regexp_replace(F.regexp_replace(s, r"^(?:\+|(-))?0*(?=\d)", "$1"), "^-0$", "0")), point)
