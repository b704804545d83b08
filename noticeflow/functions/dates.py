"""Dates, kept as text in the form YYYY-MM-DD."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeflow.functions.text import fold_empty, let

# Fixed value: a year, month and day with the marks that separate them.
DATE = r"(\d{4})\s*[年./-]\s*(\d{1,2})\s*[月./-]\s*(\d{1,2})"


def normalize_date(c: Column) -> Column:
    """DAT1: the first date in a text; the text itself if there is none, or month or day can't be."""

    def first(s: Column) -> Column:
        y, m, d = (F.regexp_extract(s, DATE, i) for i in (1, 2, 3))
        fits = (y != "") & m.try_cast("int").between(1, 12) & d.try_cast("int").between(1, 31)
        return F.when(fits, F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))).otherwise(s)

    return let(fold_empty(c), first)


def file_date(c: Column) -> Column:
    """PRJ12: the date under which a notice is filed: the normalised one, else, for
    a text that says nothing, the text itself with dashes."""
    return F.coalesce(F.nullif(normalize_date(c), F.lit("")), F.translate(c, "/.", "--"), F.lit(""))


def bid_open_date(c: Column) -> Column:
    """DAT2: a text that is a date of the calendar in the form YYYY-MM-DD, else null."""
    return let(fold_empty(c), lambda s: F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(s, "yyyy-MM-dd").isNotNull(), s))


def in_range(date: Column, start: Column, end: Column) -> Column:
    """PRJ8: both ends inclusive; what can't be decided is out."""
    return F.coalesce(date.between(start, end), F.lit(False))


def deadline_rule(published: Column, deadline: Column, today: Column, start: Column, end: Column) -> Column:
    """PRJ9: by deadline without a publishing date, by the range without a deadline, else by both."""
    open_ = deadline > today
    return F.coalesce(F.when(published.isNull(), open_).when(deadline.isNull(), in_range(published, start, end)).otherwise(open_ & in_range(published, start, end)), F.lit(False))


#: Fixed value: the zone whose days budgets go by.
BUDGET_ZONE = "Asia/Shanghai"


def budget_day(ts: Column, timezone: str = BUDGET_ZONE) -> Column:
    """DAT3: the day, in a time zone, of a UTC time without zone; the session's zone plays no part."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(timezone), ts.cast("timestamp_ntz")))
