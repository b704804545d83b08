"""Verdicts on sites, pages and requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeflow.functions.jsonx import valid_url
from noticeflow.functions.text import let, strip

# The states of a page, and the form of a frame's address.
PAGE_STATES = ["ok", "need_login", "unknown"]
FRAME_URL = r"(https?://[^\s一-鿿]+)"


def frame_url(answer: Column) -> Column:
    """SRC8: the first address in an answer, '' if there is none."""
    return F.coalesce(F.regexp_extract(answer, FRAME_URL, 1), F.lit(""))


def is_safe(answer: Column) -> Column:
    """SRC9: a page counts as safe unless the answer says otherwise."""
    return ~F.coalesce(F.lower(answer).contains("unsafe"), F.lit(False))


def page_state(answer: Column) -> Column:
    """SRC11: what an answer says of a page; anything else is unknown."""
    return let(F.lower(strip(answer)), lambda s: F.when(s.startswith("ok") | s.endswith("'ok'"), "ok").when(s.contains("login"), "need_login").otherwise("unknown"))


def login_action(required: Column, credentials: Column, state: Column) -> Column:
    """SRC11: log in where it is asked for and can be done, open what needs no login, skip the rest."""
    return F.when(required, F.when(credentials, "login").otherwise("skip")).when(state == "ok", "open").otherwise("skip")


def saved_count(called_back: Column, files: Column) -> tuple[Column, Column]:
    """AGG3: how many notices were saved, and whether the two counts differ."""
    return F.greatest(F.coalesce(called_back, F.lit(0)), F.coalesce(files, F.lit(0))), F.coalesce(called_back, F.lit(0)) != F.coalesce(files, F.lit(0))


def request_error(url: Column, login_required: Column, username: Column, password: Column, date_start: Column, date_end: Column) -> Column:
    """PRJ22: why a crawl request can't be taken, null if it can."""
    missing = (strip(username) == "") | (strip(password) == "")
    return F.when(~valid_url(url), "url must be http or https").when(login_required & missing, "login needs username and password").when(date_start > date_end, "date_start is after date_end")


def body_error(*bodies: Column) -> Column:
    """PRJ22: a request has one kind of body at most."""
    given = sum((b.isNotNull().cast("int") for b in bodies), F.lit(0))
    return F.when(given > 1, "more than one body")
