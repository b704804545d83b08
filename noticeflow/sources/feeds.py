"""Feeds behind HTTP as a Python data source, opt-in: the address, parameters and headers are options
and there are no defaults. Register with spark.dataSource.register(PagedFeed)."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import count

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType


class Query(InputPartition):
    def __init__(self, number: int, parameters: dict[str, str]):
        super().__init__(number)
        self.number, self.parameters = number, parameters


class PagedFeed(DataSource):
    """SRC13-15: query, page, status, body of each page. Options: url; queries, a JSON list of
    parameter objects, each a partition of its own; method, GET or POST (a form); next_field, where a
    page's JSON names the next one, and next_param, how it is asked for (without next_field a query
    has one page); headers, a JSON object; timeout in seconds. A task that runs again asks again. A
    status of 400 and more ends its query, with the body as a row. As a stream, one page of each query a
    batch."""

    @classmethod
    def name(cls) -> str:
        return "paged_feed"

    def schema(self) -> str:
        return "query int, page int, status int, body string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FeedReader(dict(self.options))

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return FeedStream(dict(self.options))


class FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        from urllib.parse import urlsplit

        lowered = {k.lower(): v for k, v in options.items()}
        self.url = lowered.get("url", "").strip()
        parts = urlsplit(self.url)
        if parts.scheme not in ("http", "https") or not parts.netloc:
            raise ValueError("url must be a web address")
        self.method = lowered.get("method", "GET").upper()
        if self.method not in ("GET", "POST"):
            raise ValueError("method must be GET or POST")
        self.queries: list[dict[str, str]] = json.loads(lowered.get("queries", "[{}]"))
        self.headers: dict[str, str] = json.loads(lowered.get("headers", "{}"))
        self.next_field, self.next_param = lowered.get("next_field", ""), lowered.get("next_param", "next")
        self.timeout = float(lowered.get("timeout", "120"))

    def partitions(self) -> list[InputPartition]:
        return [Query(i, {k: "" if v is None else str(v) for k, v in q.items()}) for i, q in enumerate(self.queries)]

    def _ask(self, parameters: dict[str, str]) -> tuple[int, str]:
        from urllib.error import HTTPError
        from urllib.parse import urlencode
        from urllib.request import Request, urlopen

        form = urlencode(parameters)
        headers, data, url = dict(self.headers), None, self.url
        if self.method == "POST":
            data = form.encode()
            headers.setdefault("Content-Type", "application/x-www-form-urlencoded; charset=UTF-8")
        elif form:
            url += ("&" if "?" in url else "?") + form
        try:
            with urlopen(Request(url, data, headers, method=self.method), timeout=self.timeout) as answer:
                return answer.status, answer.read().decode("utf-8", errors="replace")
        except HTTPError as e:
            return e.code, e.read().decode("utf-8", errors="replace")

    def _following(self, body: str) -> str:
        try:
            at = json.loads(body)
        except ValueError:
            return ""
        for name in self.next_field.split("."):
            at = at.get(name) if isinstance(at, dict) else None
        return "" if at is None else str(at)

    def read(self, partition: Query) -> Iterator[tuple[int, int, int, str]]:
        parameters, seen = dict(partition.parameters), set()
        for page in count():
            status, body = self._ask(parameters)
            yield partition.number, page, status, body
            token = self._following(body) if self.next_field and status < 400 else ""
            if not token:
                return
            if token in seen:
                raise ValueError(f"the feed names the page {token} twice")
            seen.add(token)
            parameters[self.next_param] = token


class FeedStream(SimpleDataSourceStreamReader):
    """SRC14 as a stream: the offset holds, for each query, its next page and what to ask for it by, and
    whether it has ended; so a run that resumes from a checkpoint asks for the pages after those it
    has committed. A failed batch is asked for again. Pages pass through the driver, one a query a batch."""

    def __init__(self, options: dict[str, str]):
        self.feed = FeedReader(options)

    def initialOffset(self) -> dict:
        return {str(q.number): {"page": 0, "token": "", "ended": False} for q in self.feed.partitions()}

    def _next(self, start: dict) -> tuple[list[tuple[int, int, int, str]], dict]:
        rows, end = [], {}
        for q in self.feed.partitions():
            at = start.get(str(q.number)) or {"page": 0, "token": "", "ended": False}
            if not at["ended"]:
                asked = q.parameters | ({self.feed.next_param: at["token"]} if at["token"] else {})
                status, body = self.feed._ask(asked)
                rows.append((q.number, at["page"], status, body))
                token = self.feed._following(body) if self.feed.next_field and status < 400 else ""
                if token and token == at["token"]:
                    raise ValueError(f"the feed names the page {token} twice")
                at = {"page": at["page"] + 1, "token": token, "ended": not token}
            end[str(q.number)] = at
        return rows, end

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._next(start)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        at = start
        while at != end:
            rows, following = self._next(at)
            yield from rows
            if following == at:
                return
            at = following
