"""Paged HTTP sources as a Python data source: a partition for each query, pages read until one is empty; as a stream, a scan that is taken up where it ended."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual


@dataclass
class Query(InputPartition):
    query: str
    first: int
    end: int


class PagedJson(DataSource):
    """Rows (query, page, item) of a paged search.

    Options: url, a template with {query}, {page} and {token}; queries, a JSON list; items, the field that holds a page's list;
    next, the field that holds the token of the next page, where the service gives one (a page without it is the last); pages,
    the most pages of a query; wait, seconds between requests of a task (P06, P07: also the pause after status 429, at most ten
    times that or ten seconds). Pages that aren't there (404) are empty. Filters on query (=, IN) choose the queries asked,
    filters on page (<, <=) the pages: a request that a filter rules out isn't made.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "query string, page int, item string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PagedStream(dict(self.options))


class _Pages:
    def __init__(self, options: dict[str, str]):
        self.url, self.items, self.next = options["url"], options.get("items", "items"), options.get("next")
        self.queries = list(dict.fromkeys(json.loads(options["queries"])))
        self.pages, self.wait = int(options.get("pages", "10")), float(options.get("wait", "0"))

    def read(self, partition: Query) -> Iterator[tuple[str, int, str]]:
        token = ""
        for page in range(partition.first, partition.end):
            got, token = self._page(partition.query, page, token)
            for item in got:
                yield partition.query, page, json.dumps(item, ensure_ascii=False, sort_keys=True)
            if not got or (self.next and not token):
                return
            time.sleep(self.wait)

    def _page(self, query: str, page: int, token: str, tries: int = 3) -> tuple[list, str]:
        url = self.url.format(query=urllib.parse.quote(query, safe=""), page=page, token=urllib.parse.quote(token, safe=""))
        for attempt in range(tries):
            try:
                with urllib.request.urlopen(url, timeout=30) as answer:
                    body = json.load(answer)
                return body.get(self.items) or [], (body.get(self.next) or "") if self.next else ""
            except urllib.error.HTTPError as e:
                if e.code == 404:
                    return [], ""
                if e.code != 429 or attempt == tries - 1:
                    raise
                time.sleep(self._pause(e.headers.get("Retry-After")))
        return [], ""

    def _pause(self, asked: str | None) -> float:
        """Seconds to wait after status 429: what the service asks for, where it gives a number, within bounds."""
        try:
            seconds = float(asked or "")
        except ValueError:
            seconds = self.wait or 1
        return min(max(seconds, self.wait), max(10.0, 10 * self.wait))


class PagedReader(_Pages, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("query",):
                self.queries = [q for q in self.queries if q == f.value]
            elif isinstance(f, In) and f.attribute == ("query",):
                self.queries = [q for q in self.queries if q in f.value]
            elif isinstance(f, LessThan) and f.attribute == ("page",):
                self.pages = min(self.pages, f.value)
            elif isinstance(f, LessThanOrEqual) and f.attribute == ("page",):
                self.pages = min(self.pages, f.value + 1)
            else:
                yield f

    def partitions(self) -> list[Query]:
        return [Query(q, 0, self.pages) for q in self.queries]


class PagedStream(_Pages, DataSourceStreamReader):
    """A scan that can be taken up again: its offset is the number of pages read of every query, and it ends at `pages`.

    Run again with more `pages` from the same checkpoint, it asks for the further ones alone. Pages are asked for by number, so
    that a batch run twice asks for the same ones: services that tell the next page by a token alone are read as a batch.
    """

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        if self.next or "{token}" in self.url:
            raise ValueError("a stream reads pages by number; read a service of page tokens as a batch")

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        return {"pages": self.pages}

    def partitions(self, start: dict, end: dict) -> list[Query]:
        if start["pages"] > end["pages"]:
            raise ValueError(f"{start['pages']} pages were read before; pages can't be lowered to {end['pages']}")
        return [Query(q, start["pages"], end["pages"]) for q in self.queries]


def register(spark: SparkSession) -> None:
    """Make the format paged_json known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedJson)
