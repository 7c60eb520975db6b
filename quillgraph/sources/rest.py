"""A paged JSON API as a Spark data source: one partition per page range, retried with back-off."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def fetch(url: str, opener: Callable = urllib.request.urlopen, retries: int = 5, sleep: Callable[[float], None] = time.sleep) -> dict | None:
    """The decoded body; None for 404 (no more pages). 429 waits as told, or twice as long each time."""
    for attempt in range(retries):
        try:
            with opener(url) as r:
                return json.loads(r.read())
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return None
            if e.code != 429 or attempt == retries - 1:
                raise
            sleep(float(e.headers.get("Retry-After") or 2**attempt))
    return None


class Pages(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.field = options["url"], options.get("field", "results")
        self.pages, self.per = int(options.get("pages", 1)), int(options.get("pages_per_task", 10))

    def partitions(self) -> list[Pages]:
        return [Pages(p, min(p + self.per, self.pages + 1)) for p in range(1, self.pages + 1, self.per)]

    def read(self, part: Pages) -> Iterator[tuple[int, str]]:
        for page in range(part.first, part.last):
            body = fetch(self.url.format(page=page))
            rows = (body or {}).get(self.field) or []
            for row in rows:
                yield page, json.dumps(row)
            if not rows:
                return


class PagedJson(DataSource):
    """``spark.dataSource.register(PagedJson)``; then format("paged_json") with url (holding {page}), pages, field."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "page int, row string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)
