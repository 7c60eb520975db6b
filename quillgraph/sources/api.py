"""A JSON API as a Spark data source: filters sent upstream, POST bodies, a second look at thin rows, one call budget.

``spark.dataSource.register(JsonApi)``, then ``format("json_api")`` with the options

* ``url``: may hold {page}; without it, and for POST, the page goes as the field ``page_field`` (page).
* ``body``: a JSON object, which makes the request a POST; filters and page are put into it.
* ``filters``: comma-separated columns that upstream can filter by; ``column = value`` on them is sent along.
* ``field`` (results): where the rows are; ``pages``, ``pages_per_task``: how many, and how many a task asks for.
* ``detail``: a URL with {id}, asked where a row lacks ``detail_need``; {id} is the row's ``detail_key``, and the first of
  ``detail_take`` that the answer has takes the missing field's place.
* ``budget``: calls that all tasks together may make. Each task has its share beforehand, so no task has to ask another,
  and every try counts; a task that Spark runs again spends its share again.

Rows: page, status (ok, or over_budget for a page or detail that was not asked for), row (JSON), and the filter columns.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from .rest import fetch


class OverBudget(RuntimeError):
    """The task's share of calls is used up."""


class Calls:
    """Opens addresses as long as there are calls left (None: no end)."""

    def __init__(self, left: int | None, opener=urllib.request.urlopen):
        self.left, self.opener, self.made = left, opener, 0

    def __call__(self, request):
        if self.left is not None and self.made >= self.left:
            raise OverBudget
        self.made += 1
        return self.opener(request)


class Range(InputPartition):
    def __init__(self, first: int, last: int, share: int | None):
        super().__init__((first, last, share))
        self.first, self.last, self.share = first, last, share


class JsonApiReader(DataSourceReader):
    def __init__(self, options: dict):
        o = self.options = dict(options)
        self.columns = [c.strip() for c in o.get("filters", "").split(",") if c.strip()]
        self.fixed: dict[str, str] = {}
        self.pages, self.per = int(o.get("pages", 1)), int(o.get("pages_per_task", 10))
        self.budget = int(o["budget"]) if "budget" in o else None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo) and len(f.attribute) == 1 else None
            if name in self.columns and f.value is not None and self.fixed.setdefault(name, f.value) == f.value:
                continue
            yield f

    def partitions(self) -> list[Range]:
        starts = range(1, self.pages + 1, self.per)
        share = lambda i: None if self.budget is None else self.budget // len(starts) + (i < self.budget % len(starts))
        return [Range(p, min(p + self.per, self.pages + 1), share(i)) for i, p in enumerate(starts)]

    def request(self, page: int) -> urllib.request.Request:
        o, page_field = self.options, self.options.get("page_field", "page")
        url = o["url"].replace("{page}", str(page))
        sent = self.fixed if url != o["url"] else self.fixed | {page_field: page}
        if "body" in o:
            data = json.dumps(json.loads(o["body"]) | sent).encode()
            return urllib.request.Request(url, data, {"Content-Type": "application/json"})
        return urllib.request.Request(url + (("&" if "?" in url else "?") + urllib.parse.urlencode(sent) if sent else ""))

    def whole(self, row: dict, calls: Calls) -> tuple[str, dict]:
        """The row, with what it lacks from its own page."""
        o = self.options
        need = o.get("detail_need")
        if "detail" not in o or row.get(need) is not None or row.get(o["detail_key"]) is None:
            return "ok", row
        try:
            more = fetch(urllib.request.Request(o["detail"].replace("{id}", urllib.parse.quote(str(row[o["detail_key"]]), safe=""))), calls) or {}
        except OverBudget:
            return "over_budget", row
        value = next((more[f.strip()] for f in o["detail_take"].split(",") if more.get(f.strip()) is not None), None)
        return "ok", row if value is None else row | {need: value}

    def read(self, part: Range) -> Iterator[tuple]:
        calls = Calls(part.share)
        for page in range(part.first, part.last):
            try:
                body = fetch(self.request(page), calls)
            except OverBudget:
                yield (page, "over_budget", None, *[self.fixed.get(c) for c in self.columns])
                continue
            rows = (body or {}).get(self.options.get("field", "results")) or []
            for row in rows:
                status, row = self.whole(row, calls)
                yield (page, status, json.dumps(row), *[str(self.fixed[c]) if c in self.fixed else None if row.get(c) is None else str(row[c]) for c in self.columns])
            if not rows:
                return


class JsonApi(DataSource):
    """Needs ``spark.sql.python.filterPushdown.enabled`` for filters to reach it."""

    @classmethod
    def name(cls) -> str:
        return "json_api"

    def schema(self) -> str:
        names = [c.strip() for c in self.options.get("filters", "").split(",") if c.strip()]
        return ", ".join(["page int", "status string", "row string", *(f"`{c}` string" for c in names)])

    def reader(self, schema) -> JsonApiReader:
        return JsonApiReader(self.options)
