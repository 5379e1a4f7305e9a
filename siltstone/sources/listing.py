"""Paged JSON listings over HTTP as a data source: ``spark.dataSource.register(Listing)``, then ``spark.read.format("listing")``."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime
from urllib.error import HTTPError
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit
from urllib.request import Request, urlopen

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

#: Statuses that are worth another try.
PASSING = frozenset((429, 500, 502, 503, 504))
LINK = re.compile(r'<([^>]*)>((?:[^,"]|"[^"]*")*)')
REL = re.compile(r'\brel="?([a-z ]+)"?', re.I)


def links(header: str | None) -> dict[str, str]:
    """rel -> url of a Link header."""
    found = ((m[1], REL.search(m[2])) for m in LINK.finditer(header or ""))
    return {name: url for url, rel in found if rel for name in rel[1].lower().split()}


def with_query(url: str, **more: object) -> str:
    """``url`` with parameters set; those it has of the same names are replaced."""
    at = urlsplit(url)
    kept = [(k, v) for k, v in parse_qsl(at.query, keep_blank_values=True) if k not in more]
    return urlunsplit(at._replace(query=urlencode([*kept, *more.items()])))


def value(kind: T.DataType, x: object) -> object:
    """A JSON value as one of a Spark type; null where it does not fit."""
    match kind:
        case T.StructType():
            return tuple(value(f.dataType, x.get(f.name)) for f in kind.fields) if isinstance(x, dict) else None
        case T.ArrayType():
            return [value(kind.elementType, y) for y in x] if isinstance(x, list) else None
        case T.MapType():
            return {k: value(kind.valueType, y) for k, y in x.items()} if isinstance(x, dict) else None
        case T.StringType():
            return x if x is None or isinstance(x, str) else json.dumps(x, ensure_ascii=False)
        case T.BooleanType():
            return x if isinstance(x, bool) else None
        case T.TimestampType() | T.DateType():
            try:
                at = datetime.fromisoformat(x) if isinstance(x, str) else None
            except ValueError:
                return None
            return at if at is None or isinstance(kind, T.TimestampType) else date(at.year, at.month, at.day)
        case T.DoubleType() | T.FloatType():
            return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None
        case T.IntegralType():
            return x if isinstance(x, int) and not isinstance(x, bool) else None
    raise TypeError(f"no JSON value is of type {kind.simpleString()}")


@dataclass
class Pages(InputPartition):
    """Pages ``first`` to ``last`` by number; with ``last`` None, ``url`` and whatever follows it by links."""

    url: str
    first: int
    last: int | None


class ListingReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.schema, self.url = schema, options["url"]
        self.page, self.size = options.get("page_parameter", "page"), int(options.get("per_page", "100"))
        self.limit = int(options["limit"]) if options.get("limit") else None
        self.tries, self.pause, self.longest = int(options.get("tries", "4")), float(options.get("pause", "0.5")), float(options.get("longest_pause", "10"))
        self.together, self.items = int(options.get("pages_per_task", "4")), options.get("items", "items")
        self.askable = {x.strip() for x in options.get("filters", "").split(",")} - {""}
        self.headers = {"Accept": "application/json", **json.loads(options.get("headers", "{}"))}
        self.timeout = float(options.get("timeout", "30"))

    def get(self, url: str) -> tuple[list, dict[str, str]]:
        """Rows and links of a page. Passing failures are tried again, after as long as the server asks or growing pauses."""
        for left in range(self.tries - 1, -1, -1):
            wait = self.pause * 2 ** (self.tries - 1 - left)
            try:
                with urlopen(Request(url, headers=self.headers), timeout=self.timeout) as answer:
                    body, found = json.load(answer), links(answer.headers.get("Link"))
                return (body if isinstance(body, list) else body.get(self.items) or []), found
            except HTTPError as error:
                if error.code not in PASSING or not left:
                    raise OSError(f"{url}: status {error.code}") from error
                asked = error.headers.get("Retry-After") or ""
                wait = float(asked) if asked.replace(".", "", 1).isdigit() else wait
            except OSError as error:
                if not left:
                    raise OSError(f"{url}: {error}") from error
            time.sleep(min(wait, self.longest))
        raise ValueError("tries must be at least 1")

    def partitions(self) -> list[Pages]:
        """A task for each few pages, where the first page says which is the last; else one that follows the links."""
        start = with_query(self.url, per_page=self.size)
        if self.limit == 0:
            return [Pages(start, 1, 0)]
        found = self.get(start)[1]
        if "next" not in found:
            return [Pages(start, 1, 1)]
        end = dict(parse_qsl(urlsplit(found.get("last", "")).query)).get(self.page, "")
        if not end.isdigit():
            return [Pages(start, 1, None)]
        last = int(end) if self.limit is None else min(int(end), -(-self.limit // self.size))
        return [Pages(start, n, min(n + self.together - 1, last)) for n in range(1, last + 1, self.together)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        url, n, seen = partition.url, partition.first, (partition.first - 1) * self.size
        while partition.last is None or n <= partition.last:
            rows, found = self.get(url if partition.last is None else with_query(url, **{self.page: n}))
            for row in rows if self.limit is None else rows[: max(0, self.limit - seen)]:
                yield value(self.schema, row if isinstance(row, dict) else {})
            seen += len(rows)
            n += 1
            if partition.last is None:
                if "next" not in found or self.limit is not None and seen >= self.limit:
                    return
                url = urljoin(url, found["next"])


class AskingReader(ListingReader):
    def pushFilters(self, filters: list) -> Iterator:
        """Equalities on the columns in ``filters`` go into the request; Spark checks all of them again."""
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in self.askable and isinstance(f.value, (str, int)):
                x = f.value
                self.url = with_query(self.url, **{f.attribute[0]: str(x).lower() if isinstance(x, bool) else x})
            yield f


class Listing(DataSource):
    """A listing that answers with JSON rows, or an object with the rows under ``items``, page by page.

    Options: url; per_page, page_parameter; limit (rows at most; none by default); tries, pause, longest_pause, timeout;
    pages_per_task; items; filters (columns that the server can compare, by name); headers (JSON). The schema is given
    to the reader: ``spark.read.format("listing").schema("number long, state string")``. Fields are taken by name; missing
    ones and values of another type are null. Requests only read, so a lost task is repeated safely.
    ``filters`` needs ``spark.sql.python.filterPushdown.enabled``. With a limit nothing is pushed: it counts rows as listed.
    """

    @classmethod
    def name(cls) -> str:
        return "listing"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        asks = self.options.get("filters") and not self.options.get("limit")
        return (AskingReader if asks else ListingReader)(dict(self.options), schema)
