"""Paged listings as a data source: a partition for each page, filters on pages and states pushed down, and new pages as a stream.

A listing is a folder of pages, ``<path>/<tool>/page-<n>.json`` with n from 1, each the JSON reply of one call: a list, or an object with
the list under items, data, results or value. Any tool's replies can be read so. Commits are listed newest first; a stream reads listings that
only grow at their end.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition, LessThanOrEqual

NAME, PAGE = "gneiss_pages", re.compile(r"page-(\d+)\.json$")
# Names under which replies hold their list, and those of an item's id.
LISTS, IDS = ("items", "data", "results", "value"), ("sha", "oid", "number", "id")
MAX_PAGES, PER_PAGE = 5, 100


def _folder(options: dict[str, str]):
    from pyarrow import fs

    path = options["path"].rstrip("/") + "/" + options["tool"]
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path) if ":" in path else "file://" + path)


def _pages(options: dict[str, str]) -> list[int]:
    from pyarrow import fs

    where, at = _folder(options)
    found = where.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted(int(m[1]) for f in found if (m := PAGE.search(f.path)))


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


def _items(reply: Any) -> list:
    if isinstance(reply, list):
        return reply
    found = next((reply[k] for k in LISTS if isinstance(reply, dict) and isinstance(reply.get(k), list)), None)
    return found or []


def _rows(options: dict[str, str], page: int, state: str | None = None) -> Iterator[tuple]:
    where, at = _folder(options)
    with where.open_input_stream(f"{at}/page-{page:05d}.json") as f:
        items = _items(json.loads(f.readall()))
    for place, item in enumerate(items):
        fields = item if isinstance(item, dict) else {}
        ident, own = next((str(fields[k]) for k in IDS if fields.get(k) is not None), None), fields.get("state")
        if state is None or own == state:
            yield page, place, ident, own, json.dumps(item, ensure_ascii=False)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.state = options, None
        self.only, self.upto = None, int(options["pages"]) if "pages" in options else None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """A state and pages are tested here; all other filters are Spark's."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("state",) and self.state in (None, f.value):
                self.state = f.value
            elif isinstance(f, EqualTo) and f.attribute == ("page",) and self.only in (None, f.value):
                self.only = f.value
            elif isinstance(f, LessThanOrEqual) and f.attribute == ("page",):
                self.upto = f.value if self.upto is None else min(self.upto, f.value)
            else:
                yield f

    def partitions(self) -> list[Page]:
        pages = [p for p in _pages(self.options) if (self.only in (None, p)) and (self.upto is None or p <= self.upto)]
        return [Page(p) for p in pages]

    def read(self, partition: Page | None) -> Iterator[tuple]:
        # without a page there is no partition to read
        return _rows(self.options, partition.number, self.state) if partition is not None else iter(())


class PagedStream(DataSourceStreamReader):
    """Offsets are numbers of pages: what is read between two is the pages after the first up to the second."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        return {"page": max(_pages(self.options), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(p) for p in _pages(self.options) if start["page"] < p <= end["page"]]

    def read(self, partition: Page) -> Iterator[tuple]:
        return _rows(self.options, partition.number)

    def commit(self, end: dict) -> None:
        pass


class Paged(DataSource):
    """Options: path, tool, and pages, how many are read at most."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "page int, place int, id string, state string, item string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))

    def streamReader(self, schema) -> PagedStream:
        return PagedStream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Paged)


def listing(spark: SparkSession, path: str, tool: str, state: str | None = None, pages: int | None = None) -> DataFrame:
    """page, place (from 0), id, state and item (JSON) of a tool's listing, of one state if it is given."""
    register(spark)
    read = spark.read.format(NAME).option("tool", tool)
    rows = (read if pages is None else read.option("pages", pages)).load(path)
    return rows if state is None else rows.filter(F.col("state") == state)


def stream(spark: SparkSession, path: str, tool: str) -> DataFrame:
    """The same of pages as they come; each page is read once, across restarts too."""
    register(spark)
    return spark.readStream.format(NAME).option("tool", tool).load(path)


def head(spark: SparkSession, path: str) -> str | None:
    """The newest commit."""
    first = listing(spark, path, "list_commits", pages=1).orderBy("page", "place").select("id").first()
    return first and first["id"]


def commits_between(spark: SparkSession, path: str, base: str, newest: str, max_pages: int = MAX_PAGES) -> tuple[DataFrame, bool]:
    """(n, id, item of the commits from ``newest`` on that come before ``base``, newest first; whether ``base`` was met).

    At most ``max_pages`` pages are read. If base is not on them the commits read are returned, and the caller should build anew.
    """
    rows = listing(spark, path, "list_commits", pages=max_pages)
    at = F.struct("page", "place")
    ends = rows.agg(F.min(F.when(F.col("id") == newest, at)).alias("first"), F.min(F.when(F.col("id") == base, at)).alias("last"))  # one row
    found = ends.select(F.col("last").isNotNull()).first()[0]
    own = rows.withColumn("at", at).join(F.broadcast(ends)).filter((F.col("at") >= F.col("first")) & (F.col("last").isNull() | (F.col("at") < F.col("last"))))
    return own.select((F.col("page") * F.lit(1_000_000).cast("long") + F.col("place")).alias("n"), "id", "item"), found or base == newest
