"""Landed pages as a data source of its own: one partition for each request, of which each may fail by itself.

spark.read.format("landed_pages").option("path", folder).load() has a row for
each page of each source under the folder: source, turn, kind, country, query,
url, body, and error, which says why a page has no body.  Files are named
<turn>-<kind>[-<query>].<ending> in a folder of their source's name; a file
that holds an HTTP status of failure, or can't be read, is a failed request.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from lotwatch.operators.files import ship

NAME = "landed_pages"
SCHEMA = "source string, turn int, kind string, country string, query string, url string, body string, error string"
FILE = re.compile(r"(\d+)(?:-([a-z]+))?(?:-(.*?))?(?:\.[a-z]+)?$")
STATUS = re.compile(r"\s*(?:HTTP )?([45]\d\d)\b")
#: Keys of JSON payloads under which items stand, of which a page has `limit` at most.
ITEMS = ("itemSummaries", "auctions", "results")


class Request(InputPartition):
    def __init__(self, source: str, path: str):
        self.source, self.path = source, path


class PageReader(DataSourceReader):
    """Reads the files of a shared folder; only the asked sources' folders are listed."""

    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("landed_pages needs the option path")
        self.folder = options["path"].removeprefix("file://").removeprefix("file:")
        self.limit = int(options.get("limit", 0))
        self.sources = {options["source"]} if "source" in options else None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            asked = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if asked is not None and f.attribute == ("source",):
                self.sources = asked if self.sources is None else self.sources & asked
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out = []
        for source in sorted(s.name for s in os.scandir(self.folder) if s.is_dir() and (self.sources is None or s.name in self.sources)):
            files = sorted(f.name for f in os.scandir(f"{self.folder}/{source}") if f.is_file() and not f.name.startswith((".", "_")))
            out += [Request(source, f"{self.folder}/{source}/{name}") for name in files]
        return out

    def read(self, partition: Request | None) -> Iterator[tuple]:
        if partition is None:  # no file at all
            return
        m = FILE.match(os.path.basename(partition.path))
        turn, kind, query = (int(m[1]), m[2], m[3]) if m else (0, None, None)
        body = error = None
        try:
            with open(partition.path, encoding="utf-8") as f:
                body = f.read()
        except (OSError, UnicodeDecodeError) as e:
            error = str(e)[:200]
        if body is not None and (status := STATUS.match(body)):
            body, error = None, f"HTTP {status[1]}"
        elif body is not None and not body.strip():
            body, error = None, "empty answer"
        country = kind.upper() if kind and len(kind) == 2 else None
        yield partition.source, turn, kind, country, query, partition.path, self.capped(body) if body and self.limit else body, error

    def capped(self, body: str) -> str:
        """A JSON payload with the first `limit` items; any other body as it is."""
        try:
            data = json.loads(body)
        except ValueError:
            return body
        held = [k for k in ITEMS if isinstance(data, dict) and isinstance(data.get(k), list) and len(data[k]) > self.limit]
        return json.dumps(data | {k: data[k][: self.limit] for k in held}, ensure_ascii=False) if held else body


class LandedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, and lets it see the filters."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedPages)


def pages(spark: SparkSession, folder: str, source: str, limit: int = 0) -> DataFrame:
    """The pages of a source, as registry.collect reads them: failed ones have a null body."""
    register(spark)
    rows = spark.read.format(NAME).option("path", folder).option("source", source)
    return (rows.option("limit", limit) if limit else rows).load()
