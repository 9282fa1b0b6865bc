"""A paged feed as a Spark source, in batch and as a stream with offsets.

    spark.dataSource.register(PagedFeed)  # executors need this package installed
    spark.read.format("threat_feed").load("s3://feeds/vendor")
    spark.readStream.format("threat_feed").option("pages_per_partition", 32).load(...)

A collector leaves each answer of its interface as one page: a JSON file ``{"items": [...]}``, in names that grow with time.
Pages are read by the executors, several to a partition; the driver only lists names.  A page that cannot be read is a row
with an error, so the intake log can say so, and never stops the others.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "threat_feed"
SCHEMA = "page string, place int, record string, error string"
PAGES_PER_PARTITION = 16


def _files(root: str):
    """File system and path of a folder, which may be a plain path or an address."""
    from pyarrow import fs

    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(root)


def pages_of(root: str) -> list[str]:
    """Names of the pages below a folder, in their order; hidden and marker files are none."""
    from pyarrow import fs

    files, path = _files(root)
    found = files.get_file_info(fs.FileSelector(path, recursive=True))
    names = [f.path[len(path.rstrip("/")) + 1 :] for f in found if f.type == fs.FileType.File]
    return sorted(n for n in names if not any(part.startswith((".", "_")) for part in n.split("/")))


class Pages(InputPartition):
    def __init__(self, names: list[str]) -> None:
        self.names = names


def _split(names: list[str], size: int) -> list[Pages]:
    return [Pages(names[first : first + size]) for first in range(0, len(names), size)]


def _rows(root: str, names: list[str]) -> Iterator[tuple]:
    files, path = _files(root)
    for name in names:
        try:
            with files.open_input_stream(f"{path.rstrip('/')}/{name}") as stream:
                items = json.loads(stream.read().decode())["items"]
            if not isinstance(items, list):
                raise ValueError("items is no list")
        except (OSError, ValueError, KeyError, TypeError) as error:
            yield name, None, None, f"{type(error).__name__}: {error}"
            continue
        for place, item in enumerate(items):
            yield name, place, json.dumps(item), None


class FeedReader(DataSourceReader):
    def __init__(self, root: str, size: int) -> None:
        self.root, self.size = root, size

    def partitions(self) -> list[Pages]:
        return _split(pages_of(self.root), self.size)

    def read(self, partition: Pages) -> Iterator[tuple]:
        yield from _rows(self.root, partition.names)


class FeedStreamReader(DataSourceStreamReader):
    """The offset is the name of the last page taken; it lies in the query's checkpoint, so a restart goes on behind it.

    A page must not appear under a name before one that was already read, as with the cursor of an interface.
    """

    def __init__(self, root: str, size: int) -> None:
        self.root, self.size = root, size

    def initialOffset(self) -> dict:
        return {"page": ""}

    def latestOffset(self) -> dict:
        return {"page": max(pages_of(self.root), default="")}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return _split([n for n in pages_of(self.root) if start["page"] < n <= end["page"]], self.size)

    def read(self, partition: Pages) -> Iterator[tuple]:
        yield from _rows(self.root, partition.names)


class PagedFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _arguments(self) -> tuple[str, int]:
        return self.options["path"], int(self.options.get("pages_per_partition", PAGES_PER_PARTITION))

    def reader(self, schema) -> FeedReader:
        return FeedReader(*self._arguments())

    def streamReader(self, schema) -> FeedStreamReader:
        return FeedStreamReader(*self._arguments())


def records(pages: DataFrame, ddl: str) -> DataFrame:
    """Records of a feed by their schema; what does not parse is left to ``page_log``."""
    parsed = _parsed(ddl)
    return pages.where(F.col("error").isNull() & parsed.isNotNull()).select("page", "place", parsed.alias("r")).select("page", "place", "r.*")


def page_log(pages: DataFrame, ddl: str) -> DataFrame:
    """Per page the records read, those that do not parse, and why the page itself could not be read."""
    bad = F.col("record").isNotNull() & _parsed(ddl).isNull()
    return pages.groupBy("page").agg(
        F.count("record").alias("n_records"), F.count_if(bad).alias("n_bad"), F.max("error").alias("error"))


def _parsed(ddl: str) -> Column:
    """The record as a struct; null unless its text is an object."""
    return F.when(F.col("record").startswith("{"), F.from_json("record", ddl))
