"""Listings as a Spark data source, for batch and for streams.

``spark.read.format("listing").option("category", url).load()`` gives (page, html) of a category's
listing. A listing is one partition, as only a page tells whether another follows; the documents that
it links are then fetched in parallel by ``fetch_documents``. As a stream, each trigger reads the pages
that have come since the last one.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from .pages import has_next, http_get, listing_pages

LISTING = "page int, html string"
FETCHED = "url string, html string, error string"


def _address(category: str, items: int, page: int) -> str:
    return f"{category}?items_per_page={items}&page={page}"


class _Reader(DataSourceReader):
    def __init__(self, category: str, items: int, most: int | None):
        self.category, self.items, self.most = category, items, most

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.category)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from listing_pages(partition.value, self.items, self.most)


class _StreamReader(SimpleDataSourceStreamReader):
    def __init__(self, category: str, items: int, most: int | None):
        self.category, self.items, self.most = category, items, most

    def initialOffset(self) -> dict:
        return {"page": 0, "read": False}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        """The page at start. The offset stays at the last page, which is given again once a next one is linked."""
        page = start["page"]
        last = self.most is not None and page + 1 >= self.most
        if last and start["read"]:
            return iter([]), start
        html = http_get(_address(self.category, self.items, page))
        if has_next(html) and not last:
            return iter([(page, html)]), {"page": page + 1, "read": False}
        return iter([] if start["read"] else [(page, html)]), {"page": page, "read": True}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        stop = end["page"] + (end["read"] and start != end)
        return iter([(p, http_get(_address(self.category, self.items, p))) for p in range(start["page"], stop)])


class ListingSource(DataSource):
    """Options: category (the listing's address), items_per_page (60), max_pages (none)."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return LISTING

    def _arguments(self) -> tuple:
        most = self.options.get("max_pages")
        return self.options["category"], int(self.options.get("items_per_page", 60)), int(most) if most else None

    def reader(self, schema) -> DataSourceReader:
        return _Reader(*self._arguments())

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _StreamReader(*self._arguments())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ListingSource)


def fetch_documents(urls: DataFrame, pause: float = 0.25, get=http_get) -> DataFrame:
    """url, html, error for each url; html is null where all tries failed. Each task waits between its requests."""

    def run(batches):
        for b in batches:
            rows = []
            for url in b["url"]:
                try:
                    rows.append((url, get(url), None))
                except RuntimeError as e:
                    rows.append((url, None, str(e)))
                time.sleep(pause)
            yield pd.DataFrame(rows, columns=["url", "html", "error"])

    return urls.select(F.col("url").cast("string").alias("url")).mapInPandas(run, FETCHED)
