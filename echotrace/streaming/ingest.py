"""Scraped rows as a stream: into indexed documents, and into matches.

Normalising and indexing keep no state. Each URL passes once; its state is kept for ``horizon`` of event
time if the rows have a time column, else for good. Matches are found a micro-batch at a time and
written to a folder of the batch's number, so that a batch that is run again replaces its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans import matching

ROWS = (
    "title string, date_text string, date_iso string, president string, location string, url string, "
    "node_id string, word_count int, has_video_flag boolean, transcript string"
)


def read_rows(spark: SparkSession, folder: str, form: str = "parquet", schema: str = ROWS, files_per_trigger: int = 1000) -> DataFrame:
    """Rows of the files that come into folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if form == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.format(form).load(folder)


def first_of_each_url(rows: DataFrame, time: str | None = None, horizon: str = "30 days") -> DataFrame:
    """A row of each url, the one that Spark meets first (of rows in one micro-batch, any); with a time column, urls are forgotten after horizon."""
    if time is None:
        return rows.dropDuplicates(["url"])
    return rows.withWatermark(time, horizon).dropDuplicatesWithinWatermark(["url"])


def indexed(rows: DataFrame, notes: bool = True) -> DataFrame:
    """Rows in the matching form of documents; works on streams and on tables."""
    return matching.index_documents(matching.normalize_rows(rows, notes))


def write_index(rows: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Indexed documents as Parquet in out."""
    return indexed(rows).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(out)


def write_matches(rows: DataFrame, passages: DataFrame, out: str, checkpoint: str, options: dict | None = None, **trigger) -> StreamingQuery:
    """Ranked matches of each micro-batch, in out/batch=<number>; weights are those of the batch's corpus."""

    def one(batch: DataFrame, number: int) -> None:
        matching.match(batch, passages, **(options or {})).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return indexed(rows).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
