"""Landed pages to the record table, as a stream with a checkpoint.

A batch of pages is parsed on the executors and merged set-wise into the buckets of the table that it touches, as one
version. The log holds the batch id and its counts, so a batch that is run again after a failure isn't applied twice.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import merge
from ..sources import pages


def landed(spark: SparkSession, folder: str, pages_a_batch: int = 1000) -> DataFrame:
    """A stream of pages(page_no, xml) from numbered files, as bytes: a page says itself how it is encoded."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", pages_a_batch).option("pathGlobFilter", "*.xml").load(folder)
    number = F.regexp_extract(F.col("path"), r"([0-9]+)\.xml$", 1).cast("int")
    return files.select(number.alias("page_no"), F.col("content").alias("xml"))


def ingest(spark: SparkSession, folder: str, prefix: str, table: merge.VersionedTable, checkpoint: str, source_url: str | None = None, now: datetime | None = None, pages_a_batch: int = 1000) -> StreamingQuery:
    """Starts the stream over what has landed; it ends when all of it is merged. A feed's error page stops it."""

    def batch(found: DataFrame, number: int) -> None:
        rows = pages.parsed(found, prefix).persist()
        try:
            if error := pages.first_error(rows):
                raise pages.FeedError(*error)
            stamp = now or datetime.now()
            counts = rows.agg(F.count_if(F.col("pos") < 0).alias("pages"), F.count_if(F.col("pos") >= 0).alias("records")).head()
            table.merge(pages.records(rows, prefix, source_url), lambda old, new: merge.upsert(old, new, prefix, stamp), batch=f"{prefix}-{number}", pages=counts[0], records=counts[1])
        finally:
            rows.unpersist()

    return landed(spark, folder, pages_a_batch).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
