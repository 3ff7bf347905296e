"""Continuous indexing: a stream of files, merged into the store batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.indexer import Indexer
from corvane.sources.files import as_text


def file_stream(spark: SparkSession, folder: str, pattern: str = "*.md", per_batch: int = 1000) -> DataFrame:
    """(file_path, content) of files as they arrive; names that begin with a dot or an underscore are not seen by the file source."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    found = raw.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(folder)
    base = folder.rstrip("/") + "/"
    return found.select(F.regexp_replace("path", r"^file:/+", "/").alias("path"), "content", "modificationTime").select(F.when(F.col("path").startswith(base), F.substring("path", len(base) + 1, 1 << 20)).otherwise(F.col("path")).alias("file_path"), "content", "modificationTime")


def index_stream(indexer: Indexer, files: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Merge every batch of ``files``; merging again what a lost batch had merged changes nothing. ``once``: what is there now, then end."""

    def merge(batch: DataFrame, _: int) -> None:
        last = batch.groupBy("file_path").agg(F.max_by("content", "modificationTime").alias("content"))
        indexer.merge(as_text(last))

    writer = files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
