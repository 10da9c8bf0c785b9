"""Inbox folder as a stream: each new file is parsed once, whatever restarts happen."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from aligna.plans import task
from aligna.sources import docx


def start(spark: SparkSession, folder: str, out: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Units of all new .docx files under folder, appended by batch to <out>/batch=<n>; a repeated batch overwrites its own."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.[dD][oO][cC][xX]").option("maxFilesPerTrigger", files_per_batch).load(folder)

    def commit(batch, number):
        task.extract(docx.parse_files(batch.select("path", "content"))).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
