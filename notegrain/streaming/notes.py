"""Notes that keep arriving: the same operators over a file stream, each batch written once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from notegrain.sources.files import decoded


def arriving_notes(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """doc_id (of the path), file_path, text of files as they arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.xxhash64("path").alias("doc_id"), F.col("path").alias("file_path"), decoded(F.col("content")).alias("text"))


def write_results(notes: DataFrame, operator: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """An operator's rows for each batch, as Parquet; a batch that is run again overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = notes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
