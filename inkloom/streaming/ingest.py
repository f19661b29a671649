"""Structured Streaming: new files converted as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from inkloom.model import Options
from inkloom.plans.convert import convert, with_file_hints

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """A stream of the files that appear below path, at most max_files a batch."""
    return with_file_hints(spark.readStream.format("binaryFile").schema(BINARY_FILE).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").load(path))


def convert_stream(spark: SparkSession, path: str, target: str, checkpoint: str, options: Options | None = None, available_now: bool = False) -> StreamingQuery:
    """Converts arriving files into a Parquet folder; each file once, by the sink's checkpoint."""
    writer = convert(stream_files(spark, path), options).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(target)
