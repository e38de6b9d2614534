"""Start, finish and read streaming jobs. Results go to an append-only parquet log (exactly once)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_files(spark: SparkSession, folder: str, schema: StructType, glob: str = "*.parquet",
               files_per_batch: int = 1_000, bytes_per_batch: int | None = None) -> DataFrame:
    """A stream over the parquet files of a folder, a bounded number of files, or of bytes, per micro-batch."""
    bound = ("maxFilesPerTrigger", files_per_batch) if bytes_per_batch is None else ("maxBytesPerTrigger", bytes_per_batch)
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option(*bound).parquet(folder)


def start(stream: DataFrame, out: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Append the stream to a parquet log; without an interval it takes what is there and ends."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def drain(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Process all available input and return the log so far."""
    start(stream, out, checkpoint).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
