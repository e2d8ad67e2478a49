"""An inbox folder as a stream: each file is parsed in the batch that it arrives in. Context never crosses files, so no state is kept between batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.sources.lines import lines_from_text


def inbox_lines(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """Lines of text files as they arrive."""
    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_a_batch).load(path)
    return lines_from_text(files.select(F.input_file_name().alias("path"), "value"), "path", "value")


def parse_inbox(spark: SparkSession, path: str, out: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame], once: bool = False) -> StreamingQuery:
    """Parses each batch and appends it as Parquet. A batch that is run again after a failure replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        parse(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = inbox_lines(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def counts_by_window(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Arrivals by source in windows of time, with a bound on lateness."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "source").agg(F.count("*").alias("n"))
