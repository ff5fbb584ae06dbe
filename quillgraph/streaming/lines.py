"""A stream of line documents, each processed as it comes, accumulated or replaced."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def line_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.text(folder).select(F.trim("value").alias("text")).where("text <> ''")


def run(lines: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, mode: str = "accumulate") -> StreamingQuery:
    """Writes ``step`` of each batch to ``path``: appended, or in place of what was there. A batch that runs again in accumulate mode replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        target = f"{path}/batch={number}" if mode == "accumulate" else path
        step(batch).write.mode("overwrite").parquet(target)

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
