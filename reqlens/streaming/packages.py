"""Packages that arrive as files: the coverage plan over each micro-batch. An extension: the batch form is the whole feature."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from reqlens.plans.coverage import analyze
from reqlens.sources.packages import REQUEST


def follow(spark: SparkSession, folder: str, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Results of every new package file go to `sink(results, batch_id)`; each package is one row, so no state is kept."""
    stream = spark.readStream.schema(REQUEST).option("multiLine", True).json(folder)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: sink(analyze(df)["results"], i))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
