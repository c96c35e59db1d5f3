"""Scoring of vectors and counting of events as they arrive, each micro-batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.similarity import nearest


def batch_folder(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch that writes batch n to folder/batch=n, in the place of what a run that broke off left there."""

    def sink(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return sink


def batches(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all batches of batch_folder(), with their number in batch."""
    return spark.read.parquet(folder)


def score_stream(arriving: DataFrame, reference: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, k: int = 20) -> StreamingQuery:
    """Each micro-batch of (vec_id, embedding) gets its k neighbours, which go to sink(rows, batch_id)."""

    def one(batch: DataFrame, number: int) -> None:
        sink(nearest(batch, reference, k), number)

    return arriving.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_rates(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Windowed counts of (ts, event_type) with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def rates_stream(events: DataFrame, folder: str, checkpoint: str, late: str = "10 minutes", width: str = "5 minutes", mode: str = "append") -> StreamingQuery:
    """event_rates() into batch_folder(). In append mode a window is written once, when the watermark has passed it; in update mode with every batch that adds to it. Its state is dropped when the watermark has passed it."""
    rates = event_rates(events, late, width).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "event_type", "n")
    return rates.writeStream.outputMode(mode).foreachBatch(batch_folder(folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_rates(spark: SparkSession, folder: str) -> DataFrame:
    """(window_start, window_end, event_type, n) of all windows that rates_stream() has written in update mode, open ones too: the count of the last batch that added to it."""
    return batches(spark, folder).groupBy("window_start", "window_end", "event_type").agg(F.max_by("n", "batch").alias("n"))


def dropped_late(query: StreamingQuery) -> int:
    """Rows that came after the watermark had passed their window, over the progress that a query still holds."""
    return sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)
