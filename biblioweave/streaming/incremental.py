"""Statistics kept up as rows arrive: an extension of the refreshed tables to streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts_by_window(events: DataFrame, time: str, kind: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, ``kind``, n) of a stream: rows in each window, final once the watermark has passed it; later rows are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def upsert_batch(base: str, key: list[str]):  # noqa: ANN201
    """A function for foreachBatch that adds each batch's counts to the table under ``base``, one version a batch.

    A batch that is tried again after a failure replaces its own version, so that it counts once.
    """

    def apply(batch: DataFrame, number: int) -> None:
        batch.groupBy(*key).agg(F.count("*").alias("n")).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/batch={number}")

    return apply
