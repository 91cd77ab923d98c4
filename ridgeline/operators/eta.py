"""Progress of a run in this session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .planning import remaining_download_seconds, remaining_processing_seconds


def remaining(progress: DataFrame, mbps: float = 16.0, each: float = 0.5) -> DataFrame:
    """Rows of (left_bytes, done_bytes, download_seconds, left_tiles, done_tiles, processing_seconds) with ``eta_seconds``.

    Done bytes and seconds are both of this session, so that a resumed run doesn't overstate its rate.
    """
    return progress.withColumn(
        "eta_seconds",
        remaining_download_seconds(F.col("left_bytes"), F.col("done_bytes"), F.col("download_seconds"), mbps)
        + remaining_processing_seconds(F.col("left_tiles"), F.col("done_tiles"), F.col("processing_seconds"), each),
    )
