"""New pixel files as a stream: each batch of files is reduced to partials, which are appended; summaries stay batch jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import zonal

PIXELS = "tatort string, kommun string, tile string, batch_index int, batch_position int, row int, col int, x double, y double, v double, slope double"
KEYS = ("tatort", "kommun", "tile", "batch_index", "batch_position")


def append_partials(spark: SparkSession, source: str, target: str, checkpoint: str) -> None:
    """Reduces the files of a folder that were not seen before, and ends. A file holds whole tiles.

    A batch's partials go to a folder of its number, so a batch that is repeated after a failure replaces its own.
    """

    def reduce(batch: DataFrame, number: int) -> None:
        zonal.tile_partials(batch, *KEYS).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(PIXELS).parquet(source)
    stream.writeStream.foreachBatch(reduce).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merged(spark: SparkSession, target: str) -> DataFrame:
    """Zones' partials over all batches so far."""
    return zonal.merge_partials(spark.read.parquet(target), "tatort", "kommun")
