"""A streaming directory source for pixel files, feeding the batch transforms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.rasters import PIXELS


def stream_pixels(spark: SparkSession, folder: str, files_per_trigger: int = 100, schema: str | StructType = PIXELS) -> DataFrame:
    """New pixel Parquet files of a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def run_to_parquet(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Apply a stateless transform to what is there and stop; restarts resume."""
    return transform(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
