"""Sinks that publish all of a run or nothing.

The one pass over the results that writes them to a hidden folder also counts them, by
observed metrics. Only a run without any failed item is then renamed to its visible
place, as one folder; a run with one failure is deleted. Readers see whole runs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from .scratch import children, delete, move


def publish(results: DataFrame, folder: str, error: str = "error", fmt: str = "parquet", **options: str) -> dict[str, int]:
    """Write ``results`` below ``folder`` unless an item of theirs failed (a row with something
    in the column ``error``). Returns the counters completed, failed, total and published
    (rows that became visible).

    A null in ``error`` is a completed item; an empty table publishes an empty run. A job that
    fails leaves a hidden folder at most, which no reader looks at.
    """
    spark, run = results.sparkSession, uuid.uuid4().hex
    staged, seen = f"{folder}/_staged-{run}", Observation()
    counted = results.observe(seen, F.count("*").alias("total"), F.count(F.col(error)).alias("failed"))
    counted.drop(error).write.format(fmt).options(**options).save(staged)
    total, failed = seen.get["total"], seen.get["failed"]
    if failed:
        delete(spark, staged)
    else:
        move(spark, staged, f"{folder}/run-{run}")
    return {"completed": total - failed, "failed": failed, "total": total, "published": 0 if failed else total}


def published(spark: SparkSession, folder: str, schema: StructType | str, fmt: str = "parquet") -> DataFrame:
    """The rows of all runs below ``folder`` that were published."""
    runs = [p for p in children(spark, folder) if p.rsplit("/", 1)[-1].startswith("run-")]
    return spark.read.format(fmt).schema(schema).load(runs) if runs else spark.createDataFrame([], schema)


def publish_texts(results: DataFrame, folder: str, names: str = "name", error: str = "error") -> dict[str, int]:
    """Save text: write one text file per row (columns ``names``, text, ``error``) below
    ``folder``, named by the row, all or none of them. Rows without text write nothing but count as completed."""
    from ..operators.rasters import save_files

    spark, run = results.sparkSession, uuid.uuid4().hex
    staged, seen = f"{folder}/_staged-{run}", Observation()
    counted = results.observe(seen, F.count("*").alias("total"), F.count(F.col(error)).alias("failed"))
    files = counted.filter(F.col(error).isNull() & (F.col("text") != "")).select(F.col(names).alias("path"), F.encode("text", "UTF-8").alias("content"))
    written = save_files(files, staged).agg(F.count("*").alias("n")).first()["n"]
    total, failed = seen.get["total"], seen.get["failed"]
    if failed:
        delete(spark, staged)
    elif written:
        move(spark, staged, f"{folder}/run-{run}")
    return {"completed": total - failed, "failed": failed, "total": total, "published": 0 if failed else written}
