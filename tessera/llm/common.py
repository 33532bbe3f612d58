"""Helpers shared by the training-data operators.

Tables that cut lineage go to the folder named in ``spark.checkpoint.dir``, which
driver and executors share. A private folder is used only where that setting is
absent and the session runs on one machine.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: the white space that separates words
WS = " \t\n\x0b\x0c\r"

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder of this session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="tessera-"))
    return _own_dir[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The reader carries no partitioning, so a later join exchanges both sides
    itself and adaptive execution may split hot keys.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[id(back)] = (back, path)
    made = _recorded.get()
    if made is not None:
        made.append(back)
    return back


_written: dict[int, tuple[DataFrame, str]] = {}
_recorded: ContextVar[list[DataFrame] | None] = ContextVar("recorded", default=None)


@contextmanager
def recorded():
    """The list of the tables that are cut inside the block, for ``forget`` when all that
    reads them has been written."""
    made: list[DataFrame] = []
    token = _recorded.set(made)
    try:
        yield made
    finally:
        _recorded.reset(token)


def forget(*tables: DataFrame | None) -> None:
    """Delete what ``cut`` wrote for these tables: for steps whose readers have been
    written themselves, so that nothing is ever computed from them again."""
    for t in tables:
        _, path = _written.pop(id(t), (None, None))
        if path:
            jvm = t.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have."""
    while base in df.columns:
        base += "_"
    return base


def open_fs(uri: str):
    """(filesystem, path) of a URI or plain path, for use inside tasks."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:") and not uri.startswith("file://"):
            uri = "file://" + uri[len("file:"):]
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def dense_slots(df: DataFrame, group: str, order: list[str], out: str = "slot") -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... without gathering a group.

    The rows are written once with the id of the task that wrote them; a row's
    number is its rank within (group, writing task) plus the group's rows in
    earlier tasks. Nothing larger than one task's share is ever sorted
    together, however large a group is.
    """
    return slots_within(cut(df.withColumn("__pid", F.spark_partition_id()), "slots"), group, order, out)


def slots_within(rows: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """``dense_slots`` of written rows whose column __pid names the task that wrote them."""
    counts = rows.groupBy(group, "__pid").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    local = F.row_number().over(Window.partitionBy(group, "__pid").orderBy(*order))
    return (
        rows.withColumn("__local", local)
        .join(offsets, [group, "__pid"])
        .withColumn(out, (F.col("__before") + F.col("__local") - 1).cast("long"))
        .drop("__pid", "__before", "__local")
    )
