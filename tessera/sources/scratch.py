"""Folders that driver and executors share, and what is done to them by Hadoop's file systems."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder below ``spark.checkpoint.dir``, or, in a session on one machine
    that lacks this setting, below a private folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="tessera-core-"))
        shared = _own[0]
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder, which is atomic in file systems that have folders; the target must not exist."""
    fs, old = _path(spark, source)
    _, new = _path(spark, target)
    fs.mkdirs(new.getParent())
    if fs.exists(new) or not fs.rename(old, new):
        raise OSError(f"cannot rename {source} to {target}")


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _path(spark, path)
    fs.delete(where, True)


def children(spark: SparkSession, folder: str) -> list[str]:
    """Paths of what lies in a folder; none where there is no such folder."""
    fs, where = _path(spark, folder)
    return [f.getPath().toString() for f in fs.listStatus(where)] if fs.exists(where) else []
