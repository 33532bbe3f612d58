"""Work units: which input is read, where its result goes, and in what format.

A plan is a table of (op_id, source, input, output, format, error). Generators have no
input; otherwise a folder comes before a list of files, and a list before a single file.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import IMAGE_EXTENSIONS, TEXT_EXTENSIONS, ext_error, is_stdout, replace_ext_column, resolve_ext

PLAN = ["op_id", "source", "input", "output", "format", "error"]
GENERATORS = ("gradient",)
MULTI_INPUT = ("gif", "stack")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def has_ext(path: Column) -> Column:
    return F.coalesce(path.rlike(r"\.[^./]*$"), F.lit(False))


def join_path(folder: Column, name: Column) -> Column:
    return F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/"), name)


def plan(units: DataFrame, output_folder: str = "out") -> DataFrame:
    """The plan of units (op_id, command, source, input, flag, destination, stamp,
    several): source is file, stdin or none; several says that the unit is one of many,
    so that a destination is a folder whatever it looks like."""
    c = F.col
    ext = resolve_ext(c("flag"), c("destination"), c("command"), c("source"), c("input"))
    named = F.when(c("source") == "none", F.concat(c("command"), F.lit("-"), c("stamp"), F.lit("."), ext)).when(
        c("source") == "stdin", F.concat(F.lit("img-"), c("stamp"), F.lit("."), ext)
    ).otherwise(replace_ext_column(base_name(c("input")), ext))
    folder = F.when(c("command") == "ocr", join_path(F.lit(output_folder), F.lit("ocr"))).otherwise(F.lit(output_folder))
    given = F.nullif(c("destination"), F.lit(""))
    whole_file = given.isNotNull() & has_ext(given) & ~c("several")
    output = F.when(is_stdout(given) & ~c("several"), "-").when(whole_file, given).otherwise(join_path(F.coalesce(given, folder), named))
    return units.select("op_id", "source", "input", output.alias("output"), ext.alias("format"), ext_error(ext).alias("error"))


def plan_together(units: DataFrame, output_folder: str = "out") -> DataFrame:
    """The plan of commands that make one output of many inputs (op_id, command, input,
    flag, destination, stamp): all inputs of a unit share its output."""
    c = F.col
    given = F.nullif(c("destination"), F.lit(""))
    default = F.when(c("command") == "gif", "gif").otherwise("png")
    own = F.coalesce(F.nullif(c("flag"), F.lit("")), default)
    folder = F.coalesce(given, F.when(c("command") == "gif", join_path(F.lit(output_folder), F.lit("gifs"))).otherwise(F.lit(output_folder)))
    whole_file = given.isNotNull() & has_ext(given)
    stdout = is_stdout(given)
    ext = F.when(whole_file & ~stdout, F.regexp_extract(given, r"\.([^./]*)$", 1)).otherwise(own)
    output = F.when(stdout, "-").when(whole_file, given).otherwise(join_path(folder, F.concat(c("command"), F.lit("-"), c("stamp"), F.lit("."), own)))
    return units.select("op_id", F.lit("file").alias("source"), "input", output.alias("output"), ext.alias("format"), ext_error(ext).alias("error"))


def files_of(spark: SparkSession, folder: str, command: str = "") -> DataFrame:
    """(path) of the readable files under a folder; fails where there are none."""
    admitted = (*IMAGE_EXTENSIONS, *TEXT_EXTENSIONS) if command == "ocr" else IMAGE_EXTENSIONS
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    found = found.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*admitted))
    if found.isEmpty():
        raise ValueError(f"no files found under {folder}")
    return found


def files_listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path) of a list of files, made absolute, with ``~`` expanded."""
    return spark.createDataFrame([(os.path.abspath(os.path.expanduser(p)),) for p in paths], "path string")


def load(spark: SparkSession, paths: DataFrame, folder: str) -> DataFrame:
    """(path, content, error) of the wanted files below a folder: each gets its bytes,
    and those that can't be read or have an unknown format a message.

    The folder is only listed; the tasks that the wanted paths are dealt to read their
    bytes, one file at a time, so nothing is read that isn't asked for and no bytes are shuffled."""
    plain = lambda c: F.regexp_replace(c, "^file:/*", "/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(plain("path").alias("path"), F.col("path").alias("uri"))
    wanted = paths.select(plain("path").alias("path")).distinct().join(listed, "path", "left")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    error = F.when(~ext.isin(*IMAGE_EXTENSIONS, *TEXT_EXTENSIONS), F.lit("unsupported format")).when(F.col("uri").isNull(), F.lit("not found"))

    def read(batches):
        from pyarrow import fs

        for batch in batches:
            for path, uri, wrong in zip(batch["path"], batch["uri"], batch["error"]):
                content = None
                if wrong is None:
                    try:
                        where, name = fs.FileSystem.from_uri(uri if "://" in uri else uri.replace(":/", ":///", 1)) if ":/" in uri else (fs.LocalFileSystem(), uri)
                        with where.open_input_stream(name, compression=None) as f:
                            content = f.read()
                    except OSError as e:
                        wrong = str(e)
                yield pd.DataFrame({"path": [path], "content": [content], "error": [wrong]})

    return wanted.select("path", "uri", error.alias("error")).mapInPandas(read, "path string, content binary, error string")
