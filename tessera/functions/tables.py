"""Table functions for SQL.

``register(spark)`` makes them known:

    SELECT d.original_index, p.* FROM docs d, LATERAL expand_pages(d.filename, d.pages, d.native) p
    SELECT * FROM number_pages(TABLE(pages))

Both are polymorphic: their columns follow from the arguments.
"""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructType


class ExpandPages:
    """Items of a document: itself (page_index -1, its pages joined by line breaks) if its
    recogniser reads it whole, else one per page, named by number and total. A document
    without pages has no items, unless it is read whole; pages that are not text
    can't be joined."""

    @staticmethod
    def analyze(filename: AnalyzeArgument, pages: AnalyzeArgument, native: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(filename.dataType, StringType) or not isinstance(pages.dataType, ArrayType) or not isinstance(native.dataType, BooleanType):
            raise ValueError("expand_pages takes a file name, an array of pages and a boolean")
        return AnalyzeResult(StructType().add("page_index", LongType()).add("filename", StringType()).add("content", pages.dataType.elementType))

    def eval(self, filename, pages, native):
        if native:
            yield -1, filename, None if pages is None else "\n".join(p for p in pages if p is not None)
            return
        for i, page in enumerate(pages or ()):
            yield i, f"{filename}-page-{i + 1}-of-{len(pages)}", page


class NumberPages:
    """The pages of a table with the columns original_index, page_index and any others, beside
    their name by number and total. Spark brings each document's pages together in
    order; its rows are held until the last, as the name tells their number."""

    @staticmethod
    def analyze(pages: AnalyzeArgument) -> AnalyzeResult:
        if not pages.isTable:
            raise ValueError("number_pages takes a table")
        missing = {"original_index", "page_index"} - set(pages.dataType.names)
        if missing or "name" in pages.dataType.names:
            raise ValueError("number_pages needs original_index and page_index, and adds name")
        schema = StructType([*pages.dataType.fields]).add("name", StringType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("original_index")], orderBy=[OrderingColumn("page_index")])

    def __init__(self):
        self.rows: list[Row] = []

    def eval(self, row: Row):
        self.rows.append(row)

    def terminate(self):
        for row in self.rows:
            yield *row, f"doc{row['original_index']}-page-{row['page_index'] + 1}-of-{len(self.rows)}"


def register(spark: SparkSession) -> None:
    spark.udtf.register("expand_pages", udtf(ExpandPages))
    spark.udtf.register("number_pages", udtf(NumberPages))
