"""SQL functions, table functions and the stitching stream against the DataFrame forms."""

import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions import colour as C, sql, tables, text as T
from tessera.sources.derive import colours, pages_text, read
from tessera.streaming import pages as S

SF = "/root/testdata/sf0.001"


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count()


def test_scalar_functions(spark):
    c = [F.col(k) for k in "rgb"]
    px = colours(spark, SF)
    same(
        sql.run(spark, SF, "SELECT colour_id, colour_hex(r, g, b) AS hex, colour_channels(colour_hex(r, g, b)).g AS g2, colour_format(colour_hex(r, g, b)) AS f FROM tessera_colours"),
        px.select("colour_id", C.to_hex(*c).alias("hex"), C.from_hex(C.to_hex(*c))["g"].alias("g2"), C.detect_format(C.to_hex(*c)).alias("f")),
    )
    urls = read(spark, SF, "pages").select("page_id", "url")
    same(
        sql.run(spark, SF, "SELECT page_id, url_extension(url) AS e, replace_extension(url, '.png') AS p, file_size(page_id * page_id * 977) AS s FROM tessera_urls"),
        urls.select("page_id", T.url_extension(F.col("url")).alias("e"), T.replace_ext(F.col("url"), "png").alias("p"), T.file_size(F.col("page_id") * F.col("page_id") * 977).alias("s")),
    )
    got = spark.sql("SELECT url_extension('http://a.b/c.d/e.PNG?x=.y') AS u, colour_channels('#12') AS n, page_file_name('f', 0, 3) AS p, colour_grey(1, 2, 3) AS y, colour_distance(0, 0, 0, 1, 2, 3) AS d").first()
    assert (got["u"], got["n"], got["p"], got["y"], got["d"]) == (".PNG", None, "f-page-1-of-3", 1, 14)


def test_table_functions_over_views(spark):
    same(sql.run(spark, SF, "SELECT * FROM stitched()"), T.stitch(pages_text(spark, SF)))
    assert [r["hex"] for r in spark.sql("SELECT hex FROM theme_colours('Nord') ORDER BY idx").collect()][:2] == ["#2E3440", "#3B4252"]
    lateral = spark.sql("SELECT d.conv_id, p.page_index FROM (SELECT DISTINCT original_index AS conv_id FROM tessera_pages) d, LATERAL pages_of(d.conv_id) p")
    assert lateral.count() == pages_text(spark, SF).count()


def test_expand_pages_by_lateral_call(spark):
    docs = spark.createDataFrame([(1, "a", ["x", "y"], False), (2, "b", ["p", None, "q"], True), (3, "c", [], False), (4, "d", None, False)], "original_index long, filename string, pages array<string>, native boolean")
    docs.createOrReplaceTempView("expand_docs")
    tables.register(spark)
    got = spark.sql("SELECT d.original_index, p.* FROM expand_docs d, LATERAL expand_pages(d.filename, d.pages, d.native) p")
    same(got, T.expand_pages(docs))
    numbers = spark.sql("SELECT * FROM expand_pages('n', array(5, 6), false)")
    assert dict(numbers.dtypes)["content"] == "int" and [r["content"] for r in numbers.orderBy("page_index").collect()] == [5, 6]
    with pytest.raises(Exception, match="expand_pages takes"):
        spark.sql("SELECT * FROM expand_pages(1, 2, 3)")


def test_number_pages_takes_any_table(spark):
    pages_text(spark, SF).withColumn("extra", F.array(F.lit(1.5))).createOrReplaceTempView("some_pages")
    tables.register(spark)
    got = spark.sql("SELECT * FROM number_pages(TABLE(some_pages))")
    assert got.columns == ["original_index", "page_index", "text", "extra", "name"]
    same(got.select("original_index", "page_index", "name"), T.page_names(pages_text(spark, SF)))
    with pytest.raises(Exception, match="original_index"):
        spark.sql("SELECT * FROM number_pages(TABLE(SELECT 1 AS a))")


@pytest.fixture
def pages(spark):
    p = pages_text(spark, SF)
    return p.join(p.groupBy("original_index").agg(F.count("*").alias("n_pages")), "original_index").select("original_index", "page_index", "n_pages", "text")


@pytest.mark.parametrize("seed", [1, 2])
def test_documents_leave_with_their_last_page(spark, pages, tmp_path, seed):
    """Any order of files, and a restart between them, give the rows of the batch form."""
    files = [f"{tmp_path}/all/{i}" for i in range(4)]
    mixed = pages.withColumn("part", F.pmod(F.hash("original_index", "page_index", F.lit(seed)), F.lit(4))).cache()
    for i, path in enumerate(files):
        mixed.filter(F.col("part") == i).drop("part").coalesce(1).write.parquet(path)
    folder, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "cp"))
    for run in (files[:2], files[2:] + files[:1]):  # the first again: pages that are delivered twice
        for path in run:
            for name in (n for n in os.listdir(path) if n.endswith(".parquet")):
                os.makedirs(folder, exist_ok=True)
                shutil.copy(f"{path}/{name}", f"{folder}/{time.time_ns()}-{name}")
        assert S.run_stitching(spark, folder, out, checkpoint, files_per_trigger=2, partitions=2).awaitTermination(150)
    got = spark.read.schema(S.DOCUMENTS).parquet(out)
    same(got.select("original_index", "text", "n_pages"), T.stitch(pages))
    assert got.filter("not complete").count() == 0


def test_documents_leave_when_their_time_is_up(spark, tmp_path):
    folder, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "cp"))
    put = lambda rows: spark.createDataFrame(rows, S.PAGES).coalesce(1).write.mode("append").parquet(folder)
    put([(1, 1, 3, "b"), (1, 0, 3, "a"), (2, 0, 1, "whole")])
    assert S.run_stitching(spark, folder, out, checkpoint, patience_ms=1, partitions=2).awaitTermination(100)
    time.sleep(0.1)
    put([(3, 0, 2, "x")])
    assert S.run_stitching(spark, folder, out, checkpoint, patience_ms=1, partitions=2).awaitTermination(100)
    put([(1, 2, 3, "late")])
    assert S.run_stitching(spark, folder, out, checkpoint, patience_ms=1, partitions=2).awaitTermination(100)
    got = {r["original_index"]: (r["text"], r["n_pages"], r["complete"]) for r in spark.read.schema(S.DOCUMENTS).parquet(out).collect()}
    assert got[1] == (T.SEPARATOR.join("ab"), 2, False) and got[2] == ("whole", 1, True)
    assert spark.read.schema(S.DOCUMENTS).parquet(out).filter("original_index = 1").count() == 1
