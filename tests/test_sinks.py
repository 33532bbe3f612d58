"""The picture source and the sinks that publish all or nothing."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import rasters as R
from tessera.sources import pictures, publish
from tessera.sources.derive import px as pixels

PX = "img_id long, x int, y int, r int, g int, b int, a int"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def px(spark):
    return spark.createDataFrame([(i, x, y, x * 9, y * 7, i, 255 - i) for i in range(7) for x in range(3 + i) for y in range(9 - i)], PX)


def rows(df):
    return sorted(map(tuple, df.select("img_id", "x", "y", "r", "g", "b", "a").collect()))


def visible(folder):
    return sorted(os.path.basename(p) for p in glob.glob(f"{folder}/**/*.png", recursive=True) if "/_" not in p)


def test_pictures_round_trip(spark, px, tmp_path):
    folder = f"{tmp_path}/a"
    pictures.write_pictures(px, folder)
    assert visible(folder) == [f"{i}.png" for i in range(7)] and not glob.glob(f"{folder}/_*")
    back = pictures.read_pictures(spark, folder)
    assert rows(back) == rows(px)
    many = spark.read.format(pictures.NAME).option("partitionBytes", "1").load(folder)
    assert many.rdd.getNumPartitions() == 7 and rows(many) == rows(px)
    path = back.filter("img_id = 3").first()["path"]
    assert rows(back.filter(F.col("path") == path)) == rows(px.filter("img_id = 3"))
    spark.conf.set(pictures.PUSHDOWN, "true")
    one = pictures.read_pictures(spark, folder).filter(F.col("path") == path)
    assert rows(one) == rows(px.filter("img_id = 3")) and one.rdd.getNumPartitions() == 1
    spark.conf.unset(pictures.PUSHDOWN)
    assert {r["content"][:4] for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).collect()} == {b"\x89PNG"}


def test_modes_and_names(spark, px, tmp_path):
    folder = f"{tmp_path}/b"
    pictures.write_pictures(px.filter("img_id < 3"), folder)
    pictures.write_pictures(px.filter("img_id >= 3"), folder)
    assert rows(pictures.read_pictures(spark, folder)) == rows(px)
    pictures.write_pictures(px.filter("img_id = 5"), folder, "overwrite")
    assert visible(folder) == ["5.png"]
    os.rename(glob.glob(f"{folder}/part-*/5.png")[0], f"{folder}/named.png")
    got = pictures.read_pictures(spark, folder)
    assert {r["img_id"] for r in got.collect()} == {pictures.image_id("named.png")} and got.count() == px.filter("img_id = 5").count()
    pictures.write_pictures(px.limit(0), f"{tmp_path}/empty")
    assert pictures.read_pictures(spark, f"{tmp_path}/empty").count() == 0


def test_a_failing_task_leaves_no_file(spark, px, tmp_path):
    folder = f"{tmp_path}/c"
    pictures.write_pictures(px.filter("img_id = 0"), folder)
    broken = px.filter("img_id > 0").withColumn("r", F.when((F.col("img_id") == 6) & (F.col("x") == 8), F.raise_error(F.lit("no"))).otherwise(F.col("r")))
    with pytest.raises(Exception):
        pictures.write_pictures(broken, folder)
    assert visible(folder) == ["0.png"] and not glob.glob(f"{folder}/_*/**/*.png", recursive=True)


def test_an_image_in_two_tasks_is_refused(spark, px, tmp_path):
    folder = f"{tmp_path}/d"
    spark.dataSource.register(pictures.PictureSource)
    with pytest.raises(Exception, match="by_image"):
        px.repartition(4, "x").sortWithinPartitions("img_id").write.format(pictures.NAME).mode("append").save(folder)
    assert visible(folder) == []


def test_all_pictures_of_a_table(spark, tmp_path):
    px = pixels(spark, SF)
    pictures.write_pictures(px, str(tmp_path / "t"))
    assert rows(pictures.read_pictures(spark, str(tmp_path / "t"))) == rows(px)


def test_publish_is_all_or_nothing(spark, tmp_path):
    folder, schema = f"{tmp_path}/p", "id long, text string"
    scans = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            scans.add(len(b))
            yield b

    good = spark.range(1000).selectExpr("id", "concat('t', id) AS text", "CAST(NULL AS string) AS error").mapInPandas(seen, schema + ", error string")
    assert publish.publish(good, folder) == {"completed": 1000, "failed": 0, "total": 1000, "published": 1000}
    assert scans.value == 1000  # one pass
    bad = good.withColumn("error", F.when(F.col("id") == 777, F.lit("failed")))
    assert publish.publish(bad, folder) == {"completed": 999, "failed": 1, "total": 1000, "published": 0}
    assert publish.published(spark, folder, schema).count() == 1000 and len(os.listdir(folder)) == 1
    assert publish.publish(good.limit(0), folder)["total"] == 0
    assert publish.published(spark, f"{tmp_path}/none", schema).count() == 0


def test_publish_texts(spark, tmp_path):
    folder = f"{tmp_path}/q"
    items = spark.createDataFrame([("a/1.md", "eins é", None), ("2.md", "", None), ("3.md", "drei", None)], "name string, text string, error string")
    assert publish.publish_texts(items.withColumn("error", F.when(F.col("name") == "2.md", F.lit("no"))), folder)["published"] == 0
    assert not glob.glob(f"{folder}/*")
    assert publish.publish_texts(items, folder) == {"completed": 3, "failed": 0, "total": 3, "published": 2}
    found = {os.path.relpath(p, folder).split("/", 1)[1]: open(p, encoding="utf-8").read() for p in glob.glob(f"{folder}/**/*.md", recursive=True)}
    assert found == {"a/1.md": "eins é", "3.md": "drei"}
