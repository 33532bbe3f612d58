"""The queries work on the whole of their tables."""

import base64
import glob
import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.operators import pixels as P

from .test_queries import SF, canon


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    """Tables with 13,000 events: five whole images and a part of a sixth."""
    folder = str(tmp_path_factory.mktemp("many"))
    duckdb.sql(f"COPY (SELECT range AS event_id, range * 31 % 97 AS user_id FROM range(13000)) TO '{folder}/events.parquet' (FORMAT parquet)")
    return folder


def oracle(folder, name):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return canon(con.sql(catalog.oracle_sql()[name]).df())


def test_tilt_draws_every_image(spark, many):
    assert {r[0] for r in catalog.queries()["tilt"](spark, many).select("img_id").distinct().collect()} == set(range(6))


def test_stack_sheets_places_every_image(spark, many):
    got = catalog.queries()["stack_sheets"](spark, many)
    assert got.select("sheet").distinct().count() == 2
    assert got.filter("a = 255 or r + g + b > 0").count() >= 13000
    assert canon(got.toPandas()) == oracle(many, "stack_sheets")


def test_stack_sheets_fills_the_ground_behind_the_shuffle(spark, tmp_path):
    """Images with gaps, one with a place that has two pixels, and no sort of the whole ground in one task."""
    duckdb.sql(f"COPY (SELECT range AS event_id, range * 31 % 97 AS user_id FROM range(9000) WHERE range % 5 <> 2 AND range NOT BETWEEN 2500 AND 5100 UNION ALL SELECT 7001, 5) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = catalog.queries()["stack_sheets"](spark, str(tmp_path))
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    assert canon(got.toPandas()) == oracle(str(tmp_path), "stack_sheets")


def test_cells_of_cubes_are_made_by_many_tasks(spark):
    cubes = P.identity_cubes(spark.createDataFrame([(7, 4), (8, 1)], "cube_id long, level int").coalesce(1)).withColumn("task", F.spark_partition_id()).cache()
    assert cubes.select("task").distinct().count() > 4
    got = sorted(map(tuple, cubes.filter("cube_id = 7").drop("cube_id", "task").collect()))
    assert got == sorted(map(tuple, P.identity_cube(spark, 4).collect())) and cubes.count() == 16**3
    swatches = P.palette_swatches(spark.createDataFrame([("t", i, i, 0, 0) for i in range(200)], "theme string, idx int, r int, g int, b int"), 2, 2)
    assert swatches.count() == 800 and swatches.select(F.spark_partition_id()).distinct().count() > 4


def test_base64_round_trip_of_whole_texts(spark, tmp_path):
    texts = [None, "", "a" * 41, "é漢😀\n" * 500, "x" * 100_000 + "\0end"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["b64"], r["text"]) for r in catalog.queries()["base64_round_trip_whole"](spark, str(tmp_path)).collect()}
    assert got == {i: (t if t is None else base64.b64encode(t.encode()).decode(), t) for i, t in enumerate(texts)}


def brute_background(pixels, first, second):
    """k-means of one image, in plain Python: {(x, y): (cluster, a)}."""
    centres = [first, second]
    for _ in range(100):
        near = lambda p: int(math.dist(p[2:], centres[1]) < math.dist(p[2:], centres[0]))
        own = [[p for p in pixels if near(p) == k] for k in (0, 1)]
        new = [tuple(sum(p[c] for p in o) / len(o) for c in (2, 3, 4)) if o else centres[k] for k, o in enumerate(own)]
        moved, centres = max(map(math.dist, new, centres)), new
        if moved < 0.255:
            break
    labels = {p[:2]: int(math.dist(p[2:], centres[1]) < math.dist(p[2:], centres[0])) for p in pixels}
    background = int(sum(labels.values()) * 2 > len(labels))
    return {at: (k, 0 if k == background else 255) for at, k in labels.items()}


def test_kmeans_decides_for_each_image(spark):
    rng = random.Random(0)
    images = {
        0: [(x, y, *[rng.randrange(60) if x < 8 else rng.randrange(180, 255) for _ in "rgb"]) for x in range(10) for y in range(10)],
        1: [(x, y, *[rng.randrange(60) if x < 2 else rng.randrange(180, 255) for _ in "rgb"]) for x in range(10) for y in range(10)],
        2: [(x, y, 3 * x * y % 256, 5 * x * x % 256, 10 * x + y) for x in range(20) for y in range(20)],
        None: [(x, 0, 130 + x, 130 + x, 130 + x) for x in range(9)],
    }
    px = spark.createDataFrame([(i, *p, 255) for i, ps in images.items() for p in ps], "img_id long, x int, y int, r int, g int, b int, a int")
    got = {}
    for r in P.kmeans_background(px, (60, 60, 60), (200, 200, 200)).collect():
        got.setdefault(r["img_id"], {})[r["x"], r["y"]] = (r["cluster"], r["a"])
    assert got == {i: brute_background(ps, (60, 60, 60), (200, 200, 200)) for i, ps in images.items()}


def test_nearest_centroid_per_image(spark, many):
    assert canon(catalog.queries()["nearest_centroid_per_image"](spark, many).toPandas()) == oracle(many, "nearest_centroid_per_image")
