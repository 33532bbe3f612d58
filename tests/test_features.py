"""Palette index, layers, drawn clusters, model sessions and block coding against plain versions."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks as B, clusters as K, layers as L, palettes, rasters as R, sessions

PX = "img_id long, x int, y int, r int, g int, b int, a int"


def noise(seed, *shapes):
    rng = np.random.default_rng(seed)
    return [(i, x, y, *map(int, rng.integers(0, 256, 3)), int(rng.choice([0, 40, 255, 255]))) for i, (w, h) in enumerate(shapes) for x in range(w) for y in range(h)]


@pytest.mark.parametrize("n", [1, 2, 7, 300, 5_000])
def test_nearest_by_the_index_is_exact(spark, n):
    rng = random.Random(n)
    spread = [tuple(rng.choices(range(256), k=3)) for _ in range(n)] if n != 300 else [(rng.randrange(40), rng.randrange(3), 200) for _ in range(n)]
    palette = spark.createDataFrame([("a", i, *c) for i, c in enumerate(spread)] + [("b", 0, 1, 2, 3)], "theme string, idx int, r int, g int, b int")
    px = spark.createDataFrame([(*p, t) for p, t in zip(noise(n, (20, 20)), ["a", "a", "b", "none", None] * 80)], PX + ", theme string")
    cells = palettes.cell_index(palette).filter("theme = 'a'")
    assert cells.count() == palettes.CELLS**3
    if n == 5_000:
        assert cells.agg(F.max(F.size("colours"))).first()[0] < n / 10
    for row in palettes.nearest(px, palette).join(px.select("img_id", "x", "y", *[F.col(c).alias("p" + c) for c in "rgb"]), ["img_id", "x", "y"]).collect():
        p = (row["pr"], row["pg"], row["pb"])
        if row["theme"] == "a":
            want = min((sum((s - q) ** 2 for s, q in zip(c, p)), i) for i, c in enumerate(spread))[1]
            assert row["idx"] == want and (row["r"], row["g"], row["b"]) == spread[want]
        elif row["theme"] == "b":
            assert row["idx"] == 0
        else:
            assert row["idx"] is None and (row["r"], row["g"], row["b"]) == p


def test_the_index_holds_each_colour_once(spark):
    rows = [("a", i, i % 4 * 60, i % 3 * 90, 10) for i in range(6_000)]
    palette = spark.createDataFrame(rows[::-1], "theme string, idx int, r int, g int, b int")
    assert palettes.cell_index(palette).agg(F.max(F.size("colours"))).first()[0] <= 12
    px = spark.createDataFrame(noise(3, (8, 8)), PX).withColumn("theme", F.lit("a"))
    for row in palettes.nearest(px.select("*", *[F.col(c).alias("p" + c) for c in "rgb"]), palette).collect():
        assert row["idx"] == min((sum((s - row["p" + c]) ** 2 for s, c in zip(colour, "rgb")), i) for _, i, *colour in rows)[1]


def plain_over(pixels, straight):
    out = [0, 0, 0, 0]
    for *c, a in pixels:
        a16 = a * 257
        top = [(v * 257 * a16 // 65535 if straight else v * 257 if a else 0) for v in c] + [a16]
        out = [t + u * (65535 - a16) // 65535 for t, u in zip(top, out)]
    return tuple(v >> 8 for v in out)


@pytest.mark.parametrize("straight", [True, False])
def test_layers_lie_over_each_other(spark, straight):
    rng = random.Random(1)
    places = {(s, x): [(rng.randrange(256), rng.randrange(256), rng.randrange(256), rng.choice([0, 0, 9, 128, 254, 255])) for _ in range(rng.randrange(1, 9))] for s in range(2) for x in range(30)}
    if not straight:
        places = {k: [tuple(min(c, p[3]) for c in p[:3]) + p[3:] for p in v] for k, v in places.items()}
    rows = [(s, x, 0, n, *p) for (s, x), ps in places.items() for n, p in enumerate(ps)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "sheet int, x int, y int, layer int, r int, g int, b int, a int")
    got = {(r["sheet"], r["x"]): (r["r"], r["g"], r["b"], r["a"]) for r in L.compose(frame, straight=straight).collect()}
    assert got == {k: plain_over(v, straight) for k, v in places.items()}
    with pytest.raises(Exception, match="layers are numbered"):
        L.compose(frame, n_layers=2).collect()


def test_many_layers_in_blocks(spark):
    rng = random.Random(2)
    pixels = [(rng.randrange(256), rng.randrange(256), rng.randrange(256), rng.randrange(1, 40)) for _ in range(5_000)]
    frame = spark.createDataFrame([(0, 0, 0, n, *p) for n, p in enumerate(pixels)], "sheet int, x int, y int, layer int, r int, g int, b int, a int")
    got = L.compose(frame, n_layers=5_000, straight=True).first()
    assert all(abs(got[c] - w) <= 1 for c, w in zip("rgba", plain_over(pixels, True)))


@pytest.mark.parametrize("mode, options", [("horizontal", {}), ("vertical", {}), ("grid", {"rows": 2, "cols": 2}), ("grid", {"rows": 3, "cols": 1, "biggest": True})])
def test_stacks_of_images_of_different_sizes(spark, mode, options):
    shapes = [(5, 4), (3, 6), (4, 4)]
    rows = noise(3, *shapes)
    px = spark.createDataFrame(rows, PX)
    gap, images = 2, [R._raster(__import__("pandas").DataFrame([r for r in rows if r[0] == i], columns=["img_id", "x", "y", "r", "g", "b", "a"])) for i in range(3)]
    images = [np.where(m[..., 3:] > 0, m, 0) for m in images]
    pick = min if options.get("biggest") else max
    cw, ch = pick(w for w, _ in shapes), pick(h for _, h in shapes)
    if options.get("biggest"):
        images = [R.padded(R._raster(__import__("pandas").DataFrame([r for r in rows if r[0] == i], columns=["img_id", "x", "y", "r", "g", "b", "a"])).astype(float), cw, ch) for i in range(3)]
        images = [np.where(m[..., 3:] > 0, m, 0) for m in images]
    n_rows, n_cols = {"horizontal": (1, 3), "vertical": (3, 1)}.get(mode, (options.get("rows"), options.get("cols")))
    want = np.zeros((n_rows * (ch + gap) + gap, n_cols * (cw + gap) + gap, 4), int)
    for y, x in np.ndindex(want.shape[:2]):
        if x % (cw + gap) < gap or y % (ch + gap) < gap:
            want[y, x] = (1, 2, 3, 255)
    for i, m in enumerate(images):
        h, w = m.shape[:2]
        y, x = i // n_cols * (ch + gap) + gap + (ch - h) // 2, i % n_cols * (cw + gap) + gap + (cw - w) // 2
        want[y:y + h, x:x + w] = np.apply_along_axis(lambda p: plain_over([tuple(map(int, p))], False), 2, m)
    got = np.full(want.shape, -1)
    for r in L.stack(px, px.select("img_id").distinct().withColumn("sheet", F.lit(0)), mode, gap=gap, colour=(1, 2, 3), **options).collect():
        got[r["y"], r["x"]] = (r["r"], r["g"], r["b"], r["a"])
    assert (got == want).all()
    with pytest.raises(Exception, match="more images"):
        L.stack(px, px.select("img_id").distinct().withColumn("sheet", F.lit(0)), "grid", 1, 2).collect()


def test_a_background_covers(spark):
    px = spark.createDataFrame(noise(4, (12, 8)), PX)
    ground = np.dstack([*np.random.default_rng(1).integers(0, 256, (3, 30, 20)), np.full((30, 20), 255)]).astype(np.uint8)
    got = R.tilt_effect(px, width=40, height=24, background=R.png_bytes(ground))
    corner = R.covering(ground, 40, 24)[0, 0, :3]
    first = got.filter("x = 0 and y = 0").first()
    assert (first["r"], first["g"], first["b"]) == tuple(map(int, corner)) and got.count() == 40 * 24
    assert R.cover(px, 5, 7).count() == 35


def test_centres_are_drawn_by_weight(spark):
    """Over many images of the same three colours, the second centre follows the squared distances."""
    colours = {(0, 0, 0): 0, (10, 0, 0): 100, (20, 0, 0): 400}
    px = spark.range(3_000).select(F.col("id").alias("img_id"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("x")).select("img_id", "x", F.lit(0).alias("y"), (F.col("x") % 3 * 10).cast("int").alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"), F.lit(255).alias("a"))
    drawn = K.draw_centres(px, 3).collect()
    firsts = collections.Counter(r["r0"] for r in drawn)
    assert all(abs(firsts[v] / 3_000 - 1 / 3) < 0.04 for v in (0, 10, 20))
    second = collections.Counter(r["r1"] for r in drawn if r["r0"] == 0)
    assert second[0] == 0 and abs(second[10] / firsts[0] - 100 / 500) < 0.05 and len(colours) == 3
    assert sorted(map(tuple, K.draw_centres(px.repartition(7), 3).collect())) == sorted(map(tuple, drawn))
    kept = K.sample(px, 3, 0.5).count() / px.count()
    assert abs(kept - 0.5) < 0.02


def test_drawn_clusters_remove_the_larger_side(spark):
    rows = [(i, x, y, *((10, 20, 30) if x < 12 + i else (200, 180, 90)), 255) for i in range(4) for x in range(20) for y in range(10)] + [(9, 0, 0, 1, 1, 1, 77)]
    px = spark.createDataFrame(rows, PX)
    got = {(r["img_id"], r["x"], r["y"]): r["a"] for r in K.remove_background(px, 5).collect()}
    for i in range(4):
        assert all(got[i, x, y] == (0 if x < 12 + i else 255) for x in range(20) for y in range(10))
    one = {r["a"] for r in K.remove_background(px.filter("img_id = 9"), 5).collect()}
    assert one <= {0, 77, 255} and len(one) == 1


def test_a_session_is_loaded_once_and_gives_the_plain_masks(spark, tmp_path):
    kernel, path, size = np.random.default_rng(5).normal(size=(3, 3, 3)), f"{tmp_path}/m.npz", 12
    np.savez(path, kernel=kernel, bias=np.array(0.2))
    load = sessions.convolution(path)
    px = spark.createDataFrame(noise(6, (10, 8), (7, 15), (20, 20)), PX)
    got = collections.defaultdict(dict)
    for r in sessions.segment(px, load, size, batch=2).collect():
        got[r["img_id"]][r["x"], r["y"]] = r["m"]
    predict = load()
    for i, part in px.toPandas().groupby("img_id"):
        img = R._raster(part).astype(float)
        answer = predict(sessions.tensor_of(img, size)[None])[0].astype(np.float32)
        mask = sessions.mask_of(answer.astype(float), *img.shape[:2])
        assert got[i] == {(x, y): int(mask[y, x]) for y, x in np.ndindex(mask.shape)}
    loads = spark.sparkContext.accumulator(0)

    def counted():
        loads.add(1)
        return load()

    many = spark.createDataFrame(noise(7, *[(6, 6)] * 30), PX)
    assert sessions.segment(many.repartition(1), counted, size, batch=4).select("img_id").distinct().count() == 30


def test_blocks_are_transformed_and_quantised(spark):
    rows = noise(8, (19, 10), (8, 8))
    px = spark.createDataFrame(rows, PX)
    basis = np.array([[B.basis(u, at) for at in range(8)] for u in range(8)])
    assert np.allclose(basis @ basis.T, np.eye(8))
    for quality in (1, 50, 90, 100):
        steps = np.array(B.steps(quality)).reshape(8, 8)
        made = B.quantise(B.transform(px, F.col("r")), quality)
        lost, kept = collections.Counter(), collections.Counter()
        for r in made.collect():
            block = np.zeros((8, 8))
            for i, x, y, v, *_ in rows:
                if i == r["img_id"] and x // 8 == r["block_x"] and y // 8 == r["block_y"]:
                    block[y % 8, x % 8] = v - 128
            c = basis @ block @ basis.T
            assert np.allclose(np.array(r["coefficients"]).reshape(8, 8), c)
            level = np.floor(c / steps + 0.5 + B.TIE)
            assert (np.array(r["levels"]).reshape(8, 8) == level).all()
            back = basis.T @ (level * steps) @ basis
            lost[r["img_id"]] += ((back - block) ** 2).sum()
            kept[r["img_id"]] += int((level != 0).sum())
        for r in B.error(made, quality).collect():
            assert math.isclose(r["mse"], lost[r["img_id"]] / (64 * r["blocks"]), rel_tol=1e-9) and r["kept"] == kept[r["img_id"]]
    with pytest.raises(ValueError):
        B.steps(0)
