"""Hand-made cases and laws of the pixel, colour and page operators."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.functions import colour as C, text as T
from tessera.operators import pixels as P, rasters as R
from tessera.sources.derive import image_files, merge_palettes, palette_from_json
from tessera.streaming.directory import run_to_parquet, stream_pixels

PX = "img_id long, x int, y int, r int, g int, b int, a int"


@pytest.fixture(scope="module")
def tiny(spark):
    return spark.createDataFrame([(0, x, y, 10 * x, 20 * y, 200, (0, 124, 125, 255)[(x + y) % 4]) for x in range(5) for y in range(4)], PX)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_flip_and_invert_twice(tiny):
    assert rows(P.flip(P.flip(tiny, 5), 5).select(*tiny.columns)) == rows(tiny)
    assert rows(P.invert(P.invert(tiny)).select(*tiny.columns)) == rows(tiny)


def test_mirror_leaves_the_odd_column_out(tiny):
    got = {r["x"] for r in P.mirror(tiny, 5).collect()}
    assert got == {0, 1, 2, 3}


def test_nearest_prefers_the_lower_index(spark):
    px = spark.createDataFrame([(0, 0, 0, 10, 10, 10, 255)], PX)
    assert P.nearest(px, ((0, 10, 10), (20, 10, 10))).first()["idx"] == 0


def test_histogram_counts_opaque_pixels(tiny):
    assert P.histogram(tiny).agg(F.sum("n")).first()[0] == tiny.filter("a >= 125").count()


def test_bounding_box_of_nothing(spark):
    px = spark.createDataFrame([(0, 3, 3, 1, 1, 1, 0)], PX)
    assert tuple(P.bounding_box(px).first())[1:] == (0, 0, 1, 1)


def test_ranges_are_checked(tiny):
    for call in (lambda: P.brightness(tiny, 11), lambda: P.gamma(tiny, 0), lambda: P.contrast(tiny, 100), lambda: P.pixelate(tiny, 5, 4, 26), lambda: P.on_grid(0, 1), lambda: R.tilt(tiny, 30, 30), lambda: R.resize(tiny, -1, 0), lambda: C.wheel("x", F.lit(1), F.lit(1), F.lit(1)), lambda: C.lighten(F.lit(1), F.lit(1), F.lit(1), 2)):
        with pytest.raises(ValueError):
            call()


def test_png_round_trip(tiny):
    assert rows(R.decode_png(R.encode_png(tiny))) == rows(tiny)


def test_image_files_are_found(spark, tiny, tmp_path):
    data = R.encode_png(tiny).first()["content"]
    os.makedirs(tmp_path / "sub")
    (tmp_path / "sub" / "a.PNG").write_bytes(bytes(data))
    (tmp_path / "b.txt").write_text("no")
    assert [r["ext"] for r in image_files(spark, str(tmp_path)).collect()] == ["png"]


def test_palettes_from_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"name": "Own", "colors": ["#010203", "#FFFFFF"]}))
    (tmp_path / "b.json").write_text(json.dumps({"name": "Bad", "colors": ["#01020"]}))
    got = palette_from_json(spark, str(tmp_path / "*.json"))
    assert rows(got) == [("own", 0, 1, 2, 3, 255), ("own", 1, 255, 255, 255, 255)]
    assert merge_palettes(got, got).count() == 2


def test_dither_and_resize(tiny):
    assert all(r[c] % 51 == 0 for r in R.dither(tiny).collect() for c in "rgb")
    assert R.resize(tiny, 10, 0).agg(F.max("x"), F.max("y")).first()[:] == (9, 7)


def test_colour_text(spark):
    t = spark.createDataFrame([("#0a0B0c",), ("rgb(1,2,256)",), ("rgb(1,2,3)",), ("#12",), ("x",)], "t string")
    got = t.select(C.detect_format(F.col("t")), C.parse_rgb(F.col("t")), C.from_hex(F.col("t"))["g"]).collect()
    assert [tuple(r) for r in got] == [("hex", None, 11), ("rgb", None, None), ("rgb", "#010203", None), ("hex", None, None), ("unknown", None, None)]


def test_prompt(spark):
    one = spark.range(1)
    ask = lambda name, fmt="md", extra=None: one.select(T.build_prompt(F.lit("A."), F.lit(extra).cast("string"), F.lit(name), fmt)).first()[0]
    assert ask("a.pdf", "txt") == "A.Format the output in plain text"
    assert ask("a.pdf", extra="x") == "A. Format the output in Markdown. x"
    assert "FIRST PAGE of a 5-page document" in ask("a.pdf-page-1-of-5") and "multi-page document" in ask("a.pdf-page-1")
    assert "PAGE 2 of 5 total pages" in ask("a.pdf-page-2-of-5")


def test_stitch_and_recognise(spark):
    pages = spark.createDataFrame([(0, 1, "b"), (0, 0, "a"), (1, 0, "c")], "original_index long, page_index long, text string")
    assert rows(T.stitch(pages)) == [(0, "a\n\n --- \n\nb", 2), (1, "c", 1)]

    def read(row):
        if row["text"] == "b":
            raise ValueError("unreadable")
        return row["text"].upper()

    done = R.recognise(pages, read)
    assert T.fail_gate(done).first()["may_save"] is False
    assert {r["error"] for r in done.collect()} == {None, "unreadable"}


def test_stream(spark, tiny, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    tiny.write.parquet(src)
    run_to_parquet(stream_pixels(spark, src), P.invert, out, str(tmp_path / "cp")).awaitTermination()
    assert rows(spark.read.parquet(out).select(*tiny.columns)) == rows(P.invert(tiny).select(*tiny.columns))


def test_entry_without_the_training_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['tessera.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'px_invert' in q and not any(k.startswith('op') and k[2].isdigit() for k in q)"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_drawing_follows_the_size_of_each_image(spark):
    """Images of different sizes in one table are drawn as each of them alone with its own size."""
    shapes = {0: (9, 7), 1: (40, 12), 2: (1, 1), 3: (23, 50), 4: (64, 64)}
    px = spark.createDataFrame([(i, x, y, (7 * x + i) % 256, (11 * y) % 256, 90, 255) for i, (w, h) in shapes.items() for x in range(w) for y in range(h)], PX)
    own = {r["img_id"]: (r["w"], r["h"]) for r in P.sizes(px).collect()}
    assert own == shapes
    calls = {
        "border": lambda d, w, h: P.border(d, w, h, (1, 2, 3), 2), "ring": lambda d, w, h: P.border(d, w, h, (1, 2, 3), 2, 5.0), "round": lambda d, w, h: P.round_corners(d, w, h, 6),
        "flip": lambda d, w, h: P.flip(d, w), "mirror": lambda d, w, h: P.mirror(d, w), "pixelate": lambda d, w, h: P.pixelate(d, w, h, 15),
    }
    cols = ["img_id", "x", "y", "r", "g", "b", "a"]
    for name, call in calls.items():
        together = rows(call(px, None, None).select(*cols))
        apart = sorted(r for i, (w, h) in shapes.items() for r in rows(call(px.filter(F.col("img_id") == i), w, h).select(*cols)))
        assert together == apart, name
    for i, (w, h) in shapes.items():
        last = {(r["x"], r["y"]): r["r"] for r in P.border(px, colour=(1, 2, 3), thickness=1).filter(F.col("img_id") == i).collect()}
        assert all(last[x, h - 1] == 1 for x in range(w)) and all(last[w - 1, y] == 1 for y in range(h))


def test_pixelate_shows_the_pixels_of_the_formula(spark):
    for w, h, percent in ((50, 20, 15), (7, 3, 25), (100, 33, 10), (3, 64, 1)):
        px = spark.createDataFrame([(0, x, y, x % 256, y % 256, 0, 255) for x in range(w) for y in range(h)], PX)
        k = percent / 100
        shown = lambda n: [int(v * max(1, round(n * k)) // n / k) for v in range(n)]  # noqa: E731, B023
        want = {(x, y): (sx % 256, sy % 256) for x, sx in enumerate(shown(w)) for y, sy in enumerate(shown(h)) if sx < w and sy < h}
        assert {(r["x"], r["y"]): (r["r"], r["g"]) for r in P.pixelate(px, percent=percent).collect()} == want
