"""Themes, work units, options and recogniser answers: hand-made cases."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import colour as C, text as T
from tessera.operators import rasters as R
from tessera.sources import work
from tessera.sources.derive import merge_palettes, theme_list, theme_lookup, themes, themes_from_yaml

YAML = """# settings
output: /tmp/x
themes:
  - name: "Mine"
    colors:
      - "#010203"
      - '#FFffFF'
  - name: nord
    colors:
      - "#000000"
  - name: broken
    colors:
      - "#12"
      - "#123456"
  - name: empty
    colors:
other:
  - name: not a theme
    colors:
      - "#111111"
"""


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_yaml_themes(spark, tmp_path):
    (tmp_path / "config.yml").write_text(YAML)
    own = themes_from_yaml(spark, str(tmp_path / "config.yml"))
    assert sorted(map(tuple, own.collect())) == [("mine", 0, 1, 2, 3, 255), ("mine", 1, 255, 255, 255, 255), ("nord", 0, 0, 0, 0, 255)]
    known = merge_palettes(themes(spark), own)
    assert [tuple(r) for r in theme_list(known).collect()] == [("dracula", 11), ("mine", 2), ("nord", 16), ("solarized", 16)]
    (tmp_path / "t.json").write_text(json.dumps({"name": "Extra", "colors": ["#0A0b0C"]}))
    found = theme_lookup(themes(spark, str(tmp_path / "t.json")), spark.createDataFrame([("EXTRA",), ("no",)], "name string")).collect()
    assert {r["name"]: (r["colours"], r["error"]) for r in found} == {"EXTRA": (["#0A0B0C"], None), "no": (None, "unknown theme")}


def test_colour_text_cases(spark):
    cases = {
        " #0a0B0c ": "#0a0B0c", "#0a0B0": None, "rgb(1, 2 ,3)": "#010203", "rgb (1,2,3)": "#010203", "rgb(256,0,0)": None, "rgb(1,2)": None, "hsl(0,100,50)": "#ff0000",
        "hsl(120.0,100,25)": "#008000", "hsl(1.2.3,1,1)": None, "lab(100,0,0)": "#ffffff", "lab(53.24,80.09,67.2)": "#ff0000", "lab(0,0,0)": "#000000", "cmyk(1,2,3)": None, "": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").select("t", C.parse_any(F.col("t")).alias("hex")).collect()
    assert {r["t"]: r["hex"] for r in rows} == cases | {None: None}
    with pytest.raises(Exception, match="unrecognised"):
        one(spark, C.require(C.parse_any(F.lit("x")), "unrecognised colour", F.lit("x")))
    assert one(spark, C.hex_to_format(F.lit("#FF0000"), "HSL")) == "hsl(0,100,50)" and one(spark, C.hex_to_format(F.lit("#ff0000"), "lab")) == "lab(53.24,80.09,67.20)"
    for bad in (lambda: C.hex_to_format(F.lit("#000000"), "cmyk"), lambda: C.blend((F.lit(1),) * 3, (F.lit(2),) * 3, 1), lambda: C.monochromatic(F.lit(1), F.lit(1), F.lit(1), 0)):
        with pytest.raises(ValueError):
            bad()


def test_every_colour_survives_its_text(spark):
    rows = spark.range(0, 2000).select(*[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(256)).cast("int").alias(c) for k, c in enumerate("rgb")])
    texts = rows.select("r", "g", "b", C.lab_of(F.col("r"), F.col("g"), F.col("b")).alias("v"), C.to_hex(F.col("r"), F.col("g"), F.col("b")).alias("hex"))
    back = texts.select("r", "g", "b", "hex", C.rgb_of_lab(F.col("v.l"), F.col("v.a"), F.col("v.b")).alias("w"), C.hex_to_format(F.col("hex"), "rgb").alias("t"))
    assert back.filter((F.col("w.r") != F.col("r")) | (F.col("w.g") != F.col("g")) | (F.col("w.b") != F.col("b"))).count() == 0
    assert back.select("hex", C.parse_rgb(F.col("t")).alias("again")).filter("not hex <=> again").count() == 0


def test_listed_and_found_files(spark, tmp_path):
    with pytest.raises(ValueError):
        (tmp_path / "none").mkdir()
        (tmp_path / "none" / "a.txt").write_text("x")
        work.files_of(spark, str(tmp_path / "none"))
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name in ("a.PNG", "sub/b.pdf", "c.txt"):
        (tmp_path / "in" / name).write_bytes(name.encode())
    folder = str(tmp_path / "in")
    assert work.files_of(spark, folder).count() == 1 and work.files_of(spark, folder, "ocr").count() == 2
    listed = work.files_listed(spark, [f"{folder}/a.PNG", f"{folder}/c.txt", f"{folder}/absent.jpg", f"{folder}/sub/../sub/b.pdf"])
    got = {r["path"].removeprefix(folder): (r["content"], r["error"]) for r in work.load(spark, listed, folder).collect()}
    assert got == {"/a.PNG": (bytearray(b"a.PNG"), None), "/c.txt": (None, "unsupported format"), "/absent.jpg": (None, "not found"), "/sub/b.pdf": (bytearray(b"sub/b.pdf"), None)}
    assert "~" not in work.files_listed(spark, ["~/x.png"]).first()["path"]


def test_text_correction(spark):
    rows = spark.createDataFrame([(0, "teh", {"a": "1"}), (1, "bad", None)], "original_index long, text string, metadata map<string,string>")

    def fix(text):
        if text == "bad":
            raise ValueError("no answer")
        return text.replace("teh", "the")

    kept = {r["original_index"]: (r["text"], r["metadata"], r["error"]) for r in R.correct_text(rows, fix).collect()}
    assert kept == {0: ("the", {"a": "1", "TextCorrectionApplied": "true"}, None), 1: ("bad", None, None)}
    assert {r["error"] for r in R.correct_text(rows, fix, fall_back=False).collect()} == {None, "no answer"}


def test_answers_that_are_none(spark):
    got = spark.createDataFrame([("{}",), ("no json",), (None,), ('{"pages": []}',)], "a string").select(T.mistral_result(F.col("a")).alias("r")).collect()
    assert [r["r"] is None for r in got] == [True, True, True, False] and got[3]["r"]["text"] == ""
    named = one(spark, T.mistral_result(F.lit('{"pages": [{"markdown": "a"}, {"markdown": "b", "images": [{"id": "i"}]}], "model": "m", "usage_info": {"model": "x", "n": 3}}')))
    assert named["text"] == "a\n\nb" and len(named["images"]) == 1 and named["metadata"] == {"model": "x", "n": "3"}


def test_extensions(spark):
    ask = lambda *a: one(spark, T.resolve_ext(*[F.lit(x).cast("string") for x in a]))
    assert ask("gif", "a.png", "ocr", "file", "b.jpg") == "gif" and ask("", "a.png", "ocr", "file", "b.jpg") == "png" and ask(None, "dir", "ocr", "file", "b.jpg") == "md"
    assert ask(None, None, "convert", "file", "b.jpg") == "jpg" and ask(None, None, "convert", "stdin", None) == "png" and ask(None, None, "convert", "file", "noext") is None
    assert one(spark, T.ext_error(F.lit(None).cast("string"))) == "extension not found" and one(spark, T.ext_error(F.lit("bmp"))) == "unknown format: bmp" and one(spark, T.ext_error(F.lit("png"))) is None
