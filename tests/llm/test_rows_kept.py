"""Rows keep their own verdicts where ids are null or repeat."""

from pyspark.sql import functions as F

from tessera.llm import neardup, quality

from .test_llm import DOCS, prose


def test_good_rows_stay_whatever_their_ids(spark):
    good = [prose(s, 40) for s in range(4)]
    rows = [(None, good[0]), (None, "bad"), (7, good[1]), (7, "bad too"), (7, good[2]), (8, good[3]), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).withColumn("kept", F.lit("mine"))
    got = quality.keep_good(docs)
    assert got.columns == docs.columns and {r["kept"] for r in got.collect()} == {"mine"}
    assert sorted(r["text"] for r in got.collect()) == sorted(good)


def test_near_dedup_compares_every_text_of_an_id(spark):
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    near = c.rsplit(" ", 2)[0] + " other ending"
    rows = [(1, a), (7, a), (7, b), (7, c), (9, near), (9, b), (9, b), (None, c), (None, "x"), (8, prose(4, 60)), (8, prose(4, 60))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = [(r["doc_id"], r["text"]) for r in neardup.keep_one(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (7, b), (7, c), (8, prose(4, 60)), (None, c), (None, "x")], key=str)
