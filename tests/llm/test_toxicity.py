"""Toxicity on the labelled rows that were held out, and on odd tables."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import toxicity
from tessera.llm.common import table

from .test_llm import DOCS, prose

BIG = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = table(spark, BIG, "documents").repartition(16), table(spark, BIG, "labels")
    mine = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    return mine, labels, toxicity.fit(mine, labels)


def test_held_out_rows(spark, labelled):
    docs, labels, model = labelled
    scored = model.score(docs, ["doc_id"]).join(labels, "doc_id").toPandas()
    held = scored[[zlib.crc32(str(i).encode()) % 5 == 0 for i in scored.doc_id]]
    good, bad = held.__score[held.toxic == 0].to_numpy(), held.__score[held.toxic == 1].to_numpy()
    assert len(bad) >= 20 and len(good) >= 200
    auc = ((bad[:, None] > good[None, :]) + 0.5 * (bad[:, None] == good[None, :])).mean()
    assert auc > 0.98 and (bad >= 0.5).mean() > 0.9 and (good < 0.5).mean() > 0.98
    # calibrated: scores agree with shares
    for lo, hi in ((0.0, 0.2), (0.8, 1.01)):
        some = held[(held.__score >= lo) & (held.__score < hi)]
        assert abs(some.__score.mean() - some.toxic.mean()) < 0.1


def test_score_hangs_on_the_text_alone(spark, labelled):
    docs, _, model = labelled
    first = docs.limit(40)
    same = first.withColumns({"doc_id": F.col("doc_id") + 7, "lang": F.lit("xx"), "source": F.lit(None).cast("string"), "probability": F.lit(9), "prediction": F.lit("p")})
    by_text = lambda d: sorted((r["text"], r["__score"]) for r in model.score(d, ["text"]).collect())
    assert by_text(first) == by_text(same)


def test_odd_tables(spark, labelled):
    _, _, model = labelled
    rows = [(None, None), (1, ""), (1, prose(1, 30_000)), (2, "x" * 300_000), (3, "same"), (3, "same"), (4, "!!! ??? @@@ \n\t")]
    odd = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = model.score(odd, ["doc_id", "text"]).collect()
    assert len(got) == len(rows) and all(0 <= r["__score"] <= 1 for r in got)
    assert len({r["__score"] for r in got if r["text"] == "same"}) == 1
    assert model.score(odd.limit(0), ["doc_id"]).count() == 0
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    assert toxicity.score_documents(odd, labels).count() == len(rows) and toxicity.score_documents(odd.limit(0), labels).count() == 0


def test_features_of_disguised_and_shouted_words():
    lexicon = toxicity.Lexicon({"blarf": 3.0})
    f = lambda t: dict(zip(toxicity.FEATURES, toxicity.features_of(t, lexicon)))
    assert f("you blarf")["near_you"] > f("you a b c d e f g blarf")["near_you"] > f("blarf")["near_you"] == 0
    assert f("bl4rf here")["disguised"] > 0 == f("blarf here")["disguised"] and f("ABC def")["capitals"] == 0.5
    assert all(np.isfinite(list(f(t).values())).all() for t in ("", " ", "\n", "!", "漢字"))


def test_a_labelled_id_gives_one_row_however_many_bear_it(spark):
    """The bound is on rows: 20 labelled ids held by 20,000 rows give 20 training rows at most."""
    docs = spark.range(20_000).select((F.col("id") % 20).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    chosen = toxicity.labelled_sample(labels)
    rows = toxicity.bounded_texts(docs.repartition(7), chosen).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i in range(20) if zlib.crc32(str(i).encode()) % 5)
    assert all(int(r["text"].split()[1]) % 20 == r["doc_id"] for r in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, toxicity.bounded_texts(docs.repartition(3), chosen).collect()))


def plain_isotonic(points):
    """Pool adjacent violators over (raw, label): the fitted value at each raw."""
    blocks = []
    for raw, label in sorted(points):
        if blocks and blocks[-1][0][-1] == raw:
            blocks[-1][0].append(raw)
            blocks[-1][1].append(label)
        else:
            blocks.append([[raw], [label]])
    merged = []
    for raws, values in blocks:
        merged.append([raws, values])
        while len(merged) > 1 and np.mean(merged[-2][1]) >= np.mean(merged[-1][1]):
            last = merged.pop()
            merged[-1] = [merged[-1][0] + last[0], merged[-1][1] + last[1]]
    return {r: float(np.mean(v)) for raws, v in merged for r in raws}


def test_lexicon_and_calibration_against_plain_versions(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        toxic = int(rng.random() < 0.4)
        words = list(rng.choice(["tree", "house", "river", "stone", "cloud", "grass"], 12)) + (["vexgit"] * 2 if toxic and rng.random() < 0.9 else []) + (["vexgit"] if not toxic and rng.random() < 0.05 else [])
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    part = lambda i: zlib.crc32(str(i).encode()) % 5
    train = [r for r in rows if part(r[0]) > 1]
    weights = toxicity.learn_lexicon(spark.createDataFrame(train, "doc_id long, text string, toxic int"))
    n1, n0 = sum(x for *_, x in train), sum(1 - x for *_, x in train)
    have = lambda w, c: sum(1 for _, t, x in train if x == c and w in t.split())
    assert "vexgit" in weights and not set(weights) & {"tree", "house", "river", "stone"}
    odds = np.log((have("vexgit", 1) + 0.5) / (n1 + 1)) - np.log((have("vexgit", 0) + 0.5) / (n0 + 1))
    assert abs(weights["vexgit"] - odds) < 1e-9
    model = toxicity.fit(docs, labels)
    assert model.calibration is not None
    rated = docs.join(labels, "doc_id").select("doc_id", "toxic", toxicity.features(F.col("text"), model.weights).alias("__f"))
    raw = {r["doc_id"]: (r["__raw"], r["toxic"]) for r in model.raw(rated).collect()}
    fitted = plain_isotonic([raw[i] for i in raw if part(i) == 1])
    scores = {r["doc_id"]: r["__score"] for r in model.score(docs, ["doc_id"]).collect()}
    for i in raw:
        if part(i) == 1:
            assert abs(scores[i] - (0.999 * fitted[raw[i][0]] + 0.001 * raw[i][0])) < 1e-6
