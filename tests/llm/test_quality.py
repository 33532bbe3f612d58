"""The adaptive verdicts against brute force with exact quantiles."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import quality
from tessera.llm.common import table

from .test_llm import DOCS, SF, brute_quality, prose


def brute_verdicts(rows):
    """{row: kept} of (lang, source, text) rows, with exact quantiles."""
    rates, base = {}, {}
    for i, (lang, source, text) in enumerate(rows):
        n_words, chars, symbols, dups, repeats = brute_quality(text)
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        base[i] = n_words < 10 or 100 * repeats > 20 * n_words
        rates[i] = (symbols / max(len(text or ""), 1), dups / max(len(lines), 1), repeats / max(n_words, 1), chars / max(n_words, 1), n_words)
    good = [i for i in rates if not base[i]]

    def ends(own, k):
        values = sorted(rates[i][k] for i in own)
        return [values[max(1, math.ceil(p * len(values))) - 1] for p in ((0.25, 0.75) if k == 3 else (0.5, 0.9))] if values else None

    def shrunk(own, k, wide):
        mine, w = ends(own, k), min(quality.SHRINK, len(good))
        return [(len(own) * a + w * b) / (len(own) + w) for a, b in zip(mine, wide)] if own else wide

    out = {}
    for i, (lang, source, _) in enumerate(rows):
        bad = base[i]
        for k, floor in enumerate(f for _, _, f in quality.RATES.values()):
            whole = ends(good, k)
            if whole is None:
                continue
            language = shrunk([j for j in good if rows[j][0] == lang], k, whole)
            low, high = shrunk([j for j in good if rows[j][:2] == (lang, source)], k, language)
            slack = quality.FENCE * max(high - low, floor)
            if k == 3:
                slack *= max(1.0, math.sqrt(quality.REFERENCE / max(rates[i][4], 1)))
                bad |= rates[i][3] < low - slack
            bad |= rates[i][k] > high + slack
        out[i] = not bad
    return out


def made(seed):
    rng, rows = random.Random(seed), []
    for i in range(90):
        n = rng.randint(12, 60)
        text = prose(1000 * seed + i, n)
        kind = i % 9
        if kind == 1:
            text = text.replace(" ", " $$ ")
        elif kind == 2:
            text = "same line here\n" * rng.randint(1, 9) + text.replace(" ", "\n", 20)
        elif kind == 3:
            text = "a b c d e f " * rng.randint(0, 2) + text
        elif kind == 4:
            text = " ".join(w * 4 for w in text.split())
        elif kind == 5:
            text = " ".join(w[:2] for w in text.split())
        elif kind == 6:
            text = rng.choice([None, "", "few words", "a b c d e " * 10])
        rows.append((rng.choice(["en", "de", None]), rng.choice(["s", "t", None, f"u{i}"]), text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_kept_against_brute_force(spark, seed):
    rows = made(seed) + [made(seed)[0]] * 5
    docs = spark.createDataFrame([(i, t, lang, source, 0) for i, (lang, source, t) in enumerate(rows)], DOCS).withColumns({"kept": F.lit("x"), "n_words": F.lit("y")})
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs).collect()}
    want = brute_verdicts(rows)
    assert got == want and 20 < sum(want.values()) < len(rows) - 10
    kept = quality.keep_good(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, k in want.items() if k] and kept.columns == docs.columns


def test_only_failing_documents(spark):
    docs = spark.createDataFrame([(1, "x", "en", "s", 1), (2, None, None, None, 0)], DOCS)
    assert [r["kept"] for r in quality.judge(docs).collect()] == [False, False]


def test_thresholds_differ_between_groups_and_clean_documents_stay(spark):
    folder = SF.replace("0.001", "0.01")
    docs = table(spark, folder, "documents").repartition(8)
    measured = quality.measure(docs)
    limits = quality.thresholds(quality.group_sketches(measured)).toPandas()
    assert len(limits) > 50
    for r in ("repeats", "word_length"):
        assert (limits[f"__high_{r}"] + quality.FENCE * limits[f"__span_{r}"]).round(9).nunique() > len(limits) / 2
    kept = quality.judge(docs).join(table(spark, folder, "labels"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    share = dict(map(tuple, kept))
    assert share[1] > 0.95 and share[0] < 0.25


def test_merged_sketches_give_the_quantiles_of_one(spark):
    rows = spark.range(0, 20_000, 1, 8).select(F.pmod(F.xxhash64("id"), F.lit(1 << 20)).cast("double").alias("v"), (F.col("id") % 7).alias("g"))
    parts = rows.groupBy("g").agg(F.kll_sketch_agg_double("v").alias("s"))
    probs = F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.9)))
    merged = parts.agg(F.kll_merge_agg_double("s").alias("s")).select(F.kll_sketch_get_quantile_double("s", probs)).first()[0]
    values = sorted(r[0] for r in rows.select("v").collect())
    for p, v in zip((0.25, 0.5, 0.75, 0.9), merged):
        assert abs(sum(x <= v for x in values) / len(values) - p) < 0.03
