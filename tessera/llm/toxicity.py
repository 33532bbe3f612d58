"""Toxicity scores: gradient-boosted trees over dense features, isotonic calibration.

Labels are learned only from rows whose crc32(doc_id) mod 5 is not 0; of those,
remainder 1 calibrates and the others train. The sample is bounded by documented
parameters (``MAX_TOXIC`` and ``MAX_CLEAN`` training rows, ``MAX_CALIBRATION``): a labelled
doc_id that many rows bear gives one of their texts, chosen by a hash. Everything that is
learned comes from this sample: first the lexicon, the words and word
beginnings that occur far more often in toxic texts (by the likelihood ratio of a
binomial), with log-odds as weights; then the trees; then the calibration.

The features of a text: lexicon densities and weights, how near lexicon words stand
to second-person words, capitals, punctuation, exclamation, and obfuscation rates
(digits and symbols inside words, and words that match the lexicon only after such
characters are mapped back). Labels, lang, source and doc_id are no features.

Edge cases: null texts are empty and get a score too; rows that repeat a doc_id each
get their score; where the labels of the sample are missing or all alike, every
score is the share of toxic labels (0 without labels); an empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, functions as F

from .common import cut, free_name, table

MAX_TOXIC, MAX_CLEAN, MAX_CALIBRATION = 6_000, 14_000, 10_000
MAX_LEXICON = 2_000
MIN_EVIDENCE = 15.0
PREFIXES = (4, 5)
WORD_CACHE = 300_000
#: second-person words of the languages in the corpus
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros vuestra vuestro".split())
LEET = str.maketrans("4@301!5$7+*", "aaeoiisstti")
FEATURES = ("density", "hits", "weight", "top_weight", "distinct", "near_you", "near_rate", "capitals", "punctuation", "exclaims", "obfuscated", "disguised", "log_words")
_WORD = re.compile(r"[^\W_]+")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
_MARK = re.compile(r"[^\W\d_][0-9@$!+*]+[^\W\d_]")  # a sign or digit between letters


class Lexicon:
    """Weights of words and word beginnings, with a bounded cache per word."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.cache = weights, {}

    def __call__(self, word: str) -> float:
        got = self.cache.get(word)
        if got is None:
            w = self.weights
            got = max([w.get(word, 0.0), *(w.get(word[:n] + "*", 0.0) for n in PREFIXES if len(word) >= n)])
            if len(self.cache) >= WORD_CACHE:
                self.cache = {}
            self.cache[word] = got
        return got


def terms_of(text: str) -> set[str]:
    """The different words and word beginnings of a text."""
    words = set(_WORD.findall(text.lower()))
    return words.union(*({w[:n] + "*" for w in words if len(w) >= n} for n in PREFIXES))


def features_of(text: str, lexicon: Lexicon) -> tuple[float, ...]:
    words = _WORD.findall(text.lower())
    n = max(len(words), 1)
    weights = list(map(lexicon, words))
    hits = [i for i, w in enumerate(weights) if w > 0.0]
    near = nearest = 0.0
    if hits:
        you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        if you:
            at = np.array(you)
            where = np.searchsorted(at, hits)
            gaps = np.minimum(np.abs(at[np.minimum(where, len(at) - 1)] - hits), np.abs(at[np.maximum(where - 1, 0)] - hits))
            nearest, near = 1.0 / (1.0 + float(gaps.min())), float((gaps <= 5).mean())
    size = max(len(text), 1)
    letters = sum(map(len, words))
    upper = sum(map(len, _UPPER.findall(text)))
    marked = [raw for raw in text.split() if _MARK.search(raw)] if _MARK.search(text) else []
    disguised = 0
    for raw in marked:
        plain = "".join(_WORD.findall(raw.lower().translate(LEET)))
        disguised += lexicon(plain) > 0.0 and not any(lexicon(w) > 0.0 for w in _WORD.findall(raw.lower()))
    punctuation = size - letters - text.count(" ") - text.count("\n")
    return (
        len(hits) / n, float(len(hits)), sum(weights) / n, max(weights, default=0.0), float(len({words[i] for i in hits})),
        nearest, near, upper / max(letters, 1), punctuation / size, text.count("!") / size,
        len(marked) / n, disguised / n, math.log1p(len(words)),
    )


# ---- the bounded sample -------------------------------------------------

def fold(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def labelled_sample(labels: DataFrame) -> DataFrame:
    """(__id, toxic, part): training rows of both classes and calibration rows,
    within the documented bounds; which rows is decided by a hash of the id."""
    own = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic")).filter("__id is not null and toxic in (0, 1)")
    own = own.groupBy("__id").agg(F.max("toxic").alias("toxic")).withColumn("__f", fold(F.col("__id"))).filter("__f != 0")

    def some(rows: DataFrame, bound: int, part: str) -> DataFrame:
        return rows.orderBy(F.xxhash64("__id"), "__id").limit(bound).select("__id", "toxic", F.lit(part).alias("part"))

    train = own.filter("__f != 1")
    return (
        some(train.filter("toxic = 1"), MAX_TOXIC, "train")
        .union(some(train.filter("toxic = 0"), MAX_CLEAN, "train"))
        .union(some(own.filter("__f = 1"), MAX_CALIBRATION, "calibrate"))
    )


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Terms that toxic training texts have far more often than clean ones."""
    sizes = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return {}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = (Counter(), Counter())
            for text, label in zip(batch["text"], batch["toxic"]):
                seen[int(label)].update(terms_of(text or ""))
            rows = [(t, n, seen[0].get(t, 0)) for t, n in seen[1].items()]
            rows += [(t, 0, n) for t, n in seen[0].items() if t not in seen[1]]
            yield pd.DataFrame(rows, columns=["term", "a", "b"])

    counted = sample.select("text", "toxic").mapInPandas(count, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    p = toxic / (toxic + clean)
    n, r = F.col("a") + F.col("b"), F.col("a") / (F.col("a") + F.col("b"))
    clean_part = F.when(r < 1, (1 - r) * F.log((1 - r) / (1 - p))).otherwise(0.0)
    evidence = n * (r * F.log(r / p) + clean_part)
    odds = F.log((F.col("a") + 0.5) / (toxic + 1.0)) - F.log((F.col("b") + 0.5) / (clean + 1.0))
    good = (
        counted.filter(F.col("a") >= 3).withColumn("evidence", evidence).withColumn("odds", odds)
        .filter((F.col("evidence") >= MIN_EVIDENCE) & (F.col("odds") >= 2.0))
        .orderBy(F.desc("evidence"), "term").limit(MAX_LEXICON).select("term", "odds")
    )
    return {r[0]: float(r[1]) for r in good.collect()}


def features(text, weights: dict[str, float]):
    """The features of a text column, as an array of doubles."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(weights)
        for texts in batches:
            yield texts.map(lambda t: features_of(t, lexicon))

    return run.asNondeterministic()(F.coalesce(text, F.lit("")))  # so that it runs once a row


class Model:
    """A fitted scorer: lexicon, trees and calibration, or a constant."""

    def __init__(self, weights, trees=None, calibration=None, constant=0.0):
        self.weights, self.trees, self.calibration, self.constant = weights, trees, calibration, constant

    def score(self, docs: DataFrame, keep: list[str], name: str = "__score") -> DataFrame:
        """``keep`` and the score in a column ``name``. The models see the kept columns under
        other names, so that no name can clash with theirs."""
        if self.trees is None:
            return docs.select(*keep, F.lit(float(self.constant)).alias(name))
        kept = [docs[c].alias(f"__k{i}") for i, c in enumerate(keep)]
        back = [F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)]
        done = self.raw(docs.select(*kept, features(docs["text"], self.weights).alias("__f")))
        if self.calibration is None:
            return done.select(*back, F.col("__raw").alias(name))
        done = self.calibration.transform(done)
        score = F.col("__iso") * 0.999 + F.col("__raw") * 0.001  # the raw share keeps an order among equal steps
        return done.select(*back, F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias(name))

    def raw(self, rated: DataFrame) -> DataFrame:
        done = self.trees.transform(rated.withColumn("__x", array_to_vector("__f")))
        return done.withColumn("__raw", vector_to_array("probability")[1])


def bounded_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, text, toxic and part: one row for each chosen id, however many rows bear it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    return texts.groupBy("doc_id", "toxic", "part").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "toxic", "part")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from the bounded sample of labelled documents."""
    chosen = labelled_sample(labels)  # at most the sum of the bounds: 30,000 small rows
    sample = cut(bounded_texts(docs, chosen), "sample")
    train = sample.filter("part = 'train'")
    counts = {r[0]: r[1] for r in train.groupBy("toxic").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return Model({}, constant=1.0 if counts.get(1) else 0.0)
    weights = learn_lexicon(train)
    rated = sample.select("doc_id", "toxic", "part", features(F.col("text"), weights).alias("__f"))
    rated = cut(rated.repartition(8, "doc_id").sortWithinPartitions("doc_id"), "rated")
    assembled = rated.filter("part = 'train'").withColumn("__x", array_to_vector("__f"))
    trees = GBTClassifier(featuresCol="__x", labelCol="toxic", maxIter=20, maxDepth=4, stepSize=0.2, seed=7).fit(assembled.select("__x", "toxic"))
    model = Model(weights, trees)
    held = model.raw(rated.filter("part = 'calibrate'")).select(F.col("toxic").cast("double").alias("toxic"), "__raw")
    if held.count() >= 20 and held.select("toxic").distinct().count() == 2:
        model.calibration = IsotonicRegression(featuresCol="__raw", labelCol="toxic", predictionCol="__iso").fit(held)
    return model


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = fit(docs, labels).score(docs, ["doc_id"])
    return scored.select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        F.col("__score").alias("score"), F.when(F.col("__score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not scored as toxic, with all their columns."""
    name = free_name(docs, "__score")
    scored = fit(docs, labels).score(docs, docs.columns, name)
    return scored.filter(F.col(name) < 0.5).select(*docs.columns)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op3_toxicity": op3_toxicity}
SQL: dict[str, str] = {}
