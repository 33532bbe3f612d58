"""Interaction audit of five filters: what each removes, in every order of the five.

Native expressions build a five-bit failure mask of every document; documents with equal
masks are alike in every order, so the 32 cells of a part (its documents, good ones and
toxic ones by mask) hold all that the 120 orders need. What a filter does at a step depends
only on the set of filters before it: each cell adds to the 80 pairs of such a set and a
filter, and every order reads its five pairs from these.

Filter E fails a text that a smaller doc_id has as well. A groupBy on the text's SHA-256
supplies the smallest doc_id of each text, with partial aggregation, so that a text which a
third of all rows share sends one row per task; the rows that bear this smallest id are
then found by (doc_id, digest), a pair without hot values. Texts are read once: masks and
digests are written before they are used twice.

Edge cases: a null text is empty (it has no words, so it fails A, and may fail E); a null
doc_id is neither smaller nor larger than any other and never fails E; of rows that repeat
a doc_id and its text none is before the other; repeated labels count as 1 if one of them
is 1; null languages and empty ones are the part ""; texts of any length are measured
whole; an empty table has no parts and gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import itertools
from math import factorial

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, table

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 3
WORD = r"[^\x20\x09-\x0D]+"


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, and the mask of the filters A to D."""
    whole = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    counted = whole.select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"),
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("capitals"),
        F.length("text").cast("long").alias("points"),
        F.col("text").rlike(r"[#$%&*|]").alias("symbols"),
    )
    n_words = F.size("words").cast("long")
    failures = (
        n_words < MIN_WORDS,
        100 * F.size(F.array_distinct("words")).cast("long") < MIN_DISTINCT_PERCENT * n_words,
        100 * F.col("capitals") > MAX_CAPITALS_PERCENT * F.col("points"),
        F.col("symbols"),
    )
    return counted.select("doc_id", "part", "digest", sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failures)), F.lit(0)).alias("mask"))


def mask_histogram(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, and the documents (n), good ones and toxic ones of each cell."""
    rows = cut(measured(docs), "masks")
    known = rows.where("doc_id is not null")
    least = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("least", F.lit(True))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    judged = known.join(least, ["doc_id", "digest"], "left").join(marks, "doc_id", "left").select(
        "part",
        (F.col("mask") + F.when(F.col("least").isNull(), 1 << FILTERS.index("E")).otherwise(0)).alias("mask"),
        F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"),
    )
    nameless = rows.where("doc_id is null").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return judged.unionByName(nameless).groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def _orders() -> dict[tuple[int, int], list[str]]:
    """(set of filters before, filter), as bits -> the orders with this pair."""
    found: dict[tuple[int, int], list[str]] = {}
    for order in map("".join, itertools.permutations(FILTERS)):
        before = 0
        for letter in order:
            bit = 1 << FILTERS.index(letter)
            found.setdefault((before, bit), []).append(order)
            before |= bit
    return found


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter_order and step."""
    orders = _orders()
    pairs = F.array(*(F.struct(F.lit(before).alias("before"), F.lit(bit).alias("bit")) for before, bit in orders))
    in_orders = F.array(*(F.struct(F.lit(before).alias("before"), F.lit(bit).alias("bit"), F.lit(names).alias("names")) for (before, bit), names in orders.items()))

    mask, before, bit = F.col("mask"), F.col("before"), F.col("bit")
    fails, reached = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) == 0

    def total(of: str, where: Column) -> Column:
        return F.sum(F.when(where, F.col(of)).otherwise(0)).alias

    by_pair = (
        mask_histogram(docs, labels).select("*", F.inline(pairs)).groupBy("part", "before", "bit").agg(
            total("n", reached & ~fails)("kept"), total("n", reached & fails)("removed"), total("n", ~reached & fails)("redundant"),
            total("n", mask == bit)("unique_fails"), total("good", reached & fails)("good_lost"), total("toxic", reached & fails)("toxic_lost"),
        )
    )
    # a set of k filters stands before a filter in k! (4 - k)! orders; 16 rows a window
    rest = len(FILTERS) - 1
    weight = F.element_at(F.lit([factorial(k) * factorial(rest - k) for k in range(rest + 1)]), F.bit_count("before") + 1)
    shapley = F.sum(F.col("removed") * weight).over(Window.partitionBy("part", "bit"))
    named = by_pair.withColumn("shapley", shapley).withColumn("names", F.filter(in_orders, lambda p: (p.before == before) & (p.bit == bit))[0].names)
    return named.select(
        "part", F.explode("names").alias("filter_order"), (F.bit_count("before") + 1).cast("int").alias("step"),
        *(F.col(c).cast("long").alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")),
    )


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op11_filter_audit": op11_filter_audit}

SQL = {
    "op11_filter_audit": r"""
WITH marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), counted AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM texts
), failing AS (
  SELECT t.part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN t.doc_id > least THEN 'E' ELSE '' END) AS fails
  FROM counted t LEFT JOIN marks USING (doc_id)
), cells AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY part, fails
), letters AS (
  SELECT * FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) t(f)
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT filter_order, CAST(s AS INTEGER) AS step, substr(filter_order, s, 1) AS f, substr(filter_order, 1, s - 1) AS before FROM orders, range(1, 6) r(s)
), audit AS (
  SELECT part, filter_order, step, f,
    CAST(sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN fails = f THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM (SELECT *, contains(fails, f) AS hit, translate(fails, before, '') <> fails AS gone FROM cells, steps)
  GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM audit
""",
}
