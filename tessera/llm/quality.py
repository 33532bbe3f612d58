"""Quality rules with adaptive thresholds, in DataFrame functions only.

Per document: words, their characters, symbols, duplicate lines and words inside
repeated five-word windows. Two fixed base rules fail a document (few words, many
repeated words). The adaptive rules replace fixed cutoffs. For each (language, source)
group, mergeable KLL sketches of the documents that pass the base rules give quantiles
of each rate:

* shares (symbols, duplicate lines, repeated words) may lie above the group's 0.9
  quantile by FENCE times its distance from the median;
* the mean word length may lie outside the quartiles by FENCE times their distance,
  and by more in texts of fewer than REFERENCE words, whose mean scatters more.

A group's quantiles are drawn towards those of its language, and these towards those
of the whole table, as if SHRINK documents of the larger set (or all, of a smaller table) belonged to the
smaller one; sketches of groups merge into those of languages and of the table. A distance has
a floor, which only matters where a rate hardly varies (most often because it is 0 in
nearly all documents). The thresholds are joined to the documents by group, and the
verdicts filter.

Edge cases: a null text has no words and fails by the base rule; null languages and
sources form groups of their own; a group without passing documents has its language's
thresholds, a language without any those of the table; rows that repeat count and are
judged each; texts of any length are measured whole; an empty table gives no rows.
Columns of the input other than doc_id, text, lang and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import WS, cut, free_name, table

SYMBOLS = "#*$%&|<>"
WINDOW = 5
FENCE = 3.0
SHRINK = 50
REFERENCE = 100
#: rate -> (expression over the base columns, quantiles of the lower and upper end, least distance)
RATES = {
    "symbols": ("n_symbols / greatest(n_chars, 1)", (0.5, 0.9), 0.02),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.5, 0.9), 0.12),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.5, 0.9), 0.04),
    "word_length": ("word_chars / greatest(n_words, 1)", (0.25, 0.75), 0.2),
}
BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"
BROADCAST_ROWS = 20_000


def _repeat_words(words: Column, n_words: Column) -> Column:
    """Words inside windows of WINDOW words that occur more than once in the text.

    Windows are compared by 64-bit hashes of their words. Only texts with a repeated
    window pay for the second step, which sorts (hash, position) pairs, keeps the
    positions whose hash has an equal neighbour, sorts those, and adds up how many
    new words each of them covers.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = F.when(
        n_words >= WINDOW,
        F.transform(
            F.sequence(F.lit(1), n_words - (WINDOW - 1)),
            lambda i: F.xxhash64(*[F.element_at(F.col("__h"), i + k) for k in range(WINDOW)]),
        ),
    )
    return hashes, windows


def _covered() -> Column:
    """Words covered by repeated windows, from the column __w."""
    pairs = F.array_sort(F.transform("__w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    n = F.size("__w")
    sorted_pairs = F.col("__p")
    same = lambda a, b: F.get(sorted_pairs, a)["h"] == F.get(sorted_pairs, b)["h"]
    marked = F.transform(
        sorted_pairs,
        lambda p, i: F.when(
            F.coalesce((i > 0) & same(F.greatest(i - 1, F.lit(0)), i), F.lit(False))
            | F.coalesce((i < n - 1) & same(F.least(i + 1, n - 1), i), F.lit(False)),
            p["i"],
        ),
    )
    positions = F.array_sort(F.filter(marked, lambda x: x.isNotNull()))
    total = F.aggregate(
        F.col("__q"),
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, x: F.struct((acc["n"] + F.least(F.lit(WINDOW), x - acc["last"])).alias("n"), x.alias("last")),
        lambda acc: acc["n"].cast("long"),
    )
    return pairs, positions, total


def measure(docs: DataFrame, *carried: str) -> DataFrame:
    """The base columns of every document, beside doc_id, lang, source and the
    ``carried`` columns."""
    has = set(docs.columns)
    own = docs.select(
        "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("__t"),
        *[(F.col(c) if c in has else F.lit(None)).cast("string").alias(c) for c in ("lang", "source")],
        *carried,
    )
    split = own.withColumn("__words", F.filter(F.split("__t", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.translate(x, WS, "") != "")
    based = (
        split.withColumn("n_words", F.size("__words").cast("long"))
        .withColumn("word_chars", F.char_length(F.translate("__t", WS, "")).cast("long"))
        .withColumn("n_chars", F.char_length("__t").cast("long"))
        .withColumn("n_symbols", (F.char_length("__t") - F.char_length(F.translate("__t", SYMBOLS, ""))).cast("long"))
        .withColumn("__lines", lines)
        .withColumn("n_lines", F.size("__lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    )
    hashes, windows = _repeat_words(F.col("__words"), F.col("n_words").cast("int"))
    pairs, positions, total = _covered()
    repeated = (
        based.drop("__t", "__lines").withColumn("__h", hashes).drop("__words")
        .withColumn("__w", windows).drop("__h")
        .withColumn("__w", F.when(F.size(F.array_distinct("__w")) < F.size("__w"), F.col("__w")))
        .withColumn("__p", F.when(F.col("__w").isNotNull(), pairs))
        .withColumn("__q", F.when(F.col("__w").isNotNull(), positions))
        .withColumn("n_repeat_words", F.coalesce(F.when(F.col("__w").isNotNull(), total), F.lit(0)).cast("long"))
    )
    return repeated.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", *carried)


def group_sketches(measured: DataFrame) -> DataFrame:
    """Per (lang, source) the number of documents that pass the base rules (__n) and a
    KLL sketch of each of their rates; sketches of parts merge."""
    passed = ~F.expr(BASE_FAILED)
    rated = measured.select("lang", "source", passed.alias("__ok"), *[F.when(passed, F.expr(e).cast("double")).alias(r) for r, (e, _, _) in RATES.items()])
    return rated.groupBy("lang", "source").agg(F.count_if("__ok").alias("__n"), *[F.kll_sketch_agg_double(r).alias(f"__{r}") for r in RATES])


def _ends(n: Column, prefix: str) -> Column:
    """Struct of the (lower, upper) quantiles of each rate; null without documents."""
    parts = []
    for r, (_, probs, _) in RATES.items():
        q = F.kll_sketch_get_quantile_double(f"{prefix}{r}", F.array(*map(F.lit, probs)))
        parts.append(F.when(n > 0, q).alias(r))
    return F.struct(*parts)


def _shrunk(n: Column, own: Column, wide: Column) -> Column:
    """The quantiles ``own`` of n documents, drawn towards those of the wider set."""
    weight = F.least(F.lit(float(SHRINK)), F.col("__all_n").cast("double"))
    drawn = lambda r, i: (n * own[r][i] + weight * wide[r][i]) / (n + weight)
    return F.struct(*[F.when(n == 0, wide[r]).otherwise(F.array(drawn(r, 0), drawn(r, 1))).alias(r) for r in RATES])


def thresholds(sketches: DataFrame) -> DataFrame:
    """Per (__lang, __source) the ends and the distance of each rate."""
    merge = [F.sum("__n").alias("__n"), *[F.kll_merge_agg_double(f"__{r}").alias(f"__{r}") for r in RATES]]
    own = sketches.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), F.col("__n").alias("__own_n"), _ends(F.col("__n"), "__").alias("__own"))
    langs = sketches.groupBy("lang").agg(*merge)
    # one row; a table without groups has no thresholds to join
    whole = langs.agg(*merge).filter("__n is not null").select(F.col("__n").alias("__all_n"), _ends(F.col("__n"), "__").alias("__all"))
    langs = langs.select(F.col("lang").alias("__of"), F.col("__n").alias("__lang_n"), _ends(F.col("__n"), "__").alias("__lang_q"))
    joined = own.join(langs, own["__lang"].eqNullSafe(langs["__of"])).withColumn("__one", F.lit(1)).join(F.broadcast(whole.withColumn("__one", F.lit(1))), "__one")
    wide = joined.withColumn("__wide", _shrunk(F.col("__lang_n"), F.col("__lang_q"), F.col("__all")))
    ends = wide.withColumn("__ends", _shrunk(F.col("__own_n"), F.col("__own"), F.col("__wide")))
    found = []
    for r, (_, _, floor) in RATES.items():
        low, high = F.col("__ends")[r][0], F.col("__ends")[r][1]
        found += [low.alias(f"__low_{r}"), high.alias(f"__high_{r}"), F.greatest(high - low, F.lit(floor)).alias(f"__span_{r}")]
    return ends.select("__lang", "__source", *found)


def judge(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, the base columns, base_failed, kept and the ``carried`` columns."""
    measured = cut(measure(docs, *carried), "measured")
    limits = cut(thresholds(cut(group_sketches(measured), "sketches")), "limits")
    if limits.count() <= BROADCAST_ROWS:
        limits = F.broadcast(limits)
    joined = measured.join(limits, measured["lang"].eqNullSafe(F.col("__lang")) & measured["source"].eqNullSafe(F.col("__source")), "left")
    failed = F.expr(BASE_FAILED)
    scatter = F.greatest(F.lit(1.0), F.sqrt(REFERENCE / F.greatest("n_words", F.lit(1))))
    bad = F.lit(False)
    for r, (e, _, _) in RATES.items():
        rate, slack = F.expr(e).cast("double"), FENCE * F.col(f"__span_{r}")
        if r == "word_length":
            slack = slack * scatter
            bad = bad | F.coalesce(rate < F.col(f"__low_{r}") - slack, F.lit(False))
        bad = bad | F.coalesce(rate > F.col(f"__high_{r}") + slack, F.lit(False))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~bad).alias("kept"), *carried,
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns. Each row carries its own
    verdict: ids may be null or repeat."""
    row = free_name(docs, "__row")
    return judge(docs.withColumn(row, F.struct("*")), row).filter("kept").select(f"{row}.*")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


QUERIES = {"op6_quality": op6_quality}
SQL: dict[str, str] = {}
