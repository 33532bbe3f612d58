"""The filter audit against filters applied one by one, in every order."""

import itertools
import re

from pyspark.sql import functions as F

from tessera.llm import filter_audit

DOCS = "doc_id long, text string, lang string, mask int, part string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for doc_id, text, lang in docs:
        text = text or ""
        words = WORD.findall(text)
        smaller = any((other or "") == text and i is not None and doc_id is not None and i < doc_id for i, other, _ in docs)
        fails.append({f for f, failed in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), smaller,
        )) if failed})
    out = []
    for part in {lang or "" for *_, lang in docs}:
        mine = [(doc_id, f) for (doc_id, _, lang), f in zip(docs, fails) if (lang or "") == part]
        removed_by, rows = dict.fromkeys("ABCDE", 0), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left, gone = mine, []
            for step, f in enumerate(order, 1):
                here = [d for d in left if f in d[1]]
                kept = [d for d in left if f not in d[1]]
                rows.append([part, order, step, len(kept), len(here), sum(f in d[1] for d in gone), sum(d[1] == {f} for d in mine), sum(d[0] in good for d in here), sum(d[0] in toxic for d in here), f])
                removed_by[f] += len(here)
                left, gone = kept, gone + here
        out += [tuple(r[:-1] + [removed_by[r[-1]]]) for r in rows]
    return sorted(out)


def long_text(i, distinct=300, word="w"):
    return " ".join(f"{word}{i}x{j % distinct}" for j in range(300))


def test_against_filters_one_by_one(spark):
    docs = [(i, long_text(i), "en") for i in range(6)]
    docs += [(10, long_text(1), "en"), (11, long_text(1), "fr"), (3, long_text(3), "en"), (None, long_text(3), "en"), (None, None, None), (12, None, ""), (13, "", None), (-5, "", "de")]
    docs += [(20, long_text(20, 20), "fr"), (21, long_text(21, 20) + " #", "fr"), (22, long_text(22, word="ABCD"), "fr"), (23, "SHORT & LOUD", "fr"), (23, "short", "fr"), (23, "short", "fr"), (24, "short", "de")]
    docs += [(30, "é漢\x1c " * 300, "de"), (31, " \t\n\x0b\x0c\r", "de"), (32, "$" * 100_000, "de")]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(40)] + [(1, 0, 1), (2, None, None), (None, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], DOCS)
    got = filter_audit.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in got.collect()) == plain(docs, labels)
    assert [t for _, t in got.dtypes] == ["string", "string", "int"] + ["bigint"] * 7


def test_empty_tables(spark):
    frame = spark.createDataFrame([(1, "a", "en", 1, "x")], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(frame.limit(0), labels).count() == 0
    assert filter_audit.audit(frame, labels).where(F.col("good_lost") + F.col("toxic_lost") > 0).count() == 0
