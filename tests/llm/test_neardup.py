"""Near-duplicates where ids repeat or are missing, of long texts and in small blocks."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import neardup

from .test_llm import DOCS, brute_components, prose


def components(spark, rows, **extra):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).withColumns({"id": F.lit("x"), "bands": F.lit(1), "comp": F.lit(2), "raw": F.lit(3)})
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs.repartition(5)).collect()), key=str)


def brute(rows):
    """Every row is a document; a component has the least id of its rows."""
    named = [(i, t) for i, t in rows if i is not None]
    comp = brute_components([t for _, t in named])
    least = {}
    for k, (i, _) in enumerate(named):
        c = comp[k][1]
        least[c] = min(least.get(c, i), i)
    out = [(i, comp[k][0], least[comp[k][1]], i == least[comp[k][1]]) for k, (i, _) in enumerate(named)]
    sizes = brute_components([t for i, t in rows if i is None])
    return sorted(out + [(None, n, None, True) for n, _ in sizes.values()], key=str)


def variants(seed, n, length=80):
    base = prose(seed, length).split()
    return [" ".join(base[:k] + [f"z{seed}x{k}"] + base[k + 1:]) for k in range(0, length, length // n)]


def odd_ids():
    a, b, c = variants(1, 8), variants(2, 8), prose(3, 60)
    return [(7, a[0]), (7, b[0]), (7, c), (7, c), (3, b[1]), (9, a[1]), (9, b[2]), (9, "few words"), (4, "few words"), (None, a[0]), (None, None), (5, None), (5, ""), (7, a[0]), (2, c.upper()), (-4, a[2])]


def one_id_for_a_third_of_all_rows():
    texts = [t for s in range(60, 70) for t in variants(s, 4)]
    return [(1001, t) for t in texts[:20]] + [(1010 + i, t) for i, t in enumerate(texts[20:])] + [(1100 + i, t) for i, t in enumerate(texts[::3])]


def long_texts():
    long = prose(50, 20_000)
    return [(2000, long), (2001, long + " end"), (2002, long[: len(long) // 2]), (2003, " ".join(["x"] * 20_000)), (2004, " ".join(["x"] * 30_000)), (2005, "y" * 200_000)]


def three_quarters_and_less():
    """75 of 100 shingles are shared by the first two texts, 74 of 100 by the others."""
    out = []
    for at, n in ((3000, 79), (3002, 78)):
        words = [f"w{at}n{i}" for i in range(104)]
        out += [(at, " ".join(words)), (at + 1, " ".join(words[:n]))]
    return out


def test_odd_rows(spark):
    import os

    from tessera.llm import common

    before = set(os.listdir(common.shared_dir(spark)))
    rows = odd_ids() + one_id_for_a_third_of_all_rows() + long_texts() + three_quarters_and_less()
    got = components(spark, rows)
    assert got == brute(rows)
    linked = {i: c for i, _, c, _ in got if i is not None and i >= 3000}
    assert linked == {3000: 3000, 3001: 3000, 3002: 3002, 3003: 3003}
    assert len(set(os.listdir(common.shared_dir(spark))) - before) <= 6  # the steps are deleted


@pytest.mark.parametrize("rows_of_block,shingles", [(4, 1 << 20), (512, 200)])
def test_small_blocks(spark, monkeypatch, rows_of_block, shingles):
    monkeypatch.setattr(neardup, "BLOCK", rows_of_block)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", shingles)
    passage = prose(20, 70)
    rows = [(i, f"{passage} {t}") for i, t in enumerate(v for s in range(6) for v in variants(30 + s, 5, 60))]
    assert components(spark, rows) == brute(rows)
