"""Top-k search against brute force: ties, own rows, lengths, large numbers, tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import topk


def brute(rows, k=10, every=100):
    good = [(i, [int(np.floor(1024.0 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % every:
            continue
        scored = [(max(min(sum(a * b for a, b in zip(q, v)), 2**63 - 1), -(2**63)), j) for j, v in good if j != i]
        out += [(i, rank + 1, j, s) for rank, (s, j) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:k])]
    return sorted(out)


def run(spark, rows, **kw):
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"row": F.lit("x"), "tile": F.lit(1), "score": F.lit(2), "v": F.lit("v")})
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(d, **kw).collect())


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 150)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "SAMPLE", 40)


def test_ties_lengths_and_odd_vectors(spark, small_tiles):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.4, 12).tolist()) for i in range(500)]
    rows += [(i, rows[3][1]) for i in range(500, 640)]  # copies: ties by id
    rows += [(i, rng.normal(0, 0.4, int(rng.integers(0, 20))).tolist()) for i in range(640, 720)]  # other lengths
    rows += [(800, None), (900, [1.0, None]), (1000, [float("nan")]), (1100, [float("inf")] * 12), (None, [0.1] * 12), (1200, []), (1300, [0.0] * 12)]
    assert run(spark, rows, every=20) == brute(rows, every=20)


def test_repeated_ids(spark, small_tiles):
    rng = np.random.default_rng(2)
    rows = [(i % 60, rng.normal(0, 1, 8).tolist()) for i in range(200)]
    got = run(spark, rows, k=5, every=20)
    assert got == brute(rows, k=5, every=20)


def test_large_components_and_few_rows(spark, small_tiles):
    rng = np.random.default_rng(3)
    big = [(i, (rng.normal(0, 1, 6) * 10.0 ** rng.integers(0, 9)).tolist()) for i in range(60)] + [(100, [1e17] * 6), (200, [-1e17] * 6)]
    assert run(spark, big, every=10) == brute(big, every=10)
    assert run(spark, [(0, [1.0]), (7, [2.0])]) == [(0, 1, 7, 2048 * 1024)]
    assert run(spark, [(0, [1.0])]) == [] and run(spark, []) == []


def test_pruning_skips_blocks(monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(4)
    centres = np.eye(8) * 1000
    m = np.concatenate([np.floor(c + rng.normal(0, 5, (64, 8))) for c in centres])
    shard, looked = topk.Shard(list(range(len(m))), list(m)), []
    real = topk.best_rows
    monkeypatch.setattr(topk, "best_rows", lambda ids, scores, k: looked.append(len(ids)) or real(ids, scores, k))
    ids, scores = shard.top(m[0], 0, 10)
    want = sorted(((-int(s), j) for j, s in enumerate(m @ m[0]) if j != 0))[:10]
    assert [(-s, i) for i, s in zip(ids.tolist(), scores)] == want and len(looked) < len(shard.low) / 2
