"""Exact top-k search by inner product with MaxScore pruning.

Vector dimensions play the part of query terms: a dimension's postings are the
components of all vectors of a block, and the most it can add to a query's score is the
larger of q_d * max_d and q_d * min_d over the block. Blocks are taken by falling sum of
these bounds, until no further block can reach the current k-th score. In a block the
dimensions are ordered by their bounds; the last ones, whose bounds together stay below
the k-th score, are non-essential. The postings of the essential dimensions are
traversed for all vectors of the block, the others are probed, some at a time, only for
vectors that can still compete. Each shard gives its best k; a window over the shards'
results merges them.

A query starts with the k-th best score among SAMPLE candidates, which are the only
rows that the driver sees. Shards of candidates and blocks of queries meet in tiles,
both of bounded size, so that candidates are sent once for each block of queries and
queries once for each shard; within a tile, queries stream past the shard.

Edge cases: null vectors, vectors with a null or non-finite component and null ids
take no part; shorter vectors count as padded with zeros; candidates that share the
query's vec_id are its own rows; rows that repeat an id are separate candidates, and
each repeated query row gets a result; scores that leave the 64-bit range saturate; an
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, table

SCALE = 1024
SHARD_ROWS = QUERY_ROWS = 1 << 16  # the most of a tile
BLOCK_ROWS = 512
SAMPLE = 1024
STEP = 8
EXACT = 2.0 ** 52


def _floor_scaled(x):
    y = F.lit(float(SCALE)) * x
    return F.when(F.abs(y) < 2.0 ** 53, F.floor(y).cast("double")).otherwise(y)  # beyond 2**53 all are whole


def valid_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v) with v the array of floor(1024 * x), as doubles."""
    x = F.col("v")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
        .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(finite)
        .select("vec_id", F.transform("v", _floor_scaled).alias("v"))
    )


def best_rows(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, by falling score and then rising id."""
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= kth)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


class Shard:
    """Candidates in blocks of rows that have the same largest component, so that the
    bounds of a block are narrow."""

    def __init__(self, ids: list[int], vectors: list):
        self.d = max(map(len, vectors), default=0)
        m = np.zeros((len(ids), self.d))
        for i, v in enumerate(vectors):
            m[i, : len(v)] = v
        if self.d:
            top = np.abs(m).argmax(1)
            value = m[np.arange(len(m)), top]
            order = np.lexsort((value, value > 0, top))
        else:
            order = np.arange(len(m))
        self.ids, self.m = np.array(ids, np.int64)[order], m[order]
        starts = range(0, len(m), BLOCK_ROWS)
        self.low = np.array([self.m[i:i + BLOCK_ROWS].min(0) for i in starts]).reshape(len(starts), self.d)
        self.high = np.array([self.m[i:i + BLOCK_ROWS].max(0) for i in starts]).reshape(len(starts), self.d)
        self.largest = float(np.abs(m).max(initial=0.0))

    def top(self, q: np.ndarray, q_id: int, k: int, least: float = -np.inf) -> tuple[np.ndarray, list]:
        """(ids, scores) of the k rows with the highest inner product with q, without
        the rows whose id is q_id and, where enough others have it, those below ``least``."""
        q = q[: self.d]
        if len(q) and np.abs(q).max() * max(self.largest, 1.0) * self.d >= EXACT:
            return self._plain(q, q_id, k)
        d = len(q)
        bound = np.maximum(q * self.low[:, :d], q * self.high[:, :d])
        upper = bound.sum(1)
        top_ids, top = np.empty(0, np.int64), np.empty(0)
        for b in np.argsort(-upper, kind="stable").tolist():
            if upper[b] < least:
                break
            at = b * BLOCK_ROWS
            rows = at + np.flatnonzero(self.ids[at:at + BLOCK_ROWS] != q_id)
            terms = np.argsort(-bound[b], kind="stable")
            rest = np.append(np.cumsum(bound[b][terms][::-1])[::-1], 0.0)  # rest[j]: most that terms j, j+1, ... add
            below = np.flatnonzero(rest < least)
            j = int(below[0]) if len(below) else d  # terms[:j] are essential
            score = self.m[rows[:, None], terms[:j]] @ q[terms[:j]]
            while True:
                alive = score + rest[j] >= least
                rows, score = rows[alive], score[alive]
                if j == d or not len(rows):
                    break
                probed = terms[j:j + STEP]
                score = score + self.m[rows[:, None], probed] @ q[probed]
                j = min(j + STEP, d)
            if len(rows):
                all_ids, all_scores = np.concatenate([top_ids, self.ids[rows]]), np.concatenate([top, score])
                best = best_rows(all_ids, all_scores, k)
                top_ids, top = all_ids[best], all_scores[best]
                if len(top) == k:
                    least = max(least, top[-1])
        return top_ids, top.astype(np.int64).tolist()

    def _plain(self, q: np.ndarray, q_id: int, k: int) -> tuple[np.ndarray, list]:
        """For components too large for exact doubles: Python integers."""
        qq = [int(x) for x in q]
        scored = ((-max(min(sum(a * int(b) for a, b in zip(qq, row)), 2**63 - 1), -(2**63)), int(i)) for i, row in zip(self.ids, self.m) if i != q_id)
        got = heapq.nsmallest(k, scored)
        return np.array([i for _, i in got], np.int64), [-s for s, _ in got]


def _seed(asked: DataFrame, shard: Shard, k: int) -> DataFrame:
    """The queries with ``least``, the k-th best score among the sample; null if it has
    not so many."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            least = []
            for i, v in zip(batch["vec_id"], batch["v"]):
                scores = shard.top(np.asarray(v, float), i, k)[1]
                least.append(float(scores[-1]) if len(scores) == k and abs(scores[-1]) < EXACT else None)
            yield batch.assign(least=pd.Series(least, index=batch.index, dtype=float))

    return asked.mapInPandas(run, "row long, vec_id long, v array<double>, least double")


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k best rows for each query: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    good = cut(valid_vectors(vectors, id_col, vec_col).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"), "vectors")
    n = good.count()
    asked = good.filter(F.pmod("vec_id", F.lit(every)) == 0)
    sample = good.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("vec_id", "v").collect()
    asked = cut(_seed(asked, Shard([r[0] for r in sample], [r[1] for r in sample]), k), "queries")
    shards = max(1, -(-n // SHARD_ROWS), min(-(-n // BLOCK_ROWS), spark.sparkContext.defaultParallelism))
    blocks = max(1, -(-asked.count() // QUERY_ROWS))

    def spread(rows: DataFrame, own: int, other: int, tile: str) -> DataFrame:
        """Each row with the tiles of its own shard or block and all others."""
        placed = rows.withColumn("own", F.pmod(F.xxhash64("row"), F.lit(own))).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(other - 1))))
        return placed.select(F.expr(tile).cast("int").alias("tile"), "row", "vec_id", "v", "least", "asked")

    candidates = spread(good.select("*", F.lit(None).cast("double").alias("least"), F.lit(False).alias("asked")), shards, blocks, f"own * {blocks} + other")
    queries = spread(asked.select("*", F.lit(True).alias("asked")), blocks, shards, f"other * {blocks} + own")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, shard, ids, vecs = None, None, [], []
        for batch in batches:
            for (place, is_query), rows in batch.groupby(["tile", "asked"], sort=False):
                if place != tile:
                    tile, shard, ids, vecs = place, None, [], []
                if not is_query:
                    ids += rows["vec_id"].tolist()
                    vecs += rows["v"].tolist()
                    continue
                if shard is None:
                    shard, ids, vecs = Shard(ids, vecs), [], []
                out = []
                for row, q_id, v, least in zip(rows["row"], rows["vec_id"], rows["v"], rows["least"]):
                    got, scores = shard.top(np.asarray(v, float), q_id, k, -np.inf if np.isnan(least) else least)
                    out += [(row, q_id, i, s) for i, s in zip(got.tolist(), scores)]
                yield pd.DataFrame(out, columns=["row", "query_id", "vec_id", "score"], dtype="int64")

    met = candidates.unionByName(queries).repartitionById(shards * blocks, F.col("tile")).sortWithinPartitions("tile", "asked")
    found = met.mapInPandas(score, "row long, query_id long, vec_id long, score long")
    by_query = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


QUERIES = {"op10_topk": op10_topk}
SQL = {
    "op10_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, cast(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, cast(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
) WHERE rank <= 10
"""
}
