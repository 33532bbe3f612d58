"""Packing by optimal length buckets and token-budget batches.

Texts become token counts; a text longer than ``max_len`` becomes consecutive
pieces, so nothing is cut away. The global histogram of piece lengths (at most
``max_len`` counts) is summed over all data, and dynamic programming picks the
bucket bounds with the least padding. In each bucket every piece is padded to the
bound, and a batch holds as many pieces as the token budget allows. The rows carry the
ids of their piece, so a trainer reads batches without encoding anything again.

Edge cases: null texts are empty and have the end token alone; equal lengths share
a bucket; rows that repeat a doc_id or have none are packed like any others; texts of
any length are packed whole, in pieces; an empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructType

from .bpe import tokenizer_path
from .common import cut, slots_within, table
from .token_store import END_ID, binary_rows, by_bytes, load_encoder

MAX_LEN = 2048
N_BUCKETS = 16
BATCH_TOKENS = 16_384


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """Upper bounds of at most ``n_buckets`` buckets with the least total padding.

    Padding of one bucket over lengths i..j is counts[i..j].sum() * lengths[j] less
    the tokens themselves; the tokens are the same for every choice, so the programme
    minimises padded tokens. Among equal choices the earliest split wins.
    """
    order = np.argsort(lengths)
    lengths, counts = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n = len(lengths)
    if not n:
        return []
    upto = np.concatenate([[0], np.cumsum(counts)])
    best = upto[1:] * lengths  # one bucket for the first j + 1 lengths
    choice = [np.zeros(n, np.int64)]
    for _ in range(1, min(n_buckets, n)):
        now, cut_at = best.copy(), np.zeros(n, np.int64)
        for j in range(1, n):
            cost = best[:j] + (upto[j + 1] - upto[1:j + 1]) * lengths[j]
            i = int(np.argmin(cost))
            if cost[i] < now[j]:
                now[j], cut_at[j] = cost[i], i + 1
        choice.append(cut_at)
        best = now
    bounds, j, level = [int(lengths[-1])], n - 1, len(choice) - 1
    while level:
        i = int(choice[level][j])
        level -= 1
        if i:  # else one bucket fewer is as good
            j = i - 1
            bounds.append(int(lengths[j]))
    return bounds[::-1]


def pieces_of(docs: DataFrame, path: str, max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, n_tokens and ids (little-endian, of two
    bytes each, four for vocabularies over 65,536); the end token counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load_encoder(path)
        for batch in batches:
            for some in by_bytes(batch):
                ids, sizes = enc.encode_batch(some.column("text"), end_id)
                n = -(-sizes // max_len)
                row = np.repeat(np.arange(len(sizes)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * max_len
                n_tokens = np.minimum(max_len, sizes[row] - start)
                columns = [some.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(n_tokens, pa.int32()), binary_rows(ids, n_tokens)]
                yield pa.record_batch(columns, schema.names)

    schema = StructType().add("doc_id", docs.schema["doc_id"].dataType).add("piece", IntegerType()).add("start", LongType()).add("n_tokens", IntegerType()).add("ids", BinaryType())
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, max_len: int = MAX_LEN, n_buckets: int = N_BUCKETS, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """One row per piece: doc_id, piece, start, n_tokens, bucket, padded_len,
    batch (within the bucket), slot (within the batch) and ids."""
    if batch_tokens < max_len:
        raise ValueError("batch_tokens must be at least max_len")
    pieces = cut(pieces_of(docs, path, max_len).withColumn("__pid", F.spark_partition_id()), "pieces")
    histogram = pieces.groupBy("n_tokens").count().collect()  # at most max_len rows
    bounds = optimal_bounds(np.array([r[0] for r in histogram], np.int64), np.array([r[1] for r in histogram], np.int64), n_buckets)
    bucket, padded, per_batch = F.lit(0), F.lit(0), F.lit(1)
    for i, bound in reversed(list(enumerate(bounds))):
        fits = F.col("n_tokens") <= bound
        bucket = F.when(fits, F.lit(i)).otherwise(bucket)
        padded = F.when(fits, F.lit(bound)).otherwise(padded)
        per_batch = F.when(fits, F.lit(batch_tokens // bound)).otherwise(per_batch)
    placed = pieces.withColumns({"bucket": bucket, "padded_len": padded, "__per": per_batch})
    slotted = slots_within(placed, "bucket", ["doc_id", "piece"], "__at")
    return slotted.select(
        "doc_id", "piece", "start", "n_tokens", "bucket", "padded_len",
        F.floor(F.col("__at") / F.col("__per")).cast("long").alias("batch"),
        (F.col("__at") % F.col("__per")).cast("int").alias("slot"), "ids",
    )


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


QUERIES = {"op9_packing": op9_packing}
SQL: dict[str, str] = {}
