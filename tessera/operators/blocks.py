"""Lossy block coding: the transform of 8 x 8 blocks, quantised by quality.

The orthonormal cosine transform of a block is 64 sums over its pixels, so it is one
aggregate per block with partial sums; no pixel is multiplied into rows. Pixels count less
128; what a block lacks at the image's edge counts as 128. As the transform keeps
lengths, the squared error of the pixels is that of the coefficients.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

N = 8
# The usual luminance table at quality 50.
TABLE = (
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
)
TIE = 1e-9


def steps(quality: int) -> list[int]:
    """The quantisation steps of a quality from 1 to 100."""
    if not 1 <= quality <= 100:
        raise ValueError("quality must be in [1, 100]")
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [min(255, max(1, (t * scale + 50) // 100)) for t in TABLE]


def basis(u: int, at: int) -> float:
    return math.sqrt((1 if u == 0 else 2) / N) * math.cos((2 * at + 1) * u * math.pi / (2 * N))


def _wave(u: int, place: Column) -> Column:
    return F.element_at(F.lit([basis(u, at) for at in range(N)]), place + 1)


def transform(px: DataFrame, value: Column) -> DataFrame:
    """img_id, block_x, block_y and coefficients (array of 64, by v * 8 + u) of every block."""
    placed = px.select("img_id", F.expr(f"x div {N}").cast("int").alias("block_x"), F.expr(f"y div {N}").cast("int").alias("block_y"), (F.col("x") % N).alias("i"), (F.col("y") % N).alias("j"), (value - 128).cast("double").alias("s"))
    waves = placed.select("img_id", "block_x", "block_y", *[(F.col("s") * _wave(v, F.col("j"))).alias(f"v{v}") for v in range(N)], *[_wave(u, F.col("i")).alias(f"u{u}") for u in range(N)])
    sums = [F.sum(F.col(f"v{v}") * F.col(f"u{u}")).alias(f"c{v * N + u}") for v in range(N) for u in range(N)]
    blocks = waves.groupBy("img_id", "block_x", "block_y").agg(*sums)
    return blocks.select("img_id", "block_x", "block_y", F.array(*[F.col(f"c{k}") for k in range(N * N)]).alias("coefficients"))


def quantise(blocks: DataFrame, quality: int = 80) -> DataFrame:
    """The blocks with ``levels``, the nearest whole multiples of the steps (halves upwards)."""
    by = F.lit(steps(quality))
    return blocks.withColumn("levels", F.zip_with("coefficients", by, lambda c, q: F.floor(c / q + 0.5 + TIE).cast("int")))


def error(blocks: DataFrame, quality: int = 80) -> DataFrame:
    """Per image: its blocks, levels other than zero, and the mean squared error of a pixel when it is built again."""
    by = F.lit(steps(quality))
    lost = F.zip_with(F.zip_with("levels", by, lambda n, q: n * q), "coefficients", lambda a, c: (a - c) * (a - c))
    each = quantise(blocks, quality).select("img_id", F.aggregate(lost, F.lit(0.0), lambda a, b: a + b).alias("lost"), F.size(F.filter("levels", lambda n: n != 0)).alias("kept"))
    return each.groupBy("img_id").agg(F.count("*").alias("blocks"), F.sum("kept").alias("kept"), (F.sum("lost") / (F.count("*") * N * N)).alias("mse"))
