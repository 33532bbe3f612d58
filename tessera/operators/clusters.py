"""Background removal by two clusters per image, from a sample and drawn centres.

As published (k-means++ for two centres): a Bernoulli sample of the pixels; a first centre drawn
evenly from it; a second one drawn with weights of the squared distance from the first;
Lloyd rounds over the sample; every pixel to the nearer centre, and the cluster with more
sampled pixels becomes transparent.

The draws are aggregates with partial aggregation. Each pixel has random numbers of its own,
a function of seed, image and place, so a run can be repeated and survives lost tasks. The
weighted draw takes the pixel with the least exponential key -ln(u) / d^2, which
is each pixel's with a probability in proportion to d^2.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .pixels import CH

RATE, ROUNDS, TOLERANCE = 0.5, 100, 0.255  # the tolerance is 0.001 of the channels' range
PRIME = 2147483647
ROUND_KEYS = (48_271, 69_621, 16_807, 1_103_515_245)
CENTRES = [f"{c}{k}" for k in (0, 1) for c in CH]


def uniform(seed: int, draw: int) -> Column:
    """A number in (0, 1) for each pixel (img_id, x, y) and draw: its place, squared again and
    again modulo a prime (squares of 31 bits fit 64), with the place added between."""
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    h = F.pmod(F.col("img_id").cast("long") * 1_000_003 + y * 8191 + x * 131 + (seed * 7919 + draw * 104_729), F.lit(PRIME))
    for k in ROUND_KEYS:
        h = (h * h + x * 31 + y * 17 + k) % PRIME
    return (h + F.lit(0.5)) / F.lit(float(PRIME))


def sample(px: DataFrame, seed: int = 0, rate: float = RATE) -> DataFrame:
    return px.filter(uniform(seed, 0) < rate)


def draw_centres(sampled: DataFrame, seed: int = 0) -> DataFrame:
    """img_id, the sampled pixels (n) and the two centres r0 .. b1 of every image. Where all
    sampled pixels have one colour, both centres are that colour."""
    pixel = [F.col(c) for c in ("x", "y", *CH)]
    first = sampled.groupBy("img_id").agg(F.count("*").alias("n"), F.min(F.struct(uniform(seed, 1).alias("key"), *pixel)).alias("p"))
    first = first.select("img_id", "n", *[F.col(f"p.{c}").alias(f"{c}0") for c in CH])
    d2 = sum((F.col(c) - F.col(f"{c}0")) * (F.col(c) - F.col(f"{c}0")) for c in CH)
    key = F.when(d2 > 0, -F.ln(uniform(seed, 2)) / d2)
    second = sampled.join(first, "img_id").groupBy("img_id").agg(F.min(F.when(key.isNotNull(), F.struct(key.alias("key"), *pixel))).alias("p"))
    return first.join(second, "img_id").select("img_id", "n", *[f"{c}0" for c in CH], *[F.coalesce(F.col(f"p.{c}"), F.col(f"{c}0")).alias(f"{c}1") for c in CH])


def _nearer(k: int) -> Column:
    return sum((F.col(c) - F.col(f"__{c}{k}")) * (F.col(c) - F.col(f"__{c}{k}")) for c in CH)


def settle(sampled: DataFrame, centres: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """img_id, centres after Lloyd rounds, and the background (0 or 1). The rounds run per image over the
    different colours of its sample and their counts; an empty cluster keeps its centre."""
    names = ["img_id", *CENTRES, "background"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        colours, n = pdf[list(CH)].to_numpy(float), pdf["m"].to_numpy(float)
        centre = pdf[CENTRES].iloc[0].to_numpy(float).reshape(2, 3)

        def one() -> np.ndarray:
            d = ((colours[:, None] - centre[None]) ** 2).sum(axis=2)
            return d[:, 1] < d[:, 0]

        in_one = one()
        for _ in range(rounds):
            in_one, before = one(), centre.copy()
            for k, own in enumerate((~in_one, in_one)):
                if own.any():
                    centre[k] = (colours[own] * n[own, None]).sum(axis=0) / n[own].sum()
            if np.sqrt(((centre - before) ** 2).sum(axis=1)).max() < tolerance:
                break
        return pd.DataFrame([(pdf["img_id"].iloc[0], *centre.ravel(), int(n[in_one].sum() > n[~in_one].sum()))], columns=names)

    counts = sampled.groupBy("img_id", *CH).agg(F.count("*").alias("m"))
    schema = f"img_id {dict(sampled.dtypes)['img_id']}, {', '.join(f'{c} double' for c in CENTRES)}, background int"
    return counts.join(centres.drop("n"), "img_id").groupBy("img_id").applyInPandas(run, schema)


def remove_background(px: DataFrame, seed: int = 0, rate: float = RATE, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """The pixels with their cluster; those of the background are transparent, all others
    opaque. An image too small to have a sampled pixel keeps its alpha and has no cluster."""
    if not 0 < rate <= 1:
        raise ValueError("rate must be in (0, 1]")
    sampled = sample(px, seed, rate)
    settled = settle(sampled, draw_centres(sampled, seed), rounds, tolerance)
    met = px.join(settled.select("img_id", *[F.col(c).alias(f"__{c}") for c in CENTRES], F.col("background").alias("__background")), "img_id", "left")
    cluster = F.when(F.col("__background").isNotNull(), F.when(_nearer(1) < _nearer(0), 1).otherwise(0))
    out = met.withColumn("cluster", cluster)
    alpha = F.when(F.col("cluster").isNull(), F.col("a")).when(F.col("cluster") == F.col("__background"), 0).otherwise(255)
    return out.withColumn("a", alpha).drop("__background", *[f"__{c}" for c in CENTRES])
