"""Gradients that blend in other colour spaces than sRGB.

A gradient's few colours are taken to the space by a function per gradient; its pixels are a
projection that blends and comes back. Definitions are the usual CIE ones under D65, with lightness and
chroma in 0..1.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .pixels import spread

SPACES = ("rgb", "lab", "hcl", "hsv", "luv", "luvlch")
# The white point, its chromaticity and the sRGB matrices.
WHITE = (0.95047, 1.0, 1.08883)
TO_XYZ = (
    (0.41239079926595948, 0.35758433938387796, 0.18048078840183429),
    (0.21263900587151036, 0.71516867876775593, 0.072192315360733715),
    (0.019330818715591851, 0.11919477979462599, 0.95053215224966058),
)
TO_RGB = (
    (3.2409699419045214, -1.5373831775700935, -0.49861076029300328),
    (-0.96924363628087983, 1.8759675015077207, 0.041555057407175613),
    (0.055630079696993609, -0.20397695888897657, 1.0569715142428786),
)
UN = 4 * WHITE[0] / (WHITE[0] + 15 * WHITE[1] + 3 * WHITE[2])
VN = 9 * WHITE[1] / (WHITE[0] + 15 * WHITE[1] + 3 * WHITE[2])
GREY = 0.00015  # below this chroma a colour has no hue of its own


def _xyz(rgb: tuple[int, int, int]) -> list[float]:
    linear = [v / 12.92 if v <= 0.04045 else ((v + 0.055) / 1.055) ** 2.4 for v in (c / 255 for c in rgb)]
    return [sum(m * v for m, v in zip(row, linear)) for row in TO_XYZ]


def to_space(rgb: tuple[int, int, int], space: str) -> tuple[float, float, float]:
    """An 8-bit colour in a space; hues in degrees come first."""
    if space == "rgb":
        return tuple(c / 255 for c in rgb)
    if space == "hsv":
        r, g, b = (c / 255 for c in rgb)
        top, low = max(r, g, b), min(r, g, b)
        d = top - low
        h = 0.0 if not d else 60 * (((g - b) / d) % 6 if top == r else (b - r) / d + 2 if top == g else (r - g) / d + 4)
        return h, (d / top if top else 0.0), top
    x, y, z = _xyz(rgb)
    if space in ("lab", "hcl"):
        f = [math.cbrt(t) if t > (6 / 29) ** 3 else t / 3 * 29 / 6 * 29 / 6 + 4 / 29 for t in (v / w for v, w in zip((x, y, z), WHITE))]
        l, a, b = 1.16 * f[1] - 0.16, 5 * (f[0] - f[1]), 2 * (f[1] - f[2])  # noqa: E741
    else:
        ratio = y / WHITE[1]
        l = ratio * (29 / 3) ** 3 / 100 if ratio <= (6 / 29) ** 3 else 1.16 * math.cbrt(ratio) - 0.16  # noqa: E741
        total = x + 15 * y + 3 * z
        a, b = (13 * l * (4 * x / total - UN), 13 * l * (9 * y / total - VN)) if total else (0.0, 0.0)
    if space in ("lab", "luv"):
        return l, a, b
    chroma = math.hypot(a, b)
    hue = math.degrees(math.atan2(b, a)) % 360 if abs(b - a) > 1e-4 and abs(a) > 1e-4 else 0.0
    return hue, chroma, l


def segments(colours: list[tuple[int, int, int]], space: str) -> list[tuple[tuple, tuple]]:
    """(start, change) of each pair of neighbours; hues go the short way."""
    points, out = [to_space(c, space) for c in colours], []
    for p, q in zip(points, points[1:]):
        start, change = list(p), [b - a for a, b in zip(p, q)]
        if space in ("hcl", "hsv", "luvlch"):
            least = GREY if space != "hsv" else 0.0
            if p[1] <= least < q[1]:
                start[0] = q[0]
            end = start[0] if q[1] <= least < p[1] else q[0]
            change[0] = ((end - start[0]) % 360 + 540) % 360 - 180
        out.append((tuple(start), tuple(change)))
    return out


def from_space(p: Column, q: Column, s: Column, space: str) -> list[Column]:
    """sRGB shares (unclamped) of a colour in a space."""
    if space == "rgb":
        return [p, q, s]
    if space == "hsv":
        sector = F.pmod(p, F.lit(360.0)) / 60
        c = s * q
        x = c * (1 - F.abs(F.pmod(sector, F.lit(2.0)) - 1))
        m, zero = s - c, F.lit(0.0)
        pick = lambda *v: F.element_at(F.array(*v), F.least(F.floor(sector).cast("int"), F.lit(5)) + 1) + m
        return [pick(c, x, zero, zero, x, c), pick(x, c, c, x, zero, zero), pick(zero, zero, x, c, c, x)]
    if space in ("hcl", "luvlch"):
        p, q, s = s, q * F.cos(F.radians(p)), q * F.sin(F.radians(p))
    if space in ("lab", "hcl"):
        fy = (p + 0.16) / 1.16
        inverse = lambda t: F.when(t > 6 / 29, t * t * t).otherwise((t - F.lit(4 / 29)) * F.lit(3 * 6 / 29 * 6 / 29))
        x, y, z = (inverse(f) * w for f, w in zip((fy + q / 5, fy, fy - s / 2), WHITE))
    else:
        y = F.when(p <= 0.08, p * F.lit(100 * (3 / 29) ** 3)).otherwise(F.pow((p + 0.16) / 1.16, F.lit(3.0))) * WHITE[1]
        u, v = q / (13 * p) + UN, s / (13 * p) + VN
        x = F.when(p == 0, 0.0).otherwise(y * 9 * u / (4 * v))
        z = F.when(p == 0, 0.0).otherwise(y * (12 - 3 * u - 20 * v) / (4 * v))
    linear = [sum((m * v for m, v in zip(row[1:], (y, z))), row[0] * x) for row in TO_RGB]
    return [F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055) for v in linear]


def gradients(specs: DataFrame, degrees: float = 0.0, space: str = "rgb") -> DataFrame:
    """grad_id, x, y, r, g, b of a linear gradient for every row of ``specs`` (grad_id, w, h,
    colours: array of structs r, g, b): evenly spaced colours, blended in a space;
    shares of one are cut to 8 bits from 16. Rows with fewer than two colours or
    without a positive size give no pixels."""
    if space not in SPACES:
        raise ValueError(f"unknown space {space}")

    @F.pandas_udf("array<struct<start: array<double>, change: array<double>>>")
    def parts_of(colours: pd.Series) -> pd.Series:
        return colours.map(lambda own: [{"start": list(map(float, p)), "change": list(map(float, c))} for p, c in segments([(c["r"], c["g"], c["b"]) for c in own], space)])

    cos, sin = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    good = spread(specs.filter((F.size("colours") > 1) & (F.col("w") > 0) & (F.col("h") > 0)), "grad_id").select("grad_id", "w", "h", parts_of("colours").alias("parts"))
    lines = good.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h").cast("int") - 1)))
    at = lines.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w").cast("int") - 1)))
    half = (F.abs(F.col("w") * F.lit(cos)) + F.abs(F.col("h") * F.lit(sin))) / 2
    t = ((F.col("x") - F.col("w") / 2) * F.lit(cos) + (F.col("y") - F.col("h") / 2) * F.lit(sin) + half) / (half * 2)
    n = F.size("parts")
    at = at.withColumn("u", F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * n)
    at = at.withColumn("seg", F.least(F.greatest(F.ceil("u").cast("int") - 1, F.lit(0)), n - 1))  # the first one that holds t
    at = at.withColumns({"f": F.col("u") - F.col("seg"), "part": F.element_at("parts", F.col("seg") + 1)})
    at = at.withColumns({name: F.col("part.start")[k] + F.col("f") * F.col("part.change")[k] for k, name in enumerate(("p", "q", "s"))})
    at = at.withColumns({f"__{c}": v for c, v in zip("rgb", from_space(F.col("p"), F.col("q"), F.col("s"), space))})
    eight = lambda c: F.floor(F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * 65535 + 0.5) / 256).cast("int")
    return at.select("grad_id", "x", "y", *[eight(F.coalesce(F.nanvl(F.col(f"__{c}"), F.lit(0.0)), F.lit(0.0))).alias(c) for c in "rgb"])


def gradient(spark, w: int, h: int, colours: list[tuple[int, int, int]], degrees: float = 0.0, space: str = "rgb") -> DataFrame:
    """x, y, r, g, b of one gradient."""
    if len(colours) < 2 or w < 1 or h < 1:
        raise ValueError("a gradient needs two colours and a positive size")
    spec = spark.createDataFrame([(0, w, h, [tuple(c) for c in colours])], "grad_id int, w int, h int, colours array<struct<r: int, g: int, b: int>>")
    return gradients(spec, degrees, space).drop("grad_id")
