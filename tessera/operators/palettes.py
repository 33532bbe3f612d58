"""Palettes as data: the nearest colour of any number of colours and themes.

A palette table (theme, idx, r, g, b) is indexed by cells of the colour cube, SIDE values on
an edge: a cell lists the colours that can be nearest to some point of it. A colour can
not be if its least distance from the cell is above the largest distance of another colour, so
each list follows from two distance bounds, and exactness does not depend on the
palette. Pixels are joined to their cell's list by (theme, cell) and compare with its few
colours inside the row; pixels are not multiplied and not aggregated.

The index is built per theme along the three axes: first the cells of the red axis, then
of red and green, then of all three, each keeping only colours that can still be nearest, so a
palette of many colours does not meet every cell. Ties go to the lower idx.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SIDE = 32
CELLS = 256 // SIDE


def _bounds(colour: Column, cell: Column) -> tuple[Column, Column]:
    """Least and largest squared distance of a channel from the values of a cell."""
    low, high = cell * SIDE, cell * SIDE + SIDE - 1
    near = F.greatest(low - colour, colour - high, F.lit(0))
    far = F.greatest(F.abs(colour - low), F.abs(colour - high))
    return near * near, far * far


def cell_of(r: Column, g: Column, b: Column) -> Column:
    part = lambda c: F.shiftright(c.cast("int"), 5)  # noqa: E731 - SIDE is 2 ** 5
    return part(r) * (CELLS * CELLS) + part(g) * CELLS + part(b)


def cell_index(palette: DataFrame) -> DataFrame:
    """(theme, cell, colours): per cell the colours that can be nearest in it, by idx.

    One pass per axis: the bounds of a colour over the axes not yet cut are those of the
    whole axis, so a colour leaves as soon as it is farther at best than another is at worst.
    Rows of a palette that repeat a colour would lose every tie to its lowest idx, so each
    colour comes in once: the lists grow with different colours only, not with rows."""
    once = palette.groupBy("theme", "r", "g", "b").agg(F.min("idx").alias("idx"))
    rows = once.select("theme", "idx", "r", "g", "b").withColumns({"cell": F.lit(0), "near": F.lit(0), "far": F.lit(0)})
    for axis, rest in (("r", "gb"), ("g", "b"), ("b", "")):
        cut = rows.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))))
        near, far = _bounds(F.col(axis), F.col("step"))
        cut = cut.select("theme", "idx", "r", "g", "b", (F.col("cell") * CELLS + F.col("step")).alias("cell"), (F.col("near") + near).alias("near"), (F.col("far") + far).alias("far"))
        # what the axes not yet cut add at worst
        open_far = sum((F.greatest(F.col(c), 255 - F.col(c)) * F.greatest(F.col(c), 255 - F.col(c)) for c in rest), F.lit(0))
        least = cut.groupBy("theme", "cell").agg(F.min(F.col("far") + open_far).alias("least"))
        rows = cut.join(least, ["theme", "cell"]).filter("near <= least").drop("least")
    one = F.struct("idx", "r", "g", "b")
    return rows.groupBy("theme", "cell").agg(F.array_sort(F.collect_list(one)).alias("colours"))


def nearest(px: DataFrame, palette: DataFrame, theme: str | Column = "theme") -> DataFrame:
    """The pixels in the nearest colour of their theme (a column of ``px``, or one theme for
    all), with its idx. Pixels of an unknown theme, or of none, keep their colour with a null idx."""
    theme = F.col(theme) if isinstance(theme, str) else theme
    index = cell_index(palette).select(F.col("theme").alias("__theme"), F.col("cell").alias("__cell"), F.col("colours").alias("__colours"))
    placed = px.withColumns({"__of": theme, "__at": cell_of(F.col("r"), F.col("g"), F.col("b"))})
    met = placed.join(index, (F.col("__of") == F.col("__theme")) & (F.col("__at") == F.col("__cell")), "left")
    r, g, b = (F.col(c) for c in "rgb")

    def priced(c: Column) -> Column:
        d = (c.r - r) * (c.r - r) + (c.g - g) * (c.g - g) + (c.b - b) * (c.b - b)
        return F.struct(d.alias("d"), c.idx.alias("idx"), c.r.alias("r"), c.g.alias("g"), c.b.alias("b"))

    best = met.withColumn("__best", F.array_min(F.transform("__colours", priced)))
    new = {c: F.coalesce(F.col(f"__best.{c}"), F.col(c)).cast("int") for c in "rgb"}
    return best.withColumns(new | {"idx": F.col("__best.idx")}).drop("__of", "__at", "__theme", "__cell", "__colours", "__best")
