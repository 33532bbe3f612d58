"""Compositing of layers: source-over in layer order, and stacks of images in all layouts.

A place's pixels lie over each other in the order of their layer. Pixels multiplied by alpha
form a monoid under source-over, so the aggregate per (sheet, x, y) may fold layers that
lie next to each other first: blocks of BLOCK layers, then blocks of blocks. A group never holds
more than BLOCK rows, however many layers a place has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .pixels import CH, sizes, spread

SHOWN = (*CH, "a")
BLOCK = 64
LAYOUTS = ("horizontal", "vertical", "grid")


def over(top: Column, under: Column) -> Column:
    """Struct r, g, b, a (multiplied by alpha, 16 bits) of one pixel over another of this kind."""
    rest = F.lit(65535) - top.a
    return F.struct(*[(top[c] + F.floor(under[c] * rest / F.lit(65535))).alias(c) for c in SHOWN])


def multiplied(straight: bool) -> Column:
    """The pixel's columns as a struct of 16 bits, multiplied by alpha if they are straight."""
    a = F.col("a").cast("long") * 257
    wide = lambda c: F.col(c).cast("long") * 257
    channel = lambda c: F.floor(wide(c) * a / F.lit(65535)) if straight else F.when(a > 0, wide(c)).otherwise(0)
    return F.struct(*[channel(c).alias(c) for c in CH], a.alias("a"))


def compose(layers: DataFrame, by: tuple[str, ...] = ("sheet", "x", "y"), n_layers: int = BLOCK, straight: bool = False) -> DataFrame:
    """One pixel per place of ``layers`` (by, layer, r, g, b, a): its pixels over each other in the
    order of ``layer`` (0 to n_layers - 1, different within a place), multiplied by alpha. A
    pixel without alpha adds nothing, and a place with no others is empty.

    Arithmetic is that of image libraries, whole numbers of 16 bits; with more than BLOCK
    layers a result may differ by 1 from the fold in one go, by rounding of the blocks."""
    layer = F.when(F.col("layer").between(0, n_layers - 1), F.col("layer")).otherwise(F.raise_error(F.lit(f"layers are numbered from 0 to {n_layers - 1}"))).cast("long")
    rows = layers.select(*by, layer.alias("layer"), multiplied(straight).alias("p"))
    empty = F.struct(*[F.lit(0).cast("long").alias(c) for c in SHOWN])
    while True:
        whole = n_layers <= BLOCK
        keys = [*by] if whole else [*by, F.expr(f"layer div {BLOCK}").alias("block")]
        rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("layer", "p"))).alias("s"))
        folded = F.aggregate("s", empty, lambda under, s: over(s.p, under)).alias("p")
        if whole:
            return rows.select(*by, folded).select(*by, *[F.shiftright(F.col(f"p.{c}"), 8).cast("int").alias(c) for c in SHOWN])
        rows, n_layers = rows.select(*by, F.col("block").alias("layer"), folded), -(-n_layers // BLOCK)


def layout(dims: DataFrame, mode: str, rows: int = 0, cols: int = 0) -> DataFrame:
    """dims (sheet, img_id, w, h) with each image's row, col and the sheet's n_rows, n_cols.
    Images are numbered by img_id; a grid with too few cells is an error."""
    if mode not in LAYOUTS:
        raise ValueError(f"unknown layout {mode}")
    if mode == "grid" and (rows < 1 or cols < 1):
        raise ValueError("a grid needs positive rows and columns")
    pos = F.row_number().over(Window.partitionBy("sheet").orderBy("img_id")) - 1
    n = F.count("*").over(Window.partitionBy("sheet"))
    numbered = dims.withColumns({"__pos": pos, "__n": n.cast("int")})
    if mode == "horizontal":
        placed = numbered.withColumns({"row": F.lit(0), "col": F.col("__pos"), "n_rows": F.lit(1), "n_cols": F.col("__n")})
    elif mode == "vertical":
        placed = numbered.withColumns({"row": F.col("__pos"), "col": F.lit(0), "n_rows": F.col("__n"), "n_cols": F.lit(1)})
    else:
        fits = F.when(F.col("__n") > rows * cols, F.raise_error(F.lit("more images than cells"))).otherwise(F.lit(rows))
        placed = numbered.withColumns({"row": F.expr(f"cast(__pos div {cols} as int)"), "col": F.col("__pos") % cols, "n_rows": fits.cast("int"), "n_cols": F.lit(cols)})
    return placed.drop("__pos", "__n")


def stack(px: DataFrame, sheets: DataFrame, mode: str = "grid", rows: int = 0, cols: int = 0, gap: int = 0, colour: tuple[int, int, int] = (0, 0, 0), biggest: bool = False) -> DataFrame:
    """Sheets of images in cells with coloured gutters: (sheet, x, y, r, g, b, a).

    ``sheets`` (sheet, img_id) says which images lie on which sheet. Cells have the largest
    width and height of the sheet's images, which are centred in them; with ``biggest`` the
    smallest, and the images are scaled to fit into these. Images lie over the gutters'
    ground; empty cells stay transparent. Pixels are multiplied by alpha, as images that draw are."""
    if biggest:
        from .rasters import resize_padded_to

    dims = layout(sheets.join(sizes(px), "img_id"), mode, rows, cols)
    size = F.min if biggest else F.max
    cell = dims.groupBy("sheet", "n_rows", "n_cols").agg(size("w").alias("cw"), size("h").alias("ch"))
    if biggest:
        px = resize_padded_to(px, dims.join(cell.select("sheet", "cw", "ch"), "sheet").select("img_id", "cw", "ch"))
        dims = dims.join(cell.select("sheet", "cw", "ch"), "sheet").withColumns({"w": F.col("cw"), "h": F.col("ch")}).drop("cw", "ch")
    placed = px.join(dims.join(cell.select("sheet", "cw", "ch"), "sheet"), "img_id")
    ox = F.col("col") * (F.col("cw") + gap) + gap + F.expr("(cw - w) div 2")
    oy = F.col("row") * (F.col("ch") + gap) + gap + F.expr("(ch - h) div 2")
    images = placed.select("sheet", (F.col("x") + ox).cast("int").alias("x"), (F.col("y") + oy).cast("int").alias("y"), F.lit(1).alias("layer"), *SHOWN)
    # sheets are few: their lines go to tasks on all cores before they become pixels
    lines = spread(cell, "sheet").withColumn("y", F.explode(F.sequence(F.lit(0), (F.col("n_rows") * (F.col("ch") + gap) + gap - 1).cast("int"))))
    canvas = lines.withColumn("x", F.explode(F.sequence(F.lit(0), (F.col("n_cols") * (F.col("cw") + gap) + gap - 1).cast("int"))))
    gutter = (F.col("x") % (F.col("cw") + gap) < gap) | (F.col("y") % (F.col("ch") + gap) < gap)
    ground = canvas.select("sheet", "x", "y", F.lit(0).alias("layer"), *[F.when(gutter, v).otherwise(0).alias(c) for c, v in zip(SHOWN, (*colour, 255))])
    return compose(ground.unionByName(images), n_layers=2)


def cover_crop(dims: DataFrame, width: int, height: int) -> DataFrame:
    """(img_id, nw, nh, ox, oy): size of an image scaled to cover width x height, and where the
    part shown begins, centred."""
    ratio = F.greatest(F.lit(float(width)) / F.col("w"), F.lit(float(height)) / F.col("h"))
    sized = dims.select("img_id", *[F.greatest(F.rint(F.col(c) * ratio).cast("int"), F.lit(side)).alias(n) for c, n, side in (("w", "nw", width), ("h", "nh", height))])
    return sized.withColumns({"ox": F.expr(f"cast((nw - {width}) div 2 as int)"), "oy": F.expr(f"cast((nh - {height}) div 2 as int)")})
