"""Queries over pixels derived from the events table, with their SQL forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pixels as P, rasters as R
from ..sources.derive import NORD, PALETTE_SQL, PX_SQL, SIZED_SQL, part_palette, patches, px, read

BASE = "WITH " + PX_SQL + "\n"
SIZED = "WITH " + SIZED_SQL + "\n"
KEY = ["img_id", "x", "y"]
OUT = [*KEY, "r", "g", "b", "a"]
SRC, TO = (100, 120, 140), (10, 200, 30, 255)


def _palette_sql() -> str:
    rows = ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(NORD))
    return f"pal(idx, pr, pg, pb) AS (VALUES {rows})"


def _near_sql() -> str:
    return f"""{BASE.rstrip()}, {_palette_sql()},
d AS (SELECT img_id, x, y, idx, pr, pg, pb, row_number() OVER (PARTITION BY img_id, x, y ORDER BY (r-pr)*(r-pr)+(g-pg)*(g-pg)+(b-pb)*(b-pb), idx) AS k FROM px CROSS JOIN pal),
n AS (SELECT img_id, x, y, cast(idx AS INT) AS idx, pr AS r, pg AS g, pb AS b FROM d WHERE k = 1)
"""


def _rbf_cell_sql() -> list[str]:
    """The interpolated channels of a cell (cr, cg, cb)."""
    w = [f"exp(-((cr-{r})*(cr-{r})+(cg-{g})*(cg-{g})+(cb-{b})*(cb-{b}))/5000.0::DOUBLE)" for r, g, b in NORD]
    total = " + ".join(w)
    ch = [f"cast(floor(({' + '.join(f'{x} * {float(c[k])}::DOUBLE' for x, c in zip(w, NORD))}) / ({total})) AS INT)" for k in range(3)]
    return ch


def _rbf_sql() -> str:
    ch = _rbf_cell_sql()
    return f"""{BASE.rstrip()},
i AS (SELECT *, cast(r*63//255 AS INT) AS r6, cast(g*63//255 AS INT) AS g6, cast(b*63//255 AS INT) AS b6 FROM px),
c AS (SELECT DISTINCT r6, g6, b6, r6*255//63 AS cr, g6*255//63 AS cg, b6*255//63 AS cb FROM i),
l AS (SELECT r6, g6, b6, {ch[0]} AS nr, {ch[1]} AS ng, {ch[2]} AS nb FROM c)
SELECT img_id, x, y, nr AS r, ng AS g, nb AS b, CASE WHEN a = 0 THEN 0 ELSE 255 END AS a FROM i JOIN l USING (r6, g6, b6)"""


def _mask(p):
    return p.select(*KEY, ((F.col("x") * 7 + F.col("y") * 13) % 256).alias("m"))


def _replace(p):
    return P.replace_colour(p, SRC, TO, 60.0).select(*OUT)


def _sheets(p):
    dims = P.sizes(p).withColumn("pos", F.col("img_id"))
    return P.stack_sheets(p, dims, 2, 2, 3, (9, 8, 7))


def _pad(s, d):
    dims = read(s, d, "orders").select(F.col("o_orderkey").alias("img_id"), (1 + F.col("o_orderkey") % 97).cast("int").alias("w"), (1 + F.col("o_custkey") % 89).cast("int").alias("h"))
    return P.pad_dims(dims, 60, 40)


def _centroid(p):
    return P.nearest_centroid(p, (60, 60, 60), (200, 200, 200)).select(*KEY, "cluster", "a")


def _centroid_per_image(p):
    return P.kmeans_background(p, (60, 60, 60), (200, 200, 200), 0).select(*KEY, "cluster", "a")


def on(f):
    return lambda s, d: f(px(s, d))


def _hist_cubes(p):
    return P.cube_stats(P.histogram(p))


def _counts(p):
    return P.nearest(p, NORD).groupBy("idx").agg(F.count("*").alias("n"))


QUERIES = {
    "px_nearest_counts": on(_counts),
    "px_grayscale": on(P.grayscale),
    "px_brightness": on(lambda p: P.brightness(p, 1.1)),
    "px_gamma": on(lambda p: P.gamma(p, 2.0).select(*OUT)),
    "px_contrast": on(lambda p: P.contrast(p, 20.0).select(*OUT)),
    "px_sigmoid": on(lambda p: P.sigmoid_contrast(p, 0.5, 3.0).select(*OUT)),
    "px_saturation": on(lambda p: P.saturation(p, 25.0).select(*OUT)),
    "px_invert": on(P.invert),
    "px_replace": on(_replace),
    "px_nearest": on(lambda p: P.nearest(p, NORD).select(*KEY, "idx", "r", "g", "b")),
    "px_flip": on(lambda p: P.flip(p)),
    "px_mirror": on(lambda p: P.mirror(p)),
    "px_pixelate": on(lambda p: P.pixelate(p, percent=15)),
    "px_border": on(lambda p: P.border(p, colour=(1, 2, 3), thickness=5)),
    "px_grid": on(lambda p: P.grid(p, size=8)),
    "px_grid_mask": on(lambda p: P.grid(p, size=8, mask_only=True)),
    "px_round": on(lambda p: P.round_corners(p, radius=20)),
    "px_mask_apply": on(lambda p: P.apply_mask(p, _mask(p)).select(*OUT)),
    "px_flatten": on(lambda p: P.flatten(p, (255, 255, 255))),
    "bbox_trim": on(P.bounding_box),
    "px_trim": on(P.trim),
    "hist15": on(P.histogram),
    "cube_stats": on(_hist_cubes),
    "max_value": on(P.max_value),
    "minmax_norm": lambda s, d: P.min_max(patches(s, d)).withColumn("v", F.round("v", 6)),
    "nearest_centroid": on(_centroid),
    "nearest_centroid_per_image": on(_centroid_per_image),
    "clut_identities": lambda s, d: P.identity_cubes(read(s, d, "part").select(F.col("p_partkey").alias("cube_id"), (F.col("p_partkey") % 2 + 2).cast("int").alias("level"))),
    "clut_index": on(lambda p: P.cube_index(p).select(*KEY, "r6", "g6", "b6")),
    "clut_apply": on(lambda p: P.recolour(p, NORD)),
    "stack_sheets": on(_sheets),
    "pad_dims": _pad,
    "palette_swatches": lambda s, d: P.palette_swatches(part_palette(s, d), 3, 2),
    # sequential within an image: no SQL form
    "median_cut": on(lambda p: R.extract_palette(P.histogram(p))),
    "kmeans_background": on(lambda p: P.kmeans_background(p, (60, 60, 60), (200, 200, 200)).select(*KEY, "cluster", "a")),
    "gif_dither": on(R.dither),
    "tilt": on(lambda p: R.tilt(p, 5.0, 5.0)),
    "resize_lanczos": on(lambda p: R.resize(p, 25, 0)),
    "png_round_trip": on(lambda p: R.decode_png(R.encode_png(p))),
}


def _paint_sql(where: str, c: tuple, base: str = BASE, pixels: str = "px") -> str:
    parts = ", ".join(f"CASE WHEN {where} THEN {v} ELSE {n} END AS {n}" for n, v in zip("rgba", (*c, 255)))
    return f"{base}SELECT img_id, x, y, {parts} FROM {pixels}"


def _lut_sql(expr: str) -> str:
    """expr in terms of i (0-255)."""
    parts = ", ".join(f"(SELECT v FROM lut WHERE i = px.{c}) AS {c}" for c in "rgb")
    return f"{BASE.rstrip()}, lut AS (SELECT i, cast({expr} AS INT) AS v FROM generate_series(0, 255) t(i))\nSELECT img_id, x, y, {parts}, a FROM px"


def _round_sql() -> str:
    rho = 20.0
    cond = f"((x < {rho} OR x > w - {rho}) AND (y < {rho} OR y > h - {rho}))"
    offs = (-0.375, -0.125, 0.125, 0.375)
    n = " + ".join(f"CASE WHEN (dx+({ox}::DOUBLE))*(dx+({ox}::DOUBLE))+(dy+({oy}::DOUBLE))*(dy+({oy}::DOUBLE)) <= {rho * rho} THEN 1 ELSE 0 END" for ox in offs for oy in offs)
    return f"""{SIZED.rstrip()},
c AS (SELECT *, {cond} AS corner, (CASE WHEN x < {rho} THEN x - {rho} ELSE x - (w - {rho}) END)::DOUBLE AS dx, (CASE WHEN y < {rho} THEN y - {rho} ELSE y - (h - {rho}) END)::DOUBLE AS dy FROM spx),
s AS (SELECT *, dx*dx+dy*dy AS d2, {n} AS n FROM c),
k AS (SELECT *, corner AND (d2 > {rho * rho} OR (d2 > {(rho - 4) ** 2} AND n = 0)) AS gone, corner AND d2 > {(rho - 4) ** 2} AND n < 8 AS partly FROM s)
SELECT img_id, x, y, CASE WHEN gone THEN 0 ELSE r END AS r, CASE WHEN gone THEN 0 ELSE g END AS g, CASE WHEN gone THEN 0 ELSE b END AS b,
  CASE WHEN gone THEN 0 WHEN partly THEN cast(floor(a * n / 8.0::DOUBLE) AS INT) ELSE a END AS a FROM k"""


SQL = {
    "px_nearest_counts": _near_sql() + "SELECT idx, count(*) AS n FROM n GROUP BY idx",
    "px_grayscale": BASE + "SELECT img_id, x, y, cast(floor(0.299::DOUBLE*r+0.587::DOUBLE*g+0.114::DOUBLE*b) AS INT) AS v FROM px",
    "px_brightness": BASE + "SELECT img_id, x, y, " + ", ".join(f"cast(least(floor({c}*1.1::DOUBLE), 255) AS INT) AS {c}" for c in "rgb") + ", a FROM px",
    "px_gamma": _lut_sql("floor(255::DOUBLE * sqrt(i / 255::DOUBLE) + 0.5::DOUBLE)"),
    "px_contrast": _lut_sql("greatest(0, least(255, floor(255::DOUBLE * ((i / 255::DOUBLE - 0.5::DOUBLE) * (1 / (2 - 1.2::DOUBLE)) + 0.5::DOUBLE) + 0.5::DOUBLE)))"),
    "px_sigmoid": _lut_sql("floor(255::DOUBLE * ((1/(1+exp(3*(0.5::DOUBLE - i/255::DOUBLE)))) - 1/(1+exp(1.5::DOUBLE))) / (1/(1+exp(-1.5::DOUBLE)) - 1/(1+exp(1.5::DOUBLE))) + 0.5::DOUBLE)"),
    "px_invert": BASE + "SELECT img_id, x, y, 255-r AS r, 255-g AS g, 255-b AS b, a FROM px",
    "px_replace": f"""{BASE.rstrip()}, d AS (SELECT *, sqrt(((r-{SRC[0]})*(r-{SRC[0]})+(g-{SRC[1]})*(g-{SRC[1]})+(b-{SRC[2]})*(b-{SRC[2]}))::DOUBLE) AS d FROM px),
w AS (SELECT *, CASE WHEN d > {60.0 * 3 ** 0.5!r}::DOUBLE THEN 0.0::DOUBLE ELSE 1 - d / {60.0 * 3 ** 0.5!r}::DOUBLE END AS w FROM d)
SELECT img_id, x, y, """ + ", ".join(f"CASE WHEN w > 0 THEN cast(round((1-w)*{c}+w*{v}) AS INT) ELSE {c} END AS {c}" for c, v in zip("rgba", TO)) + " FROM w",
    "px_nearest": _near_sql() + "SELECT img_id, x, y, idx, r, g, b FROM n",
    "px_flip": SIZED + "SELECT img_id, cast(w-1-x AS INT) AS x, y, r, g, b, a FROM spx",
    "px_mirror": SIZED + "SELECT img_id, x, y, r, g, b, a FROM spx WHERE x < w//2 UNION ALL SELECT img_id, cast(w//2*2-1-x AS INT) AS x, y, r, g, b, a FROM spx WHERE x < w//2",
    "px_pixelate": f"""{SIZED.rstrip()}, m AS (SELECT *, greatest(1, round_even(w*0.15::DOUBLE, 0)) AS mw, greatest(1, round_even(h*0.15::DOUBLE, 0)) AS mh FROM spx),
t AS (SELECT img_id, x, y, cast(floor(floor(x*mw/w)/0.15::DOUBLE) AS INT) AS sx, cast(floor(floor(y*mh/h)/0.15::DOUBLE) AS INT) AS sy FROM m)
SELECT t.img_id, t.x, t.y, p.r, p.g, p.b, p.a FROM t JOIN px p ON p.img_id = t.img_id AND p.x = t.sx AND p.y = t.sy""",
    "px_border": _paint_sql("x < 5 OR y < 5 OR x >= w - 5 OR y >= h - 5", (1, 2, 3), SIZED, "spx"),
    "px_grid": _paint_sql("x % 8 < 1 OR y % 8 < 1", (93, 63, 211)),
    "px_grid_mask": BASE + "SELECT img_id, x, y, " + ", ".join(f"CASE WHEN a < 128 THEN CASE WHEN x % 8 < 1 OR y % 8 < 1 THEN {v} ELSE 0 END ELSE {c} END AS {c}" for c, v in zip("rgba", (93, 63, 211, 255))) + " FROM px",
    "px_round": _round_sql(),
    "px_mask_apply": BASE + "SELECT img_id, x, y, " + ", ".join(f"CASE WHEN (x*7+y*13)%256 = 0 THEN 0 ELSE {c} END AS {c}" for c in "rgb") + ", (x*7+y*13)%256 AS a FROM px",
    "px_flatten": BASE + "SELECT img_id, x, y, " + ", ".join(f"cast(({c}*a)//255 + (255*(255-a))//255 AS INT) AS {c}" for c in "rgb") + ", 255 AS a FROM px",
    "bbox_trim": BASE + "SELECT img_id, coalesce(min(x) FILTER (a>0), 0) AS x0, coalesce(min(y) FILTER (a>0), 0) AS y0, coalesce(max(x) FILTER (a>0) - min(x) FILTER (a>0) + 1, 1) AS w, coalesce(max(y) FILTER (a>0) - min(y) FILTER (a>0) + 1, 1) AS h FROM px GROUP BY img_id",
    "px_trim": BASE.rstrip() + ", q AS (SELECT img_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM px WHERE a > 0 GROUP BY img_id) SELECT img_id, x-x0 AS x, y-y0 AS y, r, g, b, a FROM px JOIN q USING (img_id) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1",
    "hist15": BASE + "SELECT img_id, (b >> 3) * 1024 + (g >> 3) * 32 + (r >> 3) AS bin, count(*) AS n FROM px WHERE a >= 125 GROUP BY ALL",
    "cube_stats": BASE + """SELECT img_id, min(r//8*8) AS r_min, max(r//8*8) AS r_max, min(g//8*8) AS g_min, max(g//8*8) AS g_max, min(b//8*8) AS b_min, max(b//8*8) AS b_max,
CASE WHEN max(r//8*8)-min(r//8*8) >= max(g//8*8)-min(g//8*8) AND max(r//8*8)-min(r//8*8) >= max(b//8*8)-min(b//8*8) THEN 'r' WHEN max(g//8*8)-min(g//8*8) >= max(b//8*8)-min(b//8*8) THEN 'g' ELSE 'b' END AS longest,
count(*) AS n, cast(sum(r//8*8)//count(*) AS BIGINT) AS r_avg, cast(sum(g//8*8)//count(*) AS BIGINT) AS g_avg, cast(sum(b//8*8)//count(*) AS BIGINT) AS b_avg,
cast((max(r//8*8)-min(r//8*8))::BIGINT * (max(g//8*8)-min(g//8*8)) * (max(b//8*8)-min(b//8*8)) * count(*) AS BIGINT) AS rank FROM px WHERE a >= 125 GROUP BY img_id""",
    "max_value": BASE + "SELECT img_id, greatest(max(greatest(r,g,b))/255.0::DOUBLE, 1e-6) AS max_value FROM px GROUP BY img_id",
    "minmax_norm": """WITH p AS (SELECT vec_id AS img_id, cast((i-1)%8 AS INT) AS x, cast((i-1)//8 AS INT) AS y, embedding[i]::DOUBLE AS v FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)),
s AS (SELECT img_id, min(v) AS lo, max(v) AS hi FROM p GROUP BY img_id) SELECT img_id, x, y, round((v-lo)/greatest(hi-lo, 1e-6), 6) AS v FROM p JOIN s USING (img_id)""",
    "nearest_centroid": BASE.rstrip() + """, c AS (SELECT img_id, x, y, CASE WHEN (r-200)*(r-200)+(g-200)*(g-200)+(b-200)*(b-200) < (r-60)*(r-60)+(g-60)*(g-60)+(b-60)*(b-60) THEN 1 ELSE 0 END AS cluster FROM px),
k AS (SELECT count(*) FILTER (cluster = 1) > count(*) FILTER (cluster = 0) AS one FROM c)
SELECT img_id, x, y, cluster, CASE WHEN (cluster = 1) = one THEN 0 ELSE 255 END AS a FROM c, k""",
    "nearest_centroid_per_image": BASE.rstrip() + """, c AS (SELECT img_id, x, y, CASE WHEN (r-200)*(r-200)+(g-200)*(g-200)+(b-200)*(b-200) < (r-60)*(r-60)+(g-60)*(g-60)+(b-60)*(b-60) THEN 1 ELSE 0 END AS cluster FROM px),
k AS (SELECT img_id, count(*) FILTER (cluster = 1) > count(*) FILTER (cluster = 0) AS one FROM c GROUP BY img_id)
SELECT img_id, x, y, cluster, CASE WHEN (cluster = 1) = one THEN 0 ELSE 255 END AS a FROM c JOIN k USING (img_id)""",
    "clut_identities": """WITH s AS (SELECT p_partkey AS cube_id, p_partkey % 2 + 2 AS level FROM part), c AS (SELECT *, level * level AS n, unnest(range(0, level * level * level * level * level * level)) AS i FROM s)
SELECT cube_id, i, cast(i % (n * level) AS INT) AS x, cast(i // (n * level) AS INT) AS y, cast((i % n) * 255 // (n - 1) AS INT) AS r, cast(((i // n) % n) * 255 // (n - 1) AS INT) AS g, cast((i // (n * n)) * 255 // (n - 1) AS INT) AS b FROM c""",
    "clut_index": BASE + "SELECT img_id, x, y, cast(r*63//255 AS INT) AS r6, cast(g*63//255 AS INT) AS g6, cast(b*63//255 AS INT) AS b6 FROM px",
    "clut_apply": _rbf_sql(),
    "stack_sheets": BASE.rstrip() + """, d AS (SELECT img_id, img_id // 4 AS sheet, img_id % 4 AS pos, max(x)+1 AS w, max(y)+1 AS h FROM px GROUP BY img_id), m AS (SELECT sheet, max(w) AS cw, max(h) AS ch FROM d GROUP BY sheet),
i AS (SELECT sheet, cast(x + (pos%2)*(cw+3)+3+(cw-w)//2 AS INT) AS x, cast(y + (pos//2)*(ch+3)+3+(ch-h)//2 AS INT) AS y, r, g, b, a FROM px JOIN d USING (img_id) JOIN m USING (sheet)),
k AS (SELECT sheet, cw, ch, unnest(range(0, (2*cw+9)*(2*ch+9))) AS k FROM m),
c AS (SELECT sheet, cast(k % (2*cw+9) AS INT) AS x, cast(k // (2*cw+9) AS INT) AS y, cw, ch FROM k)
SELECT c.sheet, c.x, c.y, coalesce(i.r, CASE WHEN c.x%(cw+3)<3 OR c.y%(ch+3)<3 THEN 9 ELSE 0 END) AS r, coalesce(i.g, CASE WHEN c.x%(cw+3)<3 OR c.y%(ch+3)<3 THEN 8 ELSE 0 END) AS g,
 coalesce(i.b, CASE WHEN c.x%(cw+3)<3 OR c.y%(ch+3)<3 THEN 7 ELSE 0 END) AS b, coalesce(i.a, CASE WHEN c.x%(cw+3)<3 OR c.y%(ch+3)<3 THEN 255 ELSE 0 END) AS a FROM c LEFT JOIN i ON c.sheet = i.sheet AND c.x = i.x AND c.y = i.y""",
    "pad_dims": """WITH d AS (SELECT o_orderkey AS img_id, 1+o_orderkey%97 AS w, 1+o_custkey%89 AS h FROM orders),
s AS (SELECT img_id, cast(floor(w*least(60.0::DOUBLE/w, 40.0::DOUBLE/h)) AS INT) AS nw, cast(floor(h*least(60.0::DOUBLE/w, 40.0::DOUBLE/h)) AS INT) AS nh FROM d)
SELECT img_id, nw, nh, cast((60-nw)//2 AS INT) AS ox, cast((40-nh)//2 AS INT) AS oy FROM s""",
    "palette_swatches": f"""WITH {PALETTE_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY idx) - 1 AS place FROM pal), w AS (SELECT *, unnest(range(0, 3)) AS k FROM n), t AS (SELECT *, unnest(range(0, 2)) AS y FROM w)
SELECT theme, cast(place * 3 + k AS INT) AS x, cast(y AS INT) AS y, r, g, b FROM t""",
}
