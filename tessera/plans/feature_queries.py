"""Queries of the sources, sinks, streams, table functions and operators that keep state or an index, with their SQL forms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import sql as functions_sql, tables
from ..operators import blocks as B, clusters as K, layers as L, palettes, sessions
from ..sources import pictures, publish as sinks
from ..sources.derive import COLOURS_SQL, NORD, PALETTE_SQL, PART_THEMES, PX_SQL, pages_text, part_palette, px
from ..sources.scratch import new_folder
from ..streaming import pages as stream
from .work_queries import SQL as WORK_SQL, _documents

SEED = 7
QUALITY = 60
KERNEL = np.array([[[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], [[0, 1, 0], [1, -4, 1], [0, 1, 0]], [[1, 2, 1], [0, 0, 0], [-1, -2, -1]]], float)
BASE = "WITH " + PX_SQL


def on(f):
    return lambda s, d: f(px(s, d))


# ---- sources, sinks and streams ----

def _pictures(s, d):
    folder = new_folder(s, "pictures")
    pictures.write_pictures(px(s, d), folder)
    return pictures.read_pictures(s, folder).drop("path")


def _publish(s, d):
    """Counters and visible rows of two runs: one with failed pages, one without."""
    pages, rows = pages_text(s, d), []
    bad = F.when(F.col("original_index") % 7 == 0, F.lit("bad"))
    for run, error in (("broken", bad), ("sound", F.lit(None).cast("string"))):
        folder = new_folder(s, "published")
        counters = sinks.publish(pages.withColumn("error", error), folder)
        seen = sinks.published(s, folder, pages.schema).count()
        rows.append((run, counters["completed"], counters["failed"], seen))
    return s.createDataFrame(rows, "run string, completed long, failed long, visible long")


def _stream(s, d):
    """The pages as a stream of files in several batches, stitched as documents fill up."""
    folder = new_folder(s, "stream")
    pages = pages_text(s, d)
    counted = pages.join(pages.groupBy("original_index").agg(F.count("*").alias("n_pages")), "original_index")
    part = F.pmod(F.hash("original_index", "page_index"), F.lit(6))
    counted.select("original_index", "page_index", "n_pages", "text").repartitionById(6, part).write.parquet(f"{folder}/in")
    stream.run_stitching(s, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", files_per_trigger=3, partitions=4).awaitTermination()
    return s.read.schema(stream.DOCUMENTS).parquet(f"{folder}/out").select("original_index", "text", "n_pages")


def _expand(s, d):
    _documents(s, d).createOrReplaceTempView("tessera_documents")
    tables.register(s)
    return s.sql("SELECT d.original_index, p.* FROM tessera_documents d, LATERAL expand_pages(d.filename, d.pages, d.native) p")


def _number(s, d):
    pages_text(s, d).createOrReplaceTempView("tessera_pages")
    tables.register(s)
    return s.sql("SELECT * FROM number_pages(TABLE(tessera_pages))")


def _sql_colours(s, d):
    return functions_sql.run(s, d, "SELECT colour_id, colour_hex(c.r, c.g, c.b) AS hex, colour_grey(c.r, c.g, c.b) AS grey, t.idx, t.hex AS theme_hex FROM tessera_colours c JOIN theme_colours('nord') t ON t.idx = c.colour_id % 16")


def _sql_stitched(s, d):
    return functions_sql.run(s, d, "SELECT * FROM stitched()")


# ---- pictures ----

def _nearest(s, d):
    themed = px(s, d).withColumn("theme", F.concat(F.lit("t"), F.col("img_id") % (PART_THEMES + 1)))
    return palettes.nearest(themed, part_palette(s, d)).select("img_id", "x", "y", "r", "g", "b", "idx")


def _stacks(p):
    sheets = p.select("img_id").distinct().withColumn("sheet", F.expr("img_id div 4"))
    forms = (("horizontal", {}), ("vertical", {}), ("grid", {"rows": 2, "cols": 3}), ("biggest", {"rows": 2, "cols": 3, "biggest": True}))
    made = [L.stack(p, sheets, "grid" if name == "biggest" else name, gap=3, colour=(9, 8, 7), **o).withColumn("form", F.lit(name)) for name, o in forms]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


def _compose(p):
    layers = p.select(F.expr("img_id div 8").alias("sheet"), "x", "y", (F.col("img_id") % 8).alias("layer"), "r", "g", "b", ((F.col("r") * 3 + F.col("g") + F.col("x")) % 256).alias("a"))
    return L.compose(layers, n_layers=8, straight=True)


def _draw(p):
    return K.draw_centres(K.sample(p, SEED), SEED)


def _assign(p):
    return K.remove_background(p, SEED, rounds=0).select("img_id", "x", "y", "cluster", "a")


def _segment(s, d):
    """Masks by a small convolution, which is read from a file that all workers see."""
    folder = new_folder(s, "model")
    from pyarrow import fs

    where, plain = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
    where.create_dir(plain, recursive=True)
    with where.open_output_stream(f"{plain}/model.npz") as f:
        np.savez(f, kernel=KERNEL / 8, bias=np.array(0.1))
    return sessions.segment(px(s, d), sessions.convolution(f"{folder}/model.npz"), 24)


def _dct(p):
    grey = F.expr("r * 299 + g * 587 + b * 114") / F.lit(1000.0)
    return B.quantise(B.transform(p, grey), QUALITY)


def _dct_levels(p):
    return _dct(p).select("img_id", "block_x", "block_y", F.posexplode("levels").alias("k", "level")).filter("level != 0")


def _dct_error(p):
    return B.error(_dct(p), QUALITY).select("img_id", "blocks", "kept", F.round("mse", 6).alias("mse"))


QUERIES = {
    "picture_source": _pictures,
    "publish_all_or_nothing": _publish,
    "stitch_stream": _stream,
    "expand_pages_sql": _expand,
    "number_pages_sql": _number,
    "sql_colours": _sql_colours,
    "sql_stitched": _sql_stitched,
    "px_nearest_indexed": _nearest,
    "stack_layouts": on(_stacks),
    "compose_layers": on(_compose),
    "kmeans_draw": on(_draw),
    "kmeans_assign": on(_assign),
    "segment_masks": _segment,
    "dct_levels": on(_dct_levels),
    "dct_error": on(_dct_error),
}


def _uniform_sql(draw: int) -> str:
    h = f"(img_id * 1000003 + y * 8191 + x * 131 + {SEED * 7919 + draw * 104729}) % {K.PRIME}"
    for k in K.ROUND_KEYS:
        h = f"list_transform([{h}], lambda h: (h * h + x * 31 + y * 17 + {k}) % {K.PRIME})[1]"
    return f"({h} + 0.5::DOUBLE) / {float(K.PRIME)}::DOUBLE"


_DRAW_SQL = f"""{BASE}, wide AS (SELECT img_id, x::BIGINT AS x, y::BIGINT AS y, r, g, b, a FROM px),
s AS (SELECT *, {_uniform_sql(1)} AS u1, {_uniform_sql(2)} AS u2 FROM wide WHERE {_uniform_sql(0)} < 0.5),
f AS (SELECT img_id, count(*) AS n, arg_min(r, u1) AS r0, arg_min(g, u1) AS g0, arg_min(b, u1) AS b0 FROM s GROUP BY img_id),
d AS (SELECT s.*, r0, g0, b0, (r - r0) * (r - r0) + (g - g0) * (g - g0) + (b - b0) * (b - b0) AS d2 FROM s JOIN f USING (img_id)),
c AS (SELECT img_id, arg_min(r, -ln(u2) / d2) FILTER (d2 > 0) AS r1, arg_min(g, -ln(u2) / d2) FILTER (d2 > 0) AS g1, arg_min(b, -ln(u2) / d2) FILTER (d2 > 0) AS b1 FROM d GROUP BY img_id),
drawn AS (SELECT img_id, n, r0, g0, b0, coalesce(r1, r0) AS r1, coalesce(g1, g0) AS g1, coalesce(b1, b0) AS b1 FROM f JOIN c USING (img_id))
"""


def _dct_sql() -> str:
    steps = ", ".join(f"({k}, {q})" for k, q in enumerate(B.steps(QUALITY)))
    waves = ", ".join(f"({u}, {at}, {B.basis(u, at)!r}::DOUBLE)" for u in range(B.N) for at in range(B.N))
    return f"""{BASE}, waves(u, i, w) AS (VALUES {waves}), steps(k, q) AS (VALUES {steps}),
s AS (SELECT img_id, cast(x // 8 AS INT) AS block_x, cast(y // 8 AS INT) AS block_y, x % 8 AS i, y % 8 AS j, (r * 299 + g * 587 + b * 114) / 1000.0::DOUBLE - 128 AS v FROM px),
c AS (SELECT img_id, block_x, block_y, cast(v.u * 8 + u.u AS INT) AS k, sum(s.v * v.w * u.w) AS c FROM s JOIN waves u ON u.i = s.i JOIN waves v ON v.i = s.j GROUP BY ALL),
n AS (SELECT img_id, block_x, block_y, k, c, q, cast(floor(c / q + 0.5::DOUBLE + {B.TIE!r}::DOUBLE) AS INT) AS level FROM c JOIN steps USING (k))
"""


def _stack_sql() -> str:
    forms = (("horizontal", "1", "n", "0", "pos"), ("vertical", "n", "1", "pos", "0"), ("grid", "2", "3", "pos // 3", "pos % 3"), ("biggest", "2", "3", "pos // 3", "pos % 3"))
    parts = " UNION ALL ".join(f"SELECT '{name}' AS form, sheet, img_id, w, h, cw, ch, {rows} AS nr, {cols} AS nc, {row} AS ro, {col} AS co FROM numbered" for name, rows, cols, row, col in forms)
    return f"""{BASE}, dims AS (SELECT img_id, img_id // 4 AS sheet, max(x) + 1 AS w, max(y) + 1 AS h FROM px GROUP BY img_id),
numbered AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY img_id) - 1 AS pos, count(*) OVER (PARTITION BY sheet) AS n, max(w) OVER (PARTITION BY sheet) AS cw, max(h) OVER (PARTITION BY sheet) AS ch FROM dims),
forms AS ({parts}), canvas AS (SELECT DISTINCT form, sheet, cw, ch, nr, nc FROM forms),
lines AS (SELECT *, unnest(range(0, nr * (ch + 3) + 3)) AS y FROM canvas), ground AS (SELECT form, sheet, cw, ch, cast(unnest(range(0, nc * (cw + 3) + 3)) AS INT) AS x, cast(y AS INT) AS y FROM lines),
images AS (SELECT form, sheet, px.x + co * (cw + 3) + 3 + (cw - w) // 2 AS x, px.y + ro * (ch + 3) + 3 + (ch - h) // 2 AS y, r, g, b, a FROM px JOIN forms USING (img_id) WHERE a > 0),
k AS (SELECT g.*, x % (cw + 3) < 3 OR y % (ch + 3) < 3 AS gutter FROM ground g)
SELECT k.form, k.sheet, k.x, k.y, {", ".join(f"coalesce(i.{c}, CASE WHEN gutter THEN {v} ELSE 0 END) AS {c}" for c, v in zip("rgba", (9, 8, 7, 255)))}
FROM k LEFT JOIN images i ON i.form = k.form AND i.sheet = k.sheet AND i.x = k.x AND i.y = k.y"""


_STITCHED = "SELECT conv_id AS original_index, string_agg(text, chr(10) || chr(10) || ' --- ' || chr(10) || chr(10) ORDER BY turn) AS text, count(*) AS n_pages FROM conversations GROUP BY conv_id"
_OVER = ", ".join(f"{c} := t.{c} + (u.{c} * (65535 - t.a)) // 65535" for c in "rgba")

SQL = {
    "picture_source": f"{BASE} SELECT img_id, x, y, r, g, b, a FROM px",
    "publish_all_or_nothing": """SELECT 'broken' AS run, count(*) FILTER (conv_id % 7 <> 0) AS completed, count(*) FILTER (conv_id % 7 = 0) AS failed, CASE WHEN count(*) FILTER (conv_id % 7 = 0) = 0 THEN count(*) ELSE 0 END AS visible FROM conversations
UNION ALL SELECT 'sound', count(*), 0, count(*) FROM conversations""",
    "stitch_stream": _STITCHED,
    "expand_pages_sql": WORK_SQL["expand_pages"],
    "number_pages_sql": "SELECT conv_id AS original_index, turn AS page_index, text, 'doc' || conv_id || '-page-' || (turn + 1) || '-of-' || count(*) OVER (PARTITION BY conv_id) AS name FROM conversations",
    "sql_colours": f"""WITH {COLOURS_SQL}, nord(idx, theme_hex) AS (VALUES {", ".join(f"({i}, '#%02X%02X%02X')" % c for i, c in enumerate(NORD))})
SELECT colour_id, printf('#%02X%02X%02X', r, g, b) AS hex, cast(floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b) AS INT) AS grey, cast(idx AS INT) AS idx, theme_hex FROM colours JOIN nord ON idx = colour_id % 16""",
    "sql_stitched": _STITCHED,
    "px_nearest_indexed": f"""{BASE}, {PALETTE_SQL}, named AS (SELECT cast(substr(theme, 2) AS BIGINT) AS t, idx, r AS pr, g AS pg, b AS pb FROM pal),
seen AS (SELECT DISTINCT img_id % {PART_THEMES + 1} AS t, r, g, b FROM px),
best AS (SELECT t, r, g, b, arg_min((pr, pg, pb, idx), ((r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb))::BIGINT * 1000000 + idx) AS p FROM seen JOIN named USING (t) GROUP BY t, r, g, b)
SELECT img_id, x, y, coalesce(p[1], px.r) AS r, coalesce(p[2], px.g) AS g, coalesce(p[3], px.b) AS b, p[4] AS idx FROM px LEFT JOIN best ON best.t = img_id % {PART_THEMES + 1} AND best.r = px.r AND best.g = px.g AND best.b = px.b""",
    "stack_layouts": _stack_sql(),
    "compose_layers": f"""{BASE}, l AS (SELECT img_id // 8 AS sheet, x, y, img_id % 8 AS layer, r, g, b, cast((r * 3 + g + x) % 256 AS INT) AS a FROM px),
m AS (SELECT sheet, x, y, layer, {", ".join(f"({c} * 257 * a * 257) // 65535 AS {c}" for c in "rgb")}, a * 257 AS a FROM (SELECT sheet, x, y, layer, r::BIGINT AS r, g::BIGINT AS g, b::BIGINT AS b, a::BIGINT AS a FROM l)),
s AS (SELECT sheet, x, y, list_reduce(list_prepend({{'r': 0::BIGINT, 'g': 0::BIGINT, 'b': 0::BIGINT, 'a': 0::BIGINT}}, list({{'r': r, 'g': g, 'b': b, 'a': a}} ORDER BY layer)), lambda u, t: struct_pack({_OVER})) AS p FROM m GROUP BY sheet, x, y)
SELECT sheet, x, y, {", ".join(f"cast(p.{c} >> 8 AS INT) AS {c}" for c in "rgba")} FROM s""",
    "kmeans_draw": _DRAW_SQL + "SELECT * FROM drawn",
    "kmeans_assign": _DRAW_SQL.rstrip() + """, near AS (SELECT px.*, CASE WHEN (r-r1)*(r-r1)+(g-g1)*(g-g1)+(b-b1)*(b-b1) < (r-r0)*(r-r0)+(g-g0)*(g-g0)+(b-b0)*(b-b0) THEN 1 ELSE 0 END AS cluster FROM px JOIN drawn USING (img_id)),
votes AS (SELECT d.img_id, CASE WHEN count(*) FILTER (n.cluster = 1) > count(*) FILTER (n.cluster = 0) THEN 1 ELSE 0 END AS background FROM s d JOIN near n ON n.img_id = d.img_id AND n.x = d.x AND n.y = d.y GROUP BY d.img_id)
SELECT img_id, x, y, cast(cluster AS INT) AS cluster, CASE WHEN cluster = background THEN 0 ELSE 255 END AS a FROM near JOIN votes USING (img_id)""",
    "dct_levels": _dct_sql() + "SELECT img_id, block_x, block_y, k, level FROM n WHERE level <> 0",
    "dct_error": _dct_sql() + "SELECT img_id, count(*) // 64 AS blocks, cast(count(*) FILTER (level <> 0) AS BIGINT) AS kept, round(sum((level * q - c) * (level * q - c)) / count(*), 6) AS mse FROM n GROUP BY img_id",
}
