"""Queries over whole images and colour spaces, with their SQL forms."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..operators import gradients as G, pixels as P, rasters as R
from ..sources.derive import COLOURS_SQL, NORD, PX_SQL, SIZED_SQL, colours, px, read

BASE = "WITH " + PX_SQL
OUT = ["img_id", "x", "y", "r", "g", "b", "a"]
STOPS = [(20, 40, 200), (250, 240, 10), (200, 0, 90)]
ANGLE = 30.0
RING = (9, 200, 40)


def on(f):
    return lambda s, d: f(px(s, d))


def _sheets(s, d):
    return read(s, d, "orders").select((F.col("o_custkey") % 50).alias("sheet"), (1 + F.col("o_orderkey") % 97).alias("w"), (1 + F.col("o_custkey") % 89).alias("h"))


def _named(df, *columns):
    return df.select(*columns)


def _frames(p):
    return R.frame_size(p.withColumn("anim", F.expr("img_id div 3")), "anim")


def _gif(p):
    return R.encode_gif(p.withColumn("anim", F.expr("img_id div 3")), "anim", delay=20).select("anim", "frames", "width", "height", F.sha2("content", 256).alias("sha256"))


def _base64_image(p):
    coded = R.encode_png(p).select("img_id", F.translate(F.base64("content"), "\r\n", "").alias("b64"))
    return R.decode_base64(coded)


def _gate(p):
    replaced = P.replace_colour(p, (100, 120, 140), (10, 200, 30, 255), 8.5)
    return P.replaced_gate(replaced).select("img_id", "changed", F.col("error").isNotNull().alias("failed"))


def _gradient(space):
    """A gradient per part: of the part's own colours in sRGB, of three given ones elsewhere."""
    def run(s, d):
        own = [F.struct(*[F.col(c).alias(k) for c, k in zip(order, "rgb")]) for order in ("rgb", "gbr", "brg")]
        given = [F.struct(*[F.lit(v).alias(k) for v, k in zip(c, "rgb")]) for c in STOPS]
        specs = colours(s, d).select(F.col("colour_id").alias("grad_id"), (F.col("colour_id") % 8 + 8).cast("int").alias("w"), (F.col("colour_id") % 3 + 1).cast("int").alias("h"), F.array(*(own if space == "rgb" else given)).alias("colours"))
        return G.gradients(specs, ANGLE, space)

    return run


QUERIES = {
    "px_noop": on(P.no_op),
    "px_convert_nn": on(lambda p: P.convert(p, NORD, "nn").select(*OUT)),
    "px_convert_clut": on(lambda p: P.convert(p, NORD, "clut").select(*OUT)),
    "px_border_round": on(lambda p: P.border(p, colour=RING, thickness=3, radius=12.0)),
    "px_replace_gate": on(_gate),
    "rotate": on(lambda p: R.rotate(p, 30.0)),
    "rotate_back": on(lambda p: R.rotate(p, -90.0)),
    "tilt_slight": on(lambda p: R.tilt(p, 0.5, -0.4, 0.65)),
    "frame_size": on(_frames),
    "cell_size": lambda s, d: P.cell_size(_sheets(s, d), "sheet"),
    "cell_size_biggest": lambda s, d: P.cell_size(_sheets(s, d), "sheet", True),
    "gradient_spaces_rgb": _gradient("rgb"),
    "gradient_lab": _gradient("lab"),
    "gradient_hcl": _gradient("hcl"),
    "gradient_hsv": _gradient("hsv"),
    "gradient_luv": _gradient("luv"),
    "gradient_luvlch": _gradient("luvlch"),
    "base64_image": on(_base64_image),
    # sequential within an image: no SQL form
    "dominant_colour": on(lambda p: R.extract_palette(P.histogram(p)).filter("rank = 1").select("img_id", "hex", "n")),
    "palette_quantise": on(lambda p: R.quantise(p, 16)),
    "resize_padded": on(lambda p: R.resize_padded(p, 60, 40)),
    "resize_catmullrom": on(lambda p: R.resize(p, 30, 20, "catmullrom")),
    "gif_animation": on(_gif),
    "tilt_effect": on(lambda p: R.tilt_effect(p, "p3", 320, 180)),
    "remove_background": on(lambda p: P.remove_background(p).select(*OUT)),
    "tensor_nchw": on(R.nchw),
}


def _num(v: float) -> str:
    return f"({float(v)!r}::DOUBLE)"


def _sampled_sql(size: str, position: str) -> str:
    """Bilinear samples over a canvas: size gives nw and nh, position sx and sy."""
    taps = {"00": "x0, y0", "10": "x0 + 1, y0", "01": "x0, y0 + 1", "11": "x0 + 1, y0 + 1"}
    joins = " ".join(f"LEFT JOIN px p{t} ON g.img_id = p{t}.img_id AND (p{t}.x, p{t}.y) = ({at})" for t, at in taps.items())
    w = lambda c, t: f"coalesce(p{t}.{c}, 0) * 257::DOUBLE"
    value = lambda c: f"cast(floor((({w(c, '00')} * (1 - fx) + {w(c, '10')} * fx) * (1 - fy) + ({w(c, '01')} * (1 - fx) + {w(c, '11')} * fx) * fy) / 256) AS INT)"
    return f"""{BASE}, d AS (SELECT img_id, (max(x) + 1)::DOUBLE AS w, (max(y) + 1)::DOUBLE AS h FROM px GROUP BY img_id),
s AS (SELECT img_id, w, h, {size} FROM d),
k AS (SELECT *, unnest(range(0, nw * nh)) AS k FROM s),
c AS (SELECT img_id, w, h, cast(k % nw AS INT) AS x, cast(k // nw AS INT) AS y, k % nw - nw / 2::DOUBLE AS dx, k // nw - nh / 2::DOUBLE AS dy FROM k),
q AS (SELECT *, {position} FROM c),
f AS (SELECT *, sx >= 0 AND sx < w - 1 AND sy >= 0 AND sy < h - 1 AS ok FROM q),
g AS (SELECT img_id, x, y, ok, CASE WHEN ok THEN cast(floor(sx) AS INT) END AS x0, CASE WHEN ok THEN cast(floor(sy) AS INT) END AS y0,
  CASE WHEN ok THEN sx - floor(sx) END AS fx, CASE WHEN ok THEN sy - floor(sy) END AS fy FROM f)
SELECT g.img_id, g.x, g.y, {", ".join(f"CASE WHEN ok THEN {value(c)} ELSE 0 END AS {c}" for c in "rgba")} FROM g {joins}"""


def _rotate_sql(degrees: float) -> str:
    cos, sin = _num(np.cos(np.radians(degrees))), _num(np.sin(np.radians(degrees)))
    corners = [(x, y) for x in ("(-w / 2)", "(w / 2)") for y in ("(-h / 2)", "(h / 2)")]
    xs, ys = (", ".join(e.format(x=x, y=y) for x, y in corners) for e in (f"{{x}} * {cos} - {{y}} * {sin}", f"{{x}} * {sin} + {{y}} * {cos}"))
    size = f"cast(floor(greatest({xs}) - least({xs}) + 1) AS INT) AS nw, cast(floor(greatest({ys}) - least({ys}) + 1) AS INT) AS nh"
    return _sampled_sql(size, f"dx * {cos} + dy * {sin} + w / 2 AS sx, (-dx) * {sin} + dy * {cos} + h / 2 AS sy")


def _tilt_sql(tx: float, ty: float, scale: float) -> str:
    cx, sx, cy, sy = np.cos(np.radians(tx)), np.sin(np.radians(tx)), np.cos(np.radians(ty)), np.sin(np.radians(ty))
    z = f"(dx * {_num(sy)} + dy * {_num(-sx)} * {_num(cy)} + {_num(R.FOCAL * cx * cy)})"
    factor = f"({R.FOCAL}::DOUBLE / {z} * {_num(scale)})"
    px_ = f"(dx * {_num(cy)} + dy * {_num(sx)} * {_num(sy)} + {_num(R.FOCAL * -sy)}) / {factor} + w / 2"
    py = f"(dy * {_num(cx)} + {_num(R.FOCAL * sx)}) / {factor} + h / 2"
    return _sampled_sql("cast(floor(w * 2.5::DOUBLE) AS INT) AS nw, cast(floor(h * 2.5::DOUBLE) AS INT) AS nh", f"CASE WHEN {z} > 0 THEN {px_} ELSE -1 END AS sx, {py} AS sy")


def _gradient_sql(space: str) -> str:
    parts = G.segments(STOPS, space)
    n = len(parts)
    cos, sin = _num(math.cos(math.radians(ANGLE))), _num(math.sin(math.radians(ANGLE)))
    pick = lambda end, k: "CASE seg " + " ".join(f"WHEN {i} THEN {_num(s[end][k])}" for i, s in enumerate(parts)) + " END"
    own = ", ".join(f"{pick(0, k)} + f * {pick(1, k)} AS {c}" for k, c in enumerate("pqs"))
    if space == "rgb":
        share = lambda c: f"({c} / 255::DOUBLE)"
        own = ", ".join(f"CASE seg WHEN 0 THEN {share(c1)} + f * ({share(c2)} - {share(c1)}) ELSE {share(c2)} + f * ({share(c3)} - {share(c2)}) END AS {n_}" for (c1, c2, c3), n_ in zip(("rgb", "gbr", "brg"), "pqs"))
    steps = [
        COLOURS_SQL,
        "w AS (SELECT colour_id AS grad_id, r, g, b, colour_id % 8 + 8 AS w, colour_id % 3 + 1 AS h FROM colours)",
        "y AS (SELECT *, cast(unnest(range(0, h)) AS INT) AS y FROM w)",
        f"i AS (SELECT *, cast(unnest(range(0, w)) AS INT) AS x, (abs(w * {cos}) + abs(h * {sin})) / 2 AS half FROM y)",
        f"t AS (SELECT *, least(greatest(((x - w / 2::DOUBLE) * {cos} + (y - h / 2::DOUBLE) * {sin} + half) / (half * 2), 0), 1) * {n} AS u FROM i)",
        f"g AS (SELECT *, least(greatest(cast(ceil(u) AS INT) - 1, 0), {n - 1}) AS seg FROM t)",
        "h AS (SELECT *, u - seg AS f FROM g)",
        f"c0 AS (SELECT grad_id, x, y, {own} FROM h)",
    ]
    if space == "rgb":
        steps.append("z AS (SELECT grad_id, x, y, p AS r, q AS g, s AS b FROM c0)")
    elif space == "hsv":
        steps.append("c1 AS (SELECT grad_id, x, y, ((p % 360::DOUBLE) + 360::DOUBLE) % 360::DOUBLE / 60 AS k, s * q AS c, s - s * q AS m FROM c0)")
        steps.append("c2 AS (SELECT *, c * (1 - abs(k % 2::DOUBLE - 1)) AS v, least(cast(floor(k) AS INT), 5) + 1 AS j FROM c1)")
        steps.append("z AS (SELECT grad_id, x, y, [c, v, 0, 0, v, c][j] + m AS r, [v, c, c, v, 0, 0][j] + m AS g, [0, 0, v, c, c, v][j] + m AS b FROM c2)")
    else:
        if space in ("hcl", "luvlch"):
            steps.append("c1 AS (SELECT grad_id, x, y, s AS p, q * cos(radians(p)) AS q, q * sin(radians(p)) AS s FROM c0)")
        else:
            steps.append("c1 AS (SELECT * FROM c0)")
        if space in ("lab", "hcl"):
            inv = lambda t: f"CASE WHEN {t} > {_num(6 / 29)} THEN {t} * {t} * {t} ELSE ({t} - {_num(4 / 29)}) * {_num(3 * 6 / 29 * 6 / 29)} END"
            steps.append("c2 AS (SELECT grad_id, x, y, (p + 0.16::DOUBLE) / 1.16::DOUBLE AS fy, q, s FROM c1)")
            steps.append("c3 AS (SELECT grad_id, x, y, fy + q / 5 AS fx, fy, fy - s / 2 AS fz FROM c2)")
            steps.append("c4 AS (SELECT grad_id, x, y, " + ", ".join(f"({inv(f)}) * {_num(w)} AS {n_}" for f, w, n_ in zip(("fx", "fy", "fz"), G.WHITE, ("cx", "cy", "cz"))) + " FROM c3)")
        else:
            steps.append(f"c2 AS (SELECT grad_id, x, y, p, (CASE WHEN p <= 0.08::DOUBLE THEN p * {_num(100 * (3 / 29) ** 3)} ELSE pow((p + 0.16::DOUBLE) / 1.16::DOUBLE, 3) END) * {_num(G.WHITE[1])} AS cy, q / (13 * p) + {_num(G.UN)} AS u, s / (13 * p) + {_num(G.VN)} AS v FROM c1)")
            steps.append("c4 AS (SELECT grad_id, x, y, cy, CASE WHEN p = 0 THEN 0 ELSE cy * 9 * u / (4 * v) END AS cx, CASE WHEN p = 0 THEN 0 ELSE cy * (12 - 3 * u - 20 * v) / (4 * v) END AS cz FROM c2)")
        lin = lambda row: f"{_num(row[0])} * cx + {_num(row[1])} * cy + {_num(row[2])} * cz"
        steps.append("c5 AS (SELECT grad_id, x, y, " + ", ".join(f"{lin(row)} AS l{c}" for row, c in zip(G.TO_RGB, "rgb")) + " FROM c4)")
        curve = lambda v: f"CASE WHEN {v} <= 0.0031308::DOUBLE THEN 12.92::DOUBLE * {v} ELSE 1.055::DOUBLE * pow({v}, {_num(1 / 2.4)}) - 0.055::DOUBLE END"
        steps.append("z AS (SELECT grad_id, x, y, " + ", ".join(f"{curve('l' + c)} AS {c}" for c in "rgb") + " FROM c5)")
    eight = ", ".join(f"cast(floor(floor(least(greatest({c}, 0), 1) * 65535 + 0.5::DOUBLE) / 256) AS INT) AS {c}" for c in "rgb")
    return "WITH " + ",\n".join(steps) + f"\nSELECT grad_id, x, y, {eight} FROM z"


def _border_round_sql() -> str:
    rho, t, (cr, cg, cb) = 12.0, 3, RING
    offs = P.OFFSETS
    d2 = lambda ox, oy: f"(dx + ({ox}::DOUBLE)) * (dx + ({ox}::DOUBLE)) + (dy + ({oy}::DOUBLE)) * (dy + ({oy}::DOUBLE))"
    n = " + ".join(f"CASE WHEN {d2(ox, oy)} <= {rho * rho} AND {d2(ox, oy)} < {(rho - t) ** 2} THEN 1 ELSE 0 END" for ox in offs for oy in offs)
    framed = ", ".join(f"CASE WHEN x < {t} OR y < {t} OR x >= w - {t} OR y >= h - {t} THEN {v} ELSE {c} END AS {c}" for c, v in zip("rgba", (*RING, 255)))
    return f"""WITH {SIZED_SQL}, o AS (SELECT img_id, x, y, w, h, {framed} FROM spx),
c AS (SELECT *, (x < {rho} OR x > w - {rho}) AND (y < {rho} OR y > h - {rho}) AS corner, (CASE WHEN x < {rho} THEN x - {rho} ELSE x - (w - {rho}) END)::DOUBLE AS dx,
  (CASE WHEN y < {rho} THEN y - {rho} ELSE y - (h - {rho}) END)::DOUBLE AS dy FROM o),
s AS (SELECT *, dx * dx + dy * dy AS d2, {n} AS n FROM c),
k AS (SELECT *, corner AND d2 > {rho * rho} AS outside, corner AND d2 <= {rho * rho} AND d2 > {(rho - t) ** 2} AS ring,
  corner AND d2 > {(rho - 4) ** 2} AND d2 <= {(rho - t) ** 2} AS near, corner AND d2 <= {(rho - 4) ** 2} AS inner_ FROM s),
m AS (SELECT *, outside OR (near AND n = 0) OR (inner_ AND r = {cr} AND g = {cg} AND b = {cb} AND a = 255) AS gone FROM k)
SELECT img_id, x, y, {", ".join(f"CASE WHEN gone THEN 0 WHEN ring THEN {v} ELSE {c} END AS {c}" for c, v in zip("rgb", RING))},
  CASE WHEN gone THEN 0 WHEN ring THEN 255 WHEN near AND n < 8 THEN cast(floor(a * n / 8::DOUBLE) AS INT) ELSE a END AS a FROM m"""


_SHEETS = "d AS (SELECT o_custkey % 50 AS sheet, 1 + o_orderkey % 97 AS w, 1 + o_custkey % 89 AS h FROM orders)"


def _all_sql() -> dict[str, str]:
    from .pixel_queries import _near_sql, _rbf_cell_sql, _rbf_sql

    found = {
        "px_noop": f"{BASE} SELECT img_id, x, y, r, g, b, a FROM px",
        "px_convert_nn": _near_sql() + "SELECT img_id, x, y, r, g, b, 255 AS a FROM n",
        "px_convert_clut": _rbf_sql(),
        "px_border_round": _border_round_sql(),
        "px_replace_gate": f"{BASE}, d AS (SELECT img_id, sqrt(((r-100)*(r-100)+(g-120)*(g-120)+(b-140)*(b-140))::DOUBLE) AS d FROM px) SELECT img_id, count(*) FILTER (d < {_num(8.5 * math.sqrt(3))}) AS changed, count(*) FILTER (d < {_num(8.5 * math.sqrt(3))}) = 0 AS failed FROM d GROUP BY img_id",
        "rotate": _rotate_sql(30.0),
        "rotate_back": _rotate_sql(-90.0),
        "png_round_trip": f"{BASE} SELECT img_id, x, y, r, g, b, a FROM px",
        "tilt_slight": _tilt_sql(0.5, -0.4, 0.65),
        "tilt": _tilt_sql(5.0, 5.0, 1.0),
        "frame_size": f"{BASE} SELECT img_id // 3 AS anim, max(x) + 1 AS w, max(y) + 1 AS h FROM px GROUP BY 1",
        "cell_size": f"WITH {_SHEETS} SELECT sheet, max(w) AS cw, max(h) AS ch FROM d GROUP BY sheet",
        "cell_size_biggest": f"WITH {_SHEETS} SELECT sheet, min(w) AS cw, min(h) AS ch FROM d GROUP BY sheet",
        "base64_image": f"{BASE} SELECT img_id, x, y, r, g, b, a FROM px",
        "gradient_spaces_rgb": _gradient_sql("rgb"),
    }
    return found | {f"gradient_{s}": _gradient_sql(s) for s in G.SPACES if s != "rgb"}


SQL = _all_sql()
