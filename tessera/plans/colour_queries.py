"""Queries over colour text, colour families and themes, with their SQL forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colour as C
from ..operators import pixels as P
from ..sources.derive import COLOURS_SQL, PALETTE_SQL, PART_THEMES, PX_SQL, colours, part_palette, px, read, theme_list, theme_lookup
from .text_queries import _HSL


def _c():
    return F.col("r"), F.col("g"), F.col("b")


def _hexed(c):
    return C.to_hex(c["r"], c["g"], c["b"])


def _texts(s, d):
    """Every fifth colour in each format, and in none."""
    k = F.col("colour_id") % 5
    text = (
        F.when(k == 0, F.format_string(" #%02x%02X%02x ", *_c()))
        .when(k == 1, F.format_string("rgb (%d , %d,%d)", F.col("r") + 20, F.col("g"), F.col("b")))
        .when(k == 2, F.format_string("hsl(%d,%d.5, %d)", F.col("r"), F.col("g") % 100, F.col("b") % 101))
        .when(k == 3, F.format_string("lab(%d, %d,%d)", F.col("r") % 101, F.col("g") - 128, F.col("b") - 128))
        .otherwise(F.format_string("cmyk(%d,%d,%d)", *_c()))
    )
    return colours(s, d).select("colour_id", text.alias("t"), *_c())


def _parse(s, d):
    return _texts(s, d).select("colour_id", C.detect_format(F.col("t")).alias("format"), C.parse_any(F.col("t")).alias("hex"))


def _formats(s, d):
    h = C.to_hex(*_c())
    return colours(s, d).select("colour_id", *[C.hex_to_format(h, f).alias(f) for f in C.FORMATS])


def _joined(column):
    return lambda s, d: colours(s, d).select("colour_id", F.concat_ws(",", column(*_c())).alias("colours"))


def _hsl(s, d):
    """Colours with their hue, saturation and lightness as one column."""
    return colours(s, d).select("colour_id", C.hsl_of(*_c()).alias("h"))


def _wheels(s, d):
    return _hsl(s, d).select("colour_id", *[F.concat_ws(",", C.wheel_of(k, F.col("h"))).alias(k.replace("-", "_")) for k in C.WHEEL])


def _mono(s, d):
    return _hsl(s, d).select("colour_id", F.concat_ws(",", C.monochromatic_of(F.col("h"))).alias("colours"))


def _blend(s, d):
    other = (255 - F.col("g"), F.col("b"), F.col("r"))
    return colours(s, d).select("colour_id", F.concat_ws(",", C.blend(_c(), other, 3)).alias("colours"))


def _lists(s, d):
    """Colours by tens: lists of hex to channels and back; one malformed entry spoils a list."""
    own = F.when((F.col("colour_id") % 70 == 3), F.lit("#12")).otherwise(C.to_hex(*_c()))
    lists = colours(s, d).select(F.expr("colour_id div 10").alias("list_id"), F.struct("colour_id", own.alias("h")).alias("e"))
    lists = lists.groupBy("list_id").agg(F.array_sort(F.collect_list("e")).alias("e")).select("list_id", F.col("e.h").alias("h"))
    rgba = lists.withColumn("rgba", C.hex_list_to_rgba(F.col("h")))
    reds = F.aggregate("rgba", F.lit(0), lambda acc, x: acc + x["r"])
    return rgba.select("list_id", F.coalesce(reds, F.lit(-1)).cast("long").alias("sum_r"), F.concat_ws(",", C.rgba_list_to_hex(F.col("rgba"))).alias("hexes"))


def _wanted(s, d):
    """Themes of the parts' colours by the names that parts ask for, one of them unknown."""
    names = read(s, d, "part").select(F.concat(F.lit("T"), F.col("p_partkey") % (PART_THEMES + 1)).alias("name")).distinct()
    return theme_lookup(part_palette(s, d), names).select("name", F.concat_ws(",", "colours").alias("colours"), "error")


QUERIES = {
    "colour_parse_any": _parse,
    "colour_formats": _formats,
    "colour_wheels": _wheels,
    "colour_contrast": lambda s, d: colours(s, d).select("colour_id", C.contrast(*_c()).alias("hex")),
    "colour_blend": _blend,
    "colour_tones": _joined(C.tones),
    "colour_monochromatic": _mono,
    "colour_darken": lambda s, d: colours(s, d).select("colour_id", _hexed(C.darken(*_c())).alias("hex")),
    "colour_lists": _lists,
    "theme_list": lambda s, d: theme_list(part_palette(s, d)),
    "theme_lookup": _wanted,
}


def _rgb_of_hsl_sql(h: str, s: str, l: str) -> str:  # noqa: E741
    """A [r, g, b] list of hue in degrees (not negative), saturation and lightness."""
    c = f"((1 - abs(2 * {l} - 1)) * {s})"
    k = f"(({h}) % 360::DOUBLE / 60)"
    x = f"({c} * (1 - abs({k} % 2::DOUBLE - 1)))"
    m = f"({l} - {c} / 2)"
    j = f"least(cast(floor({k}) AS INT), 5) + 1"
    channels = ([c, x, "0", "0", x, c], [x, c, c, x, "0", "0"], ["0", "0", x, c, c, x])
    return "[" + ", ".join(f"cast(round(([{', '.join(f'{v}::DOUBLE' for v in ch)}][{j}] + {m}) * 255) AS INT)" for ch in channels) + "]"


def _hex_sql(rgb: str, small: bool = False) -> str:
    two = "%02x" if small else "%02X"
    return f"printf('#{two}{two}{two}', {', '.join(f'({rgb})[{i}]' for i in (1, 2, 3))})"


def _over_hsl(select: str) -> str:
    return f"WITH {COLOURS_SQL}, {_HSL} SELECT colour_id, {select} FROM q"


def _turned(degrees) -> str:
    return " || ',' || ".join(_hex_sql(_rgb_of_hsl_sql(f"(h + {d}::DOUBLE)", "s", "l")) for d in degrees)


def _lab_sql() -> str:
    lin = lambda c: f"CASE WHEN {c}/255.0::DOUBLE <= 0.04045::DOUBLE THEN {c}/255.0::DOUBLE / 12.92::DOUBLE ELSE pow(({c}/255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"
    f = lambda v: f"CASE WHEN {v} > {216 / 24389!r}::DOUBLE THEN cbrt({v}) ELSE ({24389 / 27!r}::DOUBLE * {v} + 16) / 116 END"
    return f"""n AS (SELECT *, {lin('r')} AS lr, {lin('g')} AS lg, {lin('b')} AS lb FROM colours),
w AS (SELECT *, (0.4124564::DOUBLE*lr + 0.3575761::DOUBLE*lg + 0.1804375::DOUBLE*lb) / 0.95047::DOUBLE AS x, 0.2126729::DOUBLE*lr + 0.7151522::DOUBLE*lg + 0.0721750::DOUBLE*lb AS y,
  (0.0193339::DOUBLE*lr + 0.1191920::DOUBLE*lg + 0.9503041::DOUBLE*lb) / 1.08883::DOUBLE AS z FROM n),
f AS (SELECT *, {f('x')} AS fx, {f('y')} AS fy, {f('z')} AS fz FROM w),
lab AS (SELECT colour_id, r, g, b, 116 * fy - 16 AS ll, 500 * (fx - fy) AS la, 200 * (fy - fz) AS lb_ FROM f)"""


def _rgb_of_lab_sql(l: str, a: str, b: str) -> str:  # noqa: E741
    fy = f"(({l} + 16::DOUBLE) / 116)"
    inv = lambda t: f"(CASE WHEN {t}*{t}*{t} > {216 / 24389!r}::DOUBLE THEN {t}*{t}*{t} ELSE (116 * {t} - 16) * {27 / 24389!r}::DOUBLE END)"
    x, y, z = f"{inv(f'({fy} + {a} / 500::DOUBLE)')} * 0.95047::DOUBLE", inv(fy), f"{inv(f'({fy} - {b} / 200::DOUBLE)')} * 1.08883::DOUBLE"
    rows = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
    out = []
    for p, q, s in rows:
        v = f"({p}::DOUBLE * ({x}) + {q}::DOUBLE * ({y}) + {s}::DOUBLE * ({z}))"
        curve = f"CASE WHEN {v} <= 0.0031308::DOUBLE THEN 12.92::DOUBLE * {v} ELSE 1.055::DOUBLE * pow(greatest({v}, 0), {1 / 2.4!r}::DOUBLE) - 0.055::DOUBLE END"
        out.append(f"cast(least(greatest(floor(({curve}) * 255 + 0.5::DOUBLE), 0), 255) AS INT)")
    return "[" + ", ".join(out) + "]"


_WHEELS = ", ".join(f"{_turned(turns)} AS {k.replace('-', '_')}" for k, turns in C.WHEEL.items())
_SATURATED = _rgb_of_hsl_sql("h", "least(s * 1.25::DOUBLE, 1)", "l")
_PX_HSL = _HSL.replace("colours", "px").replace("q AS (SELECT colour_id,", "q AS (SELECT img_id, x, y, a,")

SQL = {
    "colour_parse_any": f"""WITH {COLOURS_SQL} SELECT colour_id, CASE colour_id % 5 WHEN 0 THEN 'hex' WHEN 1 THEN 'rgb' WHEN 2 THEN 'hsl' WHEN 3 THEN 'lab' ELSE 'unknown' END AS format,
CASE colour_id % 5 WHEN 0 THEN printf('#%02x%02X%02x', r, g, b) WHEN 1 THEN CASE WHEN r + 20 <= 255 THEN printf('#%02X%02X%02X', r + 20, g, b) END
 WHEN 2 THEN {_hex_sql(_rgb_of_hsl_sql('r::DOUBLE', '((g % 100 + 0.5::DOUBLE) / 100)', '((b % 101)::DOUBLE / 100)'), True)}
 WHEN 3 THEN {_hex_sql(_rgb_of_lab_sql('(r % 101)', '(g - 128)', '(b - 128)'), True)} END AS hex FROM colours""",
    "colour_formats": f"""WITH {COLOURS_SQL}, {_HSL}, {_lab_sql()} SELECT lab.colour_id, printf('#%02X%02X%02X', r, g, b) AS hex,
printf('hsl(%d,%d,%d)', cast(round(h) AS INT), cast(round(s * 100) AS INT), cast(round(l * 100) AS INT)) AS hsl, printf('lab(%.2f,%.2f,%.2f)', ll, la, lb_) AS lab,
printf('rgb(%d,%d,%d)', r, g, b) AS rgb FROM lab JOIN q USING (colour_id)""",
    "colour_wheels": _over_hsl(_WHEELS),
    "colour_wheel": _over_hsl(f"{_turned(C.WHEEL['triadic'])} AS triadic"),
    "colour_contrast": f"WITH {COLOURS_SQL} SELECT colour_id, CASE WHEN 299*r + 587*g + 114*b >= 128000 THEN '#000000' ELSE '#FFFFFF' END AS hex FROM colours",
    "colour_blend": f"WITH {COLOURS_SQL} SELECT colour_id, printf('#%02X%02X%02X,', r, g, b) || printf('#%02X%02X%02X,', cast(round(r + (255-g-r) * 0.5::DOUBLE) AS INT), cast(round(g + (b-g) * 0.5::DOUBLE) AS INT), cast(round(b + (r-b) * 0.5::DOUBLE) AS INT)) || printf('#%02X%02X%02X', 255-g, b, r) AS colours FROM colours",
    "colour_tones": f"WITH {COLOURS_SQL} SELECT colour_id, " + " || ',' || ".join("printf('#%02X%02X%02X', " + ", ".join(f"cast(round({c} + (128 - {c}) * {k / 4}::DOUBLE) AS INT)" for c in "rgb") + ")" for k in range(5)) + " AS colours FROM colours",
    "colour_monochromatic": _over_hsl(" || ',' || ".join(_hex_sql(_rgb_of_hsl_sql("h", "s", f"{(k + 1) / 6!r}::DOUBLE")) for k in range(5)) + " AS colours"),
    "colour_darken": _over_hsl(f"{_hex_sql(_rgb_of_hsl_sql('h', 's', 'greatest(l - 0.3::DOUBLE, 0)'))} AS hex"),
    "colour_lighten": _over_hsl(f"{_hex_sql(_rgb_of_hsl_sql('h', 's', 'least(l + 0.3::DOUBLE, 1)'))} AS hex"),
    "lab_convert": f"WITH {COLOURS_SQL}, {_lab_sql()} SELECT colour_id, round(ll, 4) AS l, round(la, 4) AS a, round(lb_, 4) AS b FROM lab",
    "px_saturation": f"WITH {PX_SQL}, {_PX_HSL}, t AS (SELECT img_id, x, y, a, {_SATURATED} AS c FROM q) SELECT img_id, x, y, c[1] AS r, c[2] AS g, c[3] AS b, a FROM t",
    "colour_lists": f"""WITH {COLOURS_SQL} SELECT colour_id // 10 AS list_id, CASE WHEN bool_and(colour_id % 70 <> 3) THEN cast(sum(r) AS BIGINT) ELSE -1 END AS sum_r,
CASE WHEN bool_and(colour_id % 70 <> 3) THEN string_agg(printf('#%02x%02x%02x', r, g, b), ',' ORDER BY colour_id) ELSE '' END AS hexes FROM colours GROUP BY 1""",
    "theme_list": f"WITH {PALETTE_SQL} SELECT theme, count(*) AS n_colours FROM pal GROUP BY theme",
    "theme_lookup": f"""WITH {PALETTE_SQL}, w AS (SELECT DISTINCT 'T' || (p_partkey % {PART_THEMES + 1}) AS name FROM part)
SELECT name, coalesce(string_agg(printf('#%02X%02X%02X', r, g, b), ',' ORDER BY idx), '') AS colours, CASE WHEN count(idx) = 0 THEN 'unknown theme' END AS error FROM w LEFT JOIN pal ON lower(name) = theme GROUP BY name""",
}
