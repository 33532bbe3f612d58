"""Colour functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02X%02X%02X", r.cast("int"), g.cast("int"), b.cast("int"))


def from_hex(h: Column) -> Column:
    """Struct r, g, b, a of ``#RRGGBB``; null where malformed."""
    part = lambda at: F.conv(F.substr(h, F.lit(at), F.lit(2)), 16, 10).cast("int")
    return F.when(h.rlike("^#[0-9A-Fa-f]{6}$"), F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b"), F.lit(255).alias("a")))


def detect_format(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t.startswith("#"), "hex").when(t.startswith("rgb"), "rgb").when(t.startswith("hsl"), "hsl").when(t.startswith("lab"), "lab").otherwise("unknown")


def hsl_of(r: Column, g: Column, b: Column) -> Column:
    """Struct h (0-360), s and l (0-1) of 8-bit channels."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d, total = (top - low), (top + low)
    light = total / F.lit(510.0)
    s = F.when(d == 0, F.lit(0.0)).when(total <= 255, d / total).otherwise(d / (510 - total))
    h = (
        F.when(d == 0, F.lit(0.0))
        .when(top == r, F.lit(60.0) * F.pmod((g - b) / d, F.lit(6.0)))
        .when(top == g, F.lit(60.0) * ((b - r) / d + 2))
        .otherwise(F.lit(60.0) * ((r - g) / d + 4))
    )
    return F.struct(h.alias("h"), s.cast("double").alias("s"), light.alias("l"))


def rgb_of_hsl(h: Column, s: Column, l: Column) -> Column:  # noqa: E741
    """Struct r, g, b (0-255) of h (0-360), s and l (0-1)."""
    def chroma(v: Column) -> Column:
        return F.struct(((1 - F.abs(2 * v.l - 1)) * v.s).alias("c"), v.l.alias("l"), (F.pmod(v.h, F.lit(360.0)) / 60).alias("sector"))

    def parts(v: Column) -> Column:
        return F.struct(v.c.alias("c"), (v.c * (1 - F.abs(F.pmod(v.sector, F.lit(2.0)) - 1))).alias("x"), (v.l - v.c / 2).alias("m"), v.sector.alias("sector"))

    def channels(v: Column) -> Column:
        c, x, zero = v.c, v.x, F.lit(0.0)

        def channel(*by_sector: Column) -> Column:
            at = F.when(v.sector < 1, by_sector[0])
            for i in range(1, 5):
                at = at.when(v.sector < i + 1, by_sector[i])
            return F.round((at.otherwise(by_sector[5]) + v.m) * 255).cast("int")

        return F.struct(channel(c, x, zero, zero, x, c).alias("r"), channel(x, c, c, x, zero, zero).alias("g"), channel(zero, zero, x, c, c, x).alias("b"))

    # each step is computed once, though the next one names it many times
    return _let(_let(_let(F.struct(h.cast("double").alias("h"), s.cast("double").alias("s"), l.cast("double").alias("l")), chroma), parts), channels)


def rotate_hue(r: Column, g: Column, b: Column, degrees: float) -> Column:
    h = hsl_of(r, g, b)
    return rgb_of_hsl(h["h"] + degrees, h["s"], h["l"])


#: hue offsets of the colour wheel
WHEEL = {"complementary": (180,), "triadic": (120, 240), "quadratic": (90, 180, 270), "analogous": (330, 30), "split-complementary": (150, 210)}


def wheel(kind: str, r: Column, g: Column, b: Column) -> Column:
    """Array of the colours of a wheel rule, as hex."""
    return wheel_of(kind, hsl_of(r, g, b))


def wheel_of(kind: str, h: Column) -> Column:
    """``wheel`` of a struct h, s, l. Where that is a column of its own, several rules
    share it."""
    if kind not in WHEEL:
        raise ValueError(f"unknown wheel rule {kind}")
    turned = [rgb_of_hsl(h["h"] + d, h["s"], h["l"]) for d in WHEEL[kind]]
    return F.array(*[to_hex(t["r"], t["g"], t["b"]) for t in turned])


def mix(r: Column, g: Column, b: Column, to: tuple[int, int, int], steps: int) -> Column:
    """``steps`` colours from (r, g, b) towards ``to``, both ends included, as hex."""
    if steps < 1:
        raise ValueError("steps must be at least 1")
    out = []
    for k in range(steps):
        f = k / (steps - 1) if steps > 1 else 0.0
        out.append(to_hex(*[F.round(c + (v - c) * F.lit(f)) for c, v in zip((r, g, b), to)]))
    return F.array(*out)


def shades(r, g, b, n=5):
    return mix(r, g, b, (0, 0, 0), n)


def tints(r, g, b, n=5):
    return mix(r, g, b, (255, 255, 255), n)


def tones(r, g, b, n=5):
    return mix(r, g, b, (128, 128, 128), n)


def lighten(r, g, b, amount: float = 0.3) -> Column:
    if not 0 <= amount <= 1:
        raise ValueError("amount must be in [0, 1]")
    h = hsl_of(r, g, b)
    return rgb_of_hsl(h["h"], h["s"], F.least(h["l"] + amount, F.lit(1.0)))


def darken(r, g, b, amount: float = 0.3) -> Column:
    if not 0 <= amount <= 1:
        raise ValueError("amount must be in [0, 1]")
    h = hsl_of(r, g, b)
    return rgb_of_hsl(h["h"], h["s"], F.greatest(h["l"] - amount, F.lit(0.0)))


def lab_of(r: Column, g: Column, b: Column) -> Column:
    """Struct l (0-100), a, b of 8-bit sRGB, CIE Lab under D65."""
    def linear(c):
        v = c / F.lit(255.0)
        return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    lr, lg, lb = linear(r), linear(g), linear(b)
    xyz = (
        (0.4124564 * lr + 0.3575761 * lg + 0.1804375 * lb) / 0.95047,
        0.2126729 * lr + 0.7151522 * lg + 0.0721750 * lb,
        (0.0193339 * lr + 0.1191920 * lg + 0.9503041 * lb) / 1.08883,
    )
    fx, fy, fz = (F.when(v > 216 / 24389, F.cbrt(v)).otherwise((24389 / 27 * v + 16) / 116) for v in xyz)
    return F.struct((116 * fy - 16).alias("l"), (500 * (fx - fy)).alias("a"), (200 * (fy - fz)).alias("b"))


def parse_rgb(text: Column) -> Column:
    """Hex of ``rgb(r,g,b)``; null where a channel is missing or over 255."""
    pattern = r"^\s*rgb\(\s*(\d{1,3})\s*,\s*(\d{1,3})\s*,\s*(\d{1,3})\s*\)\s*$"
    part = [F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).cast("int") for i in (1, 2, 3)]
    return F.when(F.greatest(*part) <= 255, to_hex(*part))


def palette_hash(colours: Column) -> Column:
    """First 16 hex digits of the MD5 of the joined ``#RRGGBB`` strings."""
    return F.substring(F.md5(F.array_join(colours, "")), 1, 16)


# ---- colour text --------------------------------------------------------

FORMATS = ("hex", "hsl", "lab", "rgb")


def valid_formats() -> Column:
    return F.array(*map(F.lit, FORMATS))


def to_lower_hex(c: Column) -> Column:
    """``#rrggbb`` of a struct r, g, b."""
    return F.format_string("#%02x%02x%02x", c["r"], c["g"], c["b"])


def _let(value: Column, f) -> Column:
    """f(value), with the value computed and planned once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def rgb_of_lab(l: Column, a: Column, b: Column) -> Column:  # noqa: E741
    """Struct r, g, b (0-255, clamped) of l (0-100), a, b under D65."""
    fy = (l + 16) / 116
    thirds = F.struct((fy + a / 500).alias("x"), fy.alias("y"), (fy - b / 200).alias("z"))

    def share(f: Column, white: float) -> Column:
        return F.when(f * f * f > 216 / 24389, f * f * f).otherwise((116 * f - 16) * F.lit(27 / 24389)) * white

    def linear(v: Column) -> Column:
        x, y, z = v["x"], v["y"], v["z"]
        return F.struct(
            (3.2404542 * x - 1.5371385 * y - 0.4985314 * z).alias("r"),
            (-0.9692660 * x + 1.8760108 * y + 0.0415560 * z).alias("g"),
            (0.0556434 * x - 0.2040259 * y + 1.0572252 * z).alias("b"),
        )

    def channel(v: Column) -> Column:
        s = F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)
        return F.least(F.greatest(F.floor(s * 255 + 0.5), F.lit(0)), F.lit(255)).cast("int")

    xyz = _let(thirds, lambda t: F.struct(*[share(t[k], w).alias(k) for k, w in zip("xyz", (0.95047, 1.0, 1.08883))]))
    return _let(_let(xyz, linear), lambda v: F.struct(*[channel(v[c]).alias(c) for c in "rgb"]))


def _numbers(text: Column, name: str, number: str) -> list[Column]:
    pattern = rf"^\s*{name}\s*\(\s*({number})\s*,\s*({number})\s*,\s*({number})\s*\)\s*$"
    return [F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).try_cast("double") for i in (1, 2, 3)]


def parse_hex(text: Column) -> Column:
    """The trimmed text where it is ``#`` and six hex digits, else null."""
    t = F.trim(text)
    return F.when(t.rlike("^#[0-9A-Fa-f]{6}$"), t)


def parse_hsl(text: Column) -> Column:
    """Hex of ``hsl(h,s,l)`` with s and l in percent; null where malformed."""
    h, s, l = _numbers(text, "hsl", r"[\d.]+")  # noqa: E741
    c = rgb_of_hsl(h, s / 100, l / 100)
    clamped = F.struct(*[F.least(F.greatest(c[k], F.lit(0)), F.lit(255)).alias(k) for k in "rgb"])
    return F.when(h.isNotNull() & s.isNotNull() & l.isNotNull(), to_lower_hex(clamped))


def parse_lab(text: Column) -> Column:
    """Hex of ``lab(l,a,b)``; null where malformed."""
    l, a, b = _numbers(text, "lab", r"[\d.-]+")  # noqa: E741
    return F.when(l.isNotNull() & a.isNotNull() & b.isNotNull(), to_lower_hex(rgb_of_lab(l, a, b)))


def parse_any(text: Column) -> Column:
    """Hex of a colour in any of FORMATS; null where the format is unknown or malformed
    (a caller that must fail uses ``require``)."""
    kind = detect_format(text)
    rgb = parse_rgb(F.regexp_replace(text, r"^\s*rgb\s+\(", "rgb("))
    return F.when(kind == "hex", parse_hex(text)).when(kind == "rgb", rgb).when(kind == "hsl", parse_hsl(text)).when(kind == "lab", parse_lab(text))


def require(value: Column, message: str, shown: Column) -> Column:
    """``value``, or an error that shows what could not be read."""
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit(message + ": "), F.coalesce(shown, F.lit("null")))))


def hex_to_format(h: Column, fmt: str) -> Column:
    """A hex colour as text of another format."""
    c = from_hex(h)
    r, g, b = c["r"], c["g"], c["b"]
    fmt = fmt.lower()
    if fmt == "hex":
        return h
    if fmt == "rgb":
        return F.when(c.isNotNull(), F.format_string("rgb(%d,%d,%d)", r, g, b))
    if fmt == "hsl":
        v = hsl_of(r, g, b)
        whole = [F.round(x).cast("int") for x in (v["h"], v["s"] * 100, v["l"] * 100)]
        return F.when(c.isNotNull(), F.format_string("hsl(%d,%d,%d)", *whole))
    if fmt == "lab":
        v = lab_of(r, g, b)
        return F.when(c.isNotNull(), F.format_string("lab(%.2f,%.2f,%.2f)", v["l"], v["a"], v["b"]))
    raise ValueError(f"unknown format {fmt}")


def hex_list_to_rgba(colours: Column) -> Column:
    """Array of r, g, b, a of an array of hex colours; null if any is malformed."""
    good = F.forall(colours, lambda h: F.coalesce(h.rlike("^#[0-9A-Fa-f]{6}$"), F.lit(False)))
    return F.when(good, F.transform(colours, from_hex))


def rgba_list_to_hex(colours: Column) -> Column:
    """Array of ``#rrggbb`` of an array of structs r, g, b."""
    return F.transform(colours, to_lower_hex)


def blend(first: tuple[Column, Column, Column], second: tuple[Column, Column, Column], steps: int = 3) -> Column:
    """``steps`` colours from one colour to another, both included, as hex."""
    if steps < 2:
        raise ValueError("steps must be at least 2")
    shares = [k / (steps - 1) for k in range(steps)]
    return F.array(*[to_hex(*[F.round(c + (v - c) * F.lit(f)) for c, v in zip(first, second)]) for f in shares])


def monochromatic(r: Column, g: Column, b: Column, n: int = 5) -> Column:
    """``n`` colours of the same hue and saturation, evenly spread in lightness."""
    return monochromatic_of(hsl_of(r, g, b), n)


def monochromatic_of(h: Column, n: int = 5) -> Column:
    """``monochromatic`` of a struct h, s, l."""
    if n < 1:
        raise ValueError("n must be at least 1")
    made = [rgb_of_hsl(h["h"], h["s"], F.lit((k + 1) / (n + 1))) for k in range(n)]
    return F.array(*[to_hex(c["r"], c["g"], c["b"]) for c in made])


def contrast(r: Column, g: Column, b: Column) -> Column:
    """Black on light colours and white on dark ones, as hex."""
    return F.when(299 * r + 587 * g + 114 * b >= 128_000, "#000000").otherwise("#FFFFFF")
