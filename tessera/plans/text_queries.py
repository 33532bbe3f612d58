"""Queries over colours, file names, URLs and pages, with their SQL forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colour as C, text as T
from ..sources.derive import COLOURS_SQL, PALETTE_SQL, colours, doc_files, first_wallpapers, pages_text, part_palette, read

_FILES = "f AS (SELECT doc_id, 'doc' || doc_id || '.pdf-page-' || (1 + doc_id % 5) || '-of-5' AS filename, n_chars FROM documents)"


def _c():
    return F.col("r"), F.col("g"), F.col("b")


def _hex(s, d):
    return colours(s, d).select("colour_id", C.to_hex(*_c()).alias("hex"))


def _parse(s, d):
    text = F.format_string("rgb(%d, %d, %d)", F.col("r") + 20, F.col("g"), F.col("b"))
    back = colours(s, d).select("colour_id", text.alias("t"))
    return back.select("colour_id", C.detect_format(F.col("t")).alias("format"), C.parse_rgb(F.col("t")).alias("hex"))


def _unhex(s, d):
    c = C.from_hex(F.col("hex"))
    return _hex(s, d).select("colour_id", c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b"))


def _hsl(s, d):
    h = C.hsl_of(*_c())
    return colours(s, d).select("colour_id", F.round(h["h"], 6).alias("h"), F.round(h["s"], 6).alias("s"), F.round(h["l"], 6).alias("l"))


def _lab(s, d):
    h = C.lab_of(*_c())
    return colours(s, d).select("colour_id", *[F.round(h[k], 4).alias(k) for k in ("l", "a", "b")])


def _wheel(s, d):
    return colours(s, d).select("colour_id", F.concat_ws(",", C.wheel("triadic", *_c())).alias("triadic"))


def _shades(s, d):
    return colours(s, d).select("colour_id", F.concat_ws(",", C.shades(*_c())).alias("shades"), F.concat_ws(",", C.tints(*_c())).alias("tints"))


def _lighten(s, d):
    h = C.lighten(*_c())
    return colours(s, d).select("colour_id", C.to_hex(h["r"], h["g"], h["b"]).alias("hex"))


def _hash(s, d):
    """The hash of every theme of the parts' colours."""
    own = part_palette(s, d).groupBy("theme").agg(F.array_sort(F.collect_list(F.struct("idx", C.to_hex(*_c()).alias("hex")))).alias("p"))
    return own.select("theme", C.palette_hash(F.col("p.hex")).alias("palette_hash"))


def _feeds(s, d):
    """A feed per conversation, a post per turn."""
    turn, text = F.col("page_index"), F.col("original_index").cast("string")
    post = F.struct(F.struct(
        F.when((turn + F.length("text")) % 3 == 0, "link").otherwise("image").alias("post_hint"), F.concat(F.lit("https://a/"), text, F.lit("/"), turn, F.lit(".png")).alias("url"),
        F.when(turn % 2 == 0, F.concat(F.lit("https://b/"), turn, F.lit(".png"))).otherwise("").alias("url_overridden_by_dest"),
        (F.length("text") % 4 == 0).alias("over_18"), (F.length("text") % 5 == 0).alias("is_video"),
    ).alias("data"))
    posts = pages_text(s, d).groupBy("original_index").agg(F.array_sort(F.collect_list(F.struct(turn.alias("t"), post.alias("p")))).alias("c"))
    feeds = posts.select(F.col("original_index").alias("feed_id"), F.to_json(F.struct(F.struct(F.col("c.p").alias("children")).alias("data"))).alias("json"))
    return first_wallpapers(feeds)


def _prompt(s, d):
    f = doc_files(s, d)
    return f.select("doc_id", T.build_prompt(F.lit("Read."), F.lit("Be brief."), F.col("filename"), "md").alias("prompt"))


def _fail(s, d):
    return T.fail_gate(pages_text(s, d).withColumn("error", F.when(F.col("original_index") % 7 == 0, F.lit("bad"))))


def _options(s, d):
    o = read(s, d, "customer").select("c_custkey", (F.col("c_nationkey") % 3).cast("int").alias("max_tokens"))
    return T.merge_options(o, {"max_tokens": 4096})


def _base64(s, d):
    lines = F.base64(F.encode("text", "UTF-8"))  # Spark breaks it after 76 characters
    coded = read(s, d, "documents").select("doc_id", F.translate(lines, "\r\n", "").alias("b64"))
    return coded.withColumn("text", F.decode(F.unbase64("b64"), "UTF-8"))


def _ext(s, d):
    f = doc_files(s, d).withColumn("flag", F.when(F.col("doc_id") % 3 == 0, F.lit("webp"))).withColumn("output", F.when(F.col("doc_id") % 2 == 0, F.lit("out/x.JPG")))
    return f.select("doc_id", T.output_ext(F.col("flag"), F.col("output"), F.lit(None).cast("string")).alias("ext"), T.replace_ext(F.lit("a/b.c.png"), "avif").alias("replaced"))


QUERIES = {
    "colour_to_hex": _hex,
    "colour_parse_rgb": _parse,
    "colour_from_hex": _unhex,
    "hsl_convert": _hsl,
    "lab_convert": _lab,
    "colour_wheel": _wheel,
    "colour_variants": _shades,
    "colour_lighten": _lighten,
    "palette_hash": _hash,
    "prompt_build": _prompt,
    "page_name": lambda s, d: T.page_names(pages_text(s, d)),
    "page_slice": lambda s, d: T.page_slice(pages_text(s, d), 1, 2),
    "stitch_text": lambda s, d: T.stitch(pages_text(s, d)),
    "fail_gate": _fail,
    "url_extension": lambda s, d: read(s, d, "pages").select("page_id", T.url_extension(F.col("url")).alias("ext")),
    "file_size_text": lambda s, d: doc_files(s, d).select("doc_id", T.file_size(F.col("n_chars") * F.col("n_chars")).alias("size")),
    "compress_strategy": lambda s, d: read(s, d, "part").select("p_partkey", T.strategy(F.element_at(F.array(*[F.lit(x) for x in T.STRATEGIES]), (F.col("p_partkey") % 5 + 1).cast("int"))).alias("strategy")),
    "feed_first_images": _feeds,
    "option_merge": _options,
    "output_extension": _ext,
    "base64_round_trip_whole": _base64,
}
_HSL = """h AS (SELECT *, greatest(r,g,b) AS mx, least(r,g,b) AS mn FROM colours),
q AS (SELECT colour_id, (mx+mn)/510.0::DOUBLE AS l, CASE WHEN mx=mn THEN 0.0::DOUBLE WHEN mx+mn<=255 THEN (mx-mn)::DOUBLE/(mx+mn) ELSE (mx-mn)::DOUBLE/(510-(mx+mn)) END AS s,
 CASE WHEN mx=mn THEN 0.0::DOUBLE WHEN mx=r THEN 60.0::DOUBLE*CASE WHEN g>=b THEN (g-b)::DOUBLE/(mx-mn) ELSE (g-b)::DOUBLE/(mx-mn)+6 END
  WHEN mx=g THEN 60.0::DOUBLE*((b-r)::DOUBLE/(mx-mn)+2) ELSE 60.0::DOUBLE*((r-g)::DOUBLE/(mx-mn)+4) END AS h FROM h)"""
_MIX = lambda to: " || ',' || ".join("printf('#%02X%02X%02X', " + ", ".join(f"cast(round({c} + ({v} - {c}) * {k / 4}::DOUBLE) AS INT)" for c, v in zip("rgb", to)) + ")" for k in range(5))

SQL = {
    "colour_to_hex": f"WITH {COLOURS_SQL} SELECT colour_id, printf('#%02X%02X%02X', r, g, b) AS hex FROM colours",
    "colour_parse_rgb": f"WITH {COLOURS_SQL} SELECT colour_id, 'rgb' AS format, CASE WHEN r + 20 <= 255 THEN printf('#%02X%02X%02X', r + 20, g, b) END AS hex FROM colours",
    "colour_from_hex": f"WITH {COLOURS_SQL} SELECT colour_id, r, g, b FROM colours",
    "hsl_convert": f"WITH {COLOURS_SQL}, {_HSL} SELECT colour_id, round(h, 6) AS h, round(s, 6) AS s, round(l, 6) AS l FROM q",
    "colour_variants": f"WITH {COLOURS_SQL} SELECT colour_id, {_MIX((0, 0, 0))} AS shades, {_MIX((255, 255, 255))} AS tints FROM colours",
    "palette_hash": f"WITH {PALETTE_SQL} SELECT theme, substr(md5(string_agg(printf('#%02X%02X%02X', r, g, b), '' ORDER BY idx)), 1, 16) AS palette_hash FROM pal GROUP BY theme",
    "prompt_build": f"WITH {_FILES} SELECT doc_id, 'Read.{T.MARKDOWN}' || CASE WHEN doc_id % 5 = 0 THEN '{T.FIRST % '5-page'}' ELSE '{T.LATER.split('%s')[0]}' || (1 + doc_id % 5) || '{T.LATER.split('%s')[1]}5 total pages{T.LATER.split('%s')[2]}' END || ' Be brief.' AS prompt FROM f",
    "page_name": "SELECT conv_id AS original_index, turn AS page_index, 'doc' || conv_id || '-page-' || (turn + 1) || '-of-' || count(*) OVER (PARTITION BY conv_id) AS name FROM conversations",
    "page_slice": "SELECT conv_id AS original_index, turn AS page_index, text FROM conversations WHERE turn >= 1 AND turn < 3",
    "stitch_text": "SELECT conv_id AS original_index, string_agg(text, chr(10) || chr(10) || ' --- ' || chr(10) || chr(10) ORDER BY turn) AS text, count(*) AS n_pages FROM conversations GROUP BY conv_id",
    "fail_gate": "SELECT count(*) FILTER (conv_id % 7 = 0) AS failed, count(*) FILTER (conv_id % 7 <> 0) AS completed, count(*) FILTER (conv_id % 7 = 0) = 0 AS may_save FROM conversations",
    "url_extension": "SELECT page_id, regexp_extract(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '(\\.[^./]*)$', 1) AS ext FROM pages",
    "file_size_text": "WITH f AS (SELECT doc_id, n_chars * n_chars AS n FROM documents) SELECT doc_id, CASE WHEN n >= 1073741824 THEN printf('%.1f GB', n/1073741824.0::DOUBLE) WHEN n >= 1048576 THEN printf('%.1f MB', n/1048576.0::DOUBLE) WHEN n >= 1024 THEN printf('%.1f KB', n/1024.0::DOUBLE) ELSE n || ' B' END AS size FROM f",
    "compress_strategy": "SELECT p_partkey, ['pngquant-png', 'lossyjpeg-jpeg', 'lossyjpg-jpg', 'lossywebp-webp', 'lossyavif-avif'][p_partkey % 5 + 1] AS strategy FROM part",
    "feed_first_images": """WITH p AS (SELECT conv_id AS feed_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, turn, length(text) AS n FROM conversations),
k AS (SELECT feed_id, min(pos) AS pos FROM p WHERE (turn + n) % 3 <> 0 AND n % 4 <> 0 AND n % 5 <> 0 GROUP BY feed_id)
SELECT feed_id, cast(k.pos AS INT) AS pos, CASE WHEN turn % 2 = 0 THEN 'https://b/' || turn || '.png' ELSE 'https://a/' || feed_id || '/' || turn || '.png' END AS image_url FROM k JOIN p USING (feed_id, pos)""",
    "option_merge": "SELECT c_custkey, cast(CASE WHEN c_nationkey % 3 = 0 THEN 4096 ELSE c_nationkey % 3 END AS INT) AS max_tokens FROM customer",
    "output_extension": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'webp' WHEN doc_id % 2 = 0 THEN 'jpg' ELSE 'png' END AS ext, 'a/b.c.avif' AS replaced FROM documents",
    "base64_round_trip_whole": "SELECT doc_id, to_base64(encode(text)) AS b64, text FROM documents",
}
