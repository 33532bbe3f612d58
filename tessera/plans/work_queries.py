"""Queries over work plans, options and recogniser answers, with their SQL forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.derive import pages_text, read
from ..sources.work import plan, plan_together

STAMP = "20240101-120000"


def _pick(n, *values):
    """One of the values by the remainder of a number; None gives null."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (n % len(values) + 1).cast("int"))


def _pick_sql(n, *values):
    return f"[{', '.join('NULL' if v is None else repr(v) for v in values)}][cast({n} % {len(values)} + 1 AS INT)]"


COMMANDS = ("convert", "ocr", "gradient", "convert")
INPUTS = ("/in/a.b.PNG", "/in/sub/c.pdf", "/in/noext", "in.dir/d.webp")
FLAGS = (None, "", None, "jpg", None, "bmp")
TARGETS = (None, "out.dir/x.avif", "elsewhere", "-", None)


def _units(s, d):
    k = F.col("p_partkey")
    command = _pick(k, *COMMANDS)
    source = F.when(command == "gradient", "none").when(k % 7 == 0, "stdin").otherwise("file")
    return read(s, d, "part").select(
        k.alias("op_id"), command.alias("command"), source.alias("source"), F.when(source == "file", _pick(k, *INPUTS)).alias("input"),
        _pick(k, *FLAGS).alias("flag"), _pick(k, *TARGETS).alias("destination"), F.lit(STAMP).alias("stamp"), (k % 3 == 0).alias("several"),
    )


def _together(s, d):
    k = F.col("p_partkey")
    units = read(s, d, "part").select(
        F.expr("p_partkey div 4").alias("op_id"), _pick(F.expr("p_partkey div 4"), "gif", "stack").alias("command"), F.format_string("/in/%d.png", k).alias("input"),
        _pick(F.expr("p_partkey div 8"), None, "webp").alias("flag"), _pick(F.expr("p_partkey div 16"), *TARGETS).alias("destination"), F.lit(STAMP).alias("stamp"),
    )
    return plan_together(units)


LAYOUTS = ("horizontal", " Vertical", "2x3", "02X4", "0x3", "2x", "axb", "2x3x4")
DIMS = ("1920x1080", "1x2", "x3", "12", "-1x2", "7x8x9")


def _layouts(s, d):
    got = T.parse_layout(_pick(F.col("p_partkey"), *LAYOUTS))
    return read(s, d, "part").select("p_partkey", F.coalesce(got["mode"], F.lit("malformed")).alias("mode"), F.coalesce(got["rows"], F.lit(-1)).alias("rows"), F.coalesce(got["cols"], F.lit(-1)).alias("cols"))


def _dims(s, d):
    got = T.parse_dims(_pick(F.col("p_partkey"), *DIMS))
    return read(s, d, "part").select("p_partkey", F.coalesce(got["w"], F.lit(-1)).alias("w"), F.coalesce(got["h"], F.lit(-1)).alias("h"))


def _errors(s, d):
    rows = read(s, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("pos"), F.when(F.col("l_returnflag") == "R", F.format_string("part %d failed", "l_partkey")).alias("error"))
    return T.error_list(rows, ["l_orderkey"])


def _compress(s, d):
    k = F.col("p_partkey")
    got = T.resolve_strategy(_pick(k, "png", "jpg", "avif", "bmp", "webp"), _pick(k, None, "losslesspng", "lossyjpg", ""), F.when(k % 3 == 0, k.cast("int") % 100), F.when(k % 4 == 0, 7))
    return read(s, d, "part").select(k, got["key"].alias("key"), got["quality"].alias("quality"), got["speed"].alias("speed"), got["error"].isNotNull().alias("failed"))


def _mistral(s, d):
    """A page-wise answer for every conversation, read back."""
    turns = read(s, d, "conversations")
    image = F.array(F.struct(F.format_string("img-%d", "turn").alias("id"), F.lit(1).alias("top_left_x")))
    page = F.struct(F.col("turn").cast("int").alias("index"), F.col("text").alias("markdown"), F.when(F.col("turn") % 2 == 0, image).alias("images"))
    answer = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", page.alias("p")))).alias("t"))
    usage = F.create_map(F.lit("pages_processed"), F.size("t").cast("string"), F.lit("doc_size_bytes"), F.lit("7"))
    answer = answer.select("conv_id", F.to_json(F.struct(F.col("t.p").alias("pages"), F.lit("ocr-1").alias("model"), usage.alias("usage_info"))).alias("answer"))
    got = T.mistral_result(F.col("answer"))
    meta = F.array_join(F.transform(F.array_sort(F.map_entries(got["metadata"])), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return answer.select("conv_id", got["text"].alias("text"), F.size(got["images"]).alias("n_images"), meta.alias("metadata"))


MODELS = ("", "easyocr", "smoldocling", "my-docling-2")


def _options(s, d):
    k = F.col("p_partkey")
    merged = {"ocr": (k % 2 == 0), "force_ocr": F.when(k % 3 == 0, True), "pipeline": F.lit("standard"), "pdf_backend": F.lit(""), "device": _pick(k, "cpu", None)}
    options = T.document_options(merged, _pick(k, *MODELS), _pick(k, "", "en"), _pick(k, "md", "txt", "text"))
    return read(s, d, "part").select(k, options.alias("options"))


def _option_map(s, d):
    entries = F.transform(F.array_sort(F.map_entries("options")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return _options(s, d).select("p_partkey", F.array_join(entries, ",").alias("options"))


def _option_args(s, d):
    return _options(s, d).select("p_partkey", F.array_join(T.option_args(F.col("options")), " ").alias("args"))


def _settings(s, d):
    c = F.col("c_custkey")
    got = T.resolve_setting(F.when(c % 2 == 0, c % 50), F.when(c % 3 == 0, c % 9), F.lit(10))
    return read(s, d, "customer").select("c_custkey", got.cast("long").alias("workers"))


PROVIDERS = ("docling", "mistral", "oc", "gemini", "tesseract", "nobody")


def _native(s, d):
    k = F.col("p_partkey")
    return read(s, d, "part").select(k, T.reads_pdf(_pick(k, *PROVIDERS), F.when(k % 4 == 2, True)).alias("native"))


def _documents(s, d):
    pages = pages_text(s, d).groupBy("original_index").agg(F.array_sort(F.collect_list(F.struct("page_index", "text"))).alias("p"))
    return pages.select("original_index", F.format_string("doc%d", "original_index").alias("filename"), F.col("p.text").alias("pages"), (F.col("original_index") % 3 == 0).alias("native"))


def _results(s, d):
    c = F.col("original_index")
    failed = ((c + F.col("page_index")) % 5 == 0) | (c % 11 == 0)
    return pages_text(s, d).withColumns({"error": F.when(failed, "unreadable"), "metadata": F.create_map(F.lit("page"), F.col("page_index").cast("string"))})


def _stitched(s, d):
    return T.stitch_results(_results(s, d)).select("original_index", "text", F.col("metadata")["page"].alias("first_page"), "n_pages")


def _saved(s, d):
    blanked = pages_text(s, d).withColumn("text", F.when(F.col("page_index") % 3 == 0, "").when(F.col("page_index") % 3 == 1, F.col("text")))
    return T.nonempty_texts(blanked)


QUERIES = {
    "work_plan": lambda s, d: plan(_units(s, d)),
    "work_plan_together": _together,
    "layout_parse": _layouts,
    "dims_parse": _dims,
    "error_list": _errors,
    "compress_resolve": _compress,
    "mistral_result": _mistral,
    "document_options": _option_map,
    "option_args": _option_args,
    "setting_resolve": _settings,
    "native_pdf": _native,
    "expand_pages": lambda s, d: T.expand_pages(_documents(s, d)),
    "stitch_results": _stitched,
    "save_text": _saved,
}

_EXT = r"regexp_extract({}, '\.([^./]*)$', 1)"
_BASE = "regexp_extract({}, '([^/]*)/*$', 1)"

SQL = {
    "work_plan": f"""WITH u0 AS (SELECT p_partkey AS op_id, {_pick_sql('p_partkey', *COMMANDS)} AS command, p_partkey AS k FROM part),
u AS (SELECT op_id, command, CASE WHEN command = 'gradient' THEN 'none' WHEN k % 7 = 0 THEN 'stdin' ELSE 'file' END AS source, {_pick_sql('k', *INPUTS)} AS i0, {_pick_sql('k', *FLAGS)} AS flag, {_pick_sql('k', *TARGETS)} AS dest, k % 3 = 0 AS several FROM u0),
v AS (SELECT *, CASE WHEN source = 'file' THEN i0 END AS input FROM u),
w AS (SELECT *, coalesce(nullif(flag, ''), nullif({_EXT.format('dest')}, ''), CASE WHEN command = 'ocr' THEN 'md' END, CASE WHEN source = 'file' THEN nullif({_EXT.format('input')}, '') END, CASE WHEN source <> 'file' THEN 'png' END) AS format FROM v),
n AS (SELECT *, CASE source WHEN 'none' THEN command || '-{STAMP}.' || format WHEN 'stdin' THEN 'img-{STAMP}.' || format ELSE regexp_replace({_BASE.format('input')}, '\\.[^./]*$', '') || '.' || format END AS name FROM w)
SELECT op_id, source, input, CASE WHEN dest = '-' AND NOT several THEN '-' WHEN dest LIKE '%.avif' AND NOT several THEN dest ELSE coalesce(dest, CASE WHEN command = 'ocr' THEN 'out/ocr' ELSE 'out' END) || '/' || name END AS output, format,
 CASE WHEN format IS NULL THEN 'extension not found' WHEN format NOT IN ('png','jpg','jpeg','webp','avif','pdf','gif','md','txt') THEN 'unknown format: ' || format END AS error FROM n""",
    "work_plan_together": f"""WITH u AS (SELECT p_partkey // 4 AS op_id, {_pick_sql('p_partkey // 4', 'gif', 'stack')} AS command, '/in/' || p_partkey || '.png' AS input, {_pick_sql('p_partkey // 8', None, 'webp')} AS flag, {_pick_sql('p_partkey // 16', *TARGETS)} AS dest FROM part),
v AS (SELECT *, coalesce(flag, CASE WHEN command = 'gif' THEN 'gif' ELSE 'png' END) AS own FROM u)
SELECT op_id, 'file' AS source, input, CASE WHEN dest = '-' THEN '-' WHEN dest LIKE '%.avif' THEN dest ELSE coalesce(dest, CASE WHEN command = 'gif' THEN 'out/gifs' ELSE 'out' END) || '/' || command || '-{STAMP}.' || own END AS output,
 CASE WHEN dest LIKE '%.avif' THEN 'avif' ELSE own END AS format, NULL::VARCHAR AS error FROM v""",
    "layout_parse": f"""WITH l AS (SELECT p_partkey, lower(trim({_pick_sql('p_partkey', *LAYOUTS)})) AS t FROM part), g AS (SELECT *, t IN ('2x3', '02x4') AS ok FROM l)
SELECT p_partkey, CASE WHEN t IN ('horizontal', 'vertical') THEN t WHEN ok THEN 'grid' ELSE 'malformed' END AS mode, CASE WHEN t IN ('horizontal', 'vertical') THEN 0 WHEN ok THEN 2 ELSE -1 END AS rows, CASE WHEN t IN ('horizontal', 'vertical') THEN 0 WHEN t = '2x3' THEN 3 WHEN ok THEN 4 ELSE -1 END AS cols FROM g""",
    "dims_parse": f"""WITH l AS (SELECT p_partkey, {_pick_sql('p_partkey', *DIMS)} AS t FROM part), g AS (SELECT *, regexp_matches(t, '^[0-9]+x[0-9]+$') AS ok FROM l)
SELECT p_partkey, CASE WHEN ok THEN cast(split_part(t, 'x', 1) AS INT) ELSE -1 END AS w, CASE WHEN ok THEN cast(split_part(t, 'x', 2) AS INT) ELSE -1 END AS h FROM g""",
    "error_list": "SELECT l_orderkey, string_agg('part ' || l_partkey || ' failed', chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) || chr(10) AS errors FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey",
    "compress_resolve": f"""WITH u AS (SELECT p_partkey, {_pick_sql('p_partkey', 'png', 'jpg', 'avif', 'bmp', 'webp')} AS fmt, nullif({_pick_sql('p_partkey', None, 'losslesspng', 'lossyjpg', '')}, '') AS name FROM part),
k AS (SELECT *, coalesce(name, CASE fmt WHEN 'png' THEN 'pngquant' WHEN 'jpg' THEN 'lossyjpg' WHEN 'avif' THEN 'lossyavif' WHEN 'webp' THEN 'lossywebp' END) || '-' || fmt AS key FROM u),
g AS (SELECT *, fmt <> 'bmp' AND key IN ('pngquant-png', 'losslesspng-png', 'lossyjpg-jpg', 'lossyavif-avif', 'lossywebp-webp') AS ok FROM k)
SELECT p_partkey, CASE WHEN ok THEN key END AS key, cast(CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 100 WHEN fmt = 'avif' THEN 55 ELSE 80 END AS INT) AS quality, CASE WHEN p_partkey % 4 = 0 THEN 7 ELSE 4 END AS speed, NOT ok AS failed FROM g""",
    "mistral_result": "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text, cast(count(*) FILTER (turn % 2 = 0) AS INT) AS n_images, 'doc_size_bytes=7,model=ocr-1,pages_processed=' || count(*) AS metadata FROM conversations GROUP BY conv_id",
    "document_options": f"""WITH u AS (SELECT p_partkey AS k, {_pick_sql('p_partkey', *MODELS)} AS m FROM part), v AS (SELECT *, m IN ('smoldocling', 'my-docling-2') AS vlm FROM u)
SELECT k AS p_partkey, 'device=' || CASE WHEN k % 2 = 0 THEN 'cpu' ELSE '' END || ',force_ocr=' || (k % 3 = 0)::VARCHAR || ',ocr=' || (k % 2 = 0)::VARCHAR || CASE WHEN m = 'easyocr' THEN ',ocr_engine=easyocr' ELSE '' END || CASE WHEN k % 2 = 1 THEN ',ocr_lang=en' ELSE '' END
 || ',pdf_backend=' || ',pipeline=' || CASE WHEN vlm THEN 'vlm' ELSE 'standard' END || CASE k % 3 WHEN 0 THEN ',to=md' WHEN 2 THEN ',to=text' ELSE '' END || CASE WHEN vlm THEN ',vlm_model=' || m ELSE '' END AS options FROM v""",
    "option_args": f"""WITH u AS (SELECT p_partkey AS k, {_pick_sql('p_partkey', *MODELS)} AS m FROM part), v AS (SELECT *, m IN ('smoldocling', 'my-docling-2') AS vlm FROM u)
SELECT k AS p_partkey, ltrim(CASE WHEN k % 2 = 0 THEN '--device cpu' ELSE '' END || CASE WHEN k % 3 = 0 THEN ' --force-ocr' ELSE ' --no-force-ocr' END || CASE WHEN k % 2 = 0 THEN ' --ocr' ELSE ' --no-ocr' END || CASE WHEN m = 'easyocr' THEN ' --ocr-engine easyocr' ELSE '' END || CASE WHEN k % 2 = 1 THEN ' --ocr-lang en' ELSE '' END
 || ' --pipeline ' || CASE WHEN vlm THEN 'vlm' ELSE 'standard' END || CASE k % 3 WHEN 0 THEN ' --to md' WHEN 2 THEN ' --to text' ELSE '' END || CASE WHEN vlm THEN ' --vlm-model ' || m ELSE '' END) AS args FROM v""",
    "setting_resolve": "SELECT c_custkey, cast(CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 50 WHEN c_custkey % 3 = 0 THEN c_custkey % 9 ELSE 10 END AS BIGINT) AS workers FROM customer",
    "native_pdf": f"WITH u AS (SELECT p_partkey, {_pick_sql('p_partkey', *PROVIDERS)} AS p FROM part) SELECT p_partkey, CASE WHEN p IN ('docling', 'mistral') THEN true WHEN p = 'oc' THEN p_partkey % 4 = 2 WHEN p <> 'nobody' THEN false END AS native FROM u",
    "expand_pages": """SELECT conv_id AS original_index, turn AS page_index, 'doc' || conv_id || '-page-' || (turn + 1) || '-of-' || count(*) OVER (PARTITION BY conv_id) AS filename, text AS content FROM conversations WHERE conv_id % 3 <> 0
UNION ALL SELECT conv_id, -1, 'doc' || conv_id, string_agg(text, chr(10) ORDER BY turn) FROM conversations WHERE conv_id % 3 = 0 GROUP BY conv_id""",
    "stitch_results": "SELECT conv_id AS original_index, string_agg(text, chr(10) || chr(10) || ' --- ' || chr(10) || chr(10) ORDER BY turn) AS text, cast(min(turn) AS VARCHAR) AS first_page, count(*) AS n_pages FROM conversations WHERE (conv_id + turn) % 5 <> 0 AND conv_id % 11 <> 0 GROUP BY conv_id",
    "save_text": "SELECT conv_id AS original_index, turn AS page_index, text FROM conversations WHERE turn % 3 = 1 AND text <> ''",
}
