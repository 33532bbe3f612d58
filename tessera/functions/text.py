"""Text, path and option functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The wording of the prompts and the page separator.
PLAIN = "Format the output in plain text"
MARKDOWN = " Format the output in Markdown."
FIRST = " This is the FIRST PAGE of a %s document. Use top-level headings (# and ##) as appropriate for a document beginning."
LATER = " This is PAGE %s of %s (NOT the first page). Assume this document has already started with main headings on previous pages. Use continuation-level headings (##) unless you see clear evidence this page starts a major new section."
SEPARATOR = "\n\n --- \n\n"
# The default compression of each format.
STRATEGIES = {"png": "pngquant", "jpeg": "lossyjpeg", "jpg": "lossyjpg", "webp": "lossywebp", "avif": "lossyavif"}


def page_context(filename: Column) -> Column:
    """What a prompt says about the page that a file name tells."""
    parts = F.split(filename, "-page-")
    info = F.when(F.size(parts) == 2, parts[1])
    number = F.split(info, "-of-")[0]
    total = F.when(info.contains("-of-"), F.split(info, "-of-")[1])
    has_total = F.coalesce(total, F.lit("")) != ""
    first = F.format_string(FIRST, F.when(has_total, F.concat(total, F.lit("-page"))).otherwise("multi-page"))
    later = F.format_string(LATER, number, F.when(has_total, F.concat(total, F.lit(" total pages"))).otherwise("a multi-page document"))
    return F.when(info.isNull(), "").when(number == "1", first).otherwise(later)


def build_prompt(base: Column, extra: Column, filename: Column, fmt: str) -> Column:
    start = F.concat(base, F.lit(PLAIN)) if fmt == "txt" else F.concat(base, F.lit(MARKDOWN), page_context(filename))
    return F.when(F.coalesce(extra, F.lit("")) != "", F.concat(start, F.lit(" "), extra)).otherwise(start)


def url_extension(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def file_size(n: Column) -> Column:
    """Size in B, KB, MB or GB; ties round to even."""
    kb, mb, gb = 1024, 1024**2, 1024**3
    return (
        F.when(n >= gb, F.format_string("%.1f GB", F.bround(n / F.lit(float(gb)), 1))).when(n >= mb, F.format_string("%.1f MB", F.bround(n / F.lit(float(mb)), 1)))
        .when(n >= kb, F.format_string("%.1f KB", F.bround(n / F.lit(float(kb)), 1))).otherwise(F.format_string("%d B", n))
    )


def strategy(fmt: Column, name: Column | None = None) -> Column:
    """Key ``<name>-<format>``; without a name the format's default."""
    default = F.create_map(*[F.lit(x) for kv in STRATEGIES.items() for x in kv])[fmt]
    own = default if name is None else F.coalesce(F.nullif(name, F.lit("")), default)
    return F.concat(own, F.lit("-"), fmt)


def replace_ext(path: Column, ext: str) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit("." + ext))


def replace_ext_column(path: Column, ext: Column) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit("."), F.regexp_replace(ext, r"^\.", ""))


def output_ext(flag: Column, output: Column, path: Column) -> Column:
    """The flag, else the output's extension, else the input's, else png."""
    ext = lambda c: F.nullif(F.lower(F.regexp_extract(c, r"\.([^./]+)$", 1)), F.lit(""))
    return F.coalesce(F.nullif(flag, F.lit("")), ext(output), ext(path), F.lit("png"))


# ---- pages --------------------------------------------------------------

def page_slice(pages: DataFrame, skip: int, most: int = 0) -> DataFrame:
    """Pages from ``skip`` on, at most ``most`` of them (0: all)."""
    if skip < 0 or most < 0:
        raise ValueError("skip and most must not be negative")
    kept = pages.filter(F.col("page_index") >= skip)
    return kept.filter(F.col("page_index") < skip + most) if most else kept


def page_names(pages: DataFrame) -> DataFrame:
    total = pages.groupBy("original_index").agg(F.count("*").alias("total"))
    name = F.format_string("doc%d-page-%d-of-%d", "original_index", F.col("page_index") + 1, "total")
    return pages.join(total, "original_index").select("original_index", "page_index", name.alias("name"))


def stitch(pages: DataFrame) -> DataFrame:
    """Texts of a document's pages in page order, joined by the separator."""
    got = pages.groupBy("original_index").agg(F.array_sort(F.collect_list(F.struct("page_index", "text"))).alias("p"))
    return got.select("original_index", F.array_join(F.col("p.text"), SEPARATOR).alias("text"), F.size("p").cast("long").alias("n_pages"))


def fail_gate(results: DataFrame) -> DataFrame:
    """Counts, and whether the run may be saved: only without any error."""
    return results.agg(
        F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if(F.col("error").isNull()).alias("completed"),
        (F.count_if(F.col("error").isNotNull()) == 0).alias("may_save"),
    )


def merge_options(df: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Options that are null or zero take their default."""
    return df.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(v)) for c, v in defaults.items()})


# ---- checks that a caller can gate on -----------------------------------

IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "webp", "avif")
TEXT_EXTENSIONS = ("pdf",)


def _ext(path: Column) -> Column:
    """What follows the last dot of the last part of a path, or null."""
    return F.nullif(F.regexp_extract(path, r"\.([^./]*)$", 1), F.lit(""))


def resolve_ext(flag: Column, output: Column, command: Column, source: Column, path: Column) -> Column:
    """Extension of an output: the flag, else the output's, else md for ocr, else the
    input's, else png for a stream or a generator; null where none is found."""
    named = F.coalesce(F.nullif(flag, F.lit("")), _ext(output))
    return F.coalesce(named, F.when(command == "ocr", "md"), F.when(source == "file", _ext(path)), F.when(source.isin("stdin", "none"), "png"))


def ext_error(ext: Column) -> Column:
    """A message where no extension was found or the format is unknown."""
    known = (*IMAGE_EXTENSIONS, *TEXT_EXTENSIONS, "gif", "md", "txt")
    return F.when(ext.isNull(), "extension not found").when(~ext.isin(*known), F.concat(F.lit("unknown format: "), ext))


def is_stdout(output: Column) -> Column:
    return F.coalesce(output.isin("-", "/dev/stdout"), F.lit(False))


def parse_dims(text: Column) -> Column:
    """Struct w, h of ``WxH``; null where malformed."""
    part = [F.nullif(F.regexp_extract(text, r"^(\d{1,9})x(\d{1,9})$", i), F.lit("")).cast("int") for i in (1, 2)]
    return F.when(part[0].isNotNull(), F.struct(part[0].alias("w"), part[1].alias("h")))


def parse_layout(text: Column) -> Column:
    """Struct mode, rows, cols of ``horizontal``, ``vertical`` or ``NxM`` with positive
    numbers; null where malformed."""
    t = F.lower(F.trim(text))
    part = [F.nullif(F.regexp_extract(t, r"^\+?0*([1-9]\d{0,8})x\+?0*([1-9]\d{0,8})$", i), F.lit("")).cast("int") for i in (1, 2)]
    struct = lambda mode, rows, cols: F.struct(mode.alias("mode"), rows.alias("rows"), cols.alias("cols"))
    plain = F.when(t.isin("horizontal", "vertical"), struct(t, F.lit(0), F.lit(0)))
    return F.coalesce(plain, F.when(part[0].isNotNull(), struct(F.lit("grid"), part[0], part[1])))


def error_list(errors: DataFrame, by: list[str]) -> DataFrame:
    """All messages of a group, each ended by a line break, in order of ``pos``."""
    got = errors.filter("error is not null").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "error"))).alias("e"))
    return got.select(*by, F.concat(F.array_join("e.error", "\n"), F.lit("\n")).alias("errors"))


# Strategies, and the quality and speed that they start from.
LOSSLESS = ("losslesspng-png",)
QUALITY, AVIF_QUALITY, SPEED = 80, 55, 4


def resolve_strategy(fmt: Column, name: Column, quality: Column, speed: Column) -> Column:
    """Struct key, quality, speed, error of a compression: the named or default strategy
    of a format; an error where the two don't go together."""
    key = strategy(fmt, name)
    known = [f"{s}-{f}" for f, s in STRATEGIES.items()] + list(LOSSLESS)
    error = F.when(~F.coalesce(fmt.isin(*STRATEGIES), F.lit(False)), F.concat(F.lit("no strategy for format "), F.coalesce(fmt, F.lit("null")))).when(
        ~key.isin(*known), F.concat(F.lit("strategy "), name, F.lit(" is not available for format "), fmt)
    )
    q = F.coalesce(quality, F.when(fmt == "avif", AVIF_QUALITY).otherwise(QUALITY))
    return F.struct(F.when(error.isNull(), key).alias("key"), q.alias("quality"), F.coalesce(speed, F.lit(SPEED)).alias("speed"), error.alias("error"))


# ---- shapes of recogniser answers ---------------------------------------

MISTRAL = (
    "pages array<struct<index: int, markdown: string, images: array<struct<id: string, top_left_x: int, top_left_y: int, bottom_right_x: int, "
    "bottom_left_x: int, image_base64: string>>, dimensions: struct<dpi: int, height: int, width: int>>>, model string, usage_info map<string, string>"
)


def mistral_result(answer: Column) -> Column:
    """Struct text, images, metadata of a page-wise JSON answer: texts joined by blank
    lines, images of all pages in order, usage figures and the model's name; null
    where it is no such answer."""
    r = F.from_json(answer, MISTRAL)
    usage = F.map_filter(F.coalesce(r["usage_info"], F.create_map().cast("map<string,string>")), lambda k, v: k != "model")
    model = F.create_map(F.lit("model"), F.coalesce(r["model"], F.lit("")))
    # usage figures come last, so one named "model" wins
    named = F.map_filter(F.coalesce(r["usage_info"], F.create_map().cast("map<string,string>")), lambda k, v: k == "model")
    metadata = F.map_concat(usage, F.when(F.size(named) > 0, named).otherwise(model))
    images = F.flatten(F.transform(r["pages"], lambda p: F.coalesce(p["images"], F.array())))
    return F.when(r["pages"].isNotNull(), F.struct(F.array_join(F.transform(r["pages"], lambda p: F.coalesce(p["markdown"], F.lit(""))), "\n\n").alias("text"), images.alias("images"), metadata.alias("metadata")))


def document_options(merged: dict[str, Column], model: Column, language: Column, fmt: Column) -> Column:
    """Map of a document converter's options: given ones over defaults (``merged``),
    truth values as text, and what model, language and format ask for."""
    flags = ("ocr", "force_ocr", "abort_on_error")
    vlm = model.isin("smoldocling", "granite_vision", "granite_vision_ollama") | model.contains("docling")
    values = {k: (F.coalesce(v.cast("boolean"), F.lit(False)) if k in flags else F.coalesce(v, F.lit(""))).cast("string") for k, v in merged.items()}
    values["pipeline"] = F.when(vlm, "vlm").otherwise(values.get("pipeline", F.lit("")))
    values["to"] = F.when(fmt.isin("md", "text"), fmt)
    values["vlm_model"] = F.when(vlm, model)
    values["ocr_engine"] = F.when((model != "") & ~vlm, model)
    values["ocr_lang"] = F.nullif(language, F.lit(""))
    every = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])
    return F.map_filter(every, lambda k, v: v.isNotNull())


def option_args(options: Column) -> Column:
    """Command-line words of an options map, in order of the options' names."""
    def words(e: Column) -> Column:
        flag = F.concat(F.lit("--"), F.lower(F.translate(e["key"], "_", "-")))
        off = F.when(e["key"].isin("ocr", "force_ocr"), F.array(F.concat(F.lit("--no-"), F.translate(e["key"], "_", "-")))).otherwise(F.array().cast("array<string>"))
        return F.when(e["value"] == "", F.array().cast("array<string>")).when(e["value"] == "true", F.array(flag)).when(e["value"] == "false", off).otherwise(F.array(flag, e["value"]))

    return F.flatten(F.transform(F.array_sort(F.map_entries(options)), words))


def resolve_setting(flag: Column, schema: Column, default: Column) -> Column:
    """A changed flag wins over the named schema, which wins over the default."""
    return F.coalesce(flag, schema, default)


# Recognisers and whether they read PDFs themselves (null: by configuration).
NATIVE_PDF = {
    "docling": True, "mistral": True, "oc": None, "ollama": False, "vllm": False, "openai": False, "gemini": False, "openrouter": False, "tesseract": False,
}


def reads_pdf(provider: Column, configured: Column) -> Column:
    """Whether a recogniser takes PDFs whole; null for an unknown one."""
    known = F.create_map(*[x for k, v in NATIVE_PDF.items() if v is not None for x in (F.lit(k), F.lit(v))])
    return F.when(provider == "oc", F.coalesce(configured, F.lit(False))).otherwise(F.try_element_at(known, provider))


def expand_pages(documents: DataFrame) -> DataFrame:
    """Pages of documents (original_index, filename, pages: array of texts, native): a
    document that its recogniser reads whole stays one item (page_index -1), others
    become one item per page, named by number and total."""
    whole = documents.filter("native").select("original_index", F.lit(-1).cast("long").alias("page_index"), "filename", F.array_join("pages", "\n").alias("content"))
    split = documents.filter("not native").select("original_index", "filename", F.size("pages").alias("n"), F.posexplode("pages").alias("pos", "content"))
    name = F.format_string("%s-page-%d-of-%d", "filename", F.col("pos") + 1, "n")
    return whole.unionByName(split.select("original_index", F.col("pos").cast("long").alias("page_index"), name.alias("filename"), "content"))


def stitch_results(results: DataFrame) -> DataFrame:
    """One row per document of recognised pages (original_index, page_index, text, error,
    metadata): failed pages are left out, texts joined in page order, the first page's
    metadata kept; documents without any page left are gone."""
    good = results.filter("error is null")
    got = good.groupBy("original_index").agg(F.array_sort(F.collect_list(F.struct("page_index", "text", F.map_entries("metadata").alias("m")))).alias("p"))
    return got.select("original_index", F.array_join("p.text", SEPARATOR).alias("text"), F.map_from_entries(F.col("p")[0]["m"]).alias("metadata"), F.size("p").cast("long").alias("n_pages"))


def nonempty_texts(results: DataFrame) -> DataFrame:
    """What a text sink writes: results without text write nothing."""
    return results.filter("text is not null and text != ''")
