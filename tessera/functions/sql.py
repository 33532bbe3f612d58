"""The colour, path and page functions as SQL functions, and table functions over views.

``register(spark)`` creates temporary functions whose bodies are SQL, so that Catalyst inlines
them; ``views(spark, sf_dir)`` creates the views that the table functions read. Each function
gives the values of its DataFrame form in ``functions.colour`` and ``functions.text``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources import derive
from . import tables
from .text import SEPARATOR

#: name and parameters, returned type, body
SCALARS = (
    ("colour_hex(r INT, g INT, b INT)", "STRING", "format_string('#%02X%02X%02X', r, g, b)"),
    ("colour_channels(h STRING)", "STRUCT<r: INT, g: INT, b: INT, a: INT>",
     "CASE WHEN h RLIKE '^#[0-9A-Fa-f]{6}$' THEN named_struct('r', CAST(conv(substr(h, 2, 2), 16, 10) AS INT), 'g', CAST(conv(substr(h, 4, 2), 16, 10) AS INT), 'b', CAST(conv(substr(h, 6, 2), 16, 10) AS INT), 'a', 255) END"),
    ("colour_format(t STRING)", "STRING", "CASE WHEN trim(t) LIKE '#%' THEN 'hex' WHEN trim(t) LIKE 'rgb%' THEN 'rgb' WHEN trim(t) LIKE 'hsl%' THEN 'hsl' WHEN trim(t) LIKE 'lab%' THEN 'lab' ELSE 'unknown' END"),
    ("colour_grey(r INT, g INT, b INT)", "INT", "CAST(floor(0.299D * r + 0.587D * g + 0.114D * b) AS INT)"),
    ("colour_distance(r1 INT, g1 INT, b1 INT, r2 INT, g2 INT, b2 INT)", "INT", "(r1 - r2) * (r1 - r2) + (g1 - g2) * (g1 - g2) + (b1 - b2) * (b1 - b2)"),
    ("url_extension(url STRING)", "STRING", r"regexp_extract(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '(\\.[^./]*)$', 1)"),
    ("replace_extension(path STRING, ext STRING)", "STRING", r"concat(regexp_replace(path, '\\.[^./]*$', ''), '.', regexp_replace(ext, '^\\.', ''))"),
    ("file_size(n BIGINT)", "STRING",
     "CASE WHEN n >= 1073741824 THEN format_string('%.1f GB', bround(n / 1073741824D, 1)) WHEN n >= 1048576 THEN format_string('%.1f MB', bround(n / 1048576D, 1)) "
     "WHEN n >= 1024 THEN format_string('%.1f KB', bround(n / 1024D, 1)) ELSE format_string('%d B', n) END"),
    ("page_file_name(file STRING, page_index BIGINT, total BIGINT)", "STRING", "format_string('%s-page-%d-of-%d', file, page_index + 1, total)"),
)
#: name and parameters, returned columns, body over the views
TABLES = (
    ("theme_colours(wanted STRING)", "idx INT, r INT, g INT, b INT, hex STRING", "SELECT idx, r, g, b, colour_hex(r, g, b) FROM tessera_themes WHERE theme = lower(wanted)"),
    ("pages_of(document BIGINT)", "page_index BIGINT, text STRING", "SELECT page_index, text FROM tessera_pages WHERE original_index = document"),
    ("stitched()", "original_index BIGINT, text STRING, n_pages BIGINT",
     f"SELECT original_index, array_join(transform(array_sort(collect_list(struct(page_index, text))), p -> p.text), {SEPARATOR!r}), count(*) FROM tessera_pages GROUP BY original_index"),
)


def register(spark: SparkSession) -> None:
    """Create the functions in this session; the views of ``views`` must be there."""
    tables.register(spark)
    for head, kind, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    for head, columns, body in TABLES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS TABLE({columns}) RETURN {body}")


def views(spark: SparkSession, sf_dir: str) -> None:
    """Views over the tables of a folder: tessera_px, tessera_colours, tessera_pages, tessera_themes, tessera_urls."""
    derive.px(spark, sf_dir).createOrReplaceTempView("tessera_px")
    derive.colours(spark, sf_dir).createOrReplaceTempView("tessera_colours")
    derive.pages_text(spark, sf_dir).createOrReplaceTempView("tessera_pages")
    derive.themes(spark).createOrReplaceTempView("tessera_themes")
    derive.read(spark, sf_dir, "pages").select("page_id", "url").createOrReplaceTempView("tessera_urls")


def run(spark: SparkSession, sf_dir: str, query: str):
    """A query with the functions and views of a folder."""
    views(spark, sf_dir)
    register(spark)
    return spark.sql(query)
