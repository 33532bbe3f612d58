"""Relations over the driver's tables: pixels, pages, colours, file names, palettes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SIDE = 50

# The published Nord colours, in their order (which decides ties).
NORD = (
    (46, 52, 64), (59, 66, 82), (67, 76, 94), (76, 86, 106), (216, 222, 233), (229, 233, 240), (236, 239, 244), (143, 188, 187),
    (136, 192, 208), (129, 161, 193), (94, 129, 172), (191, 97, 106), (208, 135, 112), (235, 203, 139), (163, 190, 140), (180, 142, 173),
)

# The published Solarized and Dracula colours, in their order.
SOLARIZED = (
    (0, 43, 54), (7, 54, 66), (88, 110, 117), (101, 123, 131), (131, 148, 150), (147, 161, 161), (238, 232, 213), (253, 246, 227),
    (181, 137, 0), (203, 75, 22), (220, 50, 47), (211, 54, 130), (108, 113, 196), (38, 139, 210), (42, 161, 152), (133, 153, 0),
)
DRACULA = (
    (40, 42, 54), (68, 71, 90), (248, 248, 242), (98, 114, 164), (139, 233, 253), (80, 250, 123), (255, 184, 108), (255, 121, 198),
    (189, 147, 249), (255, 85, 85), (241, 250, 140),
)
THEMES = {"nord": NORD, "solarized": SOLARIZED, "dracula": DRACULA}

PX_SQL = """px AS (SELECT event_id // 2500 AS img_id, cast(event_id % 50 AS INT) AS x, cast((event_id // 50) % 50 AS INT) AS y,
  cast((event_id * 37 + user_id * 11) % 256 AS INT) AS r, cast((event_id * 59 + user_id * 7) % 256 AS INT) AS g,
  cast((event_id * 83 + user_id * 3) % 256 AS INT) AS b, CASE WHEN event_id % 7 = 0 THEN 0 ELSE 255 END AS a FROM events)"""

#: the pixels with the size of their image: spx
SIZED_SQL = PX_SQL + """,
sizes AS (SELECT img_id, max(x) + 1 AS w, max(y) + 1 AS h FROM px GROUP BY img_id), spx AS (SELECT * FROM px JOIN sizes USING (img_id))"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50 x 50 images from events: img_id, x, y, r, g, b, a."""
    e = F.col("event_id")
    u = F.col("user_id")
    return read(spark, sf_dir, "events").select(
        F.expr("event_id div 2500").alias("img_id"), (e % SIDE).cast("int").alias("x"), F.expr("cast((event_id div 50) % 50 as int)").alias("y"),
        ((e * 37 + u * 11) % 256).cast("int").alias("r"), ((e * 59 + u * 7) % 256).cast("int").alias("g"),
        ((e * 83 + u * 3) % 256).cast("int").alias("b"), F.when(e % 7 == 0, 0).otherwise(255).alias("a"),
    )


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 float images from embeddings: img_id, x, y, v."""
    cells = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img_id"), F.posexplode("embedding").alias("pos", "v"))
    return cells.select("img_id", (F.col("pos") % 8).alias("x"), F.expr("pos div 8").cast("int").alias("y"), F.col("v").cast("double").alias("v"))


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return part.select(k.alias("colour_id"), (k % 256).cast("int").alias("r"), ((k * 7) % 256).cast("int").alias("g"), ((F.col("p_size") * 5) % 256).cast("int").alias("b"))


COLOURS_SQL = """colours AS (SELECT p_partkey AS colour_id, cast(p_partkey % 256 AS INT) AS r, cast((p_partkey * 7) % 256 AS INT) AS g,
  cast((p_size * 5) % 256 AS INT) AS b FROM part)"""


PART_THEMES = 4


def part_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Palettes of the parts' colours: theme, idx, r, g, b."""
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        F.concat(F.lit("t"), k % PART_THEMES).alias("theme"), F.expr(f"cast(p_partkey div {PART_THEMES} as int)").alias("idx"),
        (k * 13 % 256).cast("int").alias("r"), (k * 7 % 256).cast("int").alias("g"), (F.col("p_size") * 5 % 256).cast("int").alias("b"),
    )


PALETTE_SQL = f"""pal AS (SELECT 't' || (p_partkey % {PART_THEMES}) AS theme, cast(p_partkey // {PART_THEMES} AS INT) AS idx,
  cast(p_partkey * 13 % 256 AS INT) AS r, cast(p_partkey * 7 % 256 AS INT) AS g, cast(p_size * 5 % 256 AS INT) AS b FROM part)"""


def pages_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("original_index"), F.col("turn").alias("page_index"), "text")


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc"), d, F.lit(".pdf-page-"), 1 + d % 5, F.lit("-of-5")).alias("filename"), "n_chars")


def palette_from_json(spark: SparkSession, path: str) -> DataFrame:
    """(theme, idx, r, g, b, a) from theme files {name, colors: [#RRGGBB]}.

    Themes without a name or colours, and themes with a malformed colour, are left
    out; names are lower-cased.
    """
    raw = spark.read.schema("name string, colors array<string>").option("multiLine", True).json(path)
    good = raw.filter((F.trim("name") != "") & (F.size("colors") > 0) & F.forall("colors", lambda c: F.coalesce(c.rlike("^#[0-9A-Fa-f]{6}$"), F.lit(False))))
    rows = good.select(F.lower("name").alias("theme"), F.posexplode("colors").alias("idx", "hex"))
    part = lambda at: F.conv(F.substring("hex", at, 2), 16, 10).cast("int")
    return rows.select("theme", "idx", part(2).alias("r"), part(4).alias("g"), part(6).alias("b"), F.lit(255).alias("a"))


def merge_palettes(known: DataFrame, custom: DataFrame) -> DataFrame:
    """Add custom themes; a known name is never overridden."""
    return known.unionByName(custom.join(known.select("theme").distinct(), "theme", "left_anti"))


def themes(spark: SparkSession, *files: str) -> DataFrame:
    """(theme, idx, r, g, b, a) of the themes built in and of those in theme files (JSON)."""
    rows = [(name, i, *c, 255) for name, colours in THEMES.items() for i, c in enumerate(colours)]
    known = spark.createDataFrame(rows, "theme string, idx int, r int, g int, b int, a int")
    for path in files:
        known = merge_palettes(known, palette_from_json(spark, path))
    return known


def theme_list(known: DataFrame) -> DataFrame:
    """(theme, n_colours) in alphabetical order."""
    return known.groupBy("theme").agg(F.count("*").alias("n_colours")).orderBy("theme")


def theme_lookup(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (column name) with the theme's hex colours in order, or an error."""
    colours = known.groupBy("theme").agg(F.array_sort(F.collect_list(F.struct("idx", F.format_string("#%02X%02X%02X", "r", "g", "b").alias("hex")))).alias("c"))
    colours = colours.select("theme", F.col("c.hex").alias("colours"))
    found = wanted.join(colours, F.lower("name") == F.col("theme"), "left").drop("theme")
    return found.withColumn("error", F.when(F.col("colours").isNull(), "unknown theme"))


def themes_from_yaml(spark: SparkSession, path: str) -> DataFrame:
    """(theme, idx, r, g, b, a) of configuration files whose ``themes:`` is a list of
    entries that begin with ``- name:`` and list ``colors:`` one to a line. Entries
    without a name or colours, or with a malformed colour, are left out."""
    text = spark.read.text(path, wholetext=True).filter(F.col("value").rlike(r"(?m)^themes:\s*$"))
    body = F.regexp_extract("value", r"(?ms)^themes:\s*$(.*?)(?=^\S|\z)", 1)
    parts = F.split(body, r"(?m)^\s*-\s+name:")
    entry = text.select(F.explode(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).alias("e"))
    name = F.trim(F.regexp_extract("e", r"^[ \t]*[\"']?([^\"'\n]*)", 1))
    colours = F.regexp_extract_all("e", F.lit(r"(?m)^\s*-\s+[\"']?([^\"'\s]+)[\"']?\s*$"), 1)
    named = entry.select(F.lower(name).alias("theme"), colours.alias("colors")).filter((F.col("theme") != "") & (F.size("colors") > 0))
    good = named.filter(F.forall("colors", lambda c: c.rlike("^#[0-9A-Fa-f]{6}$")))
    rows = good.select("theme", F.posexplode("colors").alias("idx", "hex"))
    part = lambda at: F.conv(F.substring("hex", at, 2), 16, 10).cast("int")
    return rows.select("theme", "idx", part(2).alias("r"), part(4).alias("g"), part(6).alias("b"), F.lit(255).alias("a"))


def image_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("png", "jpg", "jpeg", "webp", "avif")) -> DataFrame:
    """(path, ext, length, content) of the image files under a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return found.select("path", ext.alias("ext"), "length", "content").filter(F.col("ext").isin(*extensions))


def first_wallpapers(feeds: DataFrame) -> DataFrame:
    """The first acceptable post of every feed (feed_id, json): feed_id, pos, image_url.
    Feeds without one, or that can't be parsed, give no row."""
    schema = "data struct<children: array<struct<data: struct<post_hint: string, url: string, url_overridden_by_dest: string, over_18: boolean, is_video: boolean>>>>"
    posts = feeds.select("feed_id", F.posexplode(F.from_json("json", schema)["data"]["children"]).alias("pos", "post"))
    d = F.col("post.data")
    url = F.coalesce(F.nullif(d["url_overridden_by_dest"], F.lit("")), F.nullif(d["url"], F.lit("")))
    ok = ~F.coalesce(d["over_18"], F.lit(False)) & ~F.coalesce(d["is_video"], F.lit(False)) & (d["post_hint"] == "image") & url.isNotNull()
    first = posts.filter(ok).groupBy("feed_id").agg(F.min(F.struct("pos", url.alias("image_url"))).alias("p"))
    return first.select("feed_id", "p.pos", "p.image_url")


def first_wallpaper(feed: DataFrame) -> DataFrame:
    """The first acceptable post of one feed (column json): pos, image_url."""
    return first_wallpapers(feed.select(F.lit(0).alias("feed_id"), "json")).drop("feed_id")
