"""Header feeds and logs derived from the driver tables, and the category dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADERS = """
SELECT l_orderkey % 8 AS group_id,
       l_orderkey * 10 + l_linenumber AS article_number,
       concat('m', l_orderkey, '.', l_linenumber, '.', l_partkey, '.', l_suppkey, '@x') AS message_id,
       concat('poster', o_custkey % 50, '@example.test') AS poster,
       l_shipdate AS posted_at,
       CAST(floor(l_extendedprice) AS BIGINT) AS bytes,
       CASE l_orderkey % 6
         WHEN 0 THEN concat('"', title, '.mkv" yEnc (', l_linenumber, '/', 2 + l_orderkey % 4, ')')
         WHEN 1 THEN concat('[', l_linenumber, '/', 3 + l_orderkey % 3, '] - "', title, '.part0', l_linenumber, '.rar" yEnc (1/1)')
         WHEN 2 THEN concat(title, ' [0', l_linenumber, '/05] - "file', l_linenumber, '.r0', l_linenumber, '" yEnc (1/9)')
         WHEN 3 THEN concat('"', title, '.vol0', l_linenumber, '+01.par2" yEnc')
         WHEN 4 THEN concat(title, ' ', l_linenumber, ' of 4 yEnc - ', l_partkey, ' bytes')
         ELSE concat(title, '.standalone') END AS subject
FROM (SELECT l.*, o.o_custkey,
             CASE ((l_orderkey {div} 6) % 8)
               WHEN 0 THEN concat('Show.', o_custkey, '.S01E0', l_orderkey % 9, '.1080p.WEB.x264-GRP')
               WHEN 1 THEN concat('Movie.', o_custkey, '.2024.2160p.UHD.BluRay.x265-GRP')
               WHEN 2 THEN concat('Artist.', o_custkey, '.Album.FLAC')
               WHEN 3 THEN concat('Author.', o_custkey, '.Novel.epub')
               WHEN 4 THEN concat('Utility.', o_custkey, '.x64.Keygen')
               WHEN 5 THEN concat('Old.Film.', o_custkey, '.1998.DVDRip.XviD')
               WHEN 6 THEN md5(CAST(l_orderkey AS VARCHAR(20)))
               ELSE concat('Random.Junk.', o_custkey) END AS title
      FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey) x
"""

# Request paths that the request log repeats.
PATHS = ["/metrics", "/api", "/api/", "/api/v1/releases", "/api/v1/releases/abc", "/api/v1/releases/abc/nzb", "/api/v1/releases/abc/files", "/api/v1/apikeys", "/api/v1/apikeys/7", "/api/v1/admin/groups", "/api/v1/admin/groups/bulk", "/api/v1/admin/groups/7", "/api/v1/admin/groups/7/scan", "/api/v1/admin/servers/1", "/api/v1/admin/users", "/api/v1/admin/postprocess/retry-failed", "/api/v1/admin/stats", "/api/v1/login", "/api/v1/health", "/api/v1/ready", "/api/x", "/", "/index.html"]

# The categories, parents first: id, name, and children's (id, name).
CATEGORIES = [
    (1000, "Console", [(1010, "NDS"), (1020, "PSP"), (1030, "Wii"), (1040, "XBOX"), (1050, "XBOX360"), (1080, "PS3"), (1090, "Other")]),
    (2000, "Movies", [(2010, "Foreign"), (2020, "Other"), (2030, "SD"), (2040, "HD"), (2045, "UHD"), (2050, "BluRay"), (2060, "3D")]),
    (3000, "Audio", [(3010, "MP3"), (3020, "Video"), (3030, "Audiobook"), (3040, "Lossless")]),
    (4000, "PC", [(4010, "0day"), (4020, "ISO"), (4030, "Mac"), (4040, "Mobile-Other"), (4050, "Games"), (4060, "Mobile-iOS"), (4070, "Mobile-Android")]),
    (5000, "TV", [(5020, "Foreign"), (5030, "SD"), (5040, "HD"), (5045, "UHD"), (5050, "Other"), (5060, "Sport"), (5070, "Anime"), (5080, "Documentary")]),
    (6000, "XXX", [(6010, "DVD"), (6020, "WMV"), (6030, "XviD"), (6040, "x264"), (6060, "Other")]),
    (7000, "Books", [(7010, "Mags"), (7020, "Ebook"), (7030, "Comics"), (7040, "Technical"), (7060, "Foreign")]),
    (8000, "Other", [(8010, "Misc")]),
]
CATEGORY_ROWS = [(i, None, n) for i, n, _ in CATEGORIES] + [(c, i, f"{n}/{m}") for i, n, kids in CATEGORIES for c, m in kids]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A plain scan of fewer splits than there are cores, dealt over all of them; a larger one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article headers from line items and their orders."""
    return spark.sql(HEADERS.format(div="div", lineitem="{lineitem}", orders="{orders}"), lineitem=spread(table(spark, sf_dir, "lineitem")), orders=table(spark, sf_dir, "orders"))


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORY_ROWS, "id int, parent_id int, name string")


def passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan passes of 12 groups."""
    e = table(spark, sf_dir, "events")
    k = F.coalesce(F.regexp_extract("props", r"(\d+)", 1).try_cast("bigint"), F.lit(0))
    return e.select(
        (F.col("user_id") % 12).alias("group_id"), "event_id", "ts",
        (F.col("event_type") == "signup").alias("backfill"),
        F.floor("value").cast("bigint").alias("articles"),
        (100 + k).alias("duration_ms"),
        (F.col("event_id") * 10).alias("server_high"),
        F.when(F.col("event_type") == "error", "connection reset").otherwise("").alias("err"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request log."""
    paths = F.array(*[F.lit(p) for p in PATHS])
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", F.lit("GET").alias("method"),
        F.get(paths, (F.col("event_id") % len(PATHS)).cast("int")).alias("path"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        F.floor("value").cast("bigint").alias("ms"),
    )


def nfo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions with external identifiers in every third row."""
    d, n = F.col("doc_id"), F.col("doc_id").cast("string")
    line = F.when(d % 9 == 0, F.concat(F.lit("\nIMDB: TT0"), F.lpad(n, 6, "0"), F.lit(" and tt99"), F.lpad(n, 6, "0"))).when(d % 9 == 3, F.concat(F.lit("\nhttps://thetvdb.com/?tab=series&id="), n)).when(d % 9 == 6, F.concat(F.lit("\nhttps://www.themoviedb.org/movie/"), n, F.lit(" tt1234567"))).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("text", line).alias("nfo"))
