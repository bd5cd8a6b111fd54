"""The reference's operators as queries on the driver tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import subjects as S
from ..operators import assembly as A
from ..operators import jobs as J
from ..operators import search as Q
from ..operators import state as T
from ..sources import views as V
from ..sources.tables import once
from . import sql
from .sql import query as q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, statement: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if statement:
            SQL[name] = statement
        return f

    return keep


def parts(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "parts", lambda: A.ingest_parts(V.headers(spark, d)))


def parsed(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "parsed", lambda: A.part_from_header(V.headers(spark, d)))


def bins(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "binaries", lambda: A.binaries(parts(spark, d)))


def releases(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "releases", lambda: A.build_releases(bins(spark, d)))


def segments(spark: SparkSession, d: str) -> DataFrame:
    return A.release_segments(parts(spark, d), releases(spark, d))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Headers to parts to binaries to releases, searched."""
    return Q.search(releases(spark, d), "1080p show", [5000]).select("guid", "name", "category_id", "group_id", "size", "posted_at")


def ntz(x: str) -> F.Column:
    return F.lit(x).cast("timestamp_ntz")


PART = "part_id, part_number, total_parts, file_name, norm_subject, collection_key, file_number, collection_files"
BIN = "binary_id, group_id, norm_subject, collection_key, poster, collected_parts, CAST(total_parts AS INT) AS total_parts, total_bytes, posted_at, complete"
REL = "guid, release_hash, name, search_name, category_id, group_id, poster, CAST(total_parts AS INT) AS total_parts, size, posted_at, obfuscated, binary_id"
LINE = """concat_ws(chr(9), CAST(article_number AS VARCHAR), subject, poster, strftime(posted_at, '%a, %-d %b %Y %H:%M:%S +0000'), '<' || message_id || '>', '', CAST(bytes AS VARCHAR), '9')"""


def lines(spark, d):
    """Header lines whose dates have six layouts: with and without day name, seconds, zone names and comments."""
    at = lambda layout, end: F.concat(F.date_format("posted_at", layout), F.lit(end))
    k = F.col("article_number") % 6
    date = F.when(k == 0, at("EEE, d MMM yyyy HH:mm:ss", " +0000")).when(k == 1, at("d MMM yyyy HH:mm:ss", " GMT")).when(k == 2, at("EEE, dd MMM yyyy HH:mm:ss", " EST"))
    date = date.when(k == 3, at("EEE, d MMM yyyy HH:mm", " +0000")).when(k == 4, at("EEE, d MMM yyyy", " 05:30:00 +0530")).otherwise(at("EEE, d MMM yyyy HH:mm:ss", " +0000 (UTC)"))
    h = V.headers(spark, d)
    return h.select(F.concat_ws("\t", F.col("article_number").cast("string"), "subject", "poster", date, F.concat(F.lit("<"), "message_id", F.lit(">")), F.lit(""), F.col("bytes").cast("string"), F.lit("9")).alias("value"))


add("entry_search", q("SELECT guid, name, category_id, group_id, size, posted_at FROM releases WHERE NOT obfuscated AND contains(search_name, '1080p') AND contains(search_name, 'show') AND category_id BETWEEN 5000 AND 5999", "releases"))(flagship)

# Sources and sinks.
add("S01_overview_scan", q("SELECT article_number, subject, poster, message_id, bytes FROM headers", "headers"))(lambda s, d: A.overview_scan(lines(s, d)).drop("posted_at"))
add("S02_overview_date", q("SELECT article_number, posted_at FROM headers", "headers"))(lambda s, d: A.overview_scan(lines(s, d)).select("article_number", F.col("posted_at").cast("timestamp_ntz").alias("posted_at")))
add("S03_group_catalog_scan", "SELECT 'alt.' || source AS name, max(doc_id) AS high, min(doc_id) AS low, 'y' AS status, greatest(max(doc_id) - min(doc_id) + 1, 0) AS estimated_count FROM documents GROUP BY source")(
    lambda s, d: A.group_catalog_scan(V.table(s, d, "documents").groupBy("source").agg(F.concat_ws(" ", F.concat(F.lit("alt."), "source"), F.max("doc_id").cast("string"), F.min("doc_id").cast("string"), F.lit("y")).alias("value")))
)
add("S04_sanitize_utf8", "SELECT doc_id, sha256(CASE doc_id % 4 WHEN 0 THEN text || chr(65533) || 'z' WHEN 1 THEN text || chr(65533) || chr(65533) WHEN 2 THEN chr(65533) || chr(65533) || text || chr(65533) ELSE text END) AS clean FROM documents")(
    lambda s, d: V.table(s, d, "documents").select("doc_id", F.sha2(N.sanitize_utf8(soiled(F.col("text").cast("binary")).cast("string")).cast("binary"), 256).alias("clean"))
)
add("S05_ingest_parts", q("SELECT part_id, group_id, article_number, message_id, subject, poster, posted_at, bytes FROM parts", "parts"))(lambda s, d: parts(s, d).select("part_id", "group_id", "article_number", "message_id", "subject", "poster", "posted_at", "bytes"))
add("S06_part_from_header", q(f"SELECT message_id, {PART} FROM parsed", "parsed"))(lambda s, d: parsed(s, d).selectExpr("message_id", *PART.split(", ")))
MONTHS = "SELECT 'parts_' || strftime(m, '%Y_%m') AS partition_name, CAST(m AS TIMESTAMP) AS from_ts, CAST(m + INTERVAL 1 MONTH AS TIMESTAMP) AS to_ts, n AS rows FROM (SELECT date_trunc('month', posted_at) AS m, count(*) AS n FROM parts GROUP BY 1)"
add("S07_monthly_partitions", q(MONTHS, "parts"))(lambda s, d: A.monthly_partitions(parts(s, d)))
add("S08_partition_coverage", q("SELECT CAST(m AS DATE) AS month FROM (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2003-01-01', INTERVAL 1 MONTH)) AS m) WHERE m NOT IN (SELECT date_trunc('month', posted_at) FROM parts)", "parts"))(lambda s, d: A.partition_coverage(A.monthly_partitions(parts(s, d)), "1995-01-15", 96))
add("S09_drop_expired_partitions", q(f"SELECT * FROM ({MONTHS}) WHERE to_ts > TIMESTAMP '1997-06-10'", "parts"))(lambda s, d: A.kept_partitions(A.monthly_partitions(parts(s, d)), "1997-06-10"))


ESC = lambda x: f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&#34;')"
XML = f"""'<file poster="' || {ESC('r.poster')} || '" date="' || epoch(CAST(r.posted_at AS TIMESTAMP))::BIGINT || '" subject="' || {ESC("CASE WHEN first.subject <> '' THEN first.subject ELSE r.name END")} || '"><groups><group>alt.group' || r.group_id || '</group></groups><segments>' || g.lines || '</segments></file>'"""
LINES = f"""SELECT guid, string_agg('<segment bytes="' || bytes || '" number="' || number || '">' || {ESC('message_id')} || '</segment>', '' ORDER BY number) AS lines FROM segments GROUP BY guid"""


@add("S10_manifest_export", q(f"SELECT r.guid, CASE WHEN r.name = '' THEN 'release' ELSE translate(r.name, '/\\:*?\"<>|' || chr(10) || chr(13) || chr(9), '____________') END || '.nzb' AS filename, {XML} AS xml FROM releases r JOIN ({LINES}) g USING (guid) JOIN (SELECT guid, subject FROM segments WHERE number = 1) first USING (guid)", "segments"))
def manifests(s, d):
    r = releases(s, d)
    groups = r.select("group_id").distinct().withColumn("group_name", F.concat(F.lit("alt.group"), F.col("group_id").cast("string")))
    return A.manifest_export(r, segments(s, d), groups)


add("S11_safe_filename", q("SELECT part_id, CASE WHEN subject = '' THEN 'release' ELSE translate(subject, '/\\:*?\"<>|' || chr(10) || chr(13) || chr(9), '____________') END AS filename FROM parts", "parts"))(lambda s, d: parts(s, d).select("part_id", N.safe_filename(F.col("subject")).alias("filename")))
add("S12_feed_items", q("SELECT guid, name AS title, 'http://x/api?t=get&id=' || guid AS link, strftime(posted_at, '%a, %d %b %Y %H:%M:%S +0000') AS pub_date, CAST(category_id AS VARCHAR) AS category, CAST(size AS VARCHAR) AS size_attr FROM releases", "releases"))(lambda s, d: A.feed_items(releases(s, d), "http://x").select("guid", "title", "link", "pub_date", "category", "size_attr"))
add("S13_category_tree", q("SELECT p.id, p.name, coalesce(string_agg(c.id || '=' || c.name, ',' ORDER BY c.id), '') AS subcats, count(r.category_id) > 0 AS used FROM (SELECT * FROM categories WHERE parent_id IS NULL) p LEFT JOIN categories c ON c.parent_id = p.id LEFT JOIN (SELECT DISTINCT category_id // 1000 * 1000 AS category_id FROM releases) r ON r.category_id = p.id GROUP BY p.id, p.name", "releases", "categories"))(
    lambda s, d: A.category_tree(V.categories(s)).select("id", "name", F.array_join(F.transform(F.coalesce("subcats", F.array().cast("array<struct<id:int,name:string>>")), lambda c: F.concat(c["id"].cast("string"), F.lit("="), c["name"])), ",").alias("subcats")).join(releases(s, d).select((F.floor(F.col("category_id") / 1000) * 1000).alias("id")).distinct().withColumn("u", F.lit(True)), "id", "left").select("id", "name", "subcats", F.coalesce("u", F.lit(False)).alias("used"))
)
add("S14_upserted_documents", q("SELECT guid, name, search_name, category_id, size, obfuscated, posted_at AS sort_at FROM releases WHERE guid < 'c' UNION ALL SELECT guid, 'old', '', 8000, 0, true, posted_at FROM releases WHERE guid >= 'c'", "releases"))(
    lambda s, d: A.search_documents(releases(s, d).filter("guid < 'c'"), A.search_documents(releases(s, d)).withColumns({"name": F.lit("old"), "search_name": F.lit(""), "category_id": F.lit(8000), "size": F.lit(0).cast("long"), "obfuscated": F.lit(True)}))
)
add("S14_search_documents", q("SELECT guid, name, search_name, category_id, size, obfuscated, posted_at AS sort_at FROM releases", "releases"))(lambda s, d: A.search_documents(releases(s, d)))


@add("S15_segments_json", q("SELECT guid, count(*) AS n, string_agg(message_id, ',' ORDER BY number) AS ids FROM segments GROUP BY guid", "segments"))
def segments_json(s, d):
    back = F.from_json("segments_json", "array<struct<number:int,message_id:string,bytes:long,subject:string>>")
    return A.segments_array(segments(s, d)).select("guid", back.alias("b")).select("guid", F.size("b").cast("long").alias("n"), F.array_join(F.col("b.message_id"), ",").alias("ids"))


def soiled(raw):
    """Texts with bad bytes and NUL, with genuine U+FFFD, and with both."""
    k, bad, mark = F.col("doc_id") % 4, F.lit(b"\xff\xfe\0z"), F.lit("\ufffd\ufffd".encode())
    return F.when(k == 0, F.concat(raw, bad)).when(k == 1, F.concat(raw, mark)).when(k == 2, F.concat(mark, raw, F.lit(b"\xc3"))).otherwise(raw)


# Subjects, names and labels.
def parsed_fields(*cols):
    return lambda s, d: parsed(s, d).select("message_id", *cols)


for name, cols in {"T01_parse_subject": PART.split(", ")[1:], "T02_quoted_name": ["file_name"], "T03_segment_counter": ["part_number", "total_parts"], "T04_file_counter": ["file_number", "collection_files"], "T05_collection_key": ["collection_key"], "T08_normalize_subject": ["norm_subject"]}.items():
    add(name, q(f"SELECT message_id, {', '.join(cols)} FROM parsed", "parsed"))(parsed_fields(*cols))
add("T06_collection_title", q(f"SELECT message_id, CASE WHEN strlen(t) >= 8 THEN t ELSE '' END AS title FROM (SELECT message_id, trim({sql.squeeze('trim(subject)')}, ' -–_.') AS t FROM headers)", "headers"))(lambda s, d: V.headers(s, d).select("message_id", S.collection_title(F.col("subject")).alias("title")))
add("T07_collection_base", q(f"SELECT message_id, {sql.collection_base('file_name')} AS base FROM parsed", "parsed"))(lambda s, d: parsed(s, d).select("message_id", S.collection_base(F.col("file_name")).alias("base")))
add("T09_duplicate_counter", q("SELECT message_id, total_parts > 0 AND file_number = part_number AND collection_files = total_parts AS duplicate FROM parsed", "parsed"))(lambda s, d: parsed(s, d).select("message_id", S.duplicate_counter(F.col("file_number"), F.col("collection_files"), F.col("part_number"), F.col("total_parts")).alias("duplicate")))
for name, out, spark_f, sql_f in (
    ("T10_clean_name", "name", N.clean_name, sql.clean_name),
    ("T12_search_name", "name", N.search_name, sql.search_name),
    ("T13_is_obfuscated", "obfuscated", N.is_obfuscated, sql.obfuscated),
):
    add(name, q(f"SELECT message_id, {sql_f('subject')} AS {out} FROM headers", "headers"))(lambda s, d, f=spark_f, o=out: V.headers(s, d).select("message_id", f(F.col("subject")).alias(o)))
add("T11_collection_base_name", q("SELECT message_id, regexp_replace(regexp_replace(collection_key, '^t:', ''), '/[^/]*$', '') AS name FROM parsed", "parsed"))(lambda s, d: parsed(s, d).select("message_id", N.collection_base_name(F.col("collection_key")).alias("name")))
add("T14_is_word_like", "SELECT doc_id, count(*) AS tokens, count(*) FILTER (regexp_matches(t, '^([a-z]{3,}|[A-Z]{3,}|[A-Z][a-z]{2,})$') AND regexp_matches(t, '[aeiouyAEIOUY]')) AS words FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS t FROM documents) GROUP BY doc_id")(
    lambda s, d: V.table(s, d, "documents").select("doc_id", F.split("text", " ").alias("t")).select("doc_id", F.size("t").cast("long").alias("tokens"), F.size(F.filter("t", N.is_word_like)).cast("long").alias("words"))
)
add("T15_categorize", q(f"SELECT name, {sql.refine('c', 's')} AS category_id FROM (SELECT *, {sql.rule('s')} AS c FROM (SELECT DISTINCT subject AS name, {sql.search_name('subject')} AS s FROM headers))", "headers"))(lambda s, d: V.headers(s, d).select(F.col("subject").alias("name")).distinct().withColumn("category_id", N.categorize(F.col("name"))))
TIER = f"CASE WHEN {sql.has('subject', sql.R.UHD)} THEN 2 WHEN {sql.has('subject', sql.R.HD)} THEN 1 WHEN {sql.has('subject', sql.R.SD)} THEN 0 ELSE 1 END"
add("T16_resolution_tier", q(f"SELECT message_id, {TIER} AS tier FROM headers", "headers"))(lambda s, d: V.headers(s, d).select("message_id", N.resolution_tier(F.col("subject")).alias("tier")))
add("T17_refine_video_category", q(f"SELECT message_id, {sql.refine('2000', 'subject')} AS movie, {sql.refine('5000', 'subject')} AS tv FROM headers", "headers"))(lambda s, d: V.headers(s, d).select("message_id", N.refine_video_category(F.lit(2000), F.col("subject")).alias("movie"), N.refine_video_category(F.lit(5000), F.col("subject")).alias("tv")))
add("T18_size_bucket", q(f"SELECT message_id, {sql.bucket('bytes')} AS bucket FROM headers", "headers"))(lambda s, d: V.headers(s, d).select("message_id", N.size_bucket(F.col("bytes")).alias("bucket")))
add("T19_release_hash", q("SELECT binary_id, release_hash FROM n4", "n4"))(lambda s, d: A.named_binaries(A.releasable(bins(s, d))).select("binary_id", "release_hash"))
WORK = "translate(subject, '._', '  ')"
FIRST = "CASE WHEN m = '' THEN len(w) + 1 ELSE strpos(w, m) END"
add("T20_parse_title", q(
    rf"""SELECT message_id, trim(trim({sql.squeeze('lower(w[1 : least(a, b) - 1])')}, ' -–_.')) AS title, coalesce(TRY_CAST(y AS INT), 0) AS year, season, episode FROM (SELECT *, CASE WHEN m = '' THEN len(w) + 1 ELSE strpos(w, m) END AS a, CASE WHEN y = '' THEN len(w) + 1 ELSE len(regexp_extract(w, '^(.*?)\b(19\d{{2}}|20\d{{2}})\b', 1)) + 1 END AS b FROM (
    SELECT message_id, w, regexp_extract(w, '{sql.R.YEAR}', 1) AS y, CASE WHEN {sql.has('w', sql.R.EPISODE)} THEN regexp_extract(w, '{sql.R.EPISODE}') WHEN {sql.has('w', sql.R.CROSS)} THEN regexp_extract(w, '{sql.R.CROSS}') ELSE regexp_extract(w, '{sql.R.SEASON}') END AS m,
    CASE WHEN {sql.has('w', sql.R.EPISODE)} THEN CAST(regexp_extract(w, '{sql.R.EPISODE}', 1) AS INT) WHEN {sql.has('w', sql.R.CROSS)} THEN CAST(regexp_extract(w, '{sql.R.CROSS}', 1) AS INT) WHEN {sql.has('w', sql.R.SEASON)} THEN CAST(regexp_extract(w, '{sql.R.SEASON}', 1) AS INT) ELSE 0 END AS season,
    CASE WHEN {sql.has('w', sql.R.EPISODE)} THEN CAST(regexp_extract(w, '{sql.R.EPISODE}', 2) AS INT) WHEN {sql.has('w', sql.R.CROSS)} THEN CAST(regexp_extract(w, '{sql.R.CROSS}', 2) AS INT) ELSE 0 END AS episode FROM (SELECT message_id, {WORK} AS w FROM headers)))""", "headers"))(lambda s, d: V.headers(s, d).select("message_id", N.parse_title(F.col("subject")).alias("t")).select("message_id", "t.*"))  # fmt: skip
IDENT = "CASE doc_id % 4 WHEN 0 THEN ' IMDB ' WHEN 1 THEN 'tvdb' WHEN 2 THEN 'tmdb' ELSE 'other' END"
add("T21_normalize_identifier", f"SELECT doc_id, CASE WHEN lower(trim({IDENT})) = 'imdb' THEN 'tt' || CASE WHEN len(CAST(doc_id AS VARCHAR)) < 7 THEN lpad(CAST(doc_id AS VARCHAR), 7, '0') ELSE CAST(doc_id AS VARCHAR) END WHEN {IDENT} IN ('tvdb', 'tmdb') THEN CAST(doc_id AS VARCHAR) END AS identifier FROM documents")(
    lambda s, d: V.table(s, d, "documents").select("doc_id", N.normalize_identifier(F.expr(IDENT), F.when(F.col("doc_id") % 8 == 0, F.concat(F.lit("TT"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string")))["identifier"].alias("identifier"))
)
add("T22_extract_identifiers", q(
    rf"""SELECT doc_id, coalesce(list_aggregate(list_transform(ids, lambda x: x), 'string_agg', ','), '') AS ids FROM (SELECT doc_id, list_concat(list_concat(list_distinct_in(list_transform(regexp_extract_all(nfo, '{sql.R.IMDB}'), lambda x: 'imdb:' || lower(x))), list_transform(regexp_extract_all(nfo, '{sql.R.TVDB}', 1), lambda x: 'tvdb:' || x)), list_transform(regexp_extract_all(nfo, '{sql.R.TMDB}', 1), lambda x: 'tmdb:' || x)) AS ids FROM nfo)""".replace("list_distinct_in", ""), "nfo"))(
    lambda s, d: V.nfo(s, d).select("doc_id", F.array_join(F.transform(N.extract_identifiers(F.col("nfo")), lambda x: F.concat_ws(":", x["source"], x["identifier"])), ",").alias("ids"))
)
add("T23_subject_filename", q("""SELECT message_id, CASE WHEN regexp_matches(subject, '"[^"]*"') THEN regexp_extract(subject, '"([^"]*)"', 1) ELSE trim(subject) END AS filename FROM headers""", "headers"))(lambda s, d: V.headers(s, d).select("message_id", N.subject_filename(F.col("subject")).alias("filename")))
add("T24_looks_like", q("SELECT message_id, ends_with(lower(file_name), '.par2') AS par2, ends_with(lower(file_name), '.nfo') AS nfo FROM parsed", "parsed"))(lambda s, d: parsed(s, d).select("message_id", N.looks_like(F.col("file_name"), ".par2").alias("par2"), N.looks_like(F.col("file_name"), ".nfo").alias("nfo")))
BASE = sql.rx(sql.rx("file_name", sql.R.KNOWN_EXTENSION), sql.R.VOLUME)
add("T25_best_release_name", q(f"SELECT group_id, poster, trim(arg_max(b, (strlen(b), -rn))) AS best FROM (SELECT group_id, poster, {BASE} AS b, row_number() OVER (PARTITION BY group_id, poster ORDER BY file_name) AS rn FROM (SELECT DISTINCT group_id, poster, file_name FROM parts)) GROUP BY group_id, poster", "parts"))(
    lambda s, d: parts(s, d).groupBy("group_id", "poster").agg(N.best_name_of(F.col("file_name")).alias("best"))
)
add("T26_sanitize_nfo", "SELECT doc_id, sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS clean FROM documents")(lambda s, d: V.table(s, d, "documents").select("doc_id", F.sha2(N.sanitize_nfo(F.col("text").cast("binary")).cast("binary"), 256).alias("clean")))
add("T27_strip_html", "SELECT page_id, sha256(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '^\\s+|\\s+$', '', 'g')) AS plain, coalesce(TRY_CAST(regexp_extract(regexp_extract(url, '(\\d+)', 1), '^(\\d{4})', 1) AS INT), 0) AS year FROM pages")(lambda s, d: V.table(s, d, "pages").select("page_id", F.sha2(N.strip_html(F.col("html")).cast("binary"), 256).alias("plain"), N.year_from_date(F.regexp_extract("url", r"(\d+)", 1)).alias("year")))

# Labels and routes of the paths in the request log.
ROUTES = ["/metrics", "/api", "/api", "/api/v1/releases", "/api/v1/releases/:guid", "/api/v1/releases/:guid/nzb", "/api/v1/releases/:guid/*", "/api/v1/apikeys", "/api/v1/apikeys/:id", "/api/v1/admin/groups", "/api/v1/admin/groups/bulk", "/api/v1/admin/groups/:id", "/api/v1/admin/groups/:id/scan", "/api/v1/admin/servers/:id", "/api/v1/admin/users", "/api/v1/admin/postprocess/retry-failed", "/api/v1/admin/stats", "/api/v1/login", "/api/v1/health", "/api/v1/ready", "spa", "/", "spa"]
LABEL = ["metrics scrape", "newznab", "newznab", "search", "release detail", "nzb download", "release detail", "api keys", "api key", "groups", "bulk add groups", "group update", "group update", "server update", "users", "retry failed postprocess", "stats", "login", "health probe", "readiness probe", "newznab", "http request", "http request"]
pick = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + f"][CAST(event_id % {len(V.PATHS)} AS INT) + 1]"
add("T28_route_pattern", q(f"SELECT event_id, {pick(ROUTES)} AS route FROM requests", "requests"))(lambda s, d: V.requests(s, d).select("event_id", N.route_pattern(F.col("path")).alias("route")))
add("T29_request_label", q(f"SELECT event_id, {pick(LABEL)} AS label, path IN ('/api/v1/health', '/api/v1/ready') AS probe FROM requests", "requests"))(lambda s, d: V.requests(s, d).select("event_id", N.request_label(F.col("path")).alias("label"), N.is_probe(F.col("path")).alias("probe")))
add("T30_valid_group_name", "SELECT page_id, regexp_matches(url, '^[a-z0-9._+-]+$') AND contains(url, '.') AS whole, regexp_matches(h, '^[a-z0-9._+-]+$') AND contains(h, '.') AS host FROM (SELECT *, regexp_extract(url, '//([^/?#]+)', 1) AS h FROM pages)")(lambda s, d: V.table(s, d, "pages").select("page_id", N.valid_group_name(F.col("url")).alias("whole"), N.valid_group_name(F.regexp_extract("url", "//([^/?#]+)", 1)).alias("host")))
add("T31_episode_query", "SELECT event_id, trim(event_type || ' s' || lpad(CAST(user_id % 12 AS VARCHAR), 2, '0') || CASE WHEN event_id % 2 = 0 THEN 'e' || CASE WHEN event_id % 200 < 10 THEN '0' ELSE '' END || CAST(event_id % 200 AS VARCHAR) ELSE '' END) AS query FROM events")(
    lambda s, d: V.table(s, d, "events").select("event_id", N.episode_query(F.col("event_type"), (F.col("user_id") % 12).cast("string"), F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 200).cast("string")).otherwise("x")).alias("query"))
)
add("T32_parse_category_list", "SELECT event_id, (user_id % 9) * 1000 + event_id % 50 AS total, 2 AS n FROM events")(
    lambda s, d: V.table(s, d, "events").select("event_id", N.parse_category_list(F.concat_ws(",", ((F.col("user_id") % 9) * 1000).cast("string"), F.lit("x"), F.concat(F.lit(" "), (F.col("event_id") % 50).cast("string")))).alias("c")).select("event_id", F.aggregate("c", F.lit(0), lambda a, b: a + b).cast("long").alias("total"), F.size("c").alias("n"))
)
add("T33_cursor", "SELECT event_id, translate(rtrim(base64(encode(CAST(epoch_us(ts) * 1000 AS VARCHAR) || ':' || CAST(event_id AS VARCHAR))), '='), '+/', '-_') AS cursor, ts AS back_ts, event_id AS back_id FROM events")(
    lambda s, d: V.table(s, d, "events").withColumn("cursor", N.encode_cursor(F.col("ts"), F.col("event_id"))).select("event_id", "cursor", N.decode_cursor(F.col("cursor")).alias("b")).select("event_id", "cursor", F.col("b.ts").cast("timestamp_ntz").alias("back_ts"), F.col("b.id").alias("back_id"))
)
CODE = "CASE WHEN event_type = 'error' THEN [480, 481, 482, 502, 430, 500, NULL][CAST(event_id % 7 AS INT) + 1] END"
add("T34_classify_error", f"SELECT event_id, kind, kind IN ('auth', 'retention') AS permanent FROM (SELECT event_id, CASE WHEN event_type <> 'error' THEN 'none' WHEN event_id % 7 < 4 THEN 'auth' WHEN event_id % 7 = 4 THEN 'retention' WHEN event_id % 7 = 5 THEN 'protocol' ELSE 'connection' END AS kind FROM events)")(
    lambda s, d: V.table(s, d, "events").select("event_id", N.classify_error(F.when(F.col("event_type") == "error", F.get(F.array(*[F.lit(x) for x in (480, 481, 482, 502, 430, 500)], F.lit(None).cast("int")), (F.col("event_id") % 7).cast("int"))), F.when(F.col("event_type") == "error", True)).alias("e")).select("event_id", "e.*")
)
LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR+1' WHEN 'signup' THEN 'WARN' WHEN 'view' THEN 'DEBUG-2' ELSE 'INFO' END"
add("T35_level_rank", "SELECT event_id, CASE event_type WHEN 'error' THEN 8 WHEN 'signup' THEN 4 WHEN 'view' THEN -4 ELSE 0 END AS rank FROM events")(lambda s, d: V.table(s, d, "events").select("event_id", N.level_rank(F.expr(LEVEL)).alias("rank")))


from . import catalogue_jobs, catalogue_loops, catalogue_repair  # noqa: E402, F401  (they add their queries)
