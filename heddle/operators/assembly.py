"""From headers to parts, binaries and releases.

Empty tables give empty results. Headers without a message id are dropped; a null subject parses as an empty one; null keys (a group,
article number, poster) are one value like any other where rows are grouped, and match nothing where they are joined. Of rows that
repeat a key the least by the order stated stays, then the least in all columns, so ties have one outcome. Columns that an
operator doesn't know come along where rows are kept as they are (parts, cap_per_key, distinct_on, settle_quiet); working columns take names that are free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import subjects as S
from ..sources.layout import bucketed
from ..sources.tables import free

NATURAL = ["group_id", "article_number"]
#: Parts of a bucket of linked_layout.
BUCKET_ROWS = 500_000


def overview_scan(lines: DataFrame) -> DataFrame:
    """Tab-separated header lines (column value) as rows; lines of fewer than 8 fields or without a
    number are dropped."""
    f = F.split("value", "\t")
    rows = lines.select(f.alias("f")).filter((F.size("f") >= 8) & F.get("f", F.lit(0)).try_cast("bigint").isNotNull())
    g = lambda i: F.get("f", F.lit(i))
    return rows.select(g(0).cast("bigint").alias("article_number"), g(1).alias("subject"), g(2).alias("poster"), overview_date(g(3)).alias("posted_at"), F.regexp_replace(g(4), "^<|>$", "").alias("message_id"), F.coalesce(g(6).try_cast("bigint"), F.lit(0)).alias("bytes"))


def overview_date(text: F.Column) -> F.Column:
    """RFC 5322 dates with or without day name, seconds and named zone (whatever its name, it counts as
    +0000); null if it is none."""
    s = F.regexp_replace(text, r"^[A-Za-z]{3}, +", "")
    s = F.regexp_replace(F.regexp_replace(s, r" *\(.*\)$", ""), r" [A-Za-z]{1,5}$", " +0000")
    s = F.regexp_replace(s, r"^(\d+ [A-Za-z]+ \d+ \d+:\d+) ", "$1:00 ")
    return F.try_to_timestamp(s, F.lit("d MMM yyyy HH:mm:ss Z"))


def group_catalog_scan(lines: DataFrame) -> DataFrame:
    """Lines of group, high, low and status as rows with an estimate of the number of articles."""
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.select(f.alias("f")).filter(F.size("f") >= 3)
    g = lambda i: F.get("f", F.lit(i)).try_cast("bigint")
    return rows.filter(g(1).isNotNull() & g(2).isNotNull()).select(F.get("f", F.lit(0)).alias("name"), g(1).alias("high"), g(2).alias("low"), F.get("f", F.lit(3)).alias("status"), F.greatest(g(1) - g(2) + 1, F.lit(0)).alias("estimated_count"))


def distinct_on(df: DataFrame, key: list[str], *order) -> DataFrame:
    """The first row of each key. Plain minima over structs, which are reduced before they move."""
    cols, r = [c for c in df.columns if c not in key], free("_r", df)
    first = df.groupBy(*key).agg(F.min(F.struct(*order, *[c for c in cols if c not in order])).alias(r))
    return first.select(*[c if c in key else F.col(f"{r}.{c}").alias(c) for c in df.columns])


def not_existing(new: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """J07, SET3: rows whose key isn't stored."""
    return new.join(stored.select(*key).distinct(), key, "left_anti")


def part_from_header(headers: DataFrame) -> DataFrame:
    """Rows with a message id, with the fields of their subjects."""
    out = S.parse_subject(headers.filter(F.coalesce("message_id", F.lit("")) != ""))
    return out.withColumn("part_id", F.col("group_id") * 1_000_000_000 + F.col("article_number"))


def ingest_parts(batch: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """New parts of a batch, one for each natural key (the smallest message id). Only headers are
    exchanged; subjects are parsed after repeated ones are gone."""
    fresh = distinct_on(batch, NATURAL, "message_id")
    return part_from_header(fresh if stored is None else not_existing(fresh, stored, NATURAL))


def is_complete(collected: F.Column, total: F.Column) -> F.Column:
    """A04"""
    return F.when(total > 0, collected >= total).otherwise(collected >= 1)


def binary_id(kind: str, key: str) -> F.Column:
    return F.md5(F.concat_ws("|", F.lit(kind), F.col("group_id").cast("string"), F.col(key), F.col("poster")))


def unassigned_single(parts: DataFrame) -> DataFrame:
    """P01"""
    return parts.filter("collection_key = '' AND norm_subject <> '' AND total_parts > 0")


def ambiguous_parts(parts: DataFrame, limit: int | None = None, most_attempts: int = 5) -> DataFrame:
    """Parts without a key or a total, those whose bodies were tried too often (yenc_attempts, as B10 counts them) aside;
    with ``limit`` the newest so many, as a work queue takes them."""
    rows = parts.filter("collection_key = '' AND total_parts = 0")
    if "yenc_attempts" in parts.columns:
        rows = rows.filter(F.coalesce("yenc_attempts", F.lit(0)) < most_attempts)
    return rows if limit is None else rows.orderBy(F.desc("posted_at"), F.desc("part_id")).limit(limit)


def unassigned_collection(parts: DataFrame) -> DataFrame:
    """P02"""
    return parts.filter("collection_key <> ''")


def assemble_singles(parts: DataFrame) -> DataFrame:
    """Binaries of parts that share a normalised subject."""
    g = unassigned_single(parts).groupBy("group_id", "norm_subject", "poster").agg(F.count("*").alias("collected_parts"), F.max("total_parts").alias("total_parts"), F.sum("bytes").alias("total_bytes"), F.min("posted_at").alias("posted_at"), F.max("posted_at").alias("updated_at"))
    return g.select(binary_id("s", "norm_subject").alias("binary_id"), "group_id", "norm_subject", F.lit("").alias("collection_key"), "poster", "collected_parts", "total_parts", "total_bytes", "posted_at", "updated_at", ((F.col("total_parts") == 0) | (F.col("collected_parts") >= F.col("total_parts"))).alias("complete"))


def assemble_collections(parts: DataFrame) -> DataFrame:
    """Binaries of parts that share a collection key; distinct files count, over the whole binary."""
    g = unassigned_collection(parts).groupBy("group_id", "collection_key", "poster").agg(F.count_distinct("file_number").alias("collected_parts"), F.max("collection_files").alias("total_parts"), F.sum("bytes").alias("total_bytes"), F.min("posted_at").alias("posted_at"), F.max("posted_at").alias("updated_at"))
    return g.select(binary_id("c", "collection_key").alias("binary_id"), "group_id", F.lit("").alias("norm_subject"), "collection_key", "poster", "collected_parts", "total_parts", "total_bytes", "posted_at", "updated_at", ((F.col("total_parts") > 0) & (F.col("collected_parts") >= F.col("total_parts"))).alias("complete"))


def binaries(parts: DataFrame) -> DataFrame:
    return assemble_singles(parts).unionByName(assemble_collections(parts))


def link_parts(parts: DataFrame) -> DataFrame:
    """Parts with their binary's id, which follows from the key, so nothing is joined. Parts of a layout that keeps the
    id (linked_layout) are taken as they are."""
    if "binary_id" in parts.columns:
        return parts
    ident = F.when(F.col("collection_key") != "", binary_id("c", "collection_key")).when((F.col("norm_subject") != "") & (F.col("total_parts") > 0), binary_id("s", "norm_subject"))
    return parts.withColumn("binary_id", ident)


def merge_binaries(stored: DataFrame, delta: DataFrame) -> DataFrame:
    """Stored binaries with a batch's aggregate added."""
    sums, ends = F.sum, {"total_parts": F.max, "posted_at": F.min, "updated_at": F.max, "norm_subject": F.max, "collection_key": F.max, "group_id": F.max, "poster": F.max}
    both = stored.unionByName(delta).groupBy("binary_id").agg(sums("collected_parts").alias("collected_parts"), sums("total_bytes").alias("total_bytes"), *[f(c).alias(c) for c, f in ends.items()])
    single = (F.col("collection_key") == "") & ((F.col("total_parts") == 0) | (F.col("collected_parts") >= F.col("total_parts")))
    group = (F.col("collection_key") != "") & (F.col("total_parts") > 0) & (F.col("collected_parts") >= F.col("total_parts"))
    return both.withColumn("complete", single | group).select(*stored.columns)


def partials(parts: DataFrame) -> DataFrame:
    """A01 and A02 for a batch: what binaries keep of it, a row for each single binary and for each file of a
    collection, so that a file that comes in several batches counts once."""
    rows = link_parts(parts).filter("binary_id IS NOT NULL").withColumn("grouped", F.col("collection_key") != "")
    one = lambda c: F.when(F.col("grouped"), c)
    rows = rows.select("binary_id", "grouped", "group_id", F.when(F.col("grouped"), "").otherwise(F.col("norm_subject")).alias("norm_subject"), "collection_key", "poster", one(F.col("file_number")).alias("file"), one(F.col("collection_files")).otherwise(F.col("total_parts")).alias("total_parts"), "bytes", "posted_at", F.lit(1).cast("long").alias("collected_parts"), F.col("posted_at").alias("updated_at"))
    return merged(rows.withColumnRenamed("bytes", "total_bytes"))


def merged(rows: DataFrame) -> DataFrame:
    """Partial rows of several batches added up."""
    return rows.groupBy("binary_id", "grouped", "group_id", "norm_subject", "collection_key", "poster", "file").agg(F.max("total_parts").alias("total_parts"), F.sum("total_bytes").alias("total_bytes"), F.min("posted_at").alias("posted_at"), F.sum("collected_parts").alias("collected_parts"), F.max("updated_at").alias("updated_at"))


def merge_partials(rows: DataFrame) -> DataFrame:
    """A03 for all binaries: partials() of any batches as binaries. Of collections distinct files count."""
    each = merged(rows).groupBy("binary_id", "grouped", "group_id", "norm_subject", "collection_key", "poster")
    out = each.agg(F.when(F.first("grouped"), F.count("file")).otherwise(F.sum("collected_parts")).alias("collected_parts"), F.max("total_parts").alias("total_parts"), F.sum("total_bytes").alias("total_bytes"), F.min("posted_at").alias("posted_at"), F.max("updated_at").alias("updated_at"))
    full = F.col("collected_parts") >= F.col("total_parts")
    return out.withColumn("complete", F.when(F.col("grouped"), (F.col("total_parts") > 0) & full).otherwise((F.col("total_parts") == 0) | full)).drop("grouped")


def cap_per_key(df: DataFrame, key: list[str], n: int, *order) -> DataFrame:
    """At most n rows of each key, as the feature; top-n pruning happens before rows move."""
    k = free("_n", df)
    return df.withColumn(k, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col(k) <= n).drop(k)


def first_keys(df: DataFrame, key: list[str], n: int) -> DataFrame:
    """W02"""
    return df.select(*key).distinct().orderBy(*key).limit(n)


def settle_quiet(bins: DataFrame, cutoff) -> DataFrame:
    """ST06: collections of unknown size whose last part is older than cutoff become complete, with the
    one file that they count as total, so that they can be released."""
    quiet = (F.col("collection_key") != "") & (F.col("total_parts") == 0) & (F.col("updated_at") < cutoff)
    return bins.withColumns({"complete": F.col("complete") | quiet, "total_parts": F.when(quiet, F.col("collected_parts").cast("int")).otherwise(F.col("total_parts"))})


def stays(bins: DataFrame, cutoff) -> Column:
    released = F.coalesce("released", F.lit(False)) if "released" in bins.columns else F.lit(False)
    return F.col("complete") | released | (F.col("updated_at") >= cutoff)


def age_out_stale(bins: DataFrame, cutoff) -> DataFrame:
    """ST07: binaries that stay: complete, released (where that is known) or not idle since cutoff."""
    return bins.filter(stays(bins, cutoff))


def age_out_parts(parts: DataFrame, bins: DataFrame, cutoff) -> DataFrame:
    """ST07: parts that stay: all but those of binaries that go."""
    gone = bins.filter(~stays(bins, cutoff)).select("binary_id")
    return link_parts(parts).join(gone, "binary_id", "left_anti").select(*parts.columns)


def releasable(bins: DataFrame) -> DataFrame:
    """P04, without its batch limit."""
    return bins.filter("complete AND total_parts > 0")


def named_binaries(bins: DataFrame, strip_all_prefixes: bool = False) -> DataFrame:
    subject = F.when(F.col("collection_key") != "", N.collection_base_name(F.col("collection_key"), strip_all_prefixes)).otherwise(F.col("norm_subject"))
    clean = free("_n", bins)
    out = bins.withColumn("original_subject", subject).withColumn(clean, N.clean_name(F.col("original_subject")))
    out = out.withColumn("name", F.when(F.col(clean) == "", F.col("original_subject")).otherwise(F.col(clean))).drop(clean)
    return out.withColumns({"search_name": N.search_name(F.col("name")), "obfuscated": N.is_obfuscated(F.col("name")), "category_id": N.categorize(F.col("name")), "release_hash": N.release_hash(F.col("name"), F.col("total_bytes"), F.col("group_id"))})


def build_releases(bins: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Releases of complete binaries, one for each hash (the earliest update, then the id), without
    stored ones. Their guid follows from hash and binary, so a rerun makes the same."""
    first = distinct_on(named_binaries(releasable(bins)), ["release_hash"], "updated_at", "binary_id")
    if stored is not None:
        first = not_existing(first, stored, ["release_hash"])
    guid = F.substring(F.sha2(F.concat_ws("|", "release_hash", "binary_id"), 256), 1, 32)
    return first.select(guid.alias("guid"), "release_hash", "name", "search_name", "original_subject", "category_id", "group_id", "poster", "total_parts", F.col("total_bytes").alias("size"), "posted_at", "obfuscated", "binary_id")


def build_counts(bins: DataFrame, built: DataFrame) -> DataFrame:
    """Releases that were created, and binaries that repeat one or a stored one."""
    return releasable(bins).agg(F.count("*").alias("n")).join(built.agg(F.count("*").alias("created"))).select("created", (F.col("n") - F.col("created")).alias("duplicates"))


def release_segments(parts: DataFrame, releases: DataFrame) -> DataFrame:
    """Each release's segments, numbered from 1 in order of part and article number."""
    p = link_parts(parts).filter("binary_id IS NOT NULL AND message_id <> ''").select("binary_id", F.struct("part_number", "article_number", "message_id", "bytes", "subject").alias("s"))
    joined = p.join(releases.select("guid", "binary_id"), "binary_id")
    order = Window.partitionBy("binary_id", "guid").orderBy("s.part_number", "s.article_number")  # as the join has dealt them
    return joined.select("guid", F.row_number().over(order).alias("number"), "s.part_number", "s.article_number", "s.message_id", "s.bytes", "s.subject")


def linked_layout(parts: DataFrame, bins: DataFrame, releases: DataFrame, buckets: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts, binaries and releases in buckets of binary_id, for J02, J04, J08, B13 and B23, which then move no parts. Jobs that change
    a part's key must drop its binary_id, as it follows from the key. A binary has as many parts as its release has articles, so no
    bucket is hot; parts without a binary, which may be many, are dealt by their own id. Without a number of ``buckets`` there are as many as
    shuffles have partitions, and more for many parts, so that no task sorts more parts than fit its memory."""
    buckets = buckets or max(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-parts.count() // BUCKET_ROWS))
    linked = link_parts(parts).withColumn("binary_id", F.coalesce("binary_id", F.concat(F.lit("-"), F.col("part_id").cast("string"))))
    return bucketed(linked, "parts", "binary_id", buckets, ("part_id",)), bucketed(bins, "binaries", "binary_id", buckets), bucketed(releases, "releases", "binary_id", buckets)


def segments_array(segments: DataFrame) -> DataFrame:
    """The ordered list of each release, as array and as JSON. A release's list is one value by
    its definition."""
    one = F.struct("number", "message_id", "bytes", "subject")
    return segments.groupBy("guid").agg(F.array_sort(F.collect_list(one)).alias("segments")).withColumn("segments_json", F.to_json("segments"))


def manifest_export(releases: DataFrame, segments: DataFrame, group_names: DataFrame) -> DataFrame:
    """An XML manifest for each release with segments; a group without a name has an empty one."""
    joined = releases.join(segments_array(segments), "guid").join(group_names, "group_id", "left")
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&#34;"))
    lines = F.transform("segments", lambda s: F.concat(F.lit('<segment bytes="'), s["bytes"].cast("string"), F.lit('" number="'), s["number"].cast("string"), F.lit('">'), esc(s["message_id"]), F.lit("</segment>")))
    subject = F.coalesce(F.nullif(F.get("segments", F.lit(0))["subject"], F.lit("")), F.col("name"))
    xml = F.concat(F.lit('<file poster="'), esc(F.col("poster")), F.lit('" date="'), F.unix_seconds(F.col("posted_at").cast("timestamp")).cast("string"), F.lit('" subject="'), esc(subject), F.lit('"><groups><group>'), F.coalesce("group_name", F.lit("")), F.lit("</group></groups><segments>"), F.array_join(lines, ""), F.lit("</segments></file>"))
    return joined.select("guid", F.concat(N.safe_filename(F.col("name")), F.lit(".nzb")).alias("filename"), xml.alias("xml"))


def feed_items(releases: DataFrame, base_url: str) -> DataFrame:
    """Items with their attributes: size, grabs (0 where they aren't counted) and, if it has one, category."""
    date = F.date_format(F.col("posted_at").cast("timestamp"), "EEE, dd MMM yyyy HH:mm:ss Z")
    link, text = F.concat(F.lit(f"{base_url}/api?t=get&id="), "guid"), lambda c: F.col(c).cast("string")
    grabs = F.coalesce(text("grabs"), F.lit("0")) if "grabs" in releases.columns else F.lit("0")
    one = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    attributes = F.filter(F.array(one("size", text("size")), one("grabs", grabs), one("category", text("category_id"))), lambda a: a["value"].isNotNull())
    return releases.select("guid", F.col("name").alias("title"), link.alias("link"), date.alias("pub_date"), text("category_id").alias("category"), text("size").alias("size_attr"), grabs.alias("grabs_attr"), attributes.alias("attributes"))


def category_tree(categories: DataFrame) -> DataFrame:
    """S13"""
    kids = categories.filter("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("subcats"))
    return categories.filter("parent_id IS NULL").join(kids, "id", "left").select("id", "name", "subcats")


def search_documents(releases: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Search rows by guid; of several versions the last written (highest rank) wins."""
    docs = releases.select("guid", "name", "search_name", "category_id", "size", "obfuscated", F.col("posted_at").alias("sort_at"), F.lit(1).alias("rank"))
    if stored is not None:
        docs = docs.unionByName(stored.withColumn("rank", F.lit(0)))
    return distinct_on(docs.withColumn("rank", -F.col("rank")), ["guid"], "rank").drop("rank")


def monthly_partitions(parts: DataFrame) -> DataFrame:
    """Months of ingest with bounds and name; as a layout, write.partitionBy('ingest_month')."""
    m = parts.select(F.date_trunc("month", "posted_at").alias("from_ts")).groupBy("from_ts").agg(F.count("*").alias("rows"))
    return m.select(F.concat(F.lit("parts_"), F.date_format("from_ts", "yyyy_MM")).alias("partition_name"), F.col("from_ts").cast("timestamp_ntz").alias("from_ts"), F.add_months("from_ts", 1).cast("timestamp_ntz").alias("to_ts"), "rows")


def partition_coverage(partitions: DataFrame, now, future: int) -> DataFrame:
    """Months from now on that have no partition."""
    m0 = F.date_trunc("month", F.lit(now).cast("timestamp"))
    months = partitions.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(m0), F.add_months(m0, future), F.expr("interval 1 month"))).alias("month"))
    return months.join(partitions.select(F.to_date("from_ts").alias("month")), "month", "left_anti")


def kept_partitions(partitions: DataFrame, cutoff) -> DataFrame:
    """Months that stay: those that end after cutoff."""
    return partitions.filter(F.col("to_ts") > F.lit(cutoff).cast("timestamp_ntz"))
