"""Bodies, repair, segments, listings and reports as queries, each with its SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ..functions import names as N
from ..operators import assembly as A
from ..operators import jobs as J
from ..operators import repair as P
from ..operators import search as Q
from ..operators import state as T
from ..sources import views as V
from ..sources.tables import once
from ..streaming import ingest as I
from . import catalogue_jobs as C
from .catalogue import SQL, add, bins, ntz, parts, releases, segments
from .sql import query as q

CUT = "1997-01-01 00:00:00"
H, K = "CAST('0x' || substr(release_hash, 1, 4) AS INT)", "CAST('0x' || substr(release_hash, 5, 4) AS INT)"
digits = lambda at: F.conv(F.substring("release_hash", at, 4), 16, 10).cast("int")


# Bodies.
@F.arrow_udf(Y.BinaryType())
def yenc_encoded(texts: pa.Array) -> pa.Array:
    """A body around each text: the inverse of U02, with lines of 128 bytes."""
    out = []
    for x in texts:
        raw = np.frombuffer(x.as_buffer(), dtype=np.uint8) + np.uint8(42) if x.is_valid else np.zeros(0, np.uint8)
        lines = [b"Path: x", b"=ybegin line=128 name=a b"]
        for at in range(0, len(raw), 128):
            part = raw[at : at + 128]
            special = np.isin(part, [0, 10, 13, 61])
            wide = np.stack([np.where(special, 61, 0), np.where(special, part + np.uint8(64), part)], axis=1).astype(np.uint8)
            lines.append(wide[np.stack([special, np.ones(len(part), bool)], axis=1)].tobytes())
        out.append(b"\r\n".join([*lines, b"=yend size=1", b"tail"]))
    return pa.array(out, pa.binary())


add("U02_yenc_decode", "SELECT doc_id, CASE WHEN doc_id % 7 > 0 THEN sha256(text) END AS data FROM documents")(
    lambda s, d: V.table(s, d, "documents").select("doc_id", F.sha2(P.yenc_decode(F.when(F.col("doc_id") % 7 > 0, yenc_encoded(F.col("text"))).otherwise(F.col("text").cast("binary"))), 256).alias("data"))
)


def par2_packet(name, kind: bytes = P.PAR2_FILE):
    """A packet with a file's description, as columns: header, three digests and a length, the name."""
    padded = F.rpad(name.cast("binary"), (F.ceil(F.octet_length(name) / 4) * 4).cast("int"), F.lit(b"\0"))
    size = F.lit(P.PAR2_HEADER + P.PAR2_NAME) + F.octet_length(padded)
    length = F.concat(F.unhex(F.lpad(F.hex(size % 256), 2, "0")), F.unhex(F.lpad(F.hex(F.floor(size / 256)), 2, "0")), F.lit(bytes(6)))
    return F.concat(F.lit(P.PAR2_MAGIC), length, F.lit(bytes(32)), F.lit(kind), F.lit(bytes(P.PAR2_NAME)), padded)


def par2_bodies(docs):
    name = F.concat_ws(".", "source", F.col("doc_id").cast("string"), F.lit("mkv"))
    corrupt = F.lit(P.PAR2_MAGIC + b"\xff" * 8)
    return docs.select("doc_id", F.concat(F.lit(b"junk"), par2_packet(name), corrupt, par2_packet(F.lit("other"), b"PAR 2.0\x00Main\0\0\0\0"), par2_packet(F.concat(name, F.lit(".nfo"))), par2_packet(name)).alias("body"))


add("U03_par2_filenames", "SELECT doc_id, source || '.' || doc_id || '.mkv,' || source || '.' || doc_id || '.mkv.nfo' AS names, true AS magic FROM documents")(
    lambda s, d: par2_bodies(V.table(s, d, "documents")).select("doc_id", F.array_join(P.par2_filenames(F.col("body")), ",").alias("names"), P.has_par2_magic(F.col("body")).alias("magic"))
)


@F.arrow_udf(Y.BinaryType())
def yenc_encoded_binary(raw: pa.Array) -> pa.Array:
    return pa.array([None if x is None else b"=ybegin line=128 name=a\r\n" + b"".join(b"=" + bytes([(v + 106) % 256]) if (v + 42) % 256 in (0, 10, 13, 61) else bytes([(v + 42) % 256]) for v in x) + b"\r\n=yend" for x in raw.to_pylist()], pa.binary())


# Segments.
add("W04_segment_numbering", q("SELECT guid, message_id, number FROM segments", "segments"))(lambda s, d: P.number_segments(segments(s, d).withColumn("number", 99 - F.col("number"))).select("guid", "message_id", F.col("number").cast("long").alias("number")))
add("B03_snapshot_segments", q("SELECT r.guid, count(number) AS n, coalesce(string_agg(message_id, ',' ORDER BY number), '') AS ids FROM releases r LEFT JOIN segments s ON s.guid = r.guid GROUP BY r.guid", "segments"))(
    lambda s, d: P.snapshot_segments(releases(s, d), parts(s, d)).select("guid", F.size("segments").cast("long").alias("n"), F.array_join("segments.message_id", ",").alias("ids"))
)


def half_stored(s, d):
    """Releases of which half have stored segments; a table, as the releases are."""

    def make():
        all_of = P.snapshot_segments(releases(s, d), parts(s, d))
        return all_of.withColumn("segments", F.when(F.col("guid") < "8", F.col("segments")).otherwise(F.slice("segments", 1, 0)))

    return once(s, d, "half_stored", make)


def each_segment(df, *more):
    """A row for each segment, and one with nulls for a release without any."""
    return df.select("guid", *more, F.explode_outer("segments").alias("s")).select("guid", *more, F.col("s.number").cast("long").alias("number"), "s.message_id", "s.bytes")


add("J03_segments_or_parts", q("SELECT r.guid, r.guid < '8' AS stored, number, message_id, bytes FROM releases r LEFT JOIN segments s ON s.guid = r.guid", "segments"))(lambda s, d: each_segment(P.segments_or_parts(half_stored(s, d), parts(s, d)), "stored"))
add("B04_backfill_segments", q("SELECT r.guid, number, message_id, bytes FROM releases r LEFT JOIN segments s ON s.guid = r.guid AND (r.guid < '8' OR group_id <> 3)", "segments"))(lambda s, d: each_segment(P.backfill_segments(half_stored(s, d), parts(s, d).filter("group_id <> 3"))[0]))
add("B04_backfill_counts", q("SELECT count(*) FILTER (group_id <> 3) AS repaired, count(*) FILTER (group_id = 3) AS unresolved FROM releases WHERE guid >= '8'", "releases"))(lambda s, d: P.backfill_segments(half_stored(s, d), parts(s, d).filter("group_id <> 3"))[1])

# Repair.
DONE = "(SELECT binary_id FROM st WHERE pp_status = 'done')"
add("J05_retention_exists", q(f"SELECT part_id FROM linked WHERE posted_at < TIMESTAMP '{CUT}' AND binary_id IN {DONE}", "linked", st=C.STATUS))(lambda s, d: P.retention_exists(parts(s, d), bins(s, d), C.states(s, d), ntz(CUT)).select("part_id"))
changed = lambda s, d: parts(s, d).filter("part_id % 3 = 0").select("part_id", F.concat("norm_subject", F.lit("!")).alias("norm_subject"))
DIRTY = "SELECT DISTINCT binary_id FROM linked WHERE part_id % 3 = 0 AND binary_id IS NOT NULL"
add("B12_dirty_binaries", q(DIRTY, "linked"))(lambda s, d: P.dirty_binaries(parts(s, d), changed(s, d)))
add("J08_protected_binaries", q(f"{DIRTY} AND binary_id IN {DONE}", "linked", st=C.STATUS))(lambda s, d: P.protected_binaries(P.dirty_binaries(parts(s, d), changed(s, d)), C.states(s, d)))
add("J11_reparse_update", q(f"SELECT part_id, CASE WHEN part_id % 3 = 0 AND coalesce(binary_id, '') NOT IN {DONE} THEN norm_subject || '!' ELSE norm_subject END AS norm_subject FROM linked", "linked", st=C.STATUS))(lambda s, d: J.reassemble_apply(parts(s, d), C.states(s, d), changed(s, d)).select("part_id", "norm_subject"))
add("B13_reassemble_counts", q(f"SELECT count(*) FILTER (NOT p) AS updated, count(*) FILTER (p) AS kept_back, (SELECT count(*) FROM ({DIRTY}) WHERE binary_id IN {DONE}) AS protected, (SELECT count(*) FROM st WHERE pp_status <> 'done' AND binary_id IN ({DIRTY})) AS releases_deleted, (SELECT count(*) FROM binaries WHERE binary_id IN ({DIRTY}) AND binary_id NOT IN {DONE}) AS binaries_deleted FROM (SELECT coalesce(binary_id, '') IN {DONE} AS p FROM linked WHERE part_id % 3 = 0)", "linked", st=C.STATUS))(
    lambda s, d: P.reassemble_counts(parts(s, d), bins(s, d), C.states(s, d), changed(s, d))
)
stubs = lambda s, d: C.states(s, d).withColumns({"total_parts": F.when(digits(5) % 2 == 0, 0).otherwise(F.col("total_parts")), "verified": digits(9) % 4 == 0})
K9 = "CAST('0x' || substr(release_hash, 9, 4) AS INT)"
DUE = f"SELECT * FROM st WHERE {K} % 2 = 0 AND pp_status = 'done' AND {K9} % 4 <> 0"
add("J09_repair_candidates", q(f"SELECT r.guid, r.binary_id, p.part_id, s.message_id FROM ({DUE}) r JOIN segments s ON s.guid = r.guid AND s.number = 1 JOIN linked p ON p.binary_id = r.binary_id", "segments", st=C.STATUS))(lambda s, d: P.repair_candidates(stubs(s, d), segments(s, d), parts(s, d)))


add("B19_delete_group_cascade_all", q("SELECT 'part' AS kind, CAST(part_id AS VARCHAR) AS id FROM parts WHERE group_id <> 3 UNION ALL SELECT 'binary', binary_id FROM binaries WHERE group_id <> 3 UNION ALL SELECT 'release', guid FROM releases", "releases"))(
    lambda s, d: J.delete_group_cascade(parts(s, d), 3).select(F.lit("part").alias("kind"), F.col("part_id").cast("string").alias("id")).unionByName(J.delete_group_cascade(bins(s, d), 3).select(F.lit("binary").alias("kind"), F.col("binary_id").alias("id"))).unionByName(J.delete_group_cascade(releases(s, d), 3, keep=True).select(F.lit("release").alias("kind"), F.col("guid").alias("id")))
)

# Jobs and metadata.
STATES = ["queued", "running", "completed", "failed", "cancelled"]
AFTER = "CASE WHEN event_id % 5 < 2 THEN 'interrupted' ELSE ['queued', 'running', 'completed', 'failed', 'cancelled'][CAST(event_id % 5 AS INT) + 1] END"


def jobs(s, d):
    state = F.get(F.array(*map(F.lit, STATES)), (F.col("event_id") % 5).cast("int"))
    return V.table(s, d, "events").select(F.col("event_id").alias("id"), state.alias("state"), F.when(F.col("event_id") % 3 == 0, "boom").otherwise("").alias("error"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 5 >= 2, F.col("ts")).alias("finished_at"))


add("B15_requeue_jobs", f"SELECT event_id AS id, {AFTER} AS state, CASE WHEN event_id % 3 = 0 THEN 'boom' WHEN event_id % 5 < 2 THEN 'interrupted by restart' ELSE '' END AS error FROM events WHERE event_id % 5 < 2 OR ts >= TIMESTAMP '2024-01-15 00:00:00'")(lambda s, d: P.cleanup_jobs(P.interrupt_jobs(jobs(s, d), ntz("2030-01-01 00:00:00")), ntz("2024-01-15 00:00:00")).select("id", "state", "error"))
add("B16_upsert_metadata", C.ids("", "true").replace("SELECT guid FROM", "SELECT guid, CASE WHEN group_id % 2 = 0 THEN 'new' ELSE 'old' END AS external_id FROM").replace("WHERE true", "WHERE group_id % 3 = 0 OR group_id % 2 = 0"))(
    lambda s, d: J.upsert_metadata(releases(s, d).filter("group_id % 3 = 0").select("guid", F.lit("old").alias("external_id")), releases(s, d).filter("group_id % 2 = 0").select("guid", F.lit("new").alias("external_id")))
)
add("U04_lookup_provider", f"SELECT DISTINCT title, external_id FROM ({SQL['J10_enrich_lookup']})")(lambda s, d: J.enrich_lookup(releases(s, d), C.providers(s, d)).select("title", "external_id").distinct())
add("P09_unanswerable_id_query", "SELECT event_id, event_id % 3 = 0 AND event_id % 4 = 2 AS unanswerable FROM events")(
    lambda s, d: V.table(s, d, "events").select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("event_type")).otherwise(" ").alias("t"), F.expr("CASE event_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'tt0000123' WHEN 2 THEN 'bogus' END").alias("p")).select("event_id", P.unanswerable(F.col("t"), F.array(F.when(F.col("p").rlike(r"^tt\d+$"), F.col("p"))), F.col("p")).alias("unanswerable"))
)

# Listings, sets and reports.
groups = lambda s, d: T.group_state(V.passes(s, d)).withColumns({"name": F.concat(F.lit("alt.group"), F.col("group_id").cast("string")), "active": F.col("group_id") % 5 > 0})
NAMED = f"(SELECT *, 'alt.group' || group_id AS name, group_id % 5 > 0 AS active FROM ({C.GROUPS}))"
add("W08_group_page", q(f"SELECT name, consecutive_failures, count(*) OVER () AS total FROM {NAMED} WHERE active AND contains(name, 'group') ORDER BY consecutive_failures DESC NULLS LAST, name LIMIT 5 OFFSET 2", "passes"))(lambda s, d: P.group_page(groups(s, d), "GROUP", "active", sort="consecutive_failures", desc=True, limit=5, offset=2).select("name", "consecutive_failures", "total"))
add("W09_catalog_search", f"SELECT name, estimated_count, count(*) OVER () AS total FROM ({SQL['S03_group_catalog_scan']}) WHERE contains(name, 'src') ORDER BY estimated_count DESC, name LIMIT 4 OFFSET 1")(lambda s, d: P.catalog_search(C.QUERIES["S03_group_catalog_scan"](s, d), " SRC", 4, 1).select("name", "estimated_count", "total"))
add("W10_recent_errors", C.sq("SELECT guid, name FROM st WHERE pp_status = 'failed' ORDER BY posted_at DESC, guid DESC LIMIT 50"))(lambda s, d: P.recent_errors(C.states(s, d)).select("guid", "name"))
add("SET1_due_union", SQL["W05_due_queue"].replace("SELECT guid, CASE pp_status WHEN 'pending' THEN 0 ELSE 1 END AS rank", "SELECT guid"))(lambda s, d: Q.due_queue(C.states(s, d), ntz("1998-01-01 00:00:00")).select("guid"))
add("SET2_first_seen", q("SELECT binary_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(x), lambda t: list_position(x, t))), lambda i: x[i]), ' ') AS names FROM (SELECT binary_id, list_filter(string_split(search_name, ' '), lambda t: t <> '') AS x FROM releases)", "releases"))(lambda s, d: releases(s, d).select("binary_id", F.array_join(P.first_seen(F.split("search_name", " ")), " ").alias("names")))
add("SET3_difference", q("SELECT part_id FROM parts WHERE posted_at >= TIMESTAMP '1995-01-01'", "parts"))(lambda s, d: A.not_existing(parts(s, d), parts(s, d).filter(F.col("posted_at") < ntz("1995-01-01 00:00:00")), ["part_id"]).select("part_id"))
add("A06_group_release_stats", C.sq("SELECT 'alt.group' || group_id AS group_name, count(*) AS total, count(*) FILTER (pp_status = 'pending') AS pending FROM st GROUP BY group_id"))(lambda s, d: J.group_release_stats(C.states(s, d), V.headers(s, d).select("group_id").distinct().withColumn("group_name", F.concat(F.lit("alt.group"), F.col("group_id").cast("string")))).orderBy(F.desc("total"), "group_name"))
add("A19_pipeline_gauges", f"SELECT CASE WHEN starts_with(metric, 'releases_') THEN 'releases_by_status' ELSE metric END AS gauge, regexp_extract(metric, '^releases_(.*)$', 1) AS label, value FROM ({SQL['A05_pipeline_stats']})")(lambda s, d: P.pipeline_gauges(C.QUERIES["A05_pipeline_stats"](s, d)))
add("B22_admin_overview", f"SELECT 'stats' AS section, metric AS name, CAST(value AS VARCHAR) AS value FROM ({SQL['A05_pipeline_stats']}) UNION ALL SELECT 'groups', name, CAST(consecutive_failures AS VARCHAR) FROM ({SQL['W08_group_page']}) UNION ALL SELECT 'errors', guid, name FROM ({SQL['W10_recent_errors']})")(
    lambda s, d: P.admin_overview(stats=C.QUERIES["A05_pipeline_stats"](s, d), groups=C.QUERIES["W08_group_page"](s, d), errors=C.QUERIES["W10_recent_errors"](s, d))
)
add("ST03_watermark_advance", q("SELECT group_id, max(article_number) AS position FROM headers GROUP BY group_id", "headers"))(lambda s, d: I.watermark_advance(C.written(V.headers(s, d).repartition(C.files(V.table(s, d, "lineitem").count())), "feed"), V.headers(s, d)))
add("ST12_late_data", q("SELECT binary_id, collected_parts, posted_at FROM binaries", "binaries"))(lambda s, d: I.stream_assemble(C.written(parts(s, d).repartitionByRange(C.files(parts(s, d).count()), F.desc("posted_at")), "feed"), parts(s, d)).select("binary_id", "collected_parts", "posted_at"))
add("B01_build_counts", q("SELECT (SELECT count(*) FROM releases) AS created, (SELECT count(*) FROM n4) - (SELECT count(*) FROM releases) AS duplicates", "releases"))(lambda s, d: A.build_counts(bins(s, d), releases(s, d)))
add("A13_capacity_totals", q("SELECT CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS articles, round(sum(bytes) / count(*), 6) AS bytes_per_article FROM parts", "parts"))(lambda s, d: J.capacity_totals(parts(s, d)))


def first_has_none(s, d):
    """The first provider has no match for titles of a length that four divides; the second has."""
    return C.providers(s, d).withColumn("external_id", F.when((F.col("priority") > 0) | (F.length("title") % 4 > 0), F.col("external_id")))


add("J10_second_provider", f"SELECT guid, CASE WHEN len(title) % 4 = 0 THEN 'b-' || title ELSE external_id END AS external_id FROM ({SQL['J10_enrich_lookup']}) WHERE matched")(lambda s, d: J.enrich_lookup(releases(s, d), first_has_none(s, d)).filter("matched").select("guid", "external_id"))
add("J10_merged_identifiers", f"SELECT guid, 'show' AS source, external_id AS identifier FROM ({SQL['J10_enrich_lookup']}) WHERE matched UNION SELECT guid, 'group', CAST(group_id AS VARCHAR) FROM ({C.ids('', 'true').replace('SELECT guid FROM', 'SELECT guid, group_id FROM')})")(
    lambda s, d: J.merged_identifiers(J.enrich_lookup(releases(s, d), C.providers(s, d)).select("guid", F.lit("show").alias("source"), F.col("external_id").alias("identifier")), releases(s, d).select("guid", F.lit("group").alias("source"), F.explode(F.array(*[F.col("group_id").cast("string")] * 2)).alias("identifier")))
)
