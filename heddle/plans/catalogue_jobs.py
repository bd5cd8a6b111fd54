"""Predicates, joins, aggregations, windows, jobs and state machines as queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly as A
from ..operators import bodies as Y
from ..operators import jobs as J
from ..operators import search as Q
from ..operators import state as T
from ..sources import views as V
from ..sources.tables import folder, once, scratch
from ..streaming import ingest as I
from .catalogue import BIN, QUERIES, REL, ROUTES, add, bins, ntz, parts, pick, releases, segments
from .sql import query as q

R = ("releases",)
STATUS = "SELECT *, CASE WHEN h % 3 = 0 THEN 'pending' WHEN h % 3 = 1 THEN 'done' ELSE 'failed' END AS pp_status, CASE WHEN h % 3 = 2 THEN h % 5 ELSE 0 END AS pp_attempts, h % 3 = 2 AND h % 5 = 4 AS permanent, CASE WHEN h % 3 = 2 THEN posted_at END AS next_retry FROM (SELECT *, CAST('0x' || substr(release_hash, 1, 4) AS INT) AS h FROM releases)"


def states(s, d):
    return J.with_status(releases(s, d))


def sq(select, *needs):
    return q(select, "releases", *needs, st=STATUS)


ids = lambda name, where, needs=R: q(f"SELECT guid FROM releases WHERE {where}", *needs)

add("P01_unassigned_single", q("SELECT part_id FROM parts WHERE collection_key = '' AND norm_subject <> '' AND total_parts > 0", "parts"))(lambda s, d: A.unassigned_single(parts(s, d)).select("part_id"))
add("P02_unassigned_collection", q("SELECT part_id FROM parts WHERE collection_key <> ''", "parts"))(lambda s, d: A.unassigned_collection(parts(s, d)).select("part_id"))
add("P03_ambiguous_parts_all", q("SELECT part_id, message_id FROM parts WHERE collection_key = '' AND total_parts = 0", "parts"))(lambda s, d: A.ambiguous_parts(parts(s, d)).select("part_id", "message_id"))
add("P04_releasable", q("SELECT binary_id FROM binaries WHERE complete AND total_parts > 0", "binaries"))(lambda s, d: A.releasable(bins(s, d)).select("binary_id"))
add("P05_token_and_search", ids("", "contains(search_name, 'movie') AND contains(search_name, '2160')"))(lambda s, d: Q.token_and_search(releases(s, d), "2160 Movie").select("guid"))
add("P06_category_expand", ids("", "category_id BETWEEN 2000 AND 2999 OR category_id = 3040"))(lambda s, d: Q.category_expand(releases(s, d), [2000, 3040]).select("guid"))
add("P07_hide_obfuscated", ids("", "NOT obfuscated"))(lambda s, d: Q.hide_obfuscated(releases(s, d)).select("guid"))
add("P13_stub_releases", sq("SELECT guid FROM st WHERE size < 5000000 AND total_parts <= 3 AND pp_status = 'done' AND regexp_matches(name, '^[A-Za-z0-9.]{15,}$')"))(lambda s, d: J.stub_releases(states(s, d)).select("guid"))
add("P08_identifier_all", q("SELECT guid FROM releases WHERE group_id = 4 AND category_id % 2 = 0", "releases"))(
    lambda s, d: Q.identifier_all(releases(s, d), releases(s, d).select("guid", F.explode(F.array(F.struct(F.lit("tvdb").alias("source"), F.col("group_id").cast("string").alias("identifier")), F.struct(F.lit("tmdb").alias("source"), (F.col("category_id") % 2).cast("string").alias("identifier")))).alias("i")).select("guid", "i.*"), [("tvdb", "4"), ("tmdb", "0")]).select("guid")
)
add("P10_event_routing", "SELECT event_id, 'all' AS destination FROM events UNION ALL SELECT event_id, 'pager' FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, 'sales' FROM events WHERE event_type IN ('purchase', 'signup')")(
    lambda s, d: Q.event_routing(V.table(s, d, "events"), s.createDataFrame([("all", True, None), ("pager", True, ["error"]), ("sales", True, ["purchase", "signup"]), ("off", False, None)], "destination string, enabled boolean, types array<string>")).select("event_id", "destination")
)
add("P11_name_filter_ci", "SELECT o_orderkey AS k FROM orders WHERE contains(lower(o_orderpriority), 'urg')")(lambda s, d: V.table(s, d, "orders").filter(F.lower("o_orderpriority").contains("URG".lower())).select(F.col("o_orderkey").alias("k")))
add("P12_log_level_filter", "SELECT event_id FROM events WHERE event_type IN ('error', 'signup')")(lambda s, d: V.table(s, d, "events").withColumn("level", F.expr("CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END")).filter(J.N.level_rank(F.col("level")) >= 4).select("event_id"))

add("J01_link_parts", q("SELECT part_id, binary_id FROM linked", "linked"))(lambda s, d: A.link_parts(parts(s, d)).select("part_id", "binary_id"))
add("J02_release_segments", q("SELECT guid, number, message_id, bytes FROM segments", "segments"))(lambda s, d: segments(s, d).select("guid", F.col("number").cast("long").alias("number"), "message_id", "bytes"))
add("J04_retention_candidates", q("SELECT part_id FROM linked WHERE posted_at < TIMESTAMP '1997-01-01' AND binary_id IN (SELECT binary_id FROM st WHERE pp_status = 'done')", "linked", st=STATUS))(lambda s, d: J.retention_candidates(parts(s, d), states(s, d), ntz("1997-01-01 00:00:00")).select("part_id"))
add("J06_needs_metadata", sq("SELECT guid FROM st WHERE category_id BETWEEN 5000 AND 5999 AND NOT obfuscated AND pp_status <> 'done'"))(lambda s, d: Q.needs_metadata(releases(s, d), states(s, d).filter("pp_status = 'done'")).select("guid"))
add("J07_not_existing", q("SELECT part_id FROM parts WHERE group_id <> 3", "parts"))(lambda s, d: A.not_existing(parts(s, d), parts(s, d).filter("group_id = 3"), A.NATURAL).select("part_id"))
add("J10_enrich_lookup", q("SELECT guid, title, CASE WHEN len(title) % 2 = 0 THEN 'a-' || title END AS external_id, len(title) % 2 = 0 AS matched FROM (SELECT guid, title FROM (SELECT guid, trim(trim(regexp_replace(lower(w[1 : least(CASE WHEN regexp_matches(w, '(?i)\\bs(\\d{1,2})\\s*e(\\d{1,3})\\b') THEN strpos(w, regexp_extract(w, '(?i)\\bs(\\d{1,2})\\s*e(\\d{1,3})\\b')) ELSE len(w) + 1 END, CASE WHEN regexp_matches(w, '\\b(19\\d{2}|20\\d{2})\\b') THEN len(regexp_extract(w, '^(.*?)\\b(19\\d{2}|20\\d{2})\\b', 1)) + 1 ELSE len(w) + 1 END) - 1]), '[\\t\\n\\f\\r ]+', ' ', 'g'), ' -–_.')) AS title FROM (SELECT guid, translate(name, '._', '  ') AS w FROM releases)))", "releases"))(
    lambda s, d: J.enrich_lookup(releases(s, d), providers(s, d)).select("guid", "title", "external_id", "matched")
)


def providers(s, d):
    t = releases(s, d).select(J.N.parse_title(F.col("name"))["title"].alias("title")).distinct().filter(F.length("title") % 2 == 0)
    one = t.select("title", F.lit(0).alias("priority"), F.concat(F.lit("a-"), "title").alias("external_id"))
    return one.unionByName(t.select("title", F.lit(1).alias("priority"), F.concat(F.lit("b-"), "title").alias("external_id")))


add("J12_group_names", q("SELECT guid, CASE WHEN group_id < 5 THEN 'alt.group' || group_id ELSE '' END AS group_name FROM releases", "releases"))(lambda s, d: J.group_names(releases(s, d), V.headers(s, d).filter("group_id < 5").select("group_id").distinct().withColumn("group_name", F.concat(F.lit("alt.group"), F.col("group_id").cast("string")))).select("guid", "group_name"))
FIRST = "list_filter(string_split(search_name, ' '), lambda t: t <> '')[1:3]"
add("J13_related_releases", q(f"SELECT \"of\", guid, n FROM (SELECT a.guid AS \"of\", b.guid, CAST(row_number() OVER (PARTITION BY a.guid ORDER BY b.posted_at DESC, b.guid DESC) AS INT) AS n FROM (SELECT guid, {FIRST} AS w FROM releases) a JOIN (SELECT guid, posted_at, search_name AS s FROM releases WHERE NOT obfuscated) b ON a.guid <> b.guid AND len(w) > 0 AND contains(s, w[1]) AND (len(w) < 2 OR contains(s, w[2])) AND (len(w) < 3 OR contains(s, w[3]))) WHERE n <= 5", "releases"))(lambda s, d: Q.related_releases(releases(s, d)))
add("J14_discovered_vs_known", "SELECT DISTINCT source AS name, CASE WHEN source < 'src3' THEN 'existing' ELSE 'added' END AS status FROM documents")(lambda s, d: Q.discovered_vs_known(V.table(s, d, "documents").select(F.col("source").alias("name")), V.table(s, d, "documents").filter("source < 'src3'").select(F.col("source").alias("name")).distinct()))

for name, f, where in (("A01_assemble_singles", A.assemble_singles, "collection_key = ''"), ("A02_assemble_collections", A.assemble_collections, "collection_key <> ''")):
    add(name, q(f"SELECT {BIN} FROM binaries WHERE {where}", "binaries"))(lambda s, d, f=f: f(parts(s, d)).withColumn("total_parts", F.col("total_parts").cast("int")).drop("updated_at"))
add("A03_merge_binaries", q("SELECT binary_id, collected_parts, total_bytes, complete FROM binaries", "binaries"))(lambda s, d: A.merge_partials(A.partials(parts(s, d).filter("part_id % 2 = 0")).unionByName(A.partials(parts(s, d).filter("part_id % 2 = 1")))).select("binary_id", "collected_parts", "total_bytes", "complete"))
add("A04_is_complete", q("SELECT binary_id, CASE WHEN total_parts > 0 THEN collected_parts >= total_parts ELSE collected_parts >= 1 END AS done FROM binaries", "binaries"))(lambda s, d: bins(s, d).select("binary_id", A.is_complete(F.col("collected_parts"), F.col("total_parts")).alias("done")))
add("A05_pipeline_stats", sq("SELECT 'parts' AS metric, count(*) AS value FROM linked UNION ALL SELECT 'unassigned', count(*) FILTER (binary_id IS NULL) FROM linked UNION ALL SELECT 'binaries', count(*) FROM binaries UNION ALL SELECT 'complete', count(*) FILTER (complete) FROM binaries UNION ALL SELECT 'releases', count(*) FROM st UNION ALL SELECT 'releases_pending', count(*) FILTER (pp_status = 'pending') FROM st UNION ALL SELECT 'releases_done', count(*) FILTER (pp_status = 'done') FROM st UNION ALL SELECT 'releases_failed', count(*) FILTER (pp_status = 'failed') FROM st UNION ALL SELECT 'exhausted', count(*) FILTER (permanent) FROM st", "linked"))(lambda s, d: J.pipeline_stats(parts(s, d), bins(s, d), states(s, d)))
add("A08_retention_report", q("SELECT count(*) AS candidate_parts, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS candidate_bytes, count(DISTINCT binary_id) AS binaries, count(DISTINCT group_id) AS groups, min(posted_at) AS oldest, max(posted_at) AS newest, (SELECT count(*) FROM linked) AS all_parts, (SELECT count(*) FROM linked) - count(*) AS retained FROM linked WHERE posted_at < TIMESTAMP '1997-01-01' AND binary_id IN (SELECT binary_id FROM st WHERE pp_status = 'done')", "linked", st=STATUS))(
    lambda s, d: J.retention_report(parts(s, d), J.retention_candidates(parts(s, d), states(s, d), ntz("1997-01-01 00:00:00")))
)
add("A09_failed_release_counts", sq("SELECT count(*) FILTER (pp_status = 'failed') AS total, count(*) FILTER (permanent) AS permanent FROM st"))(lambda s, d: states(s, d).agg(F.count_if(F.col("pp_status") == "failed").alias("total"), F.count_if("permanent").alias("permanent")))
add("A10_throughput_ema", q("SELECT group_id, round(list_reduce(xs, lambda a, x: a + 0.3 * (x - a)), 4) AS ema FROM (SELECT group_id, list(articles / (duration_ms / 1000.0) ORDER BY ts, event_id) AS xs FROM passes WHERE err = '' AND articles > 0 AND duration_ms > 0 GROUP BY group_id)", "passes"))(lambda s, d: T.throughput_ema(V.passes(s, d)).select("group_id", F.round("ema", 4).alias("ema")))
GROUPS = "SELECT group_id, count(*) FILTER (err <> '' AND (good IS NULL OR (ts, event_id) > good)) AS consecutive_failures, max(ts) FILTER (err = '') AS last_success_at, max(ts) FILTER (err = '' AND NOT backfill) AS last_forward_at, max(ts) FILTER (err = '' AND backfill) AS last_backfill_at, arg_max(err, (ts, event_id)) AS last_error, arg_max(server_high, (ts, event_id)) FILTER (server_high > 0) AS server_high FROM (SELECT *, max((ts, event_id)) FILTER (err = '') OVER (PARTITION BY group_id) AS good FROM passes) GROUP BY group_id"
for name in ("A11_consecutive_failures", "A12_last_success_times", "ST13_pass_outcomes"):
    add(name, q(GROUPS, "passes"))(lambda s, d: T.group_state(V.passes(s, d)))
add("A13_capacity_stats", q("SELECT group_id, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS articles, round(sum(bytes) / count(*), 6) AS bytes_per_article FROM parts GROUP BY group_id", "parts"))(lambda s, d: J.capacity_stats(parts(s, d)))
add("A14_capped_count", q("SELECT least(count(*), 100) AS total, count(*) > 100 AS approximate FROM releases", "releases"))(lambda s, d: Q.capped_count(releases(s, d), 100).withColumn("total", F.col("total").cast("long")))

#: Latency bounds in milliseconds (the client library's default buckets).
BOUNDS = [5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000]
LE = ", ".join(f"count(*) FILTER (ms <= {b}) AS le_{b}" for b in BOUNDS)
for name in ("A18_route_metrics", "A18_route_metrics_all"):
    add(name, q(f"SELECT method, {pick(ROUTES)} AS route, status, count(*) AS requests, {LE} FROM requests GROUP BY ALL", "requests"))(lambda s, d: J.route_metrics(V.requests(s, d), BOUNDS))
add("A20_has_any", sq("SELECT count(*) > 0 AS any FROM st WHERE permanent"))(lambda s, d: states(s, d).filter("permanent").limit(1).agg((F.count("*") > 0).alias("any")))

add("W01_cap_per_key", q("SELECT part_id FROM (SELECT part_id, row_number() OVER (PARTITION BY group_id, poster ORDER BY article_number) AS k FROM parts) WHERE k <= 5", "parts"))(lambda s, d: A.cap_per_key(parts(s, d), ["group_id", "poster"], 5, "article_number").select("part_id"))
add("W02_first_keys", q("SELECT DISTINCT group_id, norm_subject FROM parts ORDER BY group_id, norm_subject LIMIT 50", "parts"))(lambda s, d: A.first_keys(parts(s, d), ["group_id", "norm_subject"], 50))
add("W05_due_queue", sq("SELECT guid, CASE pp_status WHEN 'pending' THEN 0 ELSE 1 END AS rank FROM st WHERE pp_status = 'pending' OR (pp_status = 'failed' AND pp_attempts < 3 AND NOT permanent AND next_retry <= TIMESTAMP '1998-01-01')"))(lambda s, d: Q.due_queue(states(s, d), ntz("1998-01-01 00:00:00")).select("guid", "rank"))
add("W06_offset_page", q("SELECT guid FROM releases ORDER BY posted_at DESC, guid DESC LIMIT 20 OFFSET 40", "releases"))(lambda s, d: Q.offset_page(releases(s, d), 20, 40).select("guid"))
add("W07_keyset_page", q("SELECT guid, CAST(ceil(k / 25.0) AS BIGINT) AS page, k % 25 = 0 AS last FROM (SELECT guid, row_number() OVER (ORDER BY posted_at DESC, guid DESC) AS k FROM releases)", "releases"))(lambda s, d: Q.keyset_pages(releases(s, d), 25).select("guid", "page", "last"))
add("W11_top_groups", q("SELECT group_id, CAST(sum(bytes) AS BIGINT) AS bytes FROM parts GROUP BY group_id ORDER BY bytes DESC LIMIT 3", "parts"))(lambda s, d: J.capacity_stats(parts(s, d)).orderBy(F.desc("bytes")).limit(3).select("group_id", "bytes"))
add("W12_smallest_first", q("SELECT guid, message_id FROM (SELECT *, row_number() OVER (PARTITION BY guid ORDER BY b, CASE WHEN b = 2 THEN bytes ELSE 0 END, number) AS k FROM (SELECT *, CASE WHEN ends_with(lower(trim(f)), '.par2') THEN 0 WHEN ends_with(lower(trim(f)), '.nfo') THEN 1 ELSE 2 END AS b FROM (SELECT *, CASE WHEN regexp_matches(subject, '\"[^\"]*\"') THEN regexp_extract(subject, '\"([^\"]*)\"', 1) ELSE trim(subject) END AS f FROM segments))) WHERE k <= 4", "segments"))(lambda s, d: J.smallest_first(segments(s, d)).select("guid", "message_id"))

add("B01_build_releases", q(f"SELECT {REL} FROM releases", "releases"))(lambda s, d: A.build_releases(bins(s, d)).withColumn("total_parts", F.col("total_parts").cast("int")).drop("original_subject"))
add("B08_pp_backoff", sq("SELECT guid, least(300 * CAST(power(2, greatest(pp_attempts - 1, 0)) AS BIGINT), 21600) AS seconds FROM st"))(lambda s, d: states(s, d).select("guid", T.pp_backoff_seconds(F.col("pp_attempts")).alias("seconds")))
add("B09_requeue_failed", sq("SELECT guid, CASE WHEN pp_status = 'failed' THEN 'pending' ELSE pp_status END AS pp_status, CASE WHEN pp_status = 'failed' THEN 0 ELSE pp_attempts END AS pp_attempts FROM st"))(lambda s, d: J.requeue_failed(states(s, d)).select("guid", "pp_status", "pp_attempts"))
add("B07_record_failure", sq("SELECT guid, CASE WHEN hit THEN 'failed' ELSE pp_status END AS pp_status, pp_attempts + CAST(hit AS INT) AS pp_attempts, CASE WHEN hit THEN pp_attempts + 1 >= 3 ELSE permanent END AS permanent FROM (SELECT *, pp_status = 'pending' OR pp_attempts = 2 AS hit FROM st)"))(
    lambda s, d: J.record_failure(states(s, d), states(s, d).filter("pp_status = 'pending' OR pp_attempts = 2").select("guid", F.lit(False).alias("permanent_failure"), F.col("posted_at").alias("at"))).select("guid", "pp_status", "pp_attempts", "permanent")
)
add("B12_reparse_plan", q("SELECT part_id FROM parts WHERE collection_key <> '' AND part_id % 3 = 0", "parts"))(lambda s, d: J.reparse_plan(parts(s, d).withColumn("collection_key", F.when(F.col("part_id") % 3 == 0, "").otherwise(F.col("collection_key")))).select("part_id"))
add("B13_reassemble_apply", q("SELECT part_id, CASE WHEN NOT p THEN norm_subject || '!' ELSE norm_subject END AS norm_subject, p AS protected FROM (SELECT *, binary_id IS NOT NULL AND binary_id IN (SELECT binary_id FROM st WHERE pp_status = 'done') AS p FROM linked)", "linked", st=STATUS))(
    lambda s, d: J.reassemble_apply(parts(s, d), states(s, d), parts(s, d).select("part_id", F.concat("norm_subject", F.lit("!")).alias("norm_subject"))).select("part_id", "norm_subject", "protected")
)
add("B14_prune_parts", q("SELECT part_id FROM linked WHERE NOT (posted_at < TIMESTAMP '1997-01-01' AND coalesce(binary_id, '') IN (SELECT binary_id FROM st WHERE pp_status = 'done'))", "linked", st=STATUS))(lambda s, d: J.prune_parts(parts(s, d), J.retention_candidates(parts(s, d), states(s, d), ntz("1997-01-01 00:00:00"))).select("part_id"))
add("B19_delete_group_cascade", q("SELECT guid, CASE WHEN group_id <> 3 THEN group_id END AS group_id FROM releases", "releases"))(lambda s, d: J.delete_group_cascade(releases(s, d), 3, keep=True).select("guid", "group_id"))
#: Groups of the pass log, every fifth inactive; half a minute from a whole one, so that rounding shows.
NOW = "2024-01-30 12:00:29.5"
health = lambda s, d: T.group_state(V.passes(s, d)).withColumns({"active": F.col("group_id") % 5 > 0, "last_scanned_high": F.col("server_high") - F.col("group_id") * 20_000})
LAG = f"SELECT *, group_id % 5 > 0 AS active, CASE WHEN server_high > 0 THEN greatest(group_id * 20000, 0) ELSE 0 END AS lag, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_success_at)) / 60000000.0::DOUBLE AS age FROM ({GROUPS})"
RANKS = "SELECT *, CASE WHEN consecutive_failures >= 5 THEN 3 WHEN consecutive_failures >= 1 THEN 2 ELSE 1 END AS f, CASE WHEN lag >= 500000 THEN 3 WHEN lag >= 50000 THEN 2 ELSE 1 END AS l, CASE WHEN age >= 1440 THEN 3 WHEN age >= 360 THEN 2 ELSE 1 END AS a, CAST(round(age) AS BIGINT) AS m FROM (" + LAG + ")"
add("B20_classify_group_health", q(f"SELECT group_id, CASE WHEN NOT active OR (age IS NULL AND greatest(f, l) = 1) THEN 'unknown' ELSE ['ok', 'warn', 'error'][greatest(f, l, CASE WHEN age IS NULL THEN 1 ELSE a END)] END AS level, CASE WHEN NOT active THEN 'group inactive' ELSE concat_ws('; ', CASE WHEN f > 1 THEN consecutive_failures || ' consecutive failures' END, CASE WHEN l > 1 THEN lag || ' articles behind' END, CASE WHEN age IS NULL AND greatest(f, l) = 1 THEN 'never scanned successfully' WHEN age IS NOT NULL AND a > 1 THEN 'no success in ' || CASE WHEN m >= 60 THEN (m // 60) || 'h' ELSE '' END || (m % 60) || 'm0s' END) END AS reasons, lag FROM ({RANKS})", "passes"))(lambda s, d: T.classify_group_health(health(s, d), F.lit(NOW).cast("timestamp")))
add("A07_group_health_stats", q(f"SELECT count(*) AS active, count(*) FILTER (lag > 0) AS behind, max(lag) AS max_lag, CAST(sum(lag) AS BIGINT) AS total_lag, count(*) FILTER (consecutive_failures > 0) AS failing, max(consecutive_failures) AS max_failures, round(max(age) * 60, 3) AS oldest_success_seconds, count(*) FILTER (age IS NULL) AS never_scanned FROM ({LAG}) WHERE active", "passes"))(lambda s, d: T.group_health_stats(health(s, d), F.lit(NOW).cast("timestamp")).withColumn("oldest_success_seconds", F.round("oldest_success_seconds", 3)))
add("B21_project_capacity", q("SELECT days, CAST(b * days AS BIGINT) AS growth_bytes, t + CAST(b * days AS BIGINT) AS projected_bytes, CAST(b * 30 AS BIGINT) AS retained_bytes FROM (SELECT CAST(sum(bytes) AS BIGINT) AS t, 10.0::DOUBLE * 86400 * 1000 AS b FROM parts), (VALUES (30), (90), (365)) v(days)", "parts"))(lambda s, d: T.project_capacity(parts(s, d).agg(F.sum("bytes").alias("db_bytes")).withColumns({"rate": F.lit(10.0), "bytes_per": F.lit(1000.0)}), 30, [30, 90, 365]))
add("B23_trace_release", q("SELECT part_id, CASE WHEN l.binary_id IS NULL THEN 'unassigned' WHEN NOT complete THEN 'incomplete' WHEN b.total_parts = 0 THEN 'unknown total' WHEN guid IS NULL THEN 'duplicate release' ELSE 'released' END AS stage FROM linked l LEFT JOIN binaries b ON b.binary_id = l.binary_id LEFT JOIN releases r ON r.binary_id = l.binary_id", "linked"))(lambda s, d: J.trace(parts(s, d), bins(s, d), releases(s, d)))

add("ST06_settle_quiet", q("SELECT binary_id, complete OR q AS complete, CASE WHEN q THEN CAST(collected_parts AS INT) ELSE CAST(total_parts AS INT) END AS total_parts FROM (SELECT *, collection_key <> '' AND total_parts = 0 AND updated_at < TIMESTAMP '1998-01-01' AS q FROM binaries)", "binaries"))(lambda s, d: A.settle_quiet(bins(s, d), ntz("1998-01-01 00:00:00")).select("binary_id", "complete", F.col("total_parts").cast("int").alias("total_parts")))
add("ST07_age_out_stale", q("SELECT binary_id FROM binaries WHERE complete OR updated_at >= TIMESTAMP '1998-01-01'", "binaries"))(lambda s, d: A.age_out_stale(bins(s, d), ntz("1998-01-01 00:00:00")).select("binary_id"))
add("ST07_age_out_stale_parts", q("SELECT part_id FROM linked WHERE coalesce(binary_id, '') NOT IN (SELECT binary_id FROM binaries WHERE NOT (complete OR updated_at >= TIMESTAMP '1998-01-01'))", "linked"))(lambda s, d: A.age_out_parts(parts(s, d), bins(s, d), ntz("1998-01-01 00:00:00")).select("part_id"))
LOG = "SELECT user_id AS key, ts, event_id, event_type = 'error' AS failed FROM events"
add("ST08_retry_state", f"SELECT key, CAST(n AS INT) AS attempts, CASE WHEN n BETWEEN 1 AND 2 THEN t + to_seconds(300 * CAST(power(2, n - 1) AS BIGINT)) END AS next_retry, n >= 3 AS permanent FROM (SELECT key, count(*) FILTER (failed AND (good IS NULL OR (ts, event_id) > good)) AS n, date_trunc('second', max(ts) FILTER (failed)) AS t FROM (SELECT *, max((ts, event_id)) FILTER (NOT failed) OVER (PARTITION BY key) AS good FROM ({LOG})) GROUP BY key)")(lambda s, d: T.retry_state(V.table(s, d, "events").select(F.col("user_id").alias("key"), "ts", "event_id", (F.col("event_type") == "error").alias("failed"))))
def chain(key, seconds):
    """Rows of the log with microseconds, and each key's window starts."""
    log = f"SELECT {key} AS key, ts, event_id, epoch_us(ts) AS t FROM events"
    return f"WITH RECURSIVE log AS ({log}), starts AS (SELECT key, min(t) AS t FROM log GROUP BY key UNION ALL SELECT l.key, min(l.t) FROM starts a JOIN log l ON l.key = a.key AND l.t > a.t + {seconds * 1_000_000} GROUP BY l.key)"


add("ST09_dedup_window", chain("event_type || '-' || user_id", 300) + " SELECT l.key AS id, event_id, s.t IS NOT NULL AND row_number() OVER (PARTITION BY l.key, l.t ORDER BY event_id) = 1 AS accepted FROM log l LEFT JOIN starts s ON s.key = l.key AND s.t = l.t")(lambda s, d: T.dedup_window(V.table(s, d, "events").select(F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("id"), "ts", "event_id")))
add("ST10_rate_limit", chain("user_id", 86400) + " SELECT key, event_id, n <= 2 AS allowed, CAST(greatest(2 - n, 0) AS INT) AS remaining, make_timestamp(s + 86400000000) AS reset FROM (SELECT *, row_number() OVER (PARTITION BY key, s ORDER BY t, event_id) AS n FROM (SELECT l.key, l.t, event_id, max(s.t) AS s FROM log l JOIN starts s ON s.key = l.key AND s.t <= l.t GROUP BY ALL))")(lambda s, d: T.rate_limit(V.table(s, d, "events").select(F.col("user_id").alias("key"), "ts", "event_id"), 86400, 2))
add("ST10_rate_limit_all", chain("event_type", 3600) + " SELECT key, event_id, n <= 3 AS allowed, CAST(greatest(3 - n, 0) AS INT) AS remaining, make_timestamp(s + 3600000000) AS reset FROM (SELECT *, row_number() OVER (PARTITION BY key, s ORDER BY t, event_id) AS n FROM (SELECT l.key, l.t, event_id, max(s.t) AS s FROM log l JOIN starts s ON s.key = l.key AND s.t <= l.t GROUP BY ALL))")(lambda s, d: T.rate_limit(V.table(s, d, "events").select(F.col("event_type").alias("key"), "ts", "event_id"), 3600, 3))
add("ST14_backlog_cadence", q("SELECT event_id, CAST(CASE WHEN articles > 0 THEN 5 ELSE 60 END AS INT) AS interval FROM passes", "passes"))(lambda s, d: T.backlog_cadence(V.passes(s, d), 5, 60))


def written(df, name):
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return path


#: Rows of a feed's file.
FILE_ROWS = 250_000


def files(rows: int, least: int = 16) -> int:
    """How many files a feed of so many rows has: no task deals or writes more the larger the feed is."""
    return max(least, -(-rows // FILE_ROWS))


add("ST04_stream_ingest_dedup", q("SELECT group_id, article_number FROM parts", "parts"))(lambda s, d: I.stream_ingest(written(V.headers(s, d).repartition(files(V.table(s, d, "lineitem").count())), "feed"), V.headers(s, d)).select("group_id", "article_number"))
add("ST05_stream_assemble", q("SELECT binary_id, collected_parts, CAST(total_parts AS INT) AS total_parts, total_bytes, posted_at, complete FROM binaries", "binaries"))(lambda s, d: I.stream_assemble(written(parts(s, d).repartition(files(parts(s, d).count())), "feed"), parts(s, d)).select("binary_id", "collected_parts", F.col("total_parts").cast("int").alias("total_parts"), "total_bytes", "posted_at", "complete"))
QUIET, STALE = "30 days 1 second", "400 days 1 second"


def idle(s, d, event):
    """One batch, so that its files' order doesn't matter; the stream's time is the newest article's, less the quiet time. The stored parts are the feed."""
    done = bins(s, d).filter("binary_id < '4'")
    return once(s, d, f"idle-{event}", lambda: I.stream_idle(folder(parts(s, d)), parts(s, d), done, QUIET, STALE, files=1 << 30, events=(event,)))


SESSIONS = "SELECT binary_id, max(posted_at) AS idle_since, count(*) AS parts, count(DISTINCT file_number) AS files, max(CASE WHEN collection_key <> '' THEN collection_files ELSE total_parts END) AS total, bool_and(collection_key = '') AS single FROM (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY binary_id ORDER BY posted_at, part_id) AS session FROM (SELECT *, coalesce(posted_at - lag(posted_at) OVER (PARTITION BY binary_id ORDER BY posted_at, part_id) >= {gap}, true) AS fresh FROM linked WHERE binary_id IS NOT NULL)) GROUP BY binary_id, session HAVING max(posted_at) + {gap} <= (SELECT max(posted_at) FROM linked WHERE binary_id IS NOT NULL) - INTERVAL '30 days 1 second'"
add("ST06_stream_settle", q(f"SELECT binary_id, idle_since, parts, files FROM ({SESSIONS.format(gap="INTERVAL '30 days 1 second'")}) WHERE NOT single AND total = 0", "linked"))(lambda s, d: idle(s, d, "settled").drop("event"))
add("ST07_stream_age_out", q(f"SELECT binary_id, idle_since, parts, files FROM ({SESSIONS.format(gap="INTERVAL '400 days 1 second'")}) WHERE NOT CASE WHEN single THEN total = 0 OR parts >= total ELSE total > 0 AND files >= total END AND binary_id >= '4'", "linked"))(lambda s, d: idle(s, d, "aged_out").drop("event"))
add("B02_mark_released", q("SELECT binary_id, complete AND total_parts > 0 AS released FROM binaries", "binaries"))(lambda s, d: bins(s, d).join(A.releasable(bins(s, d)).select("binary_id", F.lit(True).alias("r")), "binary_id", "left").select("binary_id", F.coalesce("r", F.lit(False)).alias("released")))
add("W03_distinct_on", q("SELECT group_id, poster, min(part_id) AS part_id FROM parts GROUP BY ALL", "parts"))(lambda s, d: A.distinct_on(parts(s, d).select("group_id", "poster", "part_id"), ["group_id", "poster"], "part_id"))


BODY = "CASE WHEN doc_id % 4 = 0 THEN text ELSE concat('intro\n=ybegin part=1 total=', doc_id % 5, ' line=128 size=', n_chars, ' name=', source, ' file.bin\n', text) END"


def checked(s, d):
    return V.table(s, d, "documents").select("doc_id", Y.yenc_header_scan(F.expr(BODY.replace("\n", "\\n"))).alias("y")).select("doc_id", "y.*")


SCAN = "SELECT doc_id, doc_id % 4 <> 0 AS ok, CASE WHEN doc_id % 4 <> 0 THEN 1 ELSE 0 END AS part, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 5 ELSE 0 END AS total, CASE WHEN doc_id % 4 <> 0 THEN n_chars ELSE 0 END AS size, CASE WHEN doc_id % 4 <> 0 THEN source || ' file.bin' ELSE '' END AS name FROM documents"
add("U01_yenc_header_scan", SCAN)(checked)
add("A17_verification_counts", f"SELECT count(*) AS checked, count(*) FILTER (ok AND total <= 1) AS standalone, count(*) FILTER (ok AND total > 1) AS fragment, count(*) FILTER (NOT ok) AS failed FROM ({SCAN})")(lambda s, d: Y.verification_counts(checked(s, d)))
add("A16_overall_status", "SELECT CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'error' ELSE 'ok' END AS status FROM events")(lambda s, d: Y.overall_status(V.table(s, d, "events").select(F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("level"))))
add("ST01_forward_plan", q("SELECT group_id, b AS begin, least(b + 99, e) AS \"end\" FROM (SELECT group_id, e, unnest(range(a, e + 1, 100)) AS b FROM (SELECT group_id, greatest(lo + group_id * 100 + 1, lo) AS a, least(hi, greatest(lo + group_id * 100 + 1, lo) + 999) AS e FROM (SELECT group_id, min(server_high) AS lo, max(server_high) AS hi FROM passes GROUP BY group_id)) WHERE a <= e)", "passes"))(
    lambda s, d: Y.forward_plan(V.passes(s, d).groupBy("group_id").agg(F.min("server_high").alias("server_low"), F.max("server_high").alias("server_high")).withColumn("last_high", F.col("server_low") + F.col("group_id") * 100), 1000, 100)
)
add("W13_keyset_batches", q("SELECT group_id, part_id AS cursor FROM (SELECT group_id, part_id, row_number() OVER (PARTITION BY group_id ORDER BY part_id) AS k FROM parts) WHERE k % 50 = 0", "parts"))(lambda s, d: Y.keyset_batches(parts(s, d), 50))
