"""Loops whose output is their next input (verification, post-processing, enrichment, tear-downs) and stored months, each with its SQL."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ..operators import assembly as A
from ..operators import bodies as B
from ..operators import jobs as J
from ..operators import postprocess as O
from ..operators import repair as P
from ..operators import search as Q
from ..operators import trigrams as G
from ..operators import verify as X
from ..sources import monthly as M
from ..sources import views as V
from ..sources.tables import as_it_is, once, scratch, stamp
from . import catalogue_jobs as C
from . import catalogue_repair as D
from . import sql
from .catalogue import SQL, add, bins, ntz, parts, releases, segments
from .sql import query as q

# Verification (P03, B10, A02): attempts from 0 to 6, every fifth part unchecked, some results repeated.
AMBIGUOUS = "collection_key = '' AND total_parts = 0"
counted = lambda s, d: parts(s, d).withColumns({"yenc_attempts": (F.col("part_id") % 7).cast("int"), "yenc_version": F.lit(0).cast("long")})
FIELDS = ["part_id", "yenc_attempts", "yenc_version", "total_parts", "collection_key", "file_number", "collection_files"]
whole = lambda df: df.select(*[F.col(c).cast("long").alias(c) if c != "collection_key" else c for c in FIELDS])
add("P03_ambiguous_parts", q(f"SELECT part_id, message_id FROM parts WHERE {AMBIGUOUS} AND part_id % 7 < 5", "parts"))(lambda s, d: A.ambiguous_parts(counted(s, d)).select("part_id", "message_id"))


def checks(s, d):
    rows = A.ambiguous_parts(parts(s, d)).filter("part_id % 5 <> 0")
    one = rows.select("part_id", (F.col("part_id") % 3 > 0).alias("ok"), (F.col("part_id") % 4).alias("total"), (F.col("part_id") % 9).alias("part"), F.concat(F.lit("file "), "poster").alias("file"))
    return one.unionByName(one.filter("part_id % 11 = 0").withColumns({"ok": F.lit(False), "total": F.lit(9).cast("long")}))


HIT, GOOD = "(p.part_id % 5 <> 0)", "(p.part_id % 5 <> 0 AND p.part_id % 3 > 0)"
PIECE = f"{GOOD} AND p.part_id % 4 > 1"
add("B10_verify_parts", q(f"SELECT part_id, part_id % 7 + CASE WHEN {HIT} AND part_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN {HIT} AND part_id % 11 = 0 THEN 1 ELSE 0 END AS yenc_attempts, CASE WHEN {HIT} THEN 1 ELSE 0 END AS yenc_version, CASE WHEN {GOOD} AND part_id % 4 <= 1 THEN 1 ELSE 0 END AS total_parts, CASE WHEN {PIECE} THEN 'yenc:file ' || poster || '/' || part_id % 4 ELSE '' END AS collection_key, CASE WHEN {PIECE} THEN part_id % 9 ELSE file_number END AS file_number, CASE WHEN {PIECE} THEN part_id % 4 ELSE collection_files END AS collection_files FROM parts p WHERE {AMBIGUOUS}", "parts"))(
    lambda s, d: whole(X.verify_parts(counted(s, d), checks(s, d)).join(A.ambiguous_parts(parts(s, d)).select("part_id"), "part_id", "left_semi"))
)


#: What the loop and the assembly after it read of a part.
LOOP = ["part_id", "group_id", "message_id", "poster", "bytes", "posted_at", "norm_subject", "collection_key", "total_parts", "file_number", "collection_files", "yenc_attempts", "yenc_version"]


def verified(s, d):
    """The stored parts after two passes. A quarter of the bodies can't be fetched in the first, half of these in the second neither."""

    def make():
        table = M.create(counted(s, d).select(*LOOP), scratch(s, "parts"))
        n = F.col("part_id")
        line = F.concat(F.lit("=ybegin part="), (n % 5 + 1).cast("string"), F.lit(" total="), (n % 3).cast("string"), F.lit(" line=128 size=9 name=f-"), "poster", F.lit("\r\nxyz"))
        feed = lambda missing: A.ambiguous_parts(parts(s, d)).select("message_id", F.when(n % missing > 0, line).alias("body"))
        X.verification_pass(table, feed(4), 1)
        X.verification_pass(table, feed(8), 2)
        return table.read()

    return once(s, d, "verified", make, as_it_is)


#: Attempts at first (a), those after the first pass (b) and after the second (c); and the pass that succeeded.
PASSES = f"SELECT *, CASE WHEN won = 0 THEN b + CASE WHEN a < 5 AND b < 5 THEN 1 ELSE 0 END ELSE b END AS c FROM (SELECT *, CASE WHEN a >= 5 THEN 0 WHEN part_id % 4 > 0 THEN 1 WHEN part_id % 8 > 0 AND a + 1 < 5 THEN 2 ELSE 0 END AS won, CASE WHEN a < 5 AND part_id % 4 = 0 THEN a + 1 ELSE a END AS b FROM (SELECT *, part_id % 7 AS a FROM parts WHERE {AMBIGUOUS}))"
LOOPED = f"SELECT part_id, group_id, poster, bytes, posted_at, c AS yenc_attempts, CASE WHEN won > 0 THEN won WHEN a >= 5 THEN 0 WHEN b < 5 THEN 2 ELSE 1 END AS yenc_version, CASE WHEN won > 0 AND part_id % 3 <= 1 THEN 1 ELSE 0 END AS total_parts, CASE WHEN won > 0 AND part_id % 3 = 2 THEN 'yenc:f-' || poster || '/2' ELSE '' END AS collection_key, CASE WHEN won > 0 AND part_id % 3 = 2 THEN part_id % 5 + 1 ELSE file_number END AS file_number, CASE WHEN won > 0 AND part_id % 3 = 2 THEN 2 ELSE collection_files END AS collection_files FROM ({PASSES})"
add("B10_verification_loop", q(f"SELECT {', '.join(FIELDS)} FROM ({LOOPED})", "parts"))(lambda s, d: whole(verified(s, d).join(A.ambiguous_parts(parts(s, d)).select("part_id"), "part_id", "left_semi")))
add("A02_verified_fragments", q(f"SELECT md5(concat_ws('|', 'c', CAST(group_id AS VARCHAR), collection_key, poster)) AS binary_id, count(DISTINCT file_number) AS collected_parts, CAST(sum(bytes) AS BIGINT) AS total_bytes, count(DISTINCT file_number) >= 2 AS complete FROM ({LOOPED}) WHERE collection_key <> '' GROUP BY group_id, collection_key, poster", "parts"))(lambda s, d: A.assemble_collections(verified(s, d).filter("collection_key LIKE 'yenc:%'")).select("binary_id", "collected_parts", "total_bytes", "complete"))
add("A01_verified_standalone", q(f"SELECT md5(concat_ws('|', 's', CAST(group_id AS VARCHAR), norm_subject, poster)) AS binary_id, count(*) AS collected_parts, CAST(sum(bytes) AS BIGINT) AS total_bytes FROM ({LOOPED}) JOIN (SELECT part_id, norm_subject FROM parts) USING (part_id) WHERE total_parts = 1 AND norm_subject <> '' GROUP BY group_id, norm_subject, poster", "parts"))(
    lambda s, d: A.assemble_singles(verified(s, d).filter("yenc_version > 0 AND total_parts = 1 AND collection_key = ''")).select("binary_id", "collected_parts", "total_bytes")
)


# Existing releases that turn out to be fragments.
def held_files(s, d):
    return releases(s, d).select("guid", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("file_name"))


def repaired(s, d):
    stubs, digits = D.stubs(s, d), D.digits
    found = P.repair_candidates(stubs, segments(s, d), parts(s, d)).join(releases(s, d).select("guid", "release_hash"), "guid")
    results = found.select("guid", "binary_id", "part_id", (digits(13) % 3 > 0).alias("ok"), (digits(17) % 3).alias("total"), (F.col("part_id") % 6).alias("part"), F.lit("f").alias("file"))
    twice = results.unionByName(results.withColumn("part", F.lit(0).cast("long")))  # a repeated part: the greater number holds
    r, b, p, f = X.repair_releases(stubs, bins(s, d), parts(s, d), held_files(s, d), twice)
    row = lambda df, kind, key, value: df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), value.cast("string").alias("value"))
    part = F.concat_ws(" ", "collection_key", F.col("file_number").cast("string"), F.col("collection_files").cast("string"))
    return row(r, "release", "guid", F.col("verified")).unionByName(row(b, "binary", "binary_id", F.lit(""))).unionByName(row(p, "part", "part_id", part)).unionByName(row(f, "file", "guid", F.col("file_name")))


OK, TOTAL = "CAST('0x' || substr(release_hash, 13, 4) AS INT) % 3 > 0", "CAST('0x' || substr(release_hash, 17, 4) AS INT) % 3"
HAS = "guid IN (SELECT guid FROM segments)"
STUB_PIECE = f"SELECT guid, binary_id FROM ({D.DUE}) WHERE {HAS} AND {OK} AND {TOTAL} > 1"
IN_PIECE = f"coalesce(binary_id, '') IN (SELECT binary_id FROM ({STUB_PIECE}))"
add("B11_repair_releases", q(f"SELECT 'release' AS kind, guid AS id, CASE WHEN {D.K9} % 4 = 0 OR ({D.K} % 2 = 0 AND pp_status = 'done' AND {HAS} AND {OK} AND {TOTAL} <= 1) THEN 'true' ELSE 'false' END AS value FROM st WHERE guid NOT IN (SELECT guid FROM ({STUB_PIECE})) UNION ALL SELECT 'binary', binary_id, '' FROM binaries WHERE binary_id NOT IN (SELECT binary_id FROM ({STUB_PIECE})) UNION ALL SELECT 'part', CAST(part_id AS VARCHAR), CASE WHEN {IN_PIECE} THEN 'yenc:f/2 ' || part_id % 6 || ' 2' ELSE collection_key || ' ' || file_number || ' ' || collection_files END FROM linked UNION ALL SELECT 'file', guid, n FROM releases, (VALUES ('a'), ('b')) v(n) WHERE guid NOT IN (SELECT guid FROM ({STUB_PIECE}))", "segments", st=C.STATUS))(repaired)


# Post-processing (B05, B06): subjects, bodies and server codes follow from a segment's size.
MORE, SPECIAL = bytes((v + 42) % 256 for v in range(256)), re.compile(b"[\\x00\\n\\r=]")
ESCAPED = {bytes([v]): b"=" + bytes([v + 64]) for v in (0, 10, 13, 61)}


@F.arrow_udf(Y.BinaryType())
def yenc_encoded_bytes(raw: pa.Array) -> pa.Array:
    """A body around bytes, special ones escaped."""
    lines = (None if x is None else SPECIAL.sub(lambda m: ESCAPED[m[0]], x.translate(MORE)) for x in raw.to_pylist())
    return pa.array([None if x is None else b"=ybegin line=128 name=a\r\n" + x + b"\r\n=yend" for x in lines], pa.binary())


def probed(s, d):
    """Due releases, segments by kind (every fourth a parity file, every fourth a description) and their bodies."""
    size = F.col("bytes")
    due = C.states(s, d).filter("pp_status <> 'done'")
    own = segments(s, d).withColumn("subject", F.when(size % 4 == 0, F.lit('x "a.PAR2" yEnc (1/2)')).when(size % 4 == 1, F.lit('"b.nfo" yEnc')).otherwise(F.lit("c.bin")))
    tag = F.substring("guid", 1, 4)
    real = F.concat(D.par2_packet(F.lit("a.nfo")), D.par2_packet(F.concat(F.lit("Real.Name."), tag, F.lit(".2024.1080p.BluRay.part01.rar"))), D.par2_packet(F.concat(F.lit("Real.Name."), tag, F.lit(".r05"))))
    hidden = D.par2_packet(F.lit("9c914cea0eb54d4892abd3a5b681032a.par2"))
    parity = F.when(size % 3 > 0, real).otherwise(hidden)
    note = F.when(size % 3 > 0, F.concat(F.lit("  See IMDB tt"), F.lpad((size % 100000).cast("string"), 7, "0"), F.lit(" https://thetvdb.com/?tab=series&id="), (size % 1000).cast("string"), F.lit("\n"))).otherwise(F.lit(" \r\n")).cast("binary")
    # A function in Python is called for every row, whatever condition stands around it, so only rows that need a body have an argument.
    coded = ((size % 4 == 0) | (size % 7 == 0)) & (size % 4 != 1) & (size % 5 > 0)
    body = F.when(size % 4 == 1, note).when(coded, yenc_encoded_bytes(F.when(coded, parity))).otherwise(F.lit(b"junk"))
    found = own.select("message_id", F.when(size % 5 > 0, body).alias("body"), F.when(size % 5 == 0, F.when(size % 10 == 0, 430).when(size % 15 == 0, 500)).alias("code"))
    return due, own, found


def resolved(s, d):
    return once(s, d, "resolved", lambda: O.postprocess_resolve(*probed(s, d)))


NAME = "CASE WHEN named THEN 'Real.Name.' || substr(guid, 1, 4) || '.2024.1080p.BluRay' END"
NOTE = "'See IMDB tt' || lpad(CAST(bytes % 100000 AS VARCHAR), 7, '0') || ' https://thetvdb.com/?tab=series&id=' || CAST(bytes % 1000 AS VARCHAR)"
IDS = "['imdb:tt' || lpad(CAST(bytes % 100000 AS VARCHAR), 7, '0'), 'tvdb:' || CAST(bytes % 1000 AS VARCHAR)]"
PROBE = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY guid, kind ORDER BY CASE WHEN kind = 2 THEN bytes END, number, message_id) AS k FROM (SELECT s.guid, s.message_id, s.bytes, s.number, CASE bytes % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 2 END AS kind, st.obfuscated AS hidden FROM segments s JOIN st USING (guid) WHERE pp_status <> 'done')) WHERE k <= 4 AND (kind <> 2 OR hidden)"""
FIRSTS = f"""SELECT guid, coalesce(count(*) FILTER (kind = 1), 0) AS n1, count(*) FILTER (kind = 2) AS n2, count(*) FILTER (kind = 3) AS n3, min(k) FILTER (kind = 1 AND bytes % 5 > 0 AND bytes % 3 > 0) AS f1, min(k) FILTER (kind = 2 AND bytes % 5 > 0 AND bytes % 3 > 0 AND bytes % 7 = 0) AS f2, min(k) FILTER (kind = 3 AND bytes % 5 > 0 AND bytes % 3 > 0) AS f3 FROM ({PROBE}) GROUP BY guid"""
SPENT = f"""SELECT *, CASE WHEN w2 OR w1 THEN true ELSE false END AS named, least(4 - s1 - s2, coalesce(f3, n3)) AS s3, coalesce(f3 <= 4 - s1 - s2, false) AS w3 FROM (SELECT *, least(l2, coalesce(f2, n2)) AS s2, coalesce(f2 <= l2, false) AS w2 FROM (SELECT *, f1 IS NOT NULL AS w1, CASE WHEN f1 IS NOT NULL THEN 0 ELSE 4 - least(4, coalesce(f1, n1)) END AS l2, least(4, coalesce(f1, n1)) AS s1 FROM ({FIRSTS})))"""
MISSED = f"""SELECT guid, count(*) > 0 AS missed, bool_or(bytes % 10 = 0) AS final FROM ({PROBE}) p JOIN spent USING (guid) WHERE bytes % 5 = 0 AND k <= CASE kind WHEN 1 THEN s1 WHEN 2 THEN s2 ELSE s3 END GROUP BY guid"""
RESOLVED = f"""SELECT st.guid, {NAME} AS new_name, CASE WHEN w3 THEN note.text END AS nfo, CASE WHEN w3 THEN array_to_string(note.ids, ',') ELSE '' END AS ids, CAST(coalesce(s1 + s2 + s3, 0) AS INT) AS fetched, coalesce(missed AND NOT named AND NOT w3, false) AS failed, coalesce(missed AND NOT named AND NOT w3 AND final, false) AS permanent FROM st LEFT JOIN spent USING (guid) LEFT JOIN missed USING (guid) LEFT JOIN (SELECT guid, k, {NOTE} AS text, {IDS} AS ids FROM ({PROBE}) WHERE kind = 3) note ON note.guid = st.guid AND note.k = spent.f3 WHERE pp_status <> 'done'"""


def rsql(select, *needs):
    return q(select, "segments", *needs, st=C.STATUS, spent=SPENT, missed=MISSED, resolved=RESOLVED)


SEARCH = sql.search_name("new_name")
CATEGORY = sql.refine(f"({sql.rule(SEARCH)})", SEARCH)
listed = lambda ids: F.array_join(F.transform(ids, lambda i: F.concat_ws(":", i["source"], i["identifier"])), ",")
add("B05_postprocess_resolve", rsql(f"SELECT guid, new_name, {SEARCH} AS search_name, CASE WHEN new_name IS NOT NULL THEN {CATEGORY} END AS category_id, nfo, ids, fetched, failed, permanent FROM resolved"))(
    lambda s, d: resolved(s, d).select("guid", "new_name", "search_name", "category_id", "nfo", listed(F.col("identifiers")).alias("ids"), "fetched", "failed", "permanent")
)


def before(s, d):
    """What is stored beforehand: some descriptions and identifiers."""
    r = releases(s, d)
    some = r.filter("guid < '3'")
    return O.Processed(C.states(s, d), some.select("guid", F.lit("old").alias("nfo")), some.select("guid", F.lit("tvdb").alias("source"), F.lit("7").alias("identifier")), some.select("guid", F.lit("old.bin").alias("file_name"), F.lit(1).cast("long").alias("size_bytes")))


def with_files(s, d):
    one = F.array(F.struct(F.concat("guid", F.lit(".bin")).alias("file_name"), F.lit(5).cast("long").alias("size_bytes")))
    return resolved(s, d).withColumn("files", F.when(F.col("nfo").isNotNull(), one).otherwise(F.slice(one, 1, 0)))


processed = lambda s, d: O.apply_postprocess(before(s, d), with_files(s, d))
DONE = "SELECT st.*, r.new_name, r.nfo, r.ids, r.guid IS NOT NULL AND NOT r.failed AS hit FROM st LEFT JOIN resolved r USING (guid)"
add("B06_apply_postprocess", rsql(f"SELECT guid, CASE WHEN hit AND new_name IS NOT NULL THEN new_name ELSE name END AS name, CASE WHEN hit AND new_name IS NOT NULL THEN {SEARCH} ELSE search_name END AS search_name, CASE WHEN hit AND new_name IS NOT NULL THEN {CATEGORY} ELSE category_id END AS category_id, obfuscated AND NOT (hit AND new_name IS NOT NULL) AS obfuscated, CASE WHEN hit THEN 'done' ELSE pp_status END AS pp_status FROM ({DONE})"))(
    lambda s, d: processed(s, d).releases.select("guid", "name", "search_name", "category_id", "obfuscated", "pp_status")
)
add("B06_descriptions", rsql("SELECT guid, nfo FROM resolved WHERE NOT failed AND nfo IS NOT NULL UNION ALL SELECT guid, 'old' FROM st WHERE guid < '3' AND guid NOT IN (SELECT guid FROM resolved WHERE NOT failed AND nfo IS NOT NULL)"))(lambda s, d: processed(s, d).nfos)
add("B06_identifiers", rsql("SELECT guid, split_part(i, ':', 1) AS source, split_part(i, ':', 2) AS identifier FROM (SELECT guid, unnest(string_split(ids, ',')) AS i FROM resolved WHERE ids <> '' AND NOT failed) UNION SELECT guid, 'tvdb', '7' FROM st WHERE guid < '3'"))(lambda s, d: processed(s, d).identifiers)
add("B06_release_files", rsql("SELECT guid, guid || '.bin' AS file_name, 5 AS size_bytes FROM resolved WHERE NOT failed AND nfo IS NOT NULL UNION SELECT guid, 'old.bin', 1 FROM st WHERE guid < '3'"))(lambda s, d: processed(s, d).files)
add("B07_postprocess_pass", rsql("SELECT guid, CASE WHEN r.guid IS NULL THEN pp_status WHEN failed THEN 'failed' ELSE 'done' END AS pp_status, pp_attempts + CASE WHEN coalesce(failed, false) THEN 1 ELSE 0 END AS pp_attempts, CASE WHEN coalesce(failed, false) THEN r.permanent OR pp_attempts + 1 >= 3 ELSE st.permanent END AS permanent FROM st LEFT JOIN resolved r USING (guid)"))(
    lambda s, d: O.postprocess_pass(before(s, d), *probed(s, d), ntz("2024-01-01 00:00:00"))[0].releases.select("guid", "pp_status", "pp_attempts", "permanent")
)


# Enrichment (J10, B17): the first provider fails on some titles and misses others; both know identifiers.
def answering(s, d):
    n, one = F.length("title"), lambda source, value: F.struct(F.lit(source).alias("source"), value.cast("string").alias("identifier"))
    known = releases(s, d).select(J.N.parse_title(F.col("name"))["title"].alias("title")).distinct()
    a = known.select("title", F.lit(0).alias("priority"), F.when(n % 2 == 0, F.concat(F.lit("a-"), "title")).alias("external_id"), (n % 3 == 0).alias("error"), F.array(one("imdb", n), one("tmdb", F.lit("x"))).alias("identifiers"))
    b = known.select("title", F.lit(1).alias("priority"), F.when(n % 5 < 3, F.concat(F.lit("b-"), "title")).alias("external_id"), F.lit(False).alias("error"), F.array(one("imdb", n + 1), one("tvdb", n)).alias("identifiers"))
    return a.unionByName(b)


def enriched(s, d):
    r = releases(s, d)
    return P.enrich_pass(r, r.filter("guid < '4'").select("guid", F.lit("x").alias("external_id")), r.filter("guid < '2'").select("guid", F.lit("tvdb").alias("source"), F.lit("1").alias("identifier")), answering(s, d))


TITLED = f"SELECT r.guid, title, len(title) AS n, CASE WHEN len(title) % 2 = 0 AND len(title) % 3 > 0 THEN 'a' WHEN len(title) % 5 < 3 THEN 'b' END AS who, len(title) % 2 = 0 AND len(title) % 3 > 0 AS m1, len(title) % 5 < 3 AS m2 FROM ({SQL['J10_enrich_lookup']}) r"
NEEDED = f"SELECT t.* FROM ({TITLED}) t JOIN releases2 r USING (guid) WHERE category_id BETWEEN 5000 AND 5999 AND NOT obfuscated AND t.guid >= '4'"


def esql(select):
    return q(select, "releases", releases2="SELECT * FROM releases", needed=NEEDED)


PADDED = "'tt' || lpad(CAST({} AS VARCHAR), 7, '0')"
add("J10_identifiers", f"SELECT guid, title, who || '-' || title AS external_id, who IS NOT NULL AS matched, array_to_string(list_filter([CASE WHEN m1 THEN 'imdb:' || n WHEN m2 THEN 'imdb:' || n + 1 END, CASE WHEN m1 THEN 'tmdb:x' END, CASE WHEN m2 THEN 'tvdb:' || n END], lambda x: x IS NOT NULL), ',') AS ids, who IS NULL AND n % 3 = 0 AS failed FROM ({TITLED})")(
    lambda s, d: J.enrich_lookup(releases(s, d), answering(s, d)).select("guid", "title", "external_id", "matched", listed(F.col("identifiers")).alias("ids"), "failed")
)
add("B17_enrich_pass", esql("SELECT count(*) AS processed, count(who) AS matched, count(*) FILTER (who IS NULL AND n % 3 > 0) AS misses, count(*) FILTER (who IS NULL AND n % 3 = 0) AS errors FROM needed"))(lambda s, d: enriched(s, d).counts)
add("B17_metadata", esql("SELECT guid, who || '-' || title AS external_id FROM needed WHERE who IS NOT NULL OR n % 3 > 0 UNION ALL SELECT guid, 'x' FROM releases WHERE guid < '4'"))(lambda s, d: enriched(s, d).metadata)
add("B17_identifiers", esql(f"SELECT guid, 'imdb' AS source, CASE WHEN m1 THEN {PADDED.format('n')} ELSE {PADDED.format('n + 1')} END AS identifier FROM needed WHERE m1 OR m2 UNION SELECT guid, 'tvdb', CAST(n AS VARCHAR) FROM needed WHERE m2 UNION SELECT guid, 'tvdb', '1' FROM releases WHERE guid < '2'"))(lambda s, d: enriched(s, d).identifiers)


# Tear-down (B18): the parts' subjects get a leading file counter and volume endings, so that all cases occur.
def countered(s, d):
    n = F.col("part_id")
    ending = F.element_at(F.array(*map(F.lit, (".rar", ".part01.rar", ".vol1+02.par2", ".r05.rar", ".rar.0001", ".bin", ".part1.rar"))), (n % 7 + 1).cast("int"))
    subject = F.concat(F.lit("post ["), (n % 3 + 1).cast("string"), F.lit("/"), (n % 4).cast("string"), F.lit("] - "), F.when(n % 11 > 0, F.concat(F.lit('"'), F.when(n % 13 > 0, F.concat(F.lit("Base"), (n % 6).cast("string"))).otherwise(""), ending, F.lit('"'))).otherwise("bare"), F.lit(" yEnc (1/9)"))
    return parts(s, d).withColumn("subject", F.when(n % 5 > 0, subject).otherwise("no counter"))


def torn(s, d):
    small = C.states(s, d).withColumns({"size": F.col("size") % 6_000_000, "name": F.when(D.digits(5) % 3 > 0, F.regexp_replace("name", "[^A-Za-z0-9.]", "")).otherwise(F.col("name"))})
    t = P.fix_stub_collections(small, countered(s, d), bins(s, d), held_files(s, d))
    row = lambda df, kind, key, value: df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), value.alias("value"))
    part = F.concat_ws(" ", "collection_key", F.col("file_number").cast("string"), F.col("collection_files").cast("string"))
    out = row(t.parts, "part", "part_id", part).unionByName(row(t.binaries, "binary", "binary_id", F.lit(""))).unionByName(row(t.releases, "release", "guid", F.lit(""))).unionByName(row(t.files, "file", "guid", F.col("file_name")))
    return out.unionByName(t.counts.select(F.lit("count").alias("kind"), F.lit("all").alias("id"), F.concat_ws(" ", *[F.col(c).cast("string") for c in t.counts.columns]).alias("value")))


ENDING = "['.rar', '.part01.rar', '.vol1+02.par2', '.r05.rar', '.rar.0001', '.bin', '.part1.rar'][part_id % 7 + 1]"
CUT_ENDING = "['', '', '', '', '', '.bin', ''][part_id % 7 + 1]"
NO_BASE = "['.rar', '.part01', '.vol1+02', '.r05', '.rar.0001', '.bin', '.part1'][part_id % 7 + 1]"
STUBS = f"SELECT binary_id, guid FROM (SELECT *, size % 6000000 AS sz, CASE WHEN {D.K} % 3 > 0 THEN regexp_replace(name, '[^A-Za-z0-9.]', '', 'g') ELSE name END AS nm FROM st) WHERE sz < 5000000 AND total_parts <= 3 AND pp_status = 'done' AND regexp_matches(nm, '^[A-Za-z0-9.]{{15,}}$')"
TORN = f"SELECT * FROM linked WHERE binary_id IN (SELECT binary_id FROM ({STUBS})) AND part_id % 5 > 0"
REKEYED = f"SELECT part_id, CASE WHEN part_id % 13 > 0 THEN 'Base' || part_id % 6 || {CUT_ENDING} ELSE {NO_BASE} END || '/' || part_id % 4 AS k, part_id % 3 + 1 AS f, part_id % 4 AS t FROM ({TORN}) WHERE part_id % 4 >= 2 AND part_id % 11 > 0 AND part_id % 3 > 0"
add("B18_fix_stub_collections", q(f"SELECT 'part' AS kind, CAST(part_id AS VARCHAR) AS id, coalesce(k, collection_key) || ' ' || coalesce(f, file_number) || ' ' || coalesce(t, collection_files) AS value FROM linked LEFT JOIN ({REKEYED}) USING (part_id) UNION ALL SELECT 'binary', binary_id, '' FROM binaries WHERE binary_id NOT IN (SELECT binary_id FROM ({TORN})) UNION ALL SELECT 'release', guid, '' FROM releases WHERE binary_id NOT IN (SELECT binary_id FROM ({TORN})) UNION ALL SELECT 'file', guid, n FROM releases, (VALUES ('a'), ('b')) v(n) WHERE binary_id NOT IN (SELECT binary_id FROM ({TORN})) UNION ALL SELECT 'count', 'all', concat_ws(' ', (SELECT count(DISTINCT binary_id) FROM ({STUBS})), (SELECT count(*) FROM ({REKEYED})), (SELECT count(DISTINCT binary_id) FROM ({TORN})), (SELECT count(*) FROM releases WHERE binary_id IN (SELECT binary_id FROM ({TORN}))))", "linked", st=C.STATUS))(torn)


# Months (S07, S09, B14).
def kept_months(s, d):
    return M.create(parts(s, d), scratch(s, "months"))


def expired(s, d):
    table = kept_months(s, d)
    M.drop_expired(table, ntz("1995-06-01 00:00:00"))
    return table.rows().groupBy(M.MONTH).agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes"))


def pruned(s, d):
    table = kept_months(s, d)
    M.prune(table, J.retention_candidates(parts(s, d), C.states(s, d), ntz("1997-01-01 00:00:00")))
    return table.rows().select(M.MONTH, "part_id")


MONTH = "CAST(year(posted_at) * 100 + month(posted_at) AS INT)"
add("S07_stored_months", q(f"SELECT {MONTH} AS ingest_month, 'parts_' || strftime(min(posted_at), '%Y_%m') AS partition_name, CAST(date_trunc('month', min(posted_at)) AS TIMESTAMP) AS from_ts, CAST(date_trunc('month', min(posted_at)) + INTERVAL 1 MONTH AS TIMESTAMP) AS to_ts FROM parts GROUP BY 1", "parts"))(lambda s, d: M.partitions(kept_months(s, d)))
add("S09_dropped_months", q(f"SELECT {MONTH} AS ingest_month, count(*) AS rows, CAST(sum(bytes) AS BIGINT) AS bytes FROM parts WHERE posted_at >= TIMESTAMP '1995-06-01' GROUP BY 1", "parts"))(expired)
add("B14_pruned_months", q(f"SELECT {MONTH} AS ingest_month, part_id FROM linked WHERE NOT (posted_at < TIMESTAMP '1997-01-01' AND coalesce(binary_id, '') IN (SELECT binary_id FROM st WHERE pp_status = 'done'))", "linked", st=C.STATUS))(pruned)

# Listings and plans with what was left out.
add("ST07_age_out_released", q("SELECT binary_id FROM binaries WHERE complete OR binary_id < '5' OR updated_at >= TIMESTAMP '1998-01-01'", "binaries"))(lambda s, d: A.age_out_stale(bins(s, d).withColumn("released", F.when(F.col("binary_id") < "5", True)), ntz("1998-01-01 00:00:00")).select("binary_id"))
add("S12_feed_attributes", q("SELECT guid, 'size=' || size || ',grabs=' || CASE WHEN group_id % 2 = 0 THEN size % 9 ELSE 0 END || CASE WHEN category_id <> 8000 THEN ',category=' || category_id ELSE '' END AS attributes FROM releases", "releases"))(
    lambda s, d: A.feed_items(releases(s, d).withColumns({"grabs": F.when(F.col("group_id") % 2 == 0, F.col("size") % 9), "category_id": F.nullif("category_id", F.lit(8000))}), "http://x").select("guid", F.array_join(F.transform("attributes", lambda a: F.concat_ws("=", a["name"], a["value"])), ",").alias("attributes"))
)
groups = lambda s, d: D.groups(s, d).withColumn("last_scanned_high", F.when(F.col("group_id") % 4 > 0, F.col("server_high") - F.col("group_id") * 100 + 300))
LISTED = f"SELECT g.*, greatest(CASE WHEN group_id % 4 > 0 THEN group_id * 100 - 300 ELSE 0 END, 0) AS lag, CAST(coalesce(storage, 0) AS BIGINT) AS storage FROM {D.NAMED} g LEFT JOIN (SELECT group_id, sum(bytes) AS storage FROM parts GROUP BY group_id) USING (group_id)"
for column in ("lag", "storage"):
    add(f"W08_group_page_{column}", q(f"SELECT name, {column}, count(*) OVER () AS total FROM ({LISTED}) ORDER BY {column} DESC NULLS LAST, name LIMIT 6 OFFSET 1", "parts", "passes"))(lambda s, d, c=column: P.group_page(P.group_listing(groups(s, d), parts(s, d)), sort=c, desc=True, limit=6, offset=1).select("name", c, "total"))
add("ST01_forward_plan_own_cap", q("SELECT group_id, b AS begin, least(b + 99, e) AS \"end\" FROM (SELECT group_id, e, unnest(range(a, e + 1, 100)) AS b FROM (SELECT group_id, a, CASE WHEN cap > 0 THEN least(hi, a + cap - 1) ELSE hi END AS e FROM (SELECT group_id, hi, greatest(lo + group_id * 100 + 1, lo) AS a, CASE WHEN group_id % 3 = 0 THEN 1000 WHEN group_id % 3 = 1 THEN 250 ELSE 0 END AS cap FROM (SELECT group_id, min(server_high) AS lo, max(server_high) AS hi FROM passes GROUP BY group_id))) WHERE a <= e)", "passes"))(
    lambda s, d: B.forward_plan(V.passes(s, d).groupBy("group_id").agg(F.min("server_high").alias("server_low"), F.max("server_high").alias("server_high")).withColumns({"last_high": F.col("server_low") + F.col("group_id") * 100, "own_cap": F.when(F.col("group_id") % 3 == 1, 250).when(F.col("group_id") % 3 == 2, 0)}), 1000, 100)
)


def diagnosed(s, d):
    e = V.table(s, d, "events")
    errors = e.select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("message"), (F.col("event_type") == "error").alias("failed"))
    g = D.groups(s, d).select(F.col("group_id").alias("id"), F.col("last_success_at").alias("at"), F.col("last_error").alias("message"), (F.col("last_error") != "").alias("failed"))
    r = C.states(s, d).select(F.col("guid").alias("id"), F.col("posted_at").alias("at"), F.col("name").alias("message"), (F.col("pp_status") == "failed").alias("failed"), "permanent")
    j = D.jobs(s, d).select("id", F.col("created_at").alias("at"), F.col("error").alias("message"), (F.col("state") == "failed").alias("failed"))
    return P.diagnostics({"pipeline": (errors, ""), "groups": (g, "inspect the groups"), "releases": (r, "requeue"), "permanent": (r.filter("permanent"), "requeue"), "jobs": (j, "")}, 5)


def newest(name, rows, hint):
    """The newest five failing rows (id, at, message, final) and their count."""
    return f"SELECT '{name}' AS source, coalesce(t.n, 0) AS failing, CASE WHEN coalesce(t.o, 0) > 0 THEN '{hint}' ELSE '' END AS hint, CAST(k AS INT) AS rank, id, \"at\", message FROM (SELECT count(*) AS n, count(*) FILTER (NOT final) AS o FROM ({rows})) t LEFT JOIN (SELECT *, row_number() OVER (ORDER BY \"at\" DESC NULLS LAST, id DESC) AS k FROM ({rows})) x ON k <= 5"


FAILED = "SELECT guid AS id, posted_at AS \"at\", name AS message, permanent AS final FROM st WHERE pp_status = 'failed'"
add("A15_diagnostics_summary", q(" UNION ALL ".join([
    newest("pipeline", "SELECT CAST(event_id AS VARCHAR) AS id, ts AS \"at\", 'user ' || user_id AS message, false AS final FROM events WHERE event_type = 'error'", ""),
    newest("groups", f"SELECT CAST(group_id AS VARCHAR) AS id, last_success_at AS \"at\", last_error AS message, false AS final FROM ({C.GROUPS}) WHERE last_error <> ''", "inspect the groups"),
    newest("releases", FAILED, "requeue"), newest("permanent", f"SELECT * FROM ({FAILED}) WHERE final", "requeue"),
    newest("jobs", "SELECT CAST(event_id AS VARCHAR) AS id, ts AS \"at\", CASE WHEN event_id % 3 = 0 THEN 'boom' ELSE '' END AS message, false AS final FROM events WHERE event_id % 5 = 3", ""),
]), "releases", "passes", st=C.STATUS))(diagnosed)


# Search by the stored index of trigrams (P05, P11, W09), and joins in one layout.
name_index = lambda s, d: once_made(s, d, "names", lambda: G.build(releases(s, d), "guid", "search_name"))
_MADE: dict[tuple, object] = {}


def once_made(s, d, name, make):
    """What consists of several tables, built at its first use."""
    key = (s.sparkContext.applicationId, d, name, stamp(s, d))
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


found_by = lambda query: q(f"SELECT guid FROM releases WHERE {' AND '.join(f"contains(search_name, '{t}')" for t in query.lower().split())}", "releases")
for name, text in {"P05_indexed_search": "2160 Movie", "P05_indexed_short": "s0 1 w", "P05_indexed_inside": "luray x26 ovi"}.items():
    add(name, found_by(text))(lambda s, d, text=text: Q.token_and_search(releases(s, d), text, name_index(s, d)).select("guid"))
customers = lambda s, d: once_made(s, d, "customers", lambda: G.build(V.table(s, d, "customer"), "c_custkey", "c_name", whole=True))
add("P11_indexed_filter", "SELECT c_custkey AS k FROM customer WHERE contains(lower(c_name), 'er#0000000')")(lambda s, d: G.matching(V.table(s, d, "customer"), customers(s, d), "c_custkey", ["eR#0000000"]).select(F.col("c_custkey").alias("k")))
add("W09_indexed_search", SQL["W09_catalog_search"])(lambda s, d: P.catalog_search(C.QUERIES["S03_group_catalog_scan"](s, d), " SRC", 4, 1, G.build(C.QUERIES["S03_group_catalog_scan"](s, d), "name", "name", whole=True)).select("name", "estimated_count", "total"))
laid = lambda s, d: once_made(s, d, "layout", lambda: A.linked_layout(parts(s, d), bins(s, d), C.states(s, d)))
add("J02_bucketed_segments", SQL["J02_release_segments"])(lambda s, d: A.release_segments(laid(s, d)[0], laid(s, d)[2]).select("guid", F.col("number").cast("long").alias("number"), "message_id", "bytes"))
add("J04_bucketed_candidates", SQL["J04_retention_candidates"])(lambda s, d: J.retention_candidates(laid(s, d)[0], laid(s, d)[2], ntz("1997-01-01 00:00:00")).select("part_id"))
add("J08_bucketed_protected", q(f"SELECT DISTINCT binary_id FROM linked WHERE part_id % 3 = 0 AND binary_id IN {D.DONE}", "linked", st=C.STATUS))(lambda s, d: P.protected_binaries(laid(s, d)[0].filter("part_id % 3 = 0"), laid(s, d)[2]))
add("B23_bucketed_trace", SQL["B23_trace_release"])(lambda s, d: J.trace(*laid(s, d)))
