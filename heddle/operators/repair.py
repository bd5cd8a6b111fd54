"""Bodies, repair, segments, listings and reports (P09, J03, J05, J08, J09, J11, W04, W08-W10, SET2, B03-B06,
B11, B15, B17-B18, B22, A15, A19, U02-U04).

Empty tables give empty results (reports: zeros). Null bodies decode to null; null names and texts count as
empty; rows that repeat are worked on each, unless a docstring says otherwise.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names as N
from ..functions import regexes as R
from ..sources import tables
from . import assembly as A
from . import jobs as J
from . import search as Q
from . import trigrams

#: Fixed values of PAR2 packets: the magic, the header's length, the type of a file description and where its name starts.
PAR2_MAGIC, PAR2_HEADER, PAR2_FILE, PAR2_NAME = b"PAR2\x00PKT", 64, b"PAR 2.0\x00FileDesc", 56
#: Bytes of the longest name that post-processing takes.
LONGEST_NAME = 512


# Bodies.
def decoded(body: bytes) -> bytes | None:
    """A yEnc body's bytes: the lines between =ybegin and =yend, less 42, after an = less 64 more."""
    inside, seen, out = False, False, []
    for line in body.split(b"\n"):
        line = line.rstrip(b"\r\n")
        if line.startswith((b"=ybegin", b"=ypart", b"=yend")):
            inside = not line.startswith(b"=yend")
            seen |= line.startswith(b"=ybegin")
        elif inside:
            out.append(line)
    if not seen:
        return None
    # Escapes: every second = of a run stands for itself as an escaped byte, so runs are read from their start.
    return b"".join(_line(x) for x in out)


#: Each byte less 42, and less 64 where it is escaped; lines of fewer bytes are read escape by escape, longer ones as arrays.
_LESS, _ESCAPES, _SHORT = bytes((v - 42) % 256 for v in range(256)), re.compile(b"=(.?)", re.DOTALL), 1024
_UNESCAPED = {b"=" + bytes([v]): bytes([(v - 64) % 256]) for v in range(256)} | {b"=": b""}


def _line(line: bytes) -> bytes:
    if b"=" not in line:
        return line.translate(_LESS)
    if len(line) < _SHORT:
        return _ESCAPES.sub(lambda m: _UNESCAPED[m[0]], line).translate(_LESS)
    raw = np.frombuffer(line, dtype=np.uint8)
    at = np.arange(len(raw))
    mark = raw == ord("=")
    start = mark & ~np.concatenate(([False], mark[:-1]))
    run = at - np.maximum.accumulate(np.where(start, at, 0))
    escape = mark & (run % 2 == 0)
    moved = np.concatenate(([False], escape[:-1])) & ~escape
    return (raw - np.uint8(42) - np.where(moved, np.uint8(64), np.uint8(0)))[~escape].tobytes()


@F.arrow_udf(T.BinaryType())
def yenc_decode(bodies: pa.Array) -> pa.Array:
    """Null for bodies without =ybegin."""
    return pa.array([None if b is None else decoded(b) for b in bodies.to_pylist()], pa.binary())


def declared(data: bytes) -> list[str]:
    out, at = [], data.find(PAR2_MAGIC)
    while 0 <= at <= len(data) - PAR2_HEADER:
        size = int.from_bytes(data[at + 8 : at + 16], "little")
        if size < PAR2_HEADER or at + size > len(data):
            at = data.find(PAR2_MAGIC, at + len(PAR2_MAGIC))
            continue
        if data[at + 48 : at + 64] == PAR2_FILE:
            name = data[at + PAR2_HEADER + PAR2_NAME : at + size].rstrip(b"\0").decode("utf-8", "replace")
            if name and name not in out:
                out.append(name)
        at = data.find(PAR2_MAGIC, at + size)
    return out


@F.arrow_udf(T.ArrayType(T.StringType()))
def par2_filenames(bodies: pa.Array) -> pa.Array:
    """Distinct names that PAR2 packets declare, in the order they are first seen; corrupt packets are skipped."""
    return pa.array([[] if b is None else declared(b) for b in bodies.to_pylist()], pa.list_(pa.string()))


def has_par2_magic(body: Column) -> Column:
    """U03"""
    return F.coalesce(F.contains(body, F.lit(PAR2_MAGIC)), F.lit(False))


# Segments.
def number_segments(segments: DataFrame) -> DataFrame:
    """1 to n in each release by part and article number, whatever number was stored."""
    order = Window.partitionBy("guid").orderBy("part_number", "article_number")
    return segments.withColumn("number", F.row_number().over(order))


def snapshot_segments(releases: DataFrame, parts: DataFrame) -> DataFrame:
    """Releases with their ordered segments, an empty list where there are none. Parts move once, to their binary, where
    a release's are gathered, put in order and numbered; lists aren't dealt again by guid."""
    rows = A.link_parts(parts).filter("binary_id IS NOT NULL AND message_id <> ''").select("binary_id", F.struct("part_number", "article_number", "message_id", "bytes", "subject").alias("s"))
    lists = rows.join(releases.select("binary_id"), "binary_id", "left_semi").groupBy("binary_id").agg(F.array_sort(F.collect_list("s")).alias("segments"))
    numbered = F.transform("segments", lambda s, i: F.struct((i + 1).alias("number"), s["message_id"].alias("message_id"), s["bytes"].alias("bytes"), s["subject"].alias("subject")))
    found = lists.select("binary_id", numbered.alias("segments"))
    empty = F.array().cast(found.schema["segments"].dataType)
    return releases.join(found, "binary_id", "left").select("guid", *[c for c in releases.columns if c != "guid"], F.coalesce("segments", empty).alias("segments"))


def _filled(releases: DataFrame, parts: DataFrame) -> DataFrame:
    """Releases with stored segments as they are, others with those of their parts; only these are joined."""
    bare = F.size("segments") == 0
    again = snapshot_segments(releases.filter(bare).drop("segments"), parts).withColumn("stored", F.lit(False))
    return releases.filter(~bare).withColumn("stored", F.lit(True)).select(*again.columns).unionByName(again)


def segments_or_parts(releases: DataFrame, parts: DataFrame) -> DataFrame:
    """Guid, segments and whether they are stored ones: those stored with the release (column segments),
    if any, else those of its parts. Only releases without stored ones are joined."""
    return _filled(releases, parts).select("guid", "segments", "stored")


def backfill_segments(releases: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """B04, without its batch limit: releases with segments filled in, and counts of repaired and unresolved."""
    found = _filled(releases, parts)
    counts = found.filter("NOT stored").agg(F.count_if(F.size("segments") > 0).alias("repaired"), F.count_if(F.size("segments") == 0).alias("unresolved"))
    return found, counts


# Repair.
def retention_exists(parts: DataFrame, bins: DataFrame, releases: DataFrame, cutoff: Column) -> DataFrame:
    """J04's parts by the binaries that exist."""
    done = releases.filter("pp_status = 'done'").select("binary_id")
    return A.link_parts(parts).filter(F.col("posted_at") < cutoff).join(bins.select("binary_id").join(done, "binary_id", "left_semi"), "binary_id", "left_semi")


def dirty_binaries(parts: DataFrame, updates: DataFrame) -> DataFrame:
    """Binaries of the parts that are to change."""
    return A.link_parts(parts.join(updates.select("part_id"), "part_id", "left_semi")).filter("binary_id IS NOT NULL").select("binary_id").distinct()


def protected_binaries(dirty: DataFrame, releases: DataFrame) -> DataFrame:
    """Those that back a release that is done."""
    return dirty.select("binary_id").distinct().join(releases.filter("pp_status = 'done'").select("binary_id"), "binary_id", "left_semi")


def reassemble_counts(parts: DataFrame, bins: DataFrame, releases: DataFrame, updates: DataFrame) -> DataFrame:
    """What applying updates does: parts updated and kept back, binaries protected, releases and binaries deleted."""
    dirty = dirty_binaries(parts, updates)
    safe = protected_binaries(dirty, releases)
    gone = dirty.join(safe, "binary_id", "left_anti")
    linked = A.link_parts(parts.join(updates.select("part_id"), "part_id", "left_semi")).join(safe.withColumn("safe", F.lit(True)), "binary_id", "left")
    n = linked.agg(F.count_if(F.col("safe").isNull()).alias("updated"), F.count_if("safe").alias("kept_back"))
    count = lambda df, c: df.agg(F.count("*").alias(c))
    for one in (count(safe, "protected"), count(releases.join(gone, "binary_id", "left_semi"), "releases_deleted"), count(bins.join(gone, "binary_id", "left_semi"), "binaries_deleted")):
        n = n.join(one)  # of a row each
    return n


def repair_candidates(releases: DataFrame, segments: DataFrame, parts: DataFrame) -> DataFrame:
    """J09, without its batch limit: releases of unknown size that are done and unverified, their parts (0: none
    left) and their first segment; those without segments are left out."""
    due = releases.filter("total_parts = 0 AND pp_status = 'done' AND NOT verified").select("guid", "binary_id")
    first = segments.filter("number = 1").select("guid", "message_id")
    own = A.link_parts(parts).filter("binary_id IS NOT NULL").select("binary_id", "part_id")
    return due.join(first, "guid").join(own, "binary_id", "left").select("guid", "binary_id", F.coalesce("part_id", F.lit(0)).alias("part_id"), "message_id")


def recollected(parts: DataFrame) -> DataFrame:
    """part_id, key, number and count of the collections that subjects name by a leading file counter in brackets and a quoted name.
    A count of one, or the first file of as many as the first counter of any kind gives, is no collection."""
    s = F.coalesce("subject", F.lit(""))
    leading, any_one = R.port(R.LEADING_FILES), R.port(R.COUNTER)
    number, count = (F.regexp_extract(s, leading, i).try_cast("int") for i in (1, 2))
    name, first = F.regexp_extract(s, R.QUOTED, 1), F.regexp_extract(s, any_one, 2).try_cast("int")
    rows = parts.filter(s.rlike(leading)).select("part_id", name.alias("n"), number.alias("new_file"), count.alias("new_total"), first.alias("first"))
    rows = rows.filter((F.col("new_total") >= 2) & (F.col("n") != "") & ~((F.col("new_file") == 1) & (F.col("new_total") == F.col("first"))))
    return rows.select("part_id", F.concat(volume_base(F.col("n")), F.lit("/"), F.col("new_total").cast("string")).alias("new_key"), "new_file", "new_total")


def volume_base(name: Column) -> Column:
    """A file's name without the endings of archive volumes, behind which another number may stand; the name itself if it has none."""
    ending, number = R.port(R.VOLUME_FILE), r"\.\d{3,4}\z"
    cut = F.regexp_replace(name, number, "")
    strip = lambda x: F.regexp_replace(x, ending, "")
    bare = F.regexp_replace(name, r"\.[^.]*\z", "")
    found = F.when(name.rlike(number) & (cut != "") & cut.rlike(ending), strip(cut)).when(name.rlike(ending) & (strip(name) != ""), strip(name)).when(name.rlike(ending), bare)
    return F.coalesce(F.nullif(found, F.lit("")), name)


class Torn(NamedTuple):
    """What stays after a tear-down, and counts of it."""

    parts: DataFrame
    binaries: DataFrame
    releases: DataFrame
    files: DataFrame
    counts: DataFrame


def fix_stub_collections(releases: DataFrame, parts: DataFrame, bins: DataFrame, files: DataFrame) -> Torn:
    """Binaries of stub releases (P13) some of whose parts count files in brackets are torn down: their releases, release files (guid, ...)
    and binaries go, and parts that name a collection get its key, number and count. All four tables follow from one stored list
    of what goes, so they never disagree; repeated stubs and parts count once."""
    stubs = J.stub_releases(releases).select("binary_id").distinct()
    hit = A.link_parts(parts).join(stubs, "binary_id", "left_semi").filter(F.col("subject").rlike(r"\[(?s:.*)/(?s:.*)\]"))
    hit = tables.stored(hit.select("part_id", "binary_id", "subject"), "torn")
    again = tables.stored(recollected(hit).distinct(), "recollected")
    torn = hit.select("binary_id").distinct()
    met = parts.join(again, "part_id", "left")
    new = {"collection_key": "new_key", "file_number": "new_file", "collection_files": "new_total"}
    fixed = met.select(*[F.coalesce(new[c], c).cast(parts.schema[c].dataType).alias(c) if c in new else F.col(c) for c in parts.columns])
    gone = releases.join(torn, "binary_id", "left_semi")
    counts = stubs.agg(F.count("*").alias("stubs")).join(again.agg(F.count("*").alias("parts"))).join(torn.agg(F.count("*").alias("binaries"))).join(gone.agg(F.count("*").alias("releases")))  # of a row each
    return Torn(fixed, bins.join(torn, "binary_id", "left_anti"), releases.join(torn, "binary_id", "left_anti"), files.join(gone.select("guid"), "guid", "left_anti"), counts)


# Jobs, listings, reports.
ENDED = ("completed", "failed", "cancelled", "interrupted")


def interrupt_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs that were queued or running when the process ended."""
    live = F.col("state").isin("queued", "running")
    return jobs.withColumns({"error": F.when(live & (F.coalesce("error", F.lit("")) == ""), "interrupted by restart").otherwise(F.col("error")), "finished_at": F.when(live, now).otherwise(F.col("finished_at")), "state": F.when(live, "interrupted").otherwise(F.col("state"))})


def cleanup_jobs(jobs: DataFrame, cutoff: Column) -> DataFrame:
    """Without ended jobs older than cutoff."""
    return jobs.filter(~(F.col("state").isin(*ENDED) & (F.coalesce("finished_at", "created_at") < cutoff)))


class Enriched(NamedTuple):
    metadata: DataFrame
    identifiers: DataFrame
    counts: DataFrame


def enrich_pass(releases: DataFrame, metadata: DataFrame, identifiers: DataFrame, providers: DataFrame) -> Enriched:
    """For releases that need metadata (J06) a row for each match and each miss, and the identifiers of matches, normalised
    (T21; others are left out). Where a provider failed and none matched, nothing is stored, so a later pass looks again."""
    found = tables.stored(J.enrich_lookup(Q.needs_metadata(releases, metadata), providers), "looked_up")
    counts = found.agg(F.count("*").alias("processed"), F.count_if("matched").alias("matched"), F.count_if(~F.col("matched") & ~F.col("failed")).alias("misses"), F.count_if("failed").alias("errors"))
    rows = found.filter("NOT failed").select("guid", *[c for c in metadata.columns if c != "guid"])
    new = found.select("guid", F.explode("identifiers").alias("i")).select("guid", N.normalize_identifier(F.col("i.source"), F.col("i.identifier")).alias("i")).filter("i IS NOT NULL").select("guid", "i.source", "i.identifier")
    return Enriched(J.upsert_metadata(metadata, rows), J.merged_identifiers(new, identifiers), counts)


def unanswerable(text: Column, identifiers: Column, *params: Column) -> Column:
    """A request that has an identifier parameter, but neither search text nor a valid identifier."""
    asked = F.lit(False)
    for p in params:
        asked |= F.trim(F.coalesce(p, F.lit(""))) != ""
    return asked & (F.trim(F.coalesce(text, F.lit(""))) == "") & (F.size(F.array_compact(identifiers)) == 0)


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 500) -> DataFrame:
    """A page of at most ``most`` rows, each with the ``total`` of all."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(min(limit if limit > 0 else 50, most)).join(total)  # of one row


def group_page(groups: DataFrame, search: str = "", status: str = "", errors_only: bool = False, sort: str = "name", desc: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    """Groups (name, active, last_error, ...) filtered and sorted by a column, nulls last, then by name."""
    rows = groups.filter(F.lower("name").contains(search.lower()))
    rows = rows.filter(F.col("active") == (status == "active")) if status else rows
    rows = rows.filter(F.coalesce("last_error", F.lit("")) != "") if errors_only else rows
    key = F.col(sort).desc_nulls_last() if desc else F.col(sort).asc_nulls_last()
    return page(rows, [key, F.col("name")], limit, offset)


def group_listing(groups: DataFrame, parts: DataFrame) -> DataFrame:
    """Groups (group_id, server_high, last_scanned_high, ...) with lag behind the server and bytes of their stored parts, as
    columns to sort a page by; a group without parts stores none."""
    lag = F.greatest(F.coalesce(F.col("server_high") - F.col("last_scanned_high"), F.lit(0)), F.lit(0))
    kept = parts.groupBy("group_id").agg(F.sum("bytes").alias("storage"))
    return groups.withColumn("lag", lag).join(kept, "group_id", "left").withColumn("storage", F.coalesce("storage", F.lit(0)))


def catalog_search(catalog: DataFrame, query: str, limit: int, offset: int = 0, index: trigrams.Index | None = None) -> DataFrame:
    """Names that contain the query, the largest first; by an index of whole names if there is one."""
    text = query.strip().lower()
    return page(trigrams.matching(catalog, index, "name", [text]) if index else catalog.filter(F.lower("name").contains(text)), [F.col("estimated_count").desc(), F.col("name")], limit, offset)


def recent_errors(releases: DataFrame, limit: int = 50) -> DataFrame:
    """The newest releases whose post-processing failed."""
    return releases.filter("pp_status = 'failed'").orderBy(F.desc("posted_at"), F.desc("guid")).limit(limit)


def first_seen(values: Column) -> Column:
    """SET2: distinct values in the order they are first seen, without nulls and empty ones."""
    return F.filter(F.array_distinct(values), lambda x: x.isNotNull() & (x != ""))


def pipeline_gauges(stats: DataFrame) -> DataFrame:
    """A05's figures as metric, label and value; counts by status are one metric."""
    status = F.regexp_extract("metric", "^releases_(.*)$", 1)
    return stats.select(F.when(status != "", "releases_by_status").otherwise(F.col("metric")).alias("gauge"), status.alias("label"), "value")


def diagnostics(sources: dict[str, tuple[DataFrame, str]], limit: int = 50) -> DataFrame:
    """Of each source (rows id, at, message, failed and, if only some can be tried again, permanent) the newest ``limit`` failing items by
    rank, with the number of all that fail and a hint if some of them aren't permanent. A source without any gives one row without an item."""
    out = None
    for name, (rows, hint) in sources.items():
        final = F.coalesce("permanent", F.lit(False)) if "permanent" in rows.columns else F.lit(False)
        bad = rows.filter("failed").select(F.col("id").cast("string").alias("id"), "at", F.coalesce("message", F.lit("")).alias("message"), final.alias("final"))
        total = bad.agg(F.count("*").alias("failing"), F.count_if(~F.col("final")).alias("open"))
        newest = bad.orderBy(F.desc_nulls_last("at"), F.desc("id")).limit(limit)  # the report's length
        ranked = newest.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("at"), F.desc("id"))))
        one = total.join(ranked, F.lit(True), "left").select(F.lit(name).alias("source"), "failing", F.when(F.col("open") > 0, hint).otherwise("").alias("hint"), "rank", "id", "at", "message")
        out = one if out is None else out.unionByName(one)
    return out


def admin_overview(**sections: DataFrame) -> DataFrame:
    """The sections' rows as section, name and value."""
    out = None
    for name, rows in sections.items():
        key, value = rows.columns[:2]
        one = rows.select(F.lit(name).alias("section"), F.col(key).cast("string").alias("name"), F.col(value).cast("string").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out
