"""Retention, post-processing, repair and re-parse jobs, snapshot to snapshot.

Empty tables give empty results, reports zeros. Null keys match nothing where tables are joined; a part without a binary is never a
candidate of retention and never protected. A null status is none of the known ones. Rows that repeat are each kept or dropped by the
same rule. Unknown columns come along; working columns take names that are free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import subjects as S
from ..sources import tables
from . import assembly as A
from .state import pp_backoff_seconds


def retention_candidates(parts: DataFrame, releases: DataFrame, cutoff: Column) -> DataFrame:
    """Parts older than cutoff whose binary backs a release that is done."""
    done = releases.filter("pp_status = 'done'").select("binary_id")
    return A.link_parts(parts).filter(F.col("posted_at") < cutoff).join(done, "binary_id", "left_semi")


def prune_parts(parts: DataFrame, candidates: DataFrame) -> DataFrame:
    """B14"""
    return parts.join(candidates.select("part_id"), "part_id", "left_anti")


def retention_report(parts: DataFrame, candidates: DataFrame) -> DataFrame:
    """A08"""
    c = candidates.agg(F.count("*").alias("candidate_parts"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("candidate_bytes"), F.count_distinct("binary_id").alias("binaries"), F.count_distinct("group_id").alias("groups"), F.min("posted_at").alias("oldest"), F.max("posted_at").alias("newest"))
    return c.join(F.broadcast(parts.agg(F.count("*").alias("all_parts"))), how="inner").withColumn("retained", F.col("all_parts") - F.col("candidate_parts"))


def with_status(releases: DataFrame) -> DataFrame:
    """A post-processing state for each release, from its hash, where no history is at hand."""
    h = F.conv(F.substring("release_hash", 1, 4), 16, 10).cast("int")
    status = F.when(h % 3 == 0, "pending").when(h % 3 == 1, "done").otherwise("failed")
    return releases.withColumns({"pp_status": status, "pp_attempts": F.when(status == "failed", h % 5).otherwise(0), "permanent": (status == "failed") & (h % 5 == 4), "next_retry": F.when(status == "failed", F.col("posted_at"))})


def record_failure(releases: DataFrame, failures: DataFrame) -> DataFrame:
    """``failures``: guid, permanent_failure, at. Several of one release count once: permanent if one is, at the latest time; a null
    time leaves no time to retry, and the failure counts all the same."""
    final, late, seen = (tables.free(c, releases) for c in ("_final", "_late", "_seen"))
    once = failures.groupBy("guid").agg(F.coalesce(F.bool_or("permanent_failure"), F.lit(False)).alias(final), F.max("at").alias(late), F.lit(True).alias(seen))
    out = releases.join(once, "guid", "left")
    hit, n = F.col(seen).isNotNull(), F.col("pp_attempts") + 1
    ended = F.col(final) | (n >= 3)
    later = F.timestamp_seconds(F.unix_seconds(F.col(late).cast("timestamp")) + pp_backoff_seconds(n)).cast("timestamp_ntz")
    return out.withColumns({"pp_status": F.when(hit, "failed").otherwise(F.col("pp_status")), "permanent": F.when(hit, ended).otherwise(F.col("permanent")), "next_retry": F.when(hit, F.when(~ended, later)).otherwise(F.col("next_retry")), "pp_attempts": F.when(hit, n).otherwise(F.col("pp_attempts"))}).drop(final, late, seen)


def requeue_failed(releases: DataFrame) -> DataFrame:
    """B09"""
    bad = F.col("pp_status") == "failed"
    return releases.withColumns({"pp_attempts": F.when(bad, 0).otherwise(F.col("pp_attempts")), "permanent": F.when(bad, False).otherwise(F.col("permanent")), "next_retry": F.when(~bad, F.col("next_retry")), "pp_status": F.when(bad, "pending").otherwise(F.col("pp_status"))})


def reparse_plan(stored: DataFrame) -> DataFrame:
    """Parts whose fields change when their subject is parsed again. Only these are kept: the comparison stays above the parser
    (tables.held), which so runs once for each part. Null and missing fields count as different from any other."""
    fields = ["part_number", "total_parts", "norm_subject", "collection_key", "file_number", "collection_files"]
    again, barrier = tables.held(S.parse_subject(stored.withColumnsRenamed({c: f"old_{c}" for c in fields})))
    changed = F.lit(False)
    for c in fields:
        changed |= ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    return again.filter(changed & barrier).select("part_id", *fields)


def reassemble_apply(parts: DataFrame, releases: DataFrame, updates: DataFrame) -> DataFrame:
    """Parts with their updates, but for those whose binary backs a release that is done."""
    protected = releases.filter("pp_status = 'done'").select("binary_id").distinct().withColumn("protected", F.lit(True))
    fields = [c for c in updates.columns if c != "part_id"]
    rows = A.link_parts(parts).join(protected, "binary_id", "left").join(updates.withColumnsRenamed({c: f"new_{c}" for c in fields}), "part_id", "left")
    free = F.col("protected").isNull()
    return rows.select(*[(F.when(free, F.coalesce(f"new_{c}", c)).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)) for c in parts.columns], F.coalesce("protected", F.lit(False)).alias("protected"))


def stub_releases(releases: DataFrame) -> DataFrame:
    """P13"""
    return releases.filter((F.col("size") < 5_000_000) & (F.col("total_parts") <= 3) & (F.col("pp_status") == "done") & F.col("name").rlike(r"^[A-Za-z0-9.]{15,}\z"))


def delete_group_cascade(df: DataFrame, group_id: int, keep: bool = False) -> DataFrame:
    """Without the group's rows; for releases (keep) their group becomes null."""
    if keep:
        return df.withColumn("group_id", F.when(F.col("group_id") != group_id, F.col("group_id")))
    return df.filter(F.col("group_id") != group_id)


def pipeline_stats(parts: DataFrame, bins: DataFrame, releases: DataFrame) -> DataFrame:
    """Figures in long form."""
    p = A.link_parts(parts).agg(F.count("*").alias("parts"), F.count_if(F.col("binary_id").isNull()).alias("unassigned"))
    b = bins.agg(F.count("*").alias("binaries"), F.count_if("complete").alias("complete"))
    r = releases.agg(F.count("*").alias("releases"), *[F.count_if(F.col("pp_status") == s).alias(f"releases_{s}") for s in ("pending", "done", "failed")], F.count_if((F.col("pp_status") == "failed") & F.col("permanent")).alias("exhausted"))
    long = lambda df: df.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, df.columns)), F.array(*df.columns))).alias("metric", "value"))
    return long(p).unionByName(long(b)).unionByName(long(r))


def group_release_stats(releases: DataFrame, groups: DataFrame) -> DataFrame:
    """Releases of each group that has a name, all and pending ones."""
    g = releases.groupBy("group_id").agg(F.count("*").alias("total"), F.count_if(F.col("pp_status") == "pending").alias("pending"))
    return g.join(groups, "group_id").select("group_name", "total", "pending")


def group_names(releases: DataFrame, groups: DataFrame) -> DataFrame:
    """Releases with group_name, empty where the group has none or is gone."""
    named = groups.select("group_id", "group_name").distinct()
    return releases.join(named, "group_id", "left").withColumn("group_name", F.coalesce("group_name", F.lit("")))


def capacity_stats(parts: DataFrame) -> DataFrame:
    """Bytes and articles of each group, ranked by bytes."""
    return parts.groupBy("group_id").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("articles")).withColumn("bytes_per_article", F.round(F.col("bytes") / F.col("articles"), 6))


def capacity_totals(parts: DataFrame) -> DataFrame:
    """Bytes, articles and bytes of an article over all groups; zeros for an empty table."""
    t = parts.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count("*").alias("articles"))
    return t.withColumn("bytes_per_article", F.coalesce(F.round(F.try_divide("bytes", "articles"), 6), F.lit(0.0)))


def route_metrics(requests: DataFrame, bounds: list[int]) -> DataFrame:
    """Requests and cumulative latency buckets of each route."""
    return requests.groupBy("method", N.route_pattern(F.col("path")).alias("route"), "status").agg(F.count("*").alias("requests"), *[F.count_if(F.col("ms") <= b).alias(f"le_{b}") for b in bounds])


def route_totals(metrics: DataFrame) -> DataFrame:
    """A18's rows of each route added up over methods and statuses, with the number of server errors."""
    buckets = [c for c in metrics.columns if c.startswith("le_")]
    return metrics.groupBy("route").agg(F.sum("requests").alias("requests"), F.sum(F.when(F.col("status") >= 500, F.col("requests")).otherwise(0)).alias("errors"), *[F.sum(c).alias(c) for c in buckets])


def trace(parts: DataFrame, bins: DataFrame, releases: DataFrame) -> DataFrame:
    """The first stage at which an article stops."""
    b = bins.select("binary_id", "complete", "total_parts")
    rows = A.link_parts(parts).select("part_id", "binary_id").join(b, "binary_id", "left").join(releases.select("binary_id", F.lit(True).alias("released")), "binary_id", "left")
    stage = F.when(F.col("binary_id").isNull() | F.startswith(F.col("binary_id"), F.lit("-")), "unassigned").when(~F.col("complete"), "incomplete").when(F.col("total_parts") == 0, "unknown total").when(F.col("released").isNull(), "duplicate release").otherwise("released")
    return rows.select("part_id", stage.alias("stage"))


def provider_answers(providers: DataFrame) -> DataFrame:
    """A row for each title: external_id of the provider of least priority that matches, whether any failed, and identifiers, of each
    source the one from the first provider that matches and has it (of several of one provider the least)."""
    error = F.coalesce("error", F.lit(False)) if "error" in providers.columns else F.lit(False)
    listed = F.col("identifiers") if "identifiers" in providers.columns else F.lit(None).cast("array<struct<source:string,identifier:string>>")
    rows = providers.select("title", "priority", "external_id", error.alias("error"), listed.alias("identifiers"))
    hit = ~F.col("error") & F.col("external_id").isNotNull()
    best = rows.groupBy("title").agg(F.min(F.when(hit, F.struct("priority", "external_id")))["external_id"].alias("external_id"), F.bool_or("error").alias("error"))
    first = rows.filter(hit).select("title", "priority", F.explode("identifiers").alias("i")).filter("i.source IS NOT NULL AND i.identifier IS NOT NULL")
    first = first.groupBy("title", F.col("i.source").alias("source")).agg(F.min(F.struct("priority", "i.identifier"))["identifier"].alias("identifier"))
    own = first.groupBy(F.col("title").alias("_of")).agg(F.array_sort(F.collect_list(F.struct("source", "identifier"))).alias("identifiers"))  # one for each source
    return best.join(own, F.col("title") == F.col("_of"), "left").drop("_of")


def enrich_lookup(releases: DataFrame, providers: DataFrame) -> DataFrame:
    """For each release (guid, name) its title, external_id, matched, identifiers and failed: a provider failed and none
    matched, so nothing is known. ``providers``: title, priority, external_id (null: a miss), and, where they have them, error (the lookup
    failed) and identifiers (array of source and identifier). Titles that no provider lists are misses; null ones too."""
    titles = releases.select("guid", N.parse_title(F.col("name")).alias("t")).select("guid", F.col("t.title").alias("title"))
    met = titles.join(provider_answers(providers), "title", "left")
    none = F.array().cast("array<struct<source:string,identifier:string>>")
    matched = F.col("external_id").isNotNull()
    return met.select("guid", "title", "external_id", matched.alias("matched"), F.coalesce("identifiers", none).alias("identifiers"), (~matched & F.coalesce("error", F.lit(False))).alias("failed"))


def merged_identifiers(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct identifiers (guid, source, identifier) of lookups and stored ones; those without a value are left out."""
    return stored.unionByName(found).filter("identifier IS NOT NULL AND identifier <> ''").distinct()


def upsert_metadata(stored: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace those of the same release."""
    return new.unionByName(stored.join(new.select("guid"), "guid", "left_anti"))


def smallest_first(segments: DataFrame, budget: int = 4) -> DataFrame:
    """In each release parity files first, then descriptions, then the smallest; a budget of them."""
    name = N.subject_filename(F.col("subject"))
    bucket = F.when(N.looks_like(name, ".par2"), 0).when(N.looks_like(name, ".nfo"), 1).otherwise(2)
    rows = segments.withColumn("bucket", bucket)
    return A.cap_per_key(rows, ["guid"], budget, "bucket", F.when(F.col("bucket") == 2, F.col("bytes")).otherwise(0), "number")
