"""Post-processing of releases: what their articles tell about them (B05), what is stored of it (B06), and what is recorded of failures.

A null or repeated subject counts as any; a release without segments fetches nothing and isn't a failure. Bodies are one for each
message; a null or missing one couldn't be fetched. Results whose guid is unknown are left out; of several results of a release
the one that didn't fail, then the least name counts. Null identifiers and those that T21 rejects are left out. Empty tables give
empty results. Columns named like working ones (``_kind`` and the like) must not be in the segments.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from . import jobs as J
from .repair import LONGEST_NAME, has_par2_magic, par2_filenames, yenc_decode

PARITY, OTHER, DESCRIPTION = 1, 2, 3
IDENTIFIERS = "array<struct<source:string,identifier:string>>"


def probes(due: DataFrame, segments: DataFrame, budget: int) -> DataFrame:
    """The first ``budget`` segments of each kind, in the order in which they would be fetched: parity files and descriptions by their
    number, others, which only obfuscated releases look into, the smallest first. More of a kind are never fetched."""
    name = N.subject_filename(F.coalesce("subject", F.lit("")))
    kind = F.when(N.looks_like(name, ".par2"), PARITY).when(N.looks_like(name, ".nfo"), DESCRIPTION).otherwise(OTHER)
    rows = segments.join(due.select("guid", F.col("obfuscated").alias("_hidden")).distinct(), "guid").withColumn("_kind", kind)
    rows = rows.filter((F.col("_kind") != OTHER) | F.col("_hidden"))
    order = Window.partitionBy("guid", "_kind").orderBy(F.when(F.col("_kind") == OTHER, F.col("bytes")), "number", "message_id")
    return rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= budget).select("guid", "message_id", "_kind", "_rank", "_hidden")


def recovered_name(data: Column) -> Column:
    """The best name that a parity file declares, null if it is empty, obfuscated or longer than a name can be."""
    best = N.best_release_name(par2_filenames(data))
    return F.when((best != "") & (F.octet_length(best) <= LONGEST_NAME) & ~N.is_obfuscated(best), best)


def postprocess_resolve(due: DataFrame, segments: DataFrame, bodies: DataFrame, budget: int = 4) -> DataFrame:
    """For each due release (guid, obfuscated) guid, new_name, search_name, category_id, nfo, identifiers, fetched, failed and
    permanent. ``bodies``: message_id, body, code (of the server's refusal).

    Fetches cost a budget that three steps share, each of which stops at its first success: parity files by subject; for obfuscated
    releases without a name yet any body with parity magic; descriptions. Where each step would stop follows from the least rank that
    succeeds, so no step has to wait for another: what lies behind it is discarded as if never fetched. A release
    failed if it has neither name nor description and a fetch failed, permanently if one of these did."""
    rows = probes(due, segments, budget).join(bodies.select("message_id", "body", "code"), "message_id", "left")
    rows = rows.withColumn("_data", F.coalesce(yenc_decode(F.col("body")), "body"))
    named = recovered_name(F.when((F.col("_kind") == PARITY) | ((F.col("_kind") == OTHER) & has_par2_magic(F.col("_data"))), F.col("_data")))
    rows = rows.withColumn("_name", named).withColumn("_text", F.when(F.col("_kind") == DESCRIPTION, F.nullif(N.sanitize_nfo(F.col("_data")), F.lit(""))))
    missed = F.when(F.col("body").isNull(), F.struct("_kind", "_rank", F.coalesce(N.classify_error(F.col("code"), F.lit(True))["permanent"], F.lit(False)).alias("final")))
    of = lambda kind, what: F.when((F.col("_kind") == kind) & what.isNotNull(), F.struct("_rank", what.alias("x")))
    found = rows.groupBy("guid").agg(
        *[F.count_if(F.col("_kind") == k).alias(f"_n{k}") for k in (PARITY, OTHER, DESCRIPTION)],
        *[F.min(of(k, F.col("_name"))).alias(f"_f{k}") for k in (PARITY, OTHER)],
        F.min(of(DESCRIPTION, F.col("_text"))).alias(f"_f{DESCRIPTION}"),
        F.collect_list(missed).alias("_missed"),  # three budgets at most
    )
    spent = lambda left, k: F.least(left, F.coalesce(F.col(f"_f{k}._rank"), F.col(f"_n{k}")))
    won = lambda left, k: F.coalesce(F.col(f"_f{k}._rank") <= left, F.lit(False))
    out = due.select("guid").distinct().join(found, "guid", "left").withColumns({f"_n{k}": F.coalesce(f"_n{k}", F.lit(0)) for k in (PARITY, OTHER, DESCRIPTION)})
    out = out.withColumns({"_s1": spent(F.lit(budget), PARITY), "_w1": won(F.lit(budget), PARITY)})
    out = out.withColumn("_left", F.when(F.col("_w1"), 0).otherwise(budget - F.col("_s1")))
    out = out.withColumns({"_s2": spent(F.col("_left"), OTHER), "_w2": won(F.col("_left"), OTHER)}).withColumn("_left", budget - F.col("_s1") - F.col("_s2"))
    out = out.withColumns({"_s3": spent(F.col("_left"), DESCRIPTION), "_w3": won(F.col("_left"), DESCRIPTION)})
    out = out.withColumn("new_name", F.when(F.col("_w1"), F.col("_f1.x")).when(F.col("_w2"), F.col("_f2.x"))).withColumn("nfo", F.when(F.col("_w3"), F.col("_f3.x")))
    reached = F.filter("_missed", lambda m: m["_rank"] <= F.when(m["_kind"] == PARITY, F.col("_s1")).when(m["_kind"] == OTHER, F.col("_s2")).otherwise(F.col("_s3")))
    failed = F.coalesce((F.size(reached) > 0) & F.col("new_name").isNull() & F.col("nfo").isNull(), F.lit(False))
    return out.select(
        "guid", "new_name", F.when(F.col("new_name").isNotNull(), N.search_name(F.col("new_name"))).alias("search_name"), F.when(F.col("new_name").isNotNull(), N.categorize(F.col("new_name"))).alias("category_id"), "nfo",
        F.coalesce(N.extract_identifiers(F.col("nfo")), F.array()).cast(IDENTIFIERS).alias("identifiers"), (F.col("_s1") + F.col("_s2") + F.col("_s3")).cast("int").alias("fetched"), failed.alias("failed"), (failed & F.exists(reached, lambda m: m["final"])).alias("permanent"),
    )


class Processed(NamedTuple):
    """What is stored: releases, descriptions (guid, nfo), identifiers (guid, source, identifier), files (guid, file_name, size_bytes)."""

    releases: DataFrame
    nfos: DataFrame
    identifiers: DataFrame
    files: DataFrame


def apply_postprocess(stored: Processed, results: DataFrame) -> Processed:
    """What is stored with B05's ``results`` that didn't fail. A release is done; a recovered name brings its search name and
    category and clears the obfuscated flag; without one, and without a result, they stay as they are. A description replaces an older one;
    identifiers and files (column ``files``, an array of file_name and size_bytes, if there is one) are added unless they are there."""
    good = first_of(results.filter(~F.coalesce("failed", F.lit(False)) & F.col("guid").isNotNull()))
    own = good.select("guid", F.nullif("new_name", F.lit("")).alias("_name"), F.col("search_name").alias("_search"), F.col("category_id").alias("_category"), F.lit(True).alias("_hit"))
    met = stored.releases.join(own, "guid", "left")
    named = F.col("_name").isNotNull()
    put = {"name": F.col("_name"), "search_name": F.col("_search"), "category_id": F.col("_category"), "obfuscated": F.lit(False)}
    new = {c: F.when(named, x).otherwise(F.col(c)).alias(c) for c, x in put.items()} | {"pp_status": F.when(F.col("_hit"), "done").otherwise(F.col("pp_status")).alias("pp_status")}
    releases = met.select(*[new.get(c, F.col(c)) for c in stored.releases.columns])
    known = good.join(stored.releases.select("guid"), "guid", "left_semi")
    nfos = known.filter("nfo IS NOT NULL").select("guid", "nfo")
    nfos = nfos.unionByName(stored.nfos.join(nfos.select("guid"), "guid", "left_anti"))
    found = known.select("guid", F.explode("identifiers").alias("i")).select("guid", N.normalize_identifier(F.col("i.source"), F.col("i.identifier")).alias("i")).filter("i IS NOT NULL").select("guid", "i.source", "i.identifier")
    files = stored.files
    if "files" in good.columns:
        files = files.unionByName(known.select("guid", F.explode("files").alias("f")).select("guid", "f.file_name", "f.size_bytes")).distinct()
    return Processed(releases, nfos, J.merged_identifiers(found, stored.identifiers), files)


def first_of(results: DataFrame) -> DataFrame:
    """One result for each release: the least name, nulls last."""
    order = Window.partitionBy("guid").orderBy(F.col("new_name").asc_nulls_last(), F.col("nfo").asc_nulls_last())
    return results.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def postprocess_pass(stored: Processed, due: DataFrame, segments: DataFrame, bodies: DataFrame, now: Column, budget: int = 4) -> tuple[Processed, DataFrame]:
    """B05, B06 and B07 for what is due: the tables afterwards, and the counts of processed, renamed, described and failed releases."""
    results = J.tables.stored(postprocess_resolve(due, segments, bodies, budget), "resolved")
    out = apply_postprocess(stored, results)
    failures = results.filter("failed").select("guid", F.col("permanent").alias("permanent_failure"), now.alias("at"))
    counts = results.agg(F.count("*").alias("processed"), F.count_if(~F.col("failed") & F.col("new_name").isNotNull()).alias("renamed"), F.count_if(~F.col("failed") & F.col("nfo").isNotNull()).alias("described"), F.count_if("failed").alias("failed"))
    return out._replace(releases=J.record_failure(out.releases, failures)), counts
