"""The verification loop over ambiguous parts (P03, B10, A17), and what it finds about releases that exist.

Parts carry yenc_attempts (null or absent: none yet) and yenc_version, the number of the last pass that changed them. A merge
changes only rows that results name, adds to what is stored, and skips rows of its own pass or a later one, so a pass
that is run again changes nothing. A part's several results in one pass count together: failures add up, and of good
ones the one with the most segments, then the greatest part and name, holds. Null ok is a failure, a null name an empty one.
Results of unknown parts are left out; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.monthly import MONTH, Monthly
from ..sources.tables import stored
from . import assembly as A
from . import bodies as Y

MOST_ATTEMPTS = 5
COUNTERS = {"yenc_attempts": "int", "yenc_version": "long"}


def with_counters(parts: DataFrame) -> DataFrame:
    return parts.withColumns({c: (F.coalesce(F.col(c).cast(kind), F.lit(0).cast(kind)) if c in parts.columns else F.lit(0).cast(kind)) for c, kind in COUNTERS.items()})


def outcomes(results: DataFrame, key: str) -> DataFrame:
    """A row for each key: fails, and the best good result (null: none) as struct total, part, file."""
    ok = F.coalesce("ok", F.lit(False))
    good = F.struct(F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("file", F.lit("")).alias("file"))
    return results.groupBy(key).agg(F.count_if(~ok).cast("int").alias("fails"), F.max(F.when(ok, good)).alias("good"))


def yenc_key(good: Column) -> Column:
    return F.concat(F.lit("yenc:"), good["file"], F.lit("/"), good["total"].cast("string"))


def verify_parts(parts: DataFrame, checks: DataFrame, version: int = 1) -> DataFrame:
    """``parts`` with ``checks`` of bodies (part_id, ok, total, part, file) merged in as pass ``version``. Failures add to the
    attempts; a lone article becomes a binary of one part; a fragment gets key, number and count of its collection."""
    own = {"fails": "_fails", "good": "_good"}
    met = with_counters(parts).join(outcomes(checks, "part_id").withColumnsRenamed(own), "part_id", "left")
    hit = F.col("_fails").isNotNull() & (F.col("yenc_version") < version)
    good, fragment = F.col("_good"), F.col("_good.total") > 1
    put = lambda when, new, column: F.when(hit & good.isNotNull() & when, new).otherwise(F.col(column)).cast(parts.schema[column].dataType).alias(column)
    new = {
        "yenc_attempts": F.when(hit, F.col("yenc_attempts") + F.col("_fails")).otherwise(F.col("yenc_attempts")).alias("yenc_attempts"),
        "yenc_version": F.when(hit, F.lit(version).cast("long")).otherwise(F.col("yenc_version")).alias("yenc_version"),
        "total_parts": put(~fragment, F.lit(1), "total_parts"),
        "collection_key": put(fragment, yenc_key(good), "collection_key"),
        "file_number": put(fragment, good["part"], "file_number"),
        "collection_files": put(fragment, good["total"], "collection_files"),
    }
    columns = [*parts.columns, *[c for c in COUNTERS if c not in parts.columns]]
    return met.select(*[new.get(c, F.col(c)) for c in columns])


def due(parts: DataFrame, most_attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """P03 as a queue: ambiguous parts that haven't been tried too often."""
    return A.ambiguous_parts(with_counters(parts), most_attempts=most_attempts)


def checked(parts: DataFrame, bodies: DataFrame) -> DataFrame:
    """U01 for parts: part_id, ok, total, part and file of their ``bodies`` (message_id, body); one that is null or missing failed."""
    scan = Y.yenc_header_scan(F.col("body"))
    rows = parts.select("part_id", "message_id").join(bodies.select("message_id", "body"), "message_id", "left").select("part_id", scan.alias("y"))
    return rows.select("part_id", F.coalesce("y.ok", F.lit(False)).alias("ok"), "y.total", "y.part", F.col("y.name").alias("file"))


def verification_pass(table: Monthly, bodies: DataFrame, version: int) -> DataFrame:
    """One pass over the stored parts, which must carry COUNTERS: what is due (P03) meets its bodies, the results are merged
    into the months that hold any, and counted (A17). Its output is the next pass's input."""
    waiting = due(table.rows()).filter(F.col("yenc_version") < version)
    found = stored(checked(waiting, bodies), "checks")
    months = [r[0] for r in waiting.select(MONTH).distinct().collect()]  # a row for each month
    rows = with_counters(table.read(months))
    wait = F.coalesce((F.col("collection_key") == "") & (F.col("total_parts") == 0) & (F.col("yenc_attempts") < MOST_ATTEMPTS) & (F.col("yenc_version") < version), F.lit(False))
    # Results are only of what was due, so the others, most of the parts, aren't joined, nor moved.
    table.amend(verify_parts(rows.filter(wait), found, version), rows.filter(~wait))
    return Y.verification_counts(found)


def repair_releases(releases: DataFrame, bins: DataFrame, parts: DataFrame, files: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What stays of releases, binaries, parts and release files (guid, ...) after ``results`` (guid, binary_id, part_id, ok, total,
    part, file). Standalone: the release is verified. Fragment: release, files and binary go, and its part waits under the
    collection it belongs to. Not ok: nothing changes. Results of one release count together, as above: a fragment outdoes a standalone."""
    good = outcomes(results.withColumn("_of", F.struct("guid", "binary_id")), "_of").filter("good IS NOT NULL").select("_of.guid", "_of.binary_id", "good")
    good = stored(good, "repairs")
    alone, piece = good.filter("good.total <= 1"), good.filter("good.total > 1")
    left = releases.join(piece.select("guid"), "guid", "left_anti").join(alone.select("guid", F.lit(True).alias("_now")).distinct(), "guid", "left")
    left = left.withColumn("verified", F.col("verified") | F.coalesce("_now", F.lit(False))).drop("_now")
    moved = outcomes(results.join(piece.select("guid"), "guid", "left_semi").filter("part_id <> 0"), "part_id").filter("good.total > 1").select("part_id", F.col("good").alias("_good"))
    met = parts.join(moved, "part_id", "left")
    put = lambda c, new: F.coalesce(new, c).cast(parts.schema[c].dataType).alias(c)
    fields = {"collection_key": yenc_key(F.col("_good")), "file_number": F.col("_good.part"), "collection_files": F.col("_good.total")}
    reset = met.select(*[put(c, fields[c]) if c in fields else F.col(c) for c in parts.columns])
    return left, bins.join(piece.select("binary_id"), "binary_id", "left_anti"), reset, files.join(piece.select("guid"), "guid", "left_anti")
