"""Article bodies and scan plans (U01, A16, A17, ST01, W13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ids that are numbered together.
RANGE = 1 << 16


def yenc_header_scan(body: Column) -> Column:
    """Struct of ok, part, total, size and name from the =ybegin line in the first 64 KiB."""
    line = F.regexp_extract(F.substring(body.cast("binary"), F.lit(1), F.lit(65536)).cast("string"), r"(?m)^=ybegin ([^\r\n]*)", 1)
    field = lambda k: F.coalesce(F.regexp_extract(line, rf"(?:^| ){k}=(\d+)", 1).try_cast("bigint"), F.lit(0))
    name = F.trim(F.regexp_extract(line, r"name=(.*)$", 1))
    return F.struct((line != "").alias("ok"), field("part").alias("part"), field("total").alias("total"), field("size").alias("size"), name.alias("name"))


def verification_counts(results: DataFrame) -> DataFrame:
    """``results``: ok, total."""
    return results.agg(F.count("*").alias("checked"), F.count_if(F.col("ok") & (F.col("total") <= 1)).alias("standalone"), F.count_if(F.col("ok") & (F.col("total") > 1)).alias("fragment"), F.count_if(~F.col("ok")).alias("failed"))


def overall_status(checks: DataFrame) -> DataFrame:
    """The worst of levels unknown, ok, warn and error."""
    levels = F.array(*map(F.lit, ("unknown", "ok", "warn", "error")))
    return checks.agg(F.max(F.array_position(levels, F.col("level"))).cast("int").alias("p")).select(F.element_at(levels, F.col("p")).alias("status"))


def forward_plan(groups: DataFrame, cap: int, batch: int = 10_000) -> DataFrame:
    """ST01: the article ranges that a pass reads next, for groups with last_high, server_low, server_high and, if it has one, own_cap, which
    overrides the cap of all; 0 is none. Groups with nothing new have no range."""
    start = F.greatest(F.col("last_high") + 1, F.col("server_low"))
    most = F.coalesce("own_cap", F.lit(cap)) if "own_cap" in groups.columns else F.lit(cap)
    rows = groups.withColumn("start", start).withColumn("stop", F.when(most > 0, F.least("server_high", F.col("start") + (most - 1))).otherwise(F.col("server_high")))
    rows = rows.filter("start <= stop").withColumn("begin", F.explode(F.sequence("start", "stop", F.lit(batch).cast("long"))))
    return rows.select("group_id", "begin", F.least(F.col("begin") + (batch - 1), F.col("stop")).alias("end"))


def keyset_batches(parts: DataFrame, n: int) -> DataFrame:
    """Cursors of batches of n parts in order of id. Ids are counted in ranges of RANGE, the counts added up over
    each group's ranges, and ids numbered within their range alone, so no group is ordered in one task."""
    rows = parts.select("group_id", "part_id", F.floor(F.col("part_id") / RANGE).alias("range"))
    counts = rows.groupBy("group_id", "range").agg(F.count("*").alias("n"))
    counts = counts.select("group_id", "range", (F.sum("n").over(Window.partitionBy("group_id").orderBy("range")) - F.col("n")).alias("before"))
    w = Window.partitionBy("group_id", "range").orderBy("part_id")
    rows = rows.withColumn("k", F.row_number().over(w)).join(counts, ["group_id", "range"]).withColumn("k", F.col("k") + F.col("before"))
    return rows.filter(F.col("k") % n == 0).select("group_id", F.col("part_id").alias("cursor"))
