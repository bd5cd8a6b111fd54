"""Folds of logs: group state, retries, windows, circuits (A10-A13, A07, ST08-ST14, B08, B20-B21).

No key's history is gathered or folded in one task: folds that maxima and counts can express are aggregates, windows that
start one after the other are chains whose links are doubled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import tables


def throughput_ema(passes: DataFrame, weight: float = 0.3) -> DataFrame:
    """A10: moving average of articles a second over successful passes, the first one seeding it.
    s_n = w x_n + (1-w) s_(n-1) is a sum of x_i (1-w)^(n-i), so it needs ranks, not a fold; terms
    that are 200 passes old are below double precision."""
    sample = F.col("articles") / (F.col("duration_ms") / 1000.0)
    good = passes.filter("err = '' AND articles > 0 AND duration_ms > 0").select("group_id", "ts", "event_id", sample.alias("x"))
    w = Window.partitionBy("group_id").orderBy(F.desc("ts"), F.desc("event_id"))
    n = good.withColumn("age", F.row_number().over(w) - 1).filter("age < 400")  # a limited rank: each task keeps so many of a group
    n = n.join(good.groupBy("group_id").agg(F.min(F.struct("ts", "event_id")).alias("seed")), "group_id")
    keep = 1.0 - weight
    term = F.col("x") * F.pow(F.lit(keep), F.col("age")) * F.when(F.struct("ts", "event_id") == F.col("seed"), 1.0).otherwise(weight)
    return n.groupBy("group_id").agg(F.sum(term).alias("ema"))


def group_state(passes: DataFrame) -> DataFrame:
    """A11, A12, ST13: failures since the last success, times of the last successes, the last error if
    the last pass failed, the last positive head. Maxima only, so no order within a group is needed."""
    ok = F.col("err") == ""
    at = F.struct("ts", "event_id")
    g = passes.groupBy("group_id").agg(
        F.max(F.when(ok, at)).alias("good"), F.max(at).alias("last"), F.max_by("err", at).alias("last_error"),
        F.max(F.when(ok & ~F.col("backfill"), F.col("ts"))).alias("last_forward_at"), F.max(F.when(ok & F.col("backfill"), F.col("ts"))).alias("last_backfill_at"),
        F.max_by(F.when(F.col("server_high") > 0, F.col("server_high")), F.when(F.col("server_high") > 0, at)).alias("server_high"),
    )
    later = passes.join(g.select("group_id", "good"), "group_id").filter((F.col("err") != "") & (F.col("good").isNull() | (at > F.col("good"))))
    return g.join(later.groupBy("group_id").agg(F.count("*").alias("consecutive_failures")), "group_id", "left").select(
        "group_id", F.coalesce("consecutive_failures", F.lit(0)).alias("consecutive_failures"), F.col("good.ts").alias("last_success_at"), "last_forward_at", "last_backfill_at", "last_error", "server_high"
    )


def classify_group_health(groups: DataFrame, now: Column) -> DataFrame:
    """Level, reasons and lag of groups (active, server_high, last_scanned_high,
    consecutive_failures, last_success_at)."""
    lag = F.when(F.col("server_high") > 0, F.greatest(F.col("server_high") - F.col("last_scanned_high"), F.lit(0))).otherwise(0)
    age = (F.unix_micros(now) - F.unix_micros(F.col("last_success_at").cast("timestamp"))) / 60_000_000  # in minutes
    whole = F.round("age").cast("long")
    hours, rest = F.floor(whole / 60), whole % 60
    span = F.when(whole == 0, "0s").otherwise(F.concat(F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h"))).otherwise(""), rest.cast("string"), F.lit("m0s")))
    fails = F.col("consecutive_failures")
    by_fail = F.when(fails >= 5, 3).when(fails >= 1, 2).otherwise(1)
    by_lag = F.when(F.col("lag") >= 500_000, 3).when(F.col("lag") >= 50_000, 2).otherwise(1)
    by_age = F.when(F.col("age") >= 1440, 3).when(F.col("age") >= 360, 2).otherwise(1)
    base = F.greatest(by_fail, by_lag)
    never = F.col("last_success_at").isNull()
    rank = F.when(~F.col("active"), 0).when(never, F.when(base == 1, 0).otherwise(base)).otherwise(F.greatest(base, by_age))
    reasons = F.when(~F.col("active"), F.array(F.lit("group inactive"))).otherwise(
        F.array_compact(F.array(F.when(by_fail > 1, F.concat(fails.cast("string"), F.lit(" consecutive failures"))), F.when(by_lag > 1, F.concat(F.col("lag").cast("string"), F.lit(" articles behind"))), F.when(never & (base == 1), "never scanned successfully").when(~never & (by_age > 1), F.concat(F.lit("no success in "), span))))
    )
    out = groups.withColumn("lag", lag).withColumn("age", age)
    return out.select("group_id", F.element_at(F.array(*map(F.lit, ("unknown", "ok", "warn", "error"))), rank + 1).alias("level"), F.array_join(reasons, "; ").alias("reasons"), "lag")


def group_health_stats(groups: DataFrame, now: Column) -> DataFrame:
    """One row over the active groups; zeros without any."""
    lag = F.when(F.col("server_high") > 0, F.greatest(F.col("server_high") - F.col("last_scanned_high"), F.lit(0)))
    age = (F.unix_micros(now) - F.unix_micros(F.col("last_success_at").cast("timestamp"))) / 1_000_000
    zero = lambda c: F.coalesce(c, F.lit(0))
    return groups.filter("active").agg(
        F.count("*").alias("active"), F.count_if(lag > 0).alias("behind"), zero(F.max(lag)).alias("max_lag"), zero(F.sum(lag)).alias("total_lag"), F.count_if(F.col("consecutive_failures") > 0).alias("failing"),
        zero(F.max("consecutive_failures")).alias("max_failures"), F.coalesce(F.max(age), F.lit(0.0)).alias("oldest_success_seconds"), F.count_if(F.col("last_success_at").isNull()).alias("never_scanned"),
    )


def project_capacity(stats: DataFrame, retention_days: int, horizons: list[int]) -> DataFrame:
    """Stats has db_bytes, rate (articles a second) and bytes_per."""
    daily = F.col("rate") * 86400 * F.col("bytes_per")
    rows = stats.withColumn("days", F.explode(F.array(*map(F.lit, horizons))))
    return rows.select("days", (daily * F.col("days")).cast("long").alias("growth_bytes"), (F.col("db_bytes") + (daily * F.col("days")).cast("long")).alias("projected_bytes"), (daily * retention_days).cast("long").alias("retained_bytes"))


def pp_backoff_seconds(attempts: Column) -> Column:
    """Five minutes, doubled with each attempt, at most six hours."""
    return F.least(F.lit(300) * F.pow(F.lit(2), F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(20))), F.lit(21600)).cast("long")


def retry_state(log: DataFrame) -> DataFrame:
    """ST08: attempts, next retry and permanence after a log of (key, ts, event_id, failed); success resets.
    Only the failures since the last success count, and the last of them."""
    at, failed = F.struct("ts", "event_id"), F.coalesce("failed", F.lit(False))
    good = log.groupBy(F.col("key").alias("of")).agg(F.max(F.when(~failed, at)).alias("good"))
    later = log.filter(failed).join(good, F.col("key").eqNullSafe(F.col("of"))).filter(F.col("good").isNull() | (at > F.col("good")))
    fails = later.groupBy(F.col("key").alias("failing")).agg(F.count("*").cast("int").alias("attempts"), F.max_by("ts", at).alias("ts"))
    n = F.coalesce("attempts", F.lit(0))
    retry = F.when((n > 0) & (n < 3), F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp")) + pp_backoff_seconds(n)).cast("timestamp_ntz"))
    return good.join(fails, F.col("of").eqNullSafe(F.col("failing")), "left").select(F.col("of").alias("key"), n.alias("attempts"), retry.alias("next_retry"), (n >= 3).alias("permanent"))


def _written(log: DataFrame, key: str) -> DataFrame:
    """key, ts, event_id and the row's own number, written once: rows are named by it and read several times."""
    return tables.stored(log.select(F.col(key).alias("key"), "ts", "event_id").withColumn("row", F.monotonically_increasing_id()), "log")


def window_starts(log: DataFrame, seconds: int) -> DataFrame:
    """(key, start): for each key its first event, and after each start the first event more than ``seconds`` later, in microseconds.

    A key's starts are a chain through its events: each has one successor. Links are doubled (2, 4, 8, ... steps) until none is left, and
    the chain is then collected from the longest links down, so a key of any number of events takes as many rounds as its chain has binary
    digits, each an equi-join on key and time that spreads over all tasks. Successors are looked for within slots of time as long as
    the window: behind an event's window the rest of that slot, or else the first event of the key's next slot that has any."""
    wide = max(seconds, 0) * 1_000_000 + 1  # in whole microseconds "more than" is "at least one more"
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    nodes = tables.stored(log.filter("ts IS NOT NULL").select("key", at.alias("t")).distinct(), "nodes")
    slot = lambda t: F.floor(t / wide).cast("long")
    slots = nodes.groupBy("key", slot(F.col("t")).alias("slot")).agg(F.min("t").alias("first"))
    in_order = Window.partitionBy("key").orderBy("slot")  # a row for each slot with events
    slots = slots.select(F.col("key").alias("k"), F.col("slot").alias("s"), F.lead("first").over(in_order).alias("next"), F.lead("first", 2).over(in_order).alias("after"))
    asks = nodes.select("key", (F.col("t") + wide).alias("due"), "t", F.lit(1).alias("asking"))
    both = asks.unionByName(nodes.select("key", F.col("t").alias("due"), F.lit(None).cast("long").alias("t"), F.lit(0).alias("asking"))).withColumn("slot", slot(F.col("due")))
    # Behind a question the nearest event of the same slot: the last one seen when the slot is read backwards.
    back = Window.partitionBy("key", "slot").orderBy(F.desc("due"), "asking").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("near", F.last(F.when(F.col("asking") == 0, F.col("due")), ignorenulls=True).over(back)).filter("asking = 1")
    # Without one the first event of the next slot that has any: the slot in question may have only earlier ones.
    far = near.filter("near IS NULL").join(slots, F.col("key").eqNullSafe(F.col("k")) & (F.col("slot") - 1 == F.col("s")))
    far = far.select("key", "t", F.when(slot(F.col("next")) > F.col("slot"), F.col("next")).otherwise(F.col("after")).alias("to")).filter("to IS NOT NULL")
    links = near.filter("near IS NOT NULL").select("key", "t", F.col("near").alias("to")).unionByName(far)
    doubled = [tables.stored(links, "links")]
    while doubled[-1].limit(1).count():
        one, two = doubled[-1], doubled[-1].select(F.col("key").alias("k"), F.col("t").alias("via"), F.col("to").alias("end"))
        doubled.append(tables.stored(one.join(two, F.col("key").eqNullSafe(F.col("k")) & (F.col("to") == F.col("via"))).select("key", "t", F.col("end").alias("to")), "links"))
    found = nodes.groupBy("key").agg(F.min("t").alias("start"))
    for jump in reversed(doubled[:-1]):
        more = found.join(jump.select(F.col("key").alias("k"), "t", "to"), F.col("key").eqNullSafe(F.col("k")) & (F.col("start") == F.col("t"))).select("key", F.col("to").alias("start"))
        found = tables.stored(found.unionByName(more), "starts")
    return found


def dedup_window(log: DataFrame, seconds: int = 300) -> DataFrame:
    """ST09: notifications (id, ts, event_id), each accepted unless its id was accepted in the last ``seconds``, their end included. Of
    several at one time the one with the least event_id is first; without a time each is accepted and doesn't count. A null id is one too."""
    rows = _written(log, "id")
    starts = window_starts(rows, seconds)
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    first = rows.filter("ts IS NOT NULL").groupBy(F.col("key").alias("k"), t.alias("start")).agg(F.min(F.struct("event_id", "row"))["row"].alias("row"))
    taken = first.join(starts, F.col("k").eqNullSafe(F.col("key")) & (first["start"] == starts["start"]), "left_semi").select("row", F.lit(True).alias("hit"))
    return rows.join(taken, "row", "left").select(F.col("key").alias("id"), "event_id", (F.coalesce("hit", F.lit(False)) | F.col("ts").isNull()).alias("accepted"))


def rate_limit(log: DataFrame, seconds: int, limit: int) -> DataFrame:
    """ST10: requests (key, ts, event_id): a window starts with a key's first request after the last one's
    reset; the first ``limit`` of each are allowed, by time and event_id. No limit (0 or less): all are, -1 remain, no reset. A request
    without a time is a window by itself, without a reset.

    Only the first ``limit`` of a window are ranked, which Spark prunes before it moves rows; the others are told by the last of these."""
    if limit <= 0:
        return log.select("key", "event_id", F.lit(True).alias("allowed"), F.lit(-1).alias("remaining"), F.lit(None).cast("timestamp_ntz").alias("reset"))
    rows, wide = _written(log, "key"), seconds * 1_000_000
    starts = window_starts(rows, seconds)
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    slot = lambda c: F.floor(c / (wide + 1)).cast("long")
    # A window ends in the slot in which it starts or in the next, and no two of a key overlap.
    cover = starts.select(F.col("key").alias("k"), "start", F.explode(F.array(slot(F.col("start")), slot(F.col("start")) + 1)).alias("s"))
    timed = rows.filter("ts IS NOT NULL").withColumn("t", t)
    met = timed.join(cover, F.col("key").eqNullSafe(F.col("k")) & (slot(F.col("t")) == F.col("s")) & F.col("t").between(F.col("start"), F.col("start") + wide)).select("key", "event_id", "row", "t", "start")
    met = tables.stored(met, "windows")
    order = Window.partitionBy("key", "start").orderBy("t", "event_id", "row")
    early = tables.stored(met.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit), "early")
    last = early.filter(F.col("n") == limit).select(F.col("key").alias("k"), F.col("start").alias("b"), F.struct("t", "event_id", "row").alias("last"))
    late = met.join(last, F.col("key").eqNullSafe(F.col("k")) & (F.col("start") == F.col("b"))).filter(F.struct("t", "event_id", "row") > F.col("last"))
    reset = F.timestamp_micros(F.col("start") + wide).cast("timestamp_ntz").alias("reset")
    out = early.select("key", "event_id", F.lit(True).alias("allowed"), (F.lit(limit) - F.col("n")).cast("int").alias("remaining"), reset)
    out = out.unionByName(late.select("key", "event_id", F.lit(False).alias("allowed"), F.lit(0).alias("remaining"), reset))
    return out.unionByName(rows.filter("ts IS NULL").select("key", "event_id", F.lit(True).alias("allowed"), F.lit(limit - 1).alias("remaining"), F.lit(None).cast("timestamp_ntz").alias("reset")))


def backlog_cadence(passes: DataFrame, least: int, configured: int) -> DataFrame:
    """ST14: seconds to the next pass: the configured ones, or fewer after a pass that brought articles."""
    return passes.select("event_id", F.least(F.when(F.col("articles") > 0, F.lit(least)).otherwise(F.lit(configured)), F.lit(configured)).alias("interval"))
