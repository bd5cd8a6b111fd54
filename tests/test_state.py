import datetime as dt
import random

from heddle.operators import state as S

START = dt.datetime(2026, 1, 1)


def log(spark, n=6000):
    """Half of the rows are of one key."""
    draw = random.Random(1)
    rows = [(draw.choice([0, 0, 0, 1, 2, None]), START + dt.timedelta(seconds=draw.randrange(40 * n)), i, draw.random() < 0.6) for i in range(n)]
    rows += [(7, START, n, True), (7, START, n + 1, True), (8, START, n + 2, True), (9, START, n + 3, False), (9, START, n + 4, True), (9, START, n + 5, True), (9, START, n + 6, True)]
    df = spark.createDataFrame(rows, "key long, ts timestamp_ntz, event_id long, failed boolean").repartition(5)
    by = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        by.setdefault(r[0], []).append(r)
    return df, by


def gathers(df):
    return "collect_list" in df._jdf.queryExecution().toString()


def test_retry_state(spark):
    df, by = log(spark)
    want = set()
    for k, h in by.items():
        n, retry = 0, None
        for _, ts, _, failed in h:
            n = n + 1 if failed else 0
            retry = ts + dt.timedelta(seconds=300 * 2 ** (n - 1)) if 0 < n < 3 else None
        want.add((k, n, retry, n >= 3))
    out = S.retry_state(df)
    assert {tuple(r) for r in out.collect()} == want and out.count() == len(want)
    assert not gathers(out)


def test_windows(spark):
    df, by = log(spark)
    accepted, allowed = set(), set()
    for k, h in by.items():
        last = first = None
        n = 0
        for _, ts, e, _ in h:
            ok = last is None or (ts - last).total_seconds() > 300
            last = ts if ok else last
            accepted.add((k, e, ok))
            first, n = (ts, 1) if first is None or (ts - first).total_seconds() > 900 else (first, n + 1)
            allowed.add((k, e, n <= 2, max(2 - n, 0), first + dt.timedelta(seconds=900)))
    one, two = S.dedup_window(df.withColumnRenamed("key", "id")), S.rate_limit(df, 900, 2)
    assert {tuple(r) for r in one.collect()} == accepted and {tuple(r) for r in two.collect()} == allowed
    assert one.columns == ["id", "event_id", "accepted"] and two.columns == ["key", "event_id", "allowed", "remaining", "reset"]
    assert not gathers(one) and not gathers(two)


def test_ends_of_windows_and_no_limit(spark):
    at = lambda x: START + dt.timedelta(seconds=x)
    df = spark.createDataFrame([(1, at(t), i) for i, t in enumerate((0, 300, 300.25, 600.25, 600.26))], "key long, ts timestamp_ntz, event_id long")
    assert {(r.event_id, r.accepted) for r in S.dedup_window(df.withColumnRenamed("key", "id"), 300).collect()} == {(0, True), (1, False), (2, True), (3, False), (4, True)}
    assert {(r.event_id, r.allowed, r.reset) for r in S.rate_limit(df, 300, 1).collect()} == {(0, True, at(300)), (1, False, at(300)), (2, True, at(600.25)), (3, False, at(600.25)), (4, True, at(900.26))}
    assert {(r.allowed, r.remaining, r.reset) for r in S.rate_limit(df, 300, 0).collect()} == {(True, -1, None)}


def test_health_by_the_exact_age(spark):
    now = dt.datetime(2026, 1, 2, 12)
    rows = [(1, True, 0, 0, 0, now - dt.timedelta(minutes=1439.6)), (2, True, 0, 0, 0, now - dt.timedelta(minutes=1440)), (3, True, 0, 0, 0, now - dt.timedelta(minutes=359.9)), (4, True, 0, 0, 5, None), (5, True, 0, 0, 0, None), (6, False, 9, 0, 9, None)]
    df = spark.createDataFrame(rows, "group_id long, active boolean, server_high long, last_scanned_high long, consecutive_failures long, last_success_at timestamp_ntz")
    got = {r.group_id: (r.level, r.reasons) for r in S.classify_group_health(df, S.F.lit(now.isoformat(" ")).cast("timestamp")).collect()}
    assert got == {1: ("warn", "no success in 24h0m0s"), 2: ("error", "no success in 24h0m0s"), 3: ("ok", ""), 4: ("error", "5 consecutive failures"), 5: ("unknown", "never scanned successfully"), 6: ("unknown", "group inactive")}


def test_a_hot_key_spreads_and_null_times_and_repeats_count(spark):
    """Two thirds of the events are of one key, many at the same moment, some rows repeat."""
    draw = random.Random(4)
    rows = [("hot" if draw.random() < 0.7 else draw.choice(["a", None, "b"]), None if draw.random() < 0.02 else START + dt.timedelta(seconds=draw.choice([draw.randrange(4000), draw.randrange(400_000)])), draw.randrange(2000)) for _ in range(3000)]
    rows += rows[:40]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, event_id long").repartition(4)
    want, taken = [], []
    for key in {r[0] for r in rows}:
        first = last = None
        n = 0
        for _, ts, e in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or START, r[2])):
            if ts is None:
                want.append((key, e, True, 1, None))
                taken.append((key, e, True))
                continue
            first, n = (ts, 1) if first is None or ts - first > dt.timedelta(seconds=500) else (first, n + 1)
            want.append((key, e, n <= 2, max(2 - n, 0), first + dt.timedelta(seconds=500)))
            ok = last is None or ts - last > dt.timedelta(seconds=500)
            last = ts if ok else last
            taken.append((key, e, ok))
    assert sorted(map(str, map(tuple, S.rate_limit(df, 500, 2).collect()))) == sorted(map(str, want))
    assert sorted(map(str, map(tuple, S.dedup_window(df.withColumnRenamed("key", "id"), 500).collect()))) == sorted(map(str, taken))
    assert S.dedup_window(df.withColumnRenamed("key", "id").filter("false")).count() == 0 == S.rate_limit(df.filter("false"), 5, 1).count()
