import datetime as dt
import os
import random

import pytest
from heddle.operators import assembly as A
from heddle.streaming import ingest as I
from heddle.streaming.deltas import Deltas, covering
from pyspark.sql import functions as F

HEADERS = "group_id long, article_number long, message_id string, subject string"
PARTS = "part_id long, group_id long, message_id string, poster string, collection_key string, file_number int, collection_files int, norm_subject string, total_parts int, bytes long, posted_at timestamp_ntz"


@pytest.fixture
def sf_small(tmp_path):
    """The smallest tables under a path of their own, so that nothing is kept from other tests."""
    os.symlink("/root/testdata/sf0.001", tmp_path / "sf")
    return str(tmp_path / "sf")


def feed(spark, path, batches, schema):
    """A file for each batch, oldest first."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        for f in os.listdir(path):
            full = os.path.join(path, f)
            if os.stat(full).st_mtime > 1_600_000_000:
                os.utime(full, (1_500_000_000 + 10 * i,) * 2)


def test_ingest_keeps_no_state_and_survives_a_restart(spark, tmp_path):
    draw, path, out = random.Random(2), str(tmp_path / "in"), str(tmp_path / "out")
    rows = [[(draw.choice([1, 2, None]), draw.choice([5, 6, I.RANGE + 5, 3 * I.RANGE, None, draw.randrange(50)]), f"m{b}.{i}", None) for i in range(30)] for b in range(6)]
    feed(spark, path, rows[:4], HEADERS)
    like = spark.createDataFrame([], HEADERS)
    I.stream_ingest(path, like, out, files=1)
    before = {(f, os.stat(os.path.join(d, f)).st_mtime_ns) for d, _, fs in os.walk(out) for f in fs if f.startswith("part-")}
    feed(spark, path, rows[4:], HEADERS)
    got = I.stream_ingest(path, like, out, files=1)
    want, seen = set(), set()
    for batch in rows:
        first = {}
        for r in batch:
            first.setdefault(r[:2], []).append(r)
        want |= {min(x, key=lambda r: r[2]) for k, x in first.items() if k not in seen or None in k}  # null keys never equal
        seen |= set(first)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert before <= {(f, os.stat(os.path.join(d, f)).st_mtime_ns) for d, _, fs in os.walk(out) for f in fs if f.startswith("part-")}
    assert not os.path.exists(f"{out}-state/state")  # Spark keeps no rows
    again = I.stored_headers(like, out).filter("range = 3")
    assert "PartitionFilters: [isnotnull(range" in again._jdf.queryExecution().executedPlan().toString()


def test_which_deltas_hold_a_number_of_batches():
    for fan in (2, 3, 8):
        for n in range(200):
            spans = []
            for level, number in covering(n, fan):
                spans += range(number * fan**level, (number + 1) * fan**level)
            assert spans == list(range(n)) and len(covering(n, fan)) <= fan * 8


def test_deltas_are_compacted_and_replaced(spark, tmp_path):
    merge = lambda df: df.groupBy("k").agg(F.sum("n").alias("n"))
    d = Deltas(spark, str(tmp_path / "d"), spark.createDataFrame([], "k string, n long").schema, merge, fan=3)
    assert d.read().count() == 0 and d.committed() == 0
    total = 0
    for i in range(20):
        for value in (99, i) if i in (2, 8, 9, 17) else (i,):  # run again with the right rows
            d.add(spark.createDataFrame([("a", value), ("b", 1)], "k string, n long"), i)
        total += i
        assert {r.k: r.n for r in merge(d.read()).collect()} == {"a": total, "b": i + 1}
        assert len(d.tables()) <= 6 and d.committed() == i + 1
    kept = sum(len(os.listdir(tmp_path / "d" / f)) for f in os.listdir(tmp_path / "d"))
    assert kept < 16


def parts(rows):
    return [(i, 1, f"m{i}", "p", key, f, total, "" if key else f"s{single}", 0 if key else total, 10, at) for i, (key, single, f, total, at) in enumerate(rows)]


def test_assembly_over_batches_equals_the_batch_form(spark, tmp_path):
    draw = random.Random(5)
    rows = parts([(draw.choice(["k/3", "b:x", ""]), draw.randrange(4), draw.randint(1, 4), draw.choice([0, 3]), dt.datetime(2025, 1, 1) + dt.timedelta(hours=draw.randrange(99))) for _ in range(120)])
    path, like = str(tmp_path / "in"), spark.createDataFrame([], PARTS)
    feed(spark, path, [rows[i::12] for i in range(12)], PARTS)
    got, want = I.stream_assemble(path, like, str(tmp_path / "out"), files=1), A.binaries(spark.createDataFrame(rows, PARTS))
    columns = sorted(want.columns)
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))


@pytest.mark.parametrize("restart", [False, True])
def test_idle_binaries_without_another_article(spark, tmp_path, restart):
    at = lambda h: dt.datetime(2025, 1, 1) + dt.timedelta(hours=h)
    batches = [
        [("b:quiet", 0, 1, 0, at(0)), ("b:quiet", 0, 2, 0, at(1)), ("", 1, 0, 3, at(0)), ("k/2", 0, 1, 2, at(1)), ("k/2", 0, 2, 2, at(2)), ("r/9", 0, 1, 9, at(0)), ("b:busy", 0, 1, 0, at(2))],
        [("b:busy", 0, 2, 0, at(6)), ("", 2, 0, 3, at(7))],
        [("b:busy", 0, 3, 0, at(12)), ("", 3, 0, 1, at(30))],
        [("b:later", 0, 1, 0, at(60)), ("b:quiet", 0, 3, 0, at(61))],
    ]
    path, out, like = str(tmp_path / "in"), str(tmp_path / "out"), spark.createDataFrame([], PARTS)
    flat = [r for b in batches for r in b]
    rows, cut = parts(flat), [sum(map(len, batches[:i])) for i in range(5)]
    groups = [rows[cut[i] : cut[i + 1]] for i in range(4)]
    ids = {(r["collection_key"] or r["norm_subject"]): r["binary_id"] for r in A.link_parts(spark.createDataFrame(rows, PARTS)).collect()}
    released = spark.createDataFrame([(ids["r/9"],)], "binary_id string")
    run = lambda: I.stream_idle(path, like, released, "10 hours", "24 hours", out, files=1)
    feed(spark, path, groups[: 2 if restart else 4], PARTS)
    got = run()
    if restart:
        feed(spark, path, groups[2:], PARTS)
        got = run()
    found = sorted((r.event, r.binary_id, r.idle_since, r.parts, r.files) for r in got.collect())
    # By hour 61-10 the sessions that ended before are closed; b:later and b:quiet's second one are open.
    want = [("settled", ids["b:quiet"], at(1), 2, 2), ("settled", ids["b:busy"], at(12), 3, 3), ("aged_out", ids["b:quiet"], at(1), 2, 2), ("aged_out", ids["b:busy"], at(12), 3, 3), ("aged_out", ids["s1"], at(0), 1, 1), ("aged_out", ids["s2"], at(7), 1, 1)]
    assert found == sorted(want)


def test_idle_of_nothing(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    assert I.stream_idle(str(tmp_path / "in"), spark.createDataFrame([], PARTS), spark.createDataFrame([], "binary_id string"), "1 hour", "1 day", str(tmp_path / "out")).collect() == []


def test_idle_holds_sessions_outside_the_heap_and_runs_the_events_that_are_asked_for(spark, tmp_path):
    at = lambda h: dt.datetime(2025, 1, 1) + dt.timedelta(hours=h)
    path, like, none = str(tmp_path / "in"), spark.createDataFrame([], PARTS), spark.createDataFrame([], "binary_id string")
    feed(spark, path, [parts([("b:quiet", 0, 1, 0, at(0)), ("", 1, 0, 3, at(0)), ("b:later", 0, 1, 0, at(60))])], PARTS)
    names = [f"spark.sql.streaming.stateStore.{k}" for k in I.SESSION_STATE]
    before = [spark.conf.get(k, None) for k in names]
    run = lambda out, **more: sorted(map(str, I.stream_idle(path, like, none, "10 hours", "24 hours", str(tmp_path / out), **more).filter("event = 'aged_out'").collect()))
    one = run("one", events=("aged_out",))
    assert len(one) == 2 and one == run("both")
    assert not os.path.exists(tmp_path / "one-state-settled") and os.path.exists(tmp_path / "both-state-settled")
    assert [spark.conf.get(k, None) for k in names] == before
    kept = [f for _, _, fs in os.walk(tmp_path / "one-state-aged_out" / "state") for f in fs]
    assert any(f.endswith(".changelog") for f in kept) and not any(f.endswith(".delta") for f in kept)  # .delta: of the store in the heap


def test_idle_streams_read_the_stored_parts(spark, sf_small, monkeypatch):
    from heddle.plans import catalogue as C
    from heddle.plans import catalogue_jobs as J
    from heddle.plans import registry  # noqa: F401
    from heddle.sources.tables import folder

    calls, real = [], I.stream_idle
    monkeypatch.setattr(I, "stream_idle", lambda path, *a, **b: calls.append((path, b["events"])) or real(path, *a, **b))
    J.idle(spark, sf_small, "aged_out")
    assert calls == [(folder(C.parts(spark, sf_small)), ("aged_out",))]


def test_feeds_have_more_files_the_larger_they_are():
    from heddle.plans import registry  # noqa: F401
    from heddle.plans import catalogue_jobs as C

    assert C.files(10) == 16 and C.files(10, 4) == 4 and C.files(40 * C.FILE_ROWS + 1) == 41
