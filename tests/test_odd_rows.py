"""Nulls, empty tables, ties, repeated rows and clashing names in the core operators."""

import datetime as dt

from heddle.operators import assembly as A
from heddle.operators import jobs as J
from heddle.operators import search as Q
from heddle.sources.tables import stored
from pyspark.sql import functions as F

AT = dt.datetime(2025, 1, 1)
HEADERS = "group_id long, article_number long, message_id string, poster string, posted_at timestamp_ntz, bytes long, subject string, at string, _n string, _r string"
ROWS = [
    (1, 10, "m2", "p", AT, 5, '"a.mkv" yEnc (1/2)', "x", "y", "z"), (1, 10, "m1", "p", AT, 5, '"a.mkv" yEnc (1/2)', "x", "y", "z"), (1, 10, "m1", "p", AT, 5, '"a.mkv" yEnc (1/2)', "x", "y", "z"),
    (1, 11, "m3", "p", None, None, '"a.mkv" yEnc (2/2)', None, None, None), (None, None, "m4", None, AT, 1, None, "x", None, "z"), (None, None, "m5", None, AT, 1, "b", "x", None, "z"), (2, 12, None, "p", AT, 1, "c", "", "", ""), (2, 13, "", "p", AT, 1, "c", "", "", ""),
]


def test_from_headers_to_releases(spark):
    df = spark.createDataFrame(ROWS, HEADERS).repartition(3)
    parts = stored(A.ingest_parts(df), "parts")
    assert sorted((r.article_number or 0, r.message_id, r["_n"]) for r in parts.collect()) == [(0, "m4", None), (10, "m1", "y"), (11, "m3", None)]
    bins = stored(A.binaries(parts), "bins")
    only = [r for r in bins.collect() if r.group_id == 1]
    assert [(r.collected_parts, r.total_parts, r.total_bytes, r.posted_at, r.complete) for r in only] == [(2, 2, 5, AT, True)]
    releases = stored(A.build_releases(bins.withColumn("_n", F.lit("kept out of the way"))), "releases")
    assert [r.name for r in releases.collect()] == ["a"] and A.build_releases(bins, releases).count() == 0
    assert [(r.number, r.message_id) for r in A.release_segments(parts, releases).orderBy("number").collect()] == [(1, "m1"), (2, "m3")]
    assert A.ingest_parts(df.filter("false")).count() == 0 and A.binaries(parts.filter("false")).count() == 0 and A.build_releases(bins.filter("false")).count() == 0
    assert A.ingest_parts(df, parts).count() == 1  # of null keys, which match nothing that is stored


def test_firsts_and_caps_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([("k", 2, "b", 1), ("k", 2, "a", 1), ("k", 2, "a", 1), (None, None, None, None), (None, 1, "c", 2)], "_r string, _n int, r string, n int")
    assert sorted(map(str, map(tuple, A.distinct_on(df, ["_r"], "_n").collect()))) == sorted(map(str, [("k", 2, "a", 1), (None, None, None, None)]))
    assert sorted(map(str, map(tuple, A.cap_per_key(df, ["_r"], 1, "_n", "r").collect()))) == sorted(map(str, [("k", 2, "a", 1), (None, None, None, None)]))
    assert A.cap_per_key(df.filter("false"), ["_r"], 1, "n").columns == df.columns


def test_failures_that_repeat(spark):
    rows = [("a", "pending", 0, False, None, "mine", "too"), ("b", "failed", 2, False, AT, None, None), ("c", None, 1, None, None, "", ""), (None, "pending", 0, False, None, "", "")]
    releases = spark.createDataFrame(rows, "guid string, pp_status string, pp_attempts int, permanent boolean, next_retry timestamp_ntz, at string, _final string")
    failures = spark.createDataFrame([("a", None, AT), ("a", False, None), ("b", False, AT), ("c", True, None), (None, True, AT), ("zz", True, AT)], "guid string, permanent_failure boolean, at timestamp_ntz")
    got = {r.guid: (r.pp_status, r.pp_attempts, r.permanent, r.next_retry, r.at, r["_final"]) for r in J.record_failure(releases, failures).collect()}
    assert got == {"a": ("failed", 1, False, AT + dt.timedelta(seconds=300), "mine", "too"), "b": ("failed", 3, True, None, None, None), "c": ("failed", 2, True, None, "", ""), None: ("pending", 0, False, None, "", "")}
    assert J.record_failure(releases.filter("false"), failures).columns == releases.columns


def test_retention_of_parts_without_a_binary(spark):
    parts = stored(A.ingest_parts(spark.createDataFrame(ROWS, HEADERS)), "parts")
    done = stored(A.build_releases(stored(A.binaries(parts), "bins")), "releases").withColumn("pp_status", F.lit("done"))
    cut = F.lit("2026-01-01").cast("timestamp_ntz")
    gone = J.retention_candidates(parts, done, cut)
    assert [r.message_id for r in gone.collect()] == ["m1"]  # the other part of the release has no time
    assert {r.message_id for r in J.prune_parts(parts, gone).collect()} == {"m3", "m4"}
    assert J.retention_candidates(parts, done.withColumn("pp_status", F.lit(None).cast("string")), cut).count() == 0
    report = J.retention_report(parts, gone.filter("false")).first()
    assert (report.candidate_parts, report.candidate_bytes, report.retained) == (0, 0, 3)


def test_pages_and_searches_of_nulls(spark):
    rows = [("a", None, None, None, False), ("b", "Show x", 5000, AT, None), ("c", "show", 5040, AT, False), (None, "show", 5040, None, False), ("d", "show", 2000, AT, True)]
    df = spark.createDataFrame(rows, "guid string, search_name string, category_id int, posted_at timestamp_ntz, obfuscated boolean")
    assert [r.guid for r in Q.search(df, "SHOW", [5000]).collect()] == ["c", None]
    assert [r.guid for r in Q.offset_page(df, 3, 1).collect()] == ["c", "b", "a"]
    assert [r.guid for r in Q.keyset_page(df, (AT, "c"), 9).collect()] == ["b"]
    assert [(r.guid, r.page, r.last) for r in Q.keyset_pages(df, 2).orderBy("at").collect()] == [("d", 1, False), ("c", 1, True), ("b", 2, False), ("a", 2, True), (None, 3, False)]
    assert tuple(Q.capped_count(df.filter("false"), 3).first()) == (0, False) and tuple(Q.capped_count(df, 3).first()) == (3, True)
