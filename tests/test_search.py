import datetime as dt
import random

import pytest
from heddle.operators import assembly as A
from heddle.operators import jobs as J
from heddle.operators import repair as P
from heddle.operators import search as Q
from heddle.operators import trigrams as G
from heddle.sources import layout
from pyspark.sql import functions as F

START = dt.datetime(2025, 1, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def names(spark):
    """Many of one day, many with one word; obfuscated, empty and null names; times that repeat."""
    draw = random.Random(3)
    words = ["show", "s01e02", "1080p", "web", "x264", "éa", "ab", "b", "aab", "grp", "showtime"]
    rows = []
    for i in range(400):
        text = None if i % 97 == 5 else "" if i % 89 == 7 else " ".join(draw.choices(words, weights=[20, 3, 9, 5, 5, 1, 2, 2, 2, 3, 4], k=draw.randint(1, 5)))
        rows.append((f"g{i:03}", text, START + dt.timedelta(days=0 if i % 3 else draw.randrange(9), hours=draw.randrange(3)), i % 11 == 0))
    return rows, spark.createDataFrame(rows, "guid string, search_name string, posted_at timestamp_ntz, obfuscated boolean").repartition(3)


@pytest.mark.parametrize("query", ["show", "how 80p", "b", "aa b", "éa", "s01e02 web", "zz", "showz", "", "SHOW", "x264 x264 264", "wtim"])
def test_index_against_a_scan(spark, names, query):
    rows, df = names
    index = G.build(df, "guid", "search_name")
    want = {g for g, text, *_ in rows if text is not None and all(t in text for t in query.lower().split())}
    assert {r.guid for r in Q.token_and_search(df, query, index).collect()} == want
    if query.split():
        assert want == {r.guid for r in Q.token_and_search(df, query).collect()}


def test_index_of_whole_texts(spark):
    rows = [(1, "Alt.Binaries Movies"), (2, "alt.binaries"), (3, None), (4, ""), (5, "x y"), (5, "x z"), (6, "X Y")]
    df = spark.createDataFrame(rows, "k long, t string")
    index = G.build(df, "k", "t", whole=True)
    find = lambda *n: sorted(r.id for r in index.containing(list(n)).collect())
    assert (find("s m"), find(" "), find("X "), find("binaries", "ALT"), find("nothing"), find()) == ([1], [1, 5, 6], [5, 6], [1, 2], [], [1, 2, 4, 5, 6])
    assert G.build(df.filter("false"), "k", "t").containing(["x"]).count() == 0
    assert "PushedFilters: [IsNotNull(gram), EqualTo(gram,ali)]" in plan(index.held.filter("gram = 'ali'"))


@pytest.mark.parametrize("first_block", [1, 16, 5000])
def test_newest_with_all_against_brute_force(spark, names, first_block):
    rows, df = names
    seen = df.filter("NOT obfuscated")
    index = G.build(seen, "guid", "search_name")
    wants = [["show"], ["b", "show"], ["1080p", "how"], ["éa"], ["nothing"], ["aab", "nothing"], ["e02", "s01", "web"]]
    got = {}
    for r in G.newest_with_all(index, seen, spark.createDataFrame([(w,) for w in wants], "want array<string>"), 3, first_block).collect():
        got.setdefault(tuple(r.want), []).append((r.at, r.guid))
    newest = sorted((r for r in rows if not r[3]), key=lambda r: (r[2], r[0]), reverse=True)
    want = {tuple(w): [r[0] for r in newest if r[1] is not None and all(t in r[1] for t in w)][:3] for w in wants}
    assert {w: [g for _, g in sorted(x)] for w, x in got.items()} == {w: x for w, x in want.items() if x}


def test_related_against_brute_force(spark, names):
    rows, df = names
    newest = sorted((r for r in rows if not r[3] and r[1] is not None), key=lambda r: (r[2], r[0]), reverse=True)
    want = set()
    for g, text, *_ in rows:
        asked = [t for t in (text or "").split() if t][:3]
        if asked:
            want |= {(g, r[0], n) for n, r in enumerate([r for r in newest if r[0] != g and all(t in r[1] for t in asked)][:5], 1)}
    assert {tuple(r) for r in Q.related_releases(df).collect()} == want
    assert Q.related_releases(df.filter("false")).count() == 0


def test_pages_of_a_hot_day(spark, names):
    rows, df = names
    order = sorted(rows, key=lambda r: (r[2], r[0]), reverse=True)
    got = {r.guid: (r.page, r.last) for r in Q.keyset_pages(df, 7).collect()}
    assert got == {r[0]: (i // 7 + 1, i % 7 == 6) for i, r in enumerate(order)}
    assert Q.keyset_pages(df.filter("false"), 7).count() == 0
    assert "Window" not in plan(layout.positions(df, Q.newest_first()).select("guid")) or "SinglePartition" in plan(layout.positions(df, Q.newest_first()))


def test_joins_in_one_layout_move_nothing(spark):
    parts = spark.createDataFrame([(i, 1, f"m{i}", "p", START, 10, f"s{i // 3}", "" if i % 5 else "k/2", 3, i % 2, 2, i, i % 3, "subj") for i in range(90)], "part_id long, group_id long, message_id string, poster string, posted_at timestamp_ntz, bytes long, norm_subject string, collection_key string, total_parts int, file_number int, collection_files int, article_number long, part_number int, subject string")
    bins = A.binaries(parts)
    releases = bins.select("binary_id", F.substring("binary_id", 1, 6).alias("guid"), F.lit("done").alias("pp_status"))
    p, b, r = A.linked_layout(parts, bins, releases, 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    cutoff = F.lit("2026-01-01").cast("timestamp_ntz")
    cases = [(A.release_segments(p, r), A.release_segments(parts, releases)), (J.retention_candidates(p, r, cutoff).drop("binary_id"), J.retention_candidates(parts, releases, cutoff).drop("binary_id")), (P.protected_binaries(p, r), P.protected_binaries(A.link_parts(parts).filter("binary_id IS NOT NULL"), releases)), (J.trace(p, b, r), J.trace(parts, bins, releases))]
    for laid, plain in cases:
        assert "Exchange" not in plan(laid).split("== Initial Plan ==")[0], plan(laid)
        assert sorted(map(str, laid.collect())) == sorted(map(str, plain.select(*laid.columns).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_index_broadcasts_no_grams(spark, monkeypatch):
    """Terms' stored bytes say little about how many grams they have: neither the build nor a look-up of many needles broadcasts these."""
    plans = []
    monkeypatch.setattr(G, "_sorted", lambda df, name, *keys, kept=G._sorted: (plans.append(plan(df)), kept(df, name, *keys))[1])
    df = spark.createDataFrame([(i, f"customer#{i:09}") for i in range(500)], "k long, t string")
    index = G.build(df, "k", "t", whole=True)
    assert not any("Join" in p for p in plans), plans
    assert {r.gram: r.terms for r in index.sizes.collect()} == {r.gram: r["count"] for r in index.held.groupBy("gram").count().collect()}
    many = index.terms_of_each(df.select(F.col("t").alias("t")))
    assert "SortMergeJoin" in plan(many) and many.count() == 500


def test_layout_has_more_buckets_for_more_parts(spark, monkeypatch):
    parts = spark.range(95).select(F.col("id").alias("part_id"), F.col("id").cast("string").alias("binary_id"))
    few = parts.limit(5).select("binary_id")
    monkeypatch.setattr(A, "BUCKET_ROWS", 10)
    p, b, _ = A.linked_layout(parts, few, few)
    assert len({name.split("_")[-1][:5] for name in p.inputFiles()}) == 10  # the bucket is in a file's name
    assert p.count() == 95 and p.join(b, "binary_id").count() == 5
