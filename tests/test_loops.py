import datetime as dt
import os
import random

import pytest
from heddle.operators import assembly as A
from heddle.operators import jobs as J
from heddle.operators import postprocess as O
from heddle.operators import repair as P
from heddle.operators import verify as X
from heddle.sources import monthly as M
from pyspark.sql import functions as F

PARTS = "part_id long, group_id long, message_id string, poster string, posted_at timestamp_ntz, bytes long, norm_subject string, collection_key string, total_parts int, file_number int, collection_files int, yenc_attempts int, yenc_version long"


def part(i, at, key="", total=0, attempts=0):
    return (i, 1, f"m{i}", "p", at, 10, f"s{i}", key, total, 0, 0, attempts, 0)


@pytest.fixture
def stored(spark, tmp_path):
    draw = random.Random(8)
    rows = [part(i, dt.datetime(2025, 1 + i % 4, 1 + i % 20), attempts=draw.randint(0, 6)) for i in range(60)]
    rows += [part(100 + i, dt.datetime(2025, 9, 2), key="k/2") for i in range(3)] + [part(200, None), part(201, dt.datetime(2025, 9, 1), total=3)]
    return M.create(spark.createDataFrame(rows, PARTS), str(tmp_path / "parts")), rows


def fold(rows, bodies, version):
    """A pass of verification, part by part."""
    out = []
    for r in rows:
        r = dict(zip([c.split()[0] for c in PARTS.split(", ")], r, strict=True)) if isinstance(r, tuple) else dict(r)
        if r["collection_key"] == "" and r["total_parts"] == 0 and r["yenc_attempts"] < 5 and r["yenc_version"] < version:
            body = bodies.get(r["message_id"])
            r["yenc_version"] = version
            if body is None:
                r["yenc_attempts"] += 1
            elif body[1] <= 1:
                r["total_parts"] = 1
            else:
                r |= {"collection_key": f"yenc:{body[2]}/{body[1]}", "file_number": body[0], "collection_files": body[1]}
        out.append(r)
    return out


def test_passes_against_a_fold(spark, stored):
    table, rows = stored
    draw, state = random.Random(3), rows
    for version in (1, 2, 3, 4):
        bodies = {f"m{i}": (draw.randint(1, 3), draw.randint(0, 3), draw.choice("ab")) for i in range(60) if draw.random() < 0.3}
        frame = spark.createDataFrame([(m, f"=ybegin part={b[0]} total={b[1]} line=128 name={b[2]}\r\nx".encode()) for m, b in bodies.items()] + [("m1", None)] * ("m1" not in bodies), "message_id string, body binary")
        counts = X.verification_pass(table, frame, version).first()
        state = fold(state, bodies, version)
        assert sorted(map(str, (sorted(r.asDict().items()) for r in table.read().collect()))) == sorted(map(str, (sorted(r.items()) for r in state)))
        assert counts.checked == counts.failed + counts.standalone + counts.fragment
        again = X.verification_pass(table, frame, version).first()
        assert again.checked == 0  # a pass that is run again changes nothing
    assert max(r.yenc_attempts for r in table.read().filter("yenc_version > 0").collect()) == 5
    bins = A.assemble_collections(table.read())
    want = {}
    for r in state:
        if r["collection_key"]:
            want.setdefault(r["collection_key"], set()).add(r["file_number"])
    assert {r.collection_key: r.collected_parts for r in bins.collect()} == {k: len(v) for k, v in want.items()}


def test_merge_of_odd_results(spark):
    rows = spark.createDataFrame([part(i, None, attempts=2) for i in range(6)], PARTS)
    results = [(0, None, None, None, None), (0, False, 1, 1, "x"), (1, True, 3, 2, None), (1, True, 3, 1, "z"), (2, True, None, None, None), (9, True, 5, 1, "q"), (3, True, 1, 1, "a"), (3, False, None, None, None)]
    checks = spark.createDataFrame(results, "part_id long, ok boolean, total long, part long, file string")
    got = {r.part_id: (r.yenc_attempts, r.yenc_version, r.total_parts, r.collection_key, r.file_number, r.collection_files) for r in X.verify_parts(rows, checks, 4).collect()}
    assert got == {0: (4, 4, 0, "", 0, 0), 1: (2, 4, 0, "yenc:/3", 2, 3), 2: (2, 4, 1, "", 0, 0), 3: (3, 4, 1, "", 0, 0), 4: (2, 0, 0, "", 0, 0), 5: (2, 0, 0, "", 0, 0)}
    bare = rows.drop("yenc_attempts", "yenc_version")
    assert {r.yenc_attempts for r in X.verify_parts(bare, checks).collect()} == {0, 1, 2}
    assert X.verify_parts(rows.filter("false"), checks).count() == 0 and X.verify_parts(rows, checks.filter("false")).exceptAll(rows).count() == 0


def files(table, month):
    return {(f, os.stat(os.path.join(table.path, f"{M.MONTH}={month}", f)).st_mtime_ns) for f in os.listdir(os.path.join(table.path, f"{M.MONTH}={month}"))}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_months_are_pruned_replaced_and_dropped(spark, stored):
    table, rows = stored
    assert table.months() == [None, 202501, 202502, 202503, 202504, 202509] and table.read().count() == len(rows)
    assert "PartitionFilters: [isnotnull(ingest_month" in (p := plan(table.rows([202501]))) or "PartitionFilters: [(ingest_month" in p
    untouched = files(table, 202502)
    gone = M.prune(table, table.read([202501]).filter("part_id < 30").select("part_id", "posted_at").union(table.read([202504]).select("part_id", "posted_at")))
    assert {r[0]: r[1] for r in gone.collect()} == {202501: 8, 202504: 15}
    assert table.months() == [None, 202501, 202502, 202503, 202509] and files(table, 202502) == untouched
    assert sorted(r.part_id for r in table.read([202501]).collect()) == [32, 36, 40, 44, 48, 52, 56]
    dropped = M.drop_expired(table, F.lit("2025-03-15").cast("timestamp_ntz"))
    assert sorted(r[0] for r in dropped.collect()) == [202501, 202502] and table.months() == [None, 202503, 202509]
    assert M.prune(table, table.read().filter("false").select("part_id", "posted_at")).count() == 0
    assert M.partitions(table).filter("partition_name = 'parts_2025_09'").first().to_ts == dt.datetime(2025, 10, 1)


def test_empty_months(spark, tmp_path):
    empty = M.create(spark.createDataFrame([], PARTS), str(tmp_path / "none"))
    assert empty.months() == [] and empty.read().count() == 0 and M.partitions(empty).count() == 0
    assert X.verification_pass(empty, spark.createDataFrame([], "message_id string, body binary"), 1).first().checked == 0


# Post-processing against the state machine that fetches one body after the other.
def packet(*names):
    return b"".join(P.PAR2_MAGIC + (120 + len(n)).to_bytes(8, "little") + bytes(32) + P.PAR2_FILE + bytes(56) + n.encode() for n in names)


BODIES = [None, b"", b"junk", packet("9c914cea0eb54d4892abd3a5b681032a.par2"), packet("a.nfo", "Real.Show.2024.part01.rar"), packet("Other.Name.vol1+2.par2", "Other.Name.r05"), packet("x" * 600 + ".mkv"), b"  imdb tt1234567 \n", b"=ybegin line=128 name=a\n" + bytes((c + 42) % 256 for c in b"tvdb") + b"\n=yend"]
NAMES = {4: "Real.Show.2024", 5: "Other.Name"}
TEXTS = {2: "junk", 7: "imdb tt1234567", 8: "tvdb", 3: None, 4: None, 5: None, 6: None}
KINDS = {"par2": 'x "a.par2"', "nfo": '"b.NFO" yEnc', "other": "c.bin"}


def machine(hidden, segments, budget):
    spent, name, text, errors = 0, None, None, []
    ordered = {k: sorted((s for s in segments if s[0] == k), key=lambda s: (s[2] if k == "other" else 0, s[3])) for k in KINDS}

    def fetch(s):
        nonlocal spent
        spent += 1
        if s[1] == 0:
            errors.append(s[4] == 430)
        return s[1]

    for k in ("par2", "other"):
        if k == "other" and (name or not hidden):
            break
        for s in ordered[k]:
            if spent >= budget:
                break
            if (b := fetch(s)) in NAMES:
                name = NAMES[b]
                break
    for s in ordered["nfo"]:
        if spent >= budget:
            break
        if TEXTS.get(b := fetch(s)):
            text = b
            break
    failed = bool(errors) and name is None and text is None
    return name, text, spent, failed, failed and any(errors)


def test_probes_against_the_state_machine(spark):
    draw, due, rows, bodies, want = random.Random(6), [], [], [], {}
    for g in range(300):
        hidden, segments = draw.random() < 0.6, []
        for number in range(draw.randint(0, 9)):
            kind = draw.choice(list(KINDS))
            body = draw.choice([0, 1, 2, 3, 6, draw.choice([4, 5])]) if kind != "nfo" else draw.choice([0, 1, 2, 7, 8])
            s = (kind, body, draw.randint(1, 5), number, draw.choice([430, 500, None]))
            segments.append(s)
            rows.append((f"g{g}", f"m{g}.{number}", KINDS[kind], s[2], number))
            if body or draw.random() < 0.5:
                bodies.append((f"m{g}.{number}", BODIES[body], s[4]))
            else:
                segments[-1] = (*s[:4], None)
        due.append((f"g{g}", hidden))
        want[f"g{g}"] = machine(hidden, segments, 4)
    got = O.postprocess_resolve(spark.createDataFrame(due, "guid string, obfuscated boolean"), spark.createDataFrame(rows, "guid string, message_id string, subject string, bytes long, number int"), spark.createDataFrame(bodies, "message_id string, body binary, code int")).collect()
    assert len(got) == 300
    for r in got:
        name, text, spent, failed, permanent = want[r.guid]
        assert (r.new_name, r.nfo, r.fetched, r.failed, r.permanent) == (name, TEXTS.get(text), spent, failed, permanent), r
        assert [i.identifier for i in r.identifiers] == (["tt1234567"] if text == 7 else [])
        assert (r.search_name, r.category_id is None) == (name and name.lower().replace(".", " "), name is None)
    assert {w[3:] for w in want.values()} == {(False, False), (True, False), (True, True)}


def test_results_of_odd_rows(spark):
    stored = O.Processed(
        spark.createDataFrame([("a", "old", "old", 1, True, "pending", 7), ("b", "other", "other", 2, True, "failed", 7), ("c", None, None, None, None, None, None)], "guid string, name string, search_name string, category_id int, obfuscated boolean, pp_status string, extra int"),
        spark.createDataFrame([("a", "x"), ("c", "y")], "guid string, nfo string"), spark.createDataFrame([("a", "imdb", "tt0000001")], "guid string, source string, identifier string"), spark.createDataFrame([("a", "f", 1)], "guid string, file_name string, size_bytes long"),
    )
    one = "guid string, new_name string, search_name string, category_id int, nfo string, identifiers array<struct<source:string,identifier:string>>, failed boolean, files array<struct<file_name:string,size_bytes:bigint>>"
    results = [("a", "B", "b", 5, "n", [("imdb", "1"), ("imdb", "bad"), (None, None)], False, [("f", 1), ("g", 2)]), ("a", None, None, None, None, [], None, []), ("b", "Z", "z", 9, "t", [], True, []), (None, "q", "q", 1, "q", [], False, []), ("zz", "q", "q", 1, "q", [("tvdb", "5")], False, [("q", 1)])]
    out = O.apply_postprocess(stored, spark.createDataFrame(results, one))
    again = O.apply_postprocess(out, spark.createDataFrame(results, one))
    for o in (out, again):
        assert sorted(map(tuple, o.releases.fillna("-").collect()))[0] == ("a", "B", "b", 5, False, "done", 7)
        assert {tuple(r) for r in o.releases.collect() if r.guid != "a"} == {("b", "other", "other", 2, True, "failed", 7), ("c", None, None, None, None, None, None)}
        assert sorted(map(tuple, o.nfos.collect())) == [("a", "n"), ("c", "y")]
        assert sorted(map(tuple, o.identifiers.collect())) == [("a", "imdb", "tt0000001")] and sorted(map(tuple, o.files.collect())) == [("a", "f", 1), ("a", "g", 2)]
    empty = O.apply_postprocess(stored, spark.createDataFrame([], one))
    assert empty.releases.exceptAll(stored.releases).count() == 0 and empty.nfos.count() == 2


def test_first_provider_wins_by_source(spark):
    known = [("t1", 0, "a", False, [("imdb", "2"), ("imdb", "1"), (None, "3")]), ("t1", 1, "b", False, [("imdb", "9"), ("tvdb", "4")]), ("t2", 0, None, True, None), ("t2", 1, None, False, None), ("t3", 0, "x", True, [("imdb", "7")]), ("t3", 5, "c", None, []), ("t4", 0, None, False, [("imdb", "8")])]
    providers = spark.createDataFrame(known, "title string, priority int, external_id string, error boolean, identifiers array<struct<source:string,identifier:string>>")
    names = spark.createDataFrame([("g1", "T1"), ("g2", "t2"), ("g3", "t3"), ("g4", "t4"), ("g5", "nobody"), ("g6", None), ("g7", "T1")], "guid string, name string")
    got = {r.guid: (r.external_id, r.matched, [tuple(i) for i in r.identifiers], r.failed) for r in J.enrich_lookup(names, providers).collect()}
    both = ("a", True, [("imdb", "1"), ("tvdb", "4")], False)
    assert got == {"g1": both, "g7": both, "g2": (None, False, [], True), "g3": ("c", True, [], False), "g4": (None, False, [], False), "g5": (None, False, [], False), "g6": (None, False, [], False)}


def test_bases_of_volumes(spark):
    cases = {"a.part01.rar": "a", "a.rar.0001": "a", "a.vol1+02.PAR2": "a", "a.bin": "a.bin", ".part1.rar": ".part1", ".rar": ".rar", "a.rar.x": "a.rar.x", "a.1234": "a.1234", "": "", ".rar.001": ".rar.001"}
    got = {r.n: r.b for r in spark.createDataFrame([(c,) for c in cases], "n string").select("n", P.volume_base(F.col("n")).alias("b")).collect()}
    assert got == cases


def test_reparsing_runs_the_parser_once(spark):
    rows = [(1, "[1/3] - \"a.rar\" yEnc (1/1)", 9, 9, "x", "y", 9, 9), (2, None, None, None, None, None, None, None), (3, "", 0, 0, "", "", 0, 0)]
    df = spark.createDataFrame(rows, "part_id long, subject string, part_number int, total_parts int, norm_subject string, collection_key string, file_number int, collection_files int")
    out = J.reparse_plan(df)
    filters = [line for line in plan(out).splitlines() if "Filter" in line]
    assert filters and not any("regexp" in line for line in filters)
    assert {r.part_id for r in out.collect()} >= {1} and 3 not in {r.part_id for r in out.collect()}
    assert J.reparse_plan(df.filter("false")).count() == 0


def test_months_are_written_once(spark, stored, monkeypatch):
    """Rows read from the table itself replace its months without a copy aside; months without rows go."""
    table, rows = stored
    monkeypatch.setattr(M, "stored", None)
    months = table.months()
    table.replace(months, table.read(months).filter("total_parts = 0 AND collection_key = ''"))
    assert sorted(r.part_id for r in table.read().collect()) == sorted(r[0] for r in rows if r[8] == 0 and r[7] == "")
    assert set(table.months()) == set(months) - {202509}


def test_only_changed_rows_are_dealt_again(spark, stored):
    """What a pass doesn't change is written by the tasks that read it; months that aren't named stay untouched."""
    table, rows = stored
    files = lambda: {(m, f): os.stat(os.path.join(table.path, m, f)).st_mtime_ns for m in os.listdir(table.path) if m.startswith(M.MONTH) for f in os.listdir(os.path.join(table.path, m)) if f.startswith("part-")}
    months, before = [202502, None], files()
    picked = table.read(months)
    changed, others = picked.filter("part_id % 3 = 0").withColumn("total_parts", F.lit(7)), picked.filter("part_id % 3 <> 0")
    plan = table._dealt(changed, others)._jdf.queryExecution().optimizedPlan().toString()
    branches = plan.split("Union")[1].split("RebalancePartitions")
    assert len(branches) == 2 and branches[1].count("Relation") == 2  # the others follow the dealt rows, without a deal of their own
    table.amend(changed, others)
    want = {r[0]: 7 if r[0] % 3 == 0 and (r[4] is None or r[4].month == 2) else r[8] for r in rows}
    assert {r.part_id: r.total_parts for r in table.read().collect()} == want and table.read().count() == len(rows)
    named = {f"{M.MONTH}=202502", f"{M.MONTH}={M.NONE}"}
    assert {k: v for k, v in before.items() if k[0] not in named} == {k: v for k, v in files().items() if k[0] not in named}


def test_a_pass_deals_only_what_waits(spark, stored, monkeypatch):
    table, rows = stored
    seen, real = [], M.Monthly.amend
    monkeypatch.setattr(M.Monthly, "amend", lambda self, changed, others: seen.append((changed.count(), others.count())) or real(self, changed, others))
    X.verification_pass(table, spark.createDataFrame([], "message_id string, body binary"), 1)
    wait = [r for r in rows if r[7] == "" and r[8] == 0 and r[11] < 5]
    months = {r[4] and r[4].month for r in wait}
    assert seen == [(len(wait), sum((r[4] and r[4].month) in months for r in rows) - len(wait))]


def test_verified_parts_are_read_where_they_lie(spark, tmp_path):
    from heddle.plans import registry  # noqa: F401, I001
    from heddle.plans import catalogue_loops as L

    os.symlink("/root/testdata/sf0.001", tmp_path / "sf")
    got = L.verified(spark, str(tmp_path / "sf"))
    assert got.columns == L.LOOP and all(f"/{M.MONTH}=" in f for f in got.inputFiles())  # no copy of the whole table
