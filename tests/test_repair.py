import datetime as dt
import random

from heddle.functions import names as N
from heddle.operators import assembly as A
from heddle.operators import repair as P
from heddle.plans import catalogue  # noqa: F401  (imports the others in order)
from heddle.plans import catalogue_loops as L
from pyspark.sql import functions as F


def slowly(body):
    """yEnc decoding a byte at a time."""
    inside, seen, out = False, False, bytearray()
    for line in body.split(b"\n"):
        line = line.rstrip(b"\r\n")
        if line[:7] == b"=ybegin" or line[:6] == b"=ypart":
            inside, seen = True, seen or line[:7] == b"=ybegin"
        elif line[:5] == b"=yend":
            inside = False
        elif inside:
            i = 0
            while i < len(line):
                if line[i] == ord("="):
                    i += 1
                    if i < len(line):
                        out.append((line[i] - 106) % 256)
                else:
                    out.append((line[i] - 42) % 256)
                i += 1
    return bytes(out) if seen else None


def test_yenc_against_a_byte_at_a_time():
    draw = random.Random(1)
    for _ in range(400):
        body = b"\n".join(draw.choice([b"=ybegin line=1", b"=ypart", b"=yend", b"", bytes(draw.choices(b"=ab}=\r\x00\xff", k=draw.randint(0, 12)))]) for _ in range(draw.randint(0, 8)))
        assert P.decoded(body) == slowly(body), body


def test_lines_are_decoded_alike_whatever_their_length():
    """Short lines escape by escape, long ones as arrays; a body that the feed encodes is what it was."""
    draw = random.Random(2)
    for n in (1, 700, P._SHORT - 1, P._SHORT, 3000):
        for letters in (bytes(range(256)).replace(b"\r", b"").replace(b"\n", b""), b"=a"):
            body = b"=ybegin\n" + bytes(draw.choices(letters, k=n)) + b"x\n=yend"
            assert P.decoded(body) == slowly(body)


def test_only_rows_that_need_a_body_are_encoded(spark):
    """Python is called for every row, so rows without a body give it no argument; what is encoded decodes to what it was."""
    found = L.probed(spark, "/root/testdata/sf0.001")[2]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "yenc_encoded_bytes(CASE WHEN" in plan
    raw = [bytes(range(256)) * 3, b"", None]
    got = spark.createDataFrame([(x and bytearray(x),) if x is not None else (None,) for x in raw], "b binary").select(P.yenc_decode(L.yenc_encoded_bytes(F.col("b")))).collect()
    assert [None if r[0] is None else bytes(r[0]) for r in got] == raw


def test_par2_names_of_broken_packets(spark):
    one = lambda name, size=None: P.PAR2_MAGIC + (size or 64 + 56 + len(name)).to_bytes(8, "little") + bytes(32) + P.PAR2_FILE + bytes(56) + name
    data = b"x" + one(b"a.rar") + one(b"b\0\0\0") + one(b"a.rar") + one(b"lost", 9999) + one(b"c\xff") + P.PAR2_MAGIC
    assert P.declared(data) == ["a.rar", "b", "c�"] and P.declared(b"") == []
    df = spark.createDataFrame([(bytearray(data),), (None,), (bytearray(b"PAR2"),)], "b binary")
    assert [tuple(r) for r in df.select(F.size(P.par2_filenames(F.col("b"))), P.has_par2_magic(F.col("b"))).collect()] == [(3, True), (0, False), (0, False)]


def test_zones_of_any_name(spark):
    texts = ["Mon, 02 Jan 2006 15:04:05 EST", "2 Jan 2006 15:04 GMT", "2 Jan 2006 15:04:05 -0500 (EST)", "soon", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(A.overview_date(F.col("t")).cast("timestamp_ntz")).collect()]
    assert got == [dt.datetime(2006, 1, 2, 15, 4, 5), dt.datetime(2006, 1, 2, 15, 4), dt.datetime(2006, 1, 2, 20, 4, 5), None, None]


def test_genuine_replacement_characters_stay(spark):
    raw = [b"a\xff\xfeb", "��".encode(), "��".encode() + b"\xc3", b"\0x\0", b""]
    got = [r[0] for r in spark.createDataFrame([(bytearray(b),) for b in raw], "b binary").select(N.sanitize_utf8(F.col("b").cast("string"))).collect()]
    assert got == ["a�b", "��", "���", "x", ""]


def test_a_file_in_two_batches_counts_once(spark):
    rows = [(i, 1, f"m{i}", "p", "k/3" if i < 6 else "", i % 3, 3 if i < 6 else 0, "s", 0 if i < 6 else 2, 10, dt.datetime(2026, 1, 1 + i)) for i in range(8)]
    df = spark.createDataFrame(rows, "part_id long, group_id long, message_id string, poster string, collection_key string, file_number int, collection_files int, norm_subject string, total_parts int, bytes long, posted_at timestamp_ntz")
    whole = A.binaries(df)
    halves = A.partials(df.filter("part_id % 2 = 0")).unionByName(A.partials(df.filter("part_id % 2 = 1")))
    columns = sorted(whole.columns)
    assert sorted(map(str, A.merge_partials(halves).select(*columns).collect())) == sorted(map(str, whole.select(*columns).collect()))
    assert A.merge_partials(A.partials(df.filter("false"))).count() == 0


def test_backfill_moves_parts_once(spark):
    """Stored segments aren't moved, parts only to their binary; two releases of one binary both get its segments."""
    parts = spark.createDataFrame([(1, f"k{i // 3}", "", "p", 3, 3 - i % 3, i, f"m{i}" if i != 4 else "", i) for i in range(9)], "group_id int, collection_key string, norm_subject string, poster string, total_parts int, part_number int, article_number int, message_id string, bytes long").withColumn("subject", F.lit("s"))
    ids = {r.article_number: r.binary_id for r in A.link_parts(parts).collect()}
    one = "number int, message_id string, bytes long, subject string"
    releases = spark.createDataFrame([("a", ids[0], "x", []), ("b", ids[0], "y", []), ("c", ids[3], "z", [(7, "kept", 1, "s")]), ("d", "none", "w", []), ("e", ids[3], "v", [])], f"guid string, binary_id string, name string, segments array<struct<{one.replace(' ', ':').replace(',:', ',')}>>")
    found, counts = P.backfill_segments(releases, parts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 3 and "Window" not in plan
    got = {r.guid: (r.name, r.stored, [(s.number, s.message_id) for s in r.segments]) for r in found.collect()}
    first = [(1, "m2"), (2, "m1"), (3, "m0")]
    assert got == {"a": ("x", False, first), "b": ("y", False, first), "c": ("z", True, [(7, "kept")]), "d": ("w", False, []), "e": ("v", False, [(1, "m5"), (2, "m3")])}
    assert counts.collect() == [(3, 1)]
