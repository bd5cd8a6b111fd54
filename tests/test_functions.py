import pytest
from heddle.functions import names as N
from heddle.functions import regexes as R
from heddle.functions import subjects as S
from pyspark.sql import functions as F

SUBJECTS = [
    ('"Show.S01.mkv" yEnc (3/120)', (3, 120, "Show.S01.mkv", "", 0, 0)),
    ('[05/42] - "abc.part05.rar" yEnc (1/77)', (1, 77, "abc.part05.rar", "abc/42", 5, 42)),
    ('Some Long Title [2/9] "x.r01" yEnc (4/5)', (4, 5, "x.r01", "t:Some Long Title/9", 2, 9)),
    ('"Title here" [03/18] - "show.part1.rar" yEnc (1/2)', (1, 2, "show.part1.rar", "t:\"Title here\"/18", 3, 18)),
    ('Films [2009/2010] "f.vol01+02.par2" yEnc (1/3)', (1, 3, "f.vol01+02.par2", "b:f", 0, 0)),
    ("plain 7 of 9 yEnc", (7, 9, "", "", 0, 0)),
    ("nothing at all", (0, 0, "", "", 0, 0)),
]


def test_subjects(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(SUBJECTS)], "i int, subject string")
    rows = S.parse_subject(df).orderBy("i").collect()
    for r, (s, want) in zip(rows, SUBJECTS, strict=True):
        assert (r.part_number, r.total_parts, r.file_name, r.collection_key, r.file_number, r.collection_files) == want, s


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("name,category", [("Show.S01E02.1080p.WEB", 5040), ("Film.2020.2160p.BluRay.x265", 2045), ("Film.2020.German.1080p.BluRay", 2010), ("Artist.Album.FLAC", 3040), ("Book.epub", 7020), ("whatever", 8000)])
def test_categories(spark, name, category):
    assert one(spark, N.categorize(F.lit(name))) == category


def test_names_and_identifiers(spark):
    assert one(spark, N.is_obfuscated(F.lit("a1b2c3d4e5f60718"))) and not one(spark, N.is_obfuscated(F.lit("Good.Name.2020")))
    assert one(spark, N.release_hash(F.lit("A.B"), F.lit(1_000_000), F.lit(1))) == one(spark, N.release_hash(F.lit("a b"), F.lit(1_000_400), F.lit(1)))
    got = one(spark, N.extract_identifiers(F.lit("tt123456 TT0123456 https://thetvdb.com/series/77 themoviedb.org/tv/5")))
    assert [tuple(g) for g in got] == [("imdb", "tt0123456"), ("tvdb", "77"), ("tmdb", "5")]
    assert one(spark, N.episode_query(F.lit("x"), F.lit("1"), F.lit("12"))) == "x s01e12"
    title = one(spark, N.parse_title(F.lit("My.Show.S02E03.2011.x264")))
    assert tuple(title) == ("my show", 2011, 2, 3)


def test_ported_boundaries(spark):
    """Ported boundaries look at one side each, and find what RE2's do; subjects with several names and counters parse as with general patterns."""
    import re

    texts = ["yEnc", "xyenc", "a yenc_", "éyencé", "(yenc)", "win x", "winx", "win  7z", "s01 e2", "a1s01e02", "hdtv.s01", "hdtv xs01", "web dl episode", "2020 x264", "2020x264", "720p in 1999é", "3 of 7", "a3 of 7", "3 of 7b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in [R.YENC, R.OF_COUNTER, R.EPISODE, R.FOREIGN, *[p for p, _ in R.CATEGORIES]]:
        assert "(?<=" not in R.port(pattern)
        assert [r[0] for r in df.select(F.col("t").rlike(R.port(pattern))).collect()] == [bool(re.search(pattern, t, re.ASCII)) for t in texts], pattern
    s = '[1/2] [03/18] "a" x "Title here" (7/9) "b.rar" (1/3) [1999/2001] (2/4)'
    r = S.parse_subject(spark.createDataFrame([(s, 1)], "subject string, _s int")).first()
    assert (r.file_name, r.part_number, r.total_parts, r._s) == ("b.rar", 2, 4, 1)
    assert "ArrayTransform" in str(S.parse_subject(df.withColumnRenamed("t", "subject"))._jdf.queryExecution().analyzed().toJSON())


def test_subjects_are_parsed_in_projections(spark):
    """No step copies what the others found, and each short run of steps is compiled by itself."""
    plan = S.parse_subject(spark.createDataFrame([("a [1/2] b",)], "subject string"))._jdf.queryExecution().executedPlan().toString()
    assert "named_struct" not in plan and plan.count("Project") >= 8


def test_first_characters_are_looked_for_first():
    assert "(?=" in R.port(R.OF_COUNTER) and "(?=" in R.port(R.YENC) and "(?=" in R.port(R.ARCHIVE)
    assert not any("(?=" in R.port(p) for p in (r"\b(xxx|porn)\b", r"\bs?a\b", r"(\.a|b)?\.c", r"\b(19|20)\d{2}\b"))


def test_archives_are_known_by_their_ends(spark):
    """The end of a name tells what the whole pattern does, and a name without it isn't cut; signs of n of m are found in any case."""
    ends = ["rar", "PAR2", "Zip", "7z", "sfv", "nfo", "nzb", "001", "par", "r01", "rarx", "zİp", ""]
    names = [head + "." + end for head in ("", "a", "é.vol01+2", "x.part1", "b.12345678", "\U0001f600") for end in ends] + ["rar", "", "7z", ".7z\n"]
    df = spark.createDataFrame([(n,) for n in names], "t string")
    rows = df.select("t", S.is_archive(F.col("t")), F.col("t").rlike(R.port(R.ARCHIVE)), S.collection_base(F.col("t"))).collect()
    assert [r[1] for r in rows] == [r[2] for r in rows] and sum(r[1] for r in rows) > 40
    s = ['a 3 OF 7 x', 'a 3 oF 7', 'off 3 of', '"n.rar" 2 Of 3', 'K of 2 OF 9', '"a.b1234567" "c.d123456789"']
    got = S.parse_subject(spark.createDataFrame([(i, x) for i, x in enumerate(s)], "i int, subject string")).orderBy("i").collect()
    assert [(r.part_number, r.total_parts, r.norm_subject) for r in got[:5]] == [(3, 7, "a x"), (3, 7, "a"), (0, 0, "off 3 of"), (2, 3, '"n.rar"'), (2, 9, "K of")]
    assert (got[3].collection_key, got[5].file_name) == ("b:n", "a.b1234567")
