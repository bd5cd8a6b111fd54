import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from heddle.llm import exact_dedup as E


def brute(docs):
    groups = defaultdict(list)
    for i, (d, t) in enumerate(docs):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append((d is None, d or 0, i))
    out = []
    for t, g in groups.items():
        first = min(g)
        out += [(None if n else d, None if first[0] else first[1], len(g), hashlib.sha256(t.encode()).hexdigest()) for n, d, _ in g]
    return sorted(out, key=str)


def got(df):
    rows = df.collect()
    kept = defaultdict(int)
    for r in rows:
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert all(k == 1 for k in kept.values())
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=str)


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(E.op5_exact_dedup(spark, sf)) == brute(docs)


CASES = [(5, "a  b"), (3, "a\tb"), (3, "a b"), (None, None), (7, ""), (8, " "), (9, "\n\n"), (None, "é" * 5000), (1, "é" * 5000), (2, "é" * 4999 + "e"), (2, "é" * 4999 + "e"), (4, "a b"), (6, "x" * 300_000), (10, "x" * 299_999 + "y"), (11, "x" * 300_000)]


@pytest.mark.parametrize("weak", [{}, {"prime": 3, "bases": (2,)}, {"piece": 1000, "huge": 5000}])
def test_ties_nulls_long_texts_and_collisions(spark, weak):
    df = spark.createDataFrame([(d, t, "k") for d, t in CASES], "doc_id long, text string, kept string").repartition(3)
    out = E.exact_dedup(df, **weak)
    assert "in_kept" in out.columns
    assert got(out) == brute(CASES)


def test_rows_that_stay(spark):
    df = spark.createDataFrame([(d, t, i, "k") for i, (d, t) in enumerate(CASES)], "doc_id long, text string, _uid int, kept string").repartition(2)
    out = E.deduplicated(df)
    assert out.columns == df.columns
    assert out.count() == len({s for *_, s in brute(CASES)})


def test_empty_table(spark):
    assert E.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chunks_compose():
    raw = np.random.default_rng(1).integers(0, 256, 5000, dtype=np.uint8).tobytes()
    table = E.powers()
    whole = E.fingerprint(raw, table)
    assert whole == E.fingerprint(raw, table, chunk=77)
    for i, b in enumerate(E.BASES):
        v = 0
        for x in raw:
            v = (v * b + x) % E.PRIME
        assert v == whole[i]


def test_names_that_clash_stay(spark):
    df = spark.createDataFrame([(1, "a b", 10, 11, 12), (2, "a  b", 20, 21, 22)], "doc_id long, text string, kept int, in_kept int, _uid int")
    rows = {r.doc_id: r for r in E.exact_dedup(df).collect()}
    assert [(rows[i].kept, rows[i].in_in_kept, rows[i].in_kept, rows[i].in__uid) for i in (1, 2)] == [(True, 10, 11, 12), (False, 20, 21, 22)]
    assert [tuple(r) for r in E.deduplicated(df).collect()] == [(1, "a b", 10, 11, 12)]
