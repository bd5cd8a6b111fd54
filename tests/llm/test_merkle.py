import hashlib
import random
import zlib

import duckdb
from heddle.llm import merkle as M
from pyspark.sql import functions as F

from .conftest import DOCS


def h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(d, lower=False):
    doc_id, text, lang, source, n = d
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return h(*map(field, (doc_id, source, lang, n, text)))


def climb(digests):
    """The remaining digest and, for each starting node, its siblings level by level."""
    at, ways = [[i] for i in range(len(digests))], [[] for _ in digests]
    while len(digests) > 1:
        runs = [digests[i : i + 8] for i in range(0, len(digests), 8)]
        for k, inside in enumerate(at):
            for i in inside:
                run = runs[k // 8]
                ways[i].append(("".join(run[: k % 8]), "".join(run[k % 8 + 1 :])))
        at = [sum(at[i : i + 8], []) for i in range(0, len(at), 8)]
        digests = [h(*r) for r in runs]
    return digests[0], ways


def brute(docs):
    """Results for each document, in no order."""
    trees = {}
    for d in docs:
        trees.setdefault(d[2], []).append(d)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    found = {}
    for lang in langs:
        rows = sorted(trees[lang], key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))
        found[lang] = (rows, *climb([leaf(d) for d in rows]))
    root, tops = climb([found[lang][1] for lang in langs]) if langs else ("", [])
    out = []
    for lang, top in zip(langs, tops, strict=True):
        rows, subroot, ways = found[lang]
        for d, way in zip(rows, ways, strict=True):
            hit = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0
            now = leaf(d, hit)
            for left, right in way + top:
                now = h(left, now, right)
            out.append((d[0], leaf(d), subroot, root, h(*[x for pair in way + top for x in pair]), now, now == root))
    return out


def same(found, docs):
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, brute(docs)))


def on(spark, docs, parts=3):
    df = spark.createDataFrame(docs, DOCS).repartition(parts)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return M.manifest(M.document_leaves(df, hit, M.shared.ascii_lower(F.col("text"))))


def test_whole_table_and_its_sql(spark, sf):
    docs = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = M.op13_merkle(spark, sf)
    same(found, docs)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    assert sorted(map(str, con.execute(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({M.SQL})").fetchall())) == sorted(map(str, (tuple(r) for r in found.collect())))


def test_trees_of_many_chunks(spark):
    """A hot lang of 1300 rows (three rounds), lone leaves, runs of one at the end, more langs than a node has children."""
    draw = random.Random(5)
    docs = [(i, draw.choice(["Abc Ä", "x", "", None]) if i % 7 else "Q" * 50, "en" if i < 1300 else f"l{i % 30}", f"s{i % 3}", i) for i in range(1373)]
    same(on(spark, docs, 5), docs)


def test_nulls_ties_and_repeated_rows(spark):
    docs = [(None, None, None, None, None)] * 3 + [(5, "A", None, "s", 1)] * 20 + [(5, "B", "", "s", 1), (-3, "", "", None, None), (7, "é\n:", "é", "", 0), (7, "é\n:", "z", "", 0)]
    same(on(spark, docs), docs)


def test_empty_one_row_and_extra_columns(spark):
    assert on(spark, []).collect() == []
    one = [(12, "Text", "en", "s", 4)]
    same(on(spark, one), one)
    df = spark.createDataFrame([(*one[0], 1, 2, 3)], f"{DOCS}, pos int, size int, _tree int")
    assert [r.verified for r in M.manifest(M.document_leaves(df)).collect()] == [True]


def test_long_text(spark):
    docs = [(i, "AbC " * (300_000 if i == 2 else 1), "en", "s", 1) for i in range(1, 5)]
    same(on(spark, docs), docs)
