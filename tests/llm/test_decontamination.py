import hashlib
import random
import re

import pytest

from heddle.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    out = []
    for d, text in docs:
        w, hit, ids = split(text), set(), set()
        for i, t in items:
            v = split(t)
            k = min(window, len(v))
            for s in range(len(v) - k + 1 if v else 0):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == v[s : s + k]:
                        hit |= set(range(p, p + k))
                        ids.add("" if i is None else str(i))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    draw = random.Random(11)
    vocab = ["The", "of", "and", "É", "é", "x1", "Kelvin", "k", "rare", "_"]
    text = lambda n: " ".join(draw.choices(vocab, [9, 9, 5, 1, 1, 1, 1, 1, 1, 1], k=n))
    items = [(i, text(draw.choice([1, 3, 9, 10, 11, 30]))) for i in range(12)] + [(3, text(15)), (None, "zz Top"), (50, ""), (51, None), (52, "...")]
    docs = [(i, "".join((text(draw.randint(0, 30)), ", ", draw.choice(items)[1] or "", "\n", text(draw.randint(0, 9))))) for i in range(60)]
    docs += [(None, None), (1, ""), (1, "zz, TOP"), (1, "zz, TOP"), (99, text(5000) + " " + items[5][1])]
    df = spark.createDataFrame([(*d, 0, "w") for d in docs], "doc_id long, text string, uid int, words string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in D.contamination(df, bench).collect()), key=str)
    assert got == brute(docs, items)
    clean = D.clean_documents(df, bench)
    assert clean.columns == df.columns
    assert sorted(r.text or "" for r in clean.collect()) == sorted(t or "" for (d, t), b in zip(docs, [brute([x], items)[0][5] for x in docs], strict=True) if not b)


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert D.contamination(docs.filter("false"), bench).count() == 0
    assert [r.contaminated for r in D.contamination(docs, bench.filter("false")).collect()] == [False]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta"), (2, "alpha " + "x " * 40 + "beta")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "beta alpha")], "item_id long, text string")
    terms, items = D.test_items(bench)
    near = D.proximity_matches(D.build_index(docs, terms, "text", "doc_id"), items, slop=5).collect()
    assert [(r.item_id, r.gap) for r in near] == [("7", 3)]
    rows = D.contamination(docs, bench, slop=5).collect()
    assert sorted((r.doc_id, r.n_near, r.n_hit) for r in rows) == [(1, 1, 0), (2, 0, 0)]


def test_proximity_against_brute_force(spark):
    """The two rarest words of each window, by all documents, within so many words of each other, in any order."""
    draw = random.Random(4)
    text = lambda n: " ".join(draw.choices([f"w{i}" for i in range(60)], k=n))
    docs, items, slop = [(i, text(draw.randint(1, 60))) for i in range(40)], [(i, text(draw.choice([2, 9, 10, 14]))) for i in range(8)], 6
    words = {d: split(t) for d, t in docs}
    count = {}
    for w in words.values():
        for x in w:
            count[x] = count.get(x, 0) + 1
    want = {d: set() for d, _ in docs}
    for i, t in items:
        v = split(t)
        k = min(10, len(v))
        for s in range(len(v) - k + 1):
            if not all(x in count for x in v[s : s + k]):
                continue
            a, b = (v[j] for j in sorted(range(s, s + k), key=lambda j: (count[v[j]], j))[:2])
            for d, w in words.items():
                if a != b and any(x == a and y == b and abs(p - q) <= slop for p, x in enumerate(w) for q, y in enumerate(w)):
                    want[d].add(i)
    out = D.contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), slop=slop)
    assert {r.doc_id: r.n_near for r in out.collect()} == {d: len(i) for d, i in want.items()} and any(want.values())


@pytest.mark.parametrize("rows,size", [(0, 1 << 20), (1 << 20, 10)])
def test_without_broadcast(spark, monkeypatch, rows, size):
    docs = spark.createDataFrame([(1, "x a b c d e f g h i j y"), (2, "a b c d e f g h i"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([("k" * 50, "a b c d e f g h i j"), (None, "y"), ("z", "")], "item_id string, text string")
    want = sorted(D.contamination(docs, items).collect())
    assert [(r.n_hit, r.n_items) for r in want] == [(11, 2), (0, 0), (0, 0)]
    monkeypatch.setattr(D, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(D.shared, "BROADCAST_BYTES", size)
    assert sorted(D.contamination(docs, items).collect()) == want
