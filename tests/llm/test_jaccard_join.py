import random
import re

import numpy as np
import pyarrow as pa
from heddle.llm import jaccard_join as J
from heddle.llm import wordhash
from heddle.llm.components import connected


def brute(docs, k, num, den):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(docs)), key=str)


def corpus(seed, n):
    draw = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passage = draw.choices(vocab, k=30)
    docs = []
    for g in range(n):
        base = draw.choices(vocab, k=draw.choice([1, 3, 4, 5, 40, 80, 200]))
        if g % 3 == 0:
            base += passage
        for _ in range(draw.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 3])):
                w[draw.randrange(len(w))] = draw.choice(vocab)
            docs.append((len(docs) * 7 % 1009, draw.choice([" ", "\n", " \t"]).join(w)))
    docs += [(2000, None), (None, ""), (2001, "  "), (2002, "É a"), (2003, "é A"), (2004, "é a"), (None, docs[0][1]), (5, docs[3][1]), (5, "one two three four five six"), (5, "other words in a row with one id")]
    draw.shuffle(docs)
    return docs


def test_against_brute_force(spark):
    for seed, k, num in ((1, 4, 85), (2, 5, 80)):
        docs = corpus(seed, 60)
        df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, cid int, root int").repartition(3)
        got = sorted((tuple(r) for r in J.near_components(df, k=k, num=num).collect()), key=str)
        assert got == brute(docs, k, num, 100)


def test_near_copies_make_few_pairs(spark):
    draw = random.Random(9)
    base = [f"v{i}" for i in range(150)]
    docs = []
    for i in range(300):
        w = list(base)
        w[draw.randrange(150)] = f"x{i}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(r) for r in J.near_components(df).collect()) == sorted(brute(docs, 5, 80, 100))
    kept = J.one_of_each(df)
    assert [r.doc_id for r in kept.collect()] == [0] and kept.columns == df.columns


def test_empty_table(spark):
    assert J.near_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_word_hashes_long_and_cut():
    draw = random.Random(2)
    texts = [None, "", " ", "a", "A", "x" * 3_000_000, "ab cd\tEF\n" * 300_000, "é É", "b a"] + ["".join(draw.choices("aB \n", k=50)) for _ in range(200)]
    seen = {}
    for whole in (pa.array(texts), pa.chunked_array([pa.array(texts[:4]), pa.array(texts[3:]).slice(1)])):
        rows = list(wordhash.words(whole))
        assert [i for i, _ in rows] == list(range(len(texts)))
        for t, (_, h) in zip(texts, rows, strict=True):
            w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
            assert len(w) == len(h)
            for a, b in zip(w, h.tolist(), strict=True):
                assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)
    assert np.all(np.diff(wordhash.shingles(np.arange(10, dtype=np.uint64), 4).astype(object)) > 0)


def test_chain_and_star_components(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(500, 500)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {i: 7 for i in range(8, 40)}


def test_links_of_prefixes_that_end_apart(spark):
    """Appended, inserted and cut passages around the threshold, with and without many exact copies."""
    pair = [f"w{i}" for i in range(103)]
    for copies in (0, 40):
        docs = [(0, " ".join(pair)), (1, " ".join(pair + [f"own{i}" for i in range(15)]))] + [(10 + i, " ".join(pair)) for i in range(copies)]
        got = sorted((tuple(r) for r in J.near_components(spark.createDataFrame(docs, "doc_id long, text string"), k=4, num=85, den=100).collect()), key=str)
        assert got == brute(docs, 4, 85, 100) and {r[2] for r in got} == {0}
    draw = random.Random(5)
    docs = []
    for g in range(40):
        base = [f"g{g}w{i}" for i in range(draw.choice([60, 103, 160]))]
        new = [f"n{g}w{i}" for i in range(round(len(base) * draw.uniform(0.12, 0.2)))]
        at = draw.randrange(1, len(base))
        other = (base + new, new + base, base[:at] + new + base[at:], base[: len(base) - len(new)], base[len(new) :])[g % 5]
        docs += [(len(docs) + i, " ".join(w)) for i, w in enumerate([base, other] + [base] * draw.choice([0, 0, 20]) + [other] * draw.choice([0, 0, 20]))]
    got = sorted((tuple(r) for r in J.near_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), k=4, num=85, den=100).collect()), key=str)
    assert got == brute(docs, 4, 85, 100)


def test_crowds_around_hubs_with_differences_in_common(spark):
    """Near copies of an original, just within and just beyond the threshold, where many share the same
    other passage, the same gap or the same addition, and some lie nearer to each other than to it."""
    draw = random.Random(11)
    docs = []
    for g, n in enumerate((120, 150)):
        base = [f"g{g}w{i}" for i in range(n)]
        other = [f"o{g}w{i}" for i in range(8)]
        for kind in range(120):
            w = list(base)
            if kind % 4 == 1:
                w[30:38] = other
            elif kind % 4 == 2:
                del w[50:62]
            elif kind % 4 == 3:
                w += other[:6] + base[:4]
            for _ in range(draw.choice([0, 1, 2, 3, 3, 4, 5])):
                w[draw.randrange(len(w))] = f"x{len(docs)}y{draw.randrange(9)}"
            docs.append((draw.randrange(10**6), " ".join(w)))
            if kind % 10 == 0:  # a companion that differs in one word from this one
                w[draw.randrange(len(w))] = "z"
                docs.append((draw.randrange(10**6), " ".join(w)))
        docs += [(10**6 + g * 10 + i, " ".join(base)) for i in range(3)]
    for k, num in ((4, 85), (5, 80), (4, 92)):
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        got = sorted((tuple(r) for r in J.near_components(df, k=k, num=num).collect()), key=str)
        assert got == brute(docs, k, num, 100)


def test_repeated_rows_have_one_prefix(spark, monkeypatch):
    seen = {}
    keep = J.shared.stored
    monkeypatch.setattr(J.shared, "stored", lambda df, name: seen.setdefault(name, keep(df, name)))
    docs = [(1, "a b c d e f g h"), (2, "a b c d e f g i"), (None, "k l m n o p q")] * 50
    J.near_components(spark.createDataFrame(docs, "doc_id long, text string"))
    assert seen["prefixes"].count() == 3
