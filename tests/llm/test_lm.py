import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from heddle.llm import lm
from pyspark.sql import functions as F


def brute(docs, held):
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) + [None] for _, t in docs]
    count = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
    total, distinct = sum(count.values()), len(count)
    return [(len(ws), sum(w in count for w in ws), total, sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws)) for ws in words]


def test_whole_table_against_brute_force_and_held_out_gain(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = dict(zip([d for d, _ in docs], brute(docs, [zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in docs]), strict=True))
    rows = lm.op4_lm_score(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, k, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, k, total, zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    out = [r for r in rows if r.held_out]
    base, score = (sum(getattr(r, c) for r in out) / sum(r.n_tokens for r in out) for c in ("base_score", "score"))
    print("log10 a held-out token: base", base, "model", score)
    assert score > base + 0.02


def one_hash(word, last=0):
    """Hash of a word's bytes or last bytes, alone in an array."""
    return int(next(hs for _, hs in lm.wordhash.stemmed(pa.array([word]), (last,)))[0][0])


def brute_scores(docs, held, weights):
    """Scores in plain Python, given the trained weights: contexts, both softmaxes and shares word by word."""
    fold = {c: c + 32 for c in range(65, 91)}
    texts = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold)) + [None] for _, t in docs]
    count = Counter(w for ws, h in zip(texts, held, strict=True) if not h for w in ws)
    kind = lambda w: 0 if w is None else lm.CLASSES + one_hash(w, lm.TAIL) % (lm.KINDS - lm.CLASSES)
    ident = lambda w: int(lm.END) if w is None else one_hash(w)
    mask, mixed = (1 << 64) - 1, lambda x, seed=0: int(lm.wordhash.mixed(np.array([x], np.uint64), seed)[0])

    def softmax(keys, at):
        rows = [weights[k >> (64 - lm.ROW_BITS)] for k in keys]
        e = [math.exp(max(-20, min(20, sum(float(r[c]) for r in rows)))) for c in range(lm.CLASSES)]
        return e[at] / sum(e)

    in_kind = Counter()
    for w, c in count.items():
        in_kind[kind(w)] += c + 0.1
    out = []
    for ws in texts:
        score = 0.0
        for i, w in enumerate(ws):
            one, two = (ident(ws[j]) if j >= 0 else int(lm.START) for j in (i - 1, i - 2))
            k1, k2 = (kind(ws[j]) if j >= 0 else 0 for j in (i - 1, i - 2))
            keys = [mixed(one, 0xF00), mixed((one * lm.wordhash.BASE + two) & mask, 0xF01), mixed(two, 0xF02), mixed(k1 * lm.KINDS + k2, 0xF03)]
            k = kind(w)
            score += math.log10(softmax(keys, k // lm.CLASSES))
            if w is not None:
                own = mixed(k // lm.CLASSES + 1)
                score += math.log10(softmax([(x ^ own) * lm.wordhash.BASE & mask for x in keys], k % lm.CLASSES))
                score += math.log10((count[w] + 0.1) / (in_kind[k] + 0.1))
        out.append(score)
    return out


def test_scores_against_brute_force(spark, monkeypatch):
    seen, keep = [], lm.averaged
    monkeypatch.setattr(lm, "averaged", lambda *a: seen.append(keep(*a)) or seen[-1])
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(40)
    docs = [(r.doc_id, (r.text or "")[:600]) for r in table.collect()] + [(900, None), (901, "A a\tÉ é")]
    held = [d % 5 == 0 for d, _ in docs]
    rows = lm.scored(spark.createDataFrame([(*d, h) for d, h in zip(docs, held, strict=True)], "doc_id long, text string, held_out boolean").repartition(3))
    got = {r.doc_id: r.score for r in rows.collect()}
    assert len(seen) == 2 and np.abs(seen[0]).max() > 0 and not np.array_equal(*seen)  # two rounds
    for (d, _), want in zip(docs, brute_scores(docs, held, seen[-1]), strict=True):
        assert got[d] == pytest.approx(want, rel=1e-5)


def test_probabilities_add_up():
    t = lm.Tokens(pa.array(["a b c", None, "x y"]))
    assert t.length.tolist() == [4, 1, 3] and (t.kind == 0).sum() == 3
    w = np.random.default_rng(0).normal(size=(lm.ROWS, lm.CLASSES)).astype(np.float32)
    assert all(np.allclose(lm.softmax(w, f).sum(axis=1), 1, atol=1e-5) for f in t.features(0, 8))
    again = lm.Tokens(pa.array(["x y"]))
    for level in (0, 1):
        assert np.array_equal(again.features(0, 3)[level], t.features(5, 8)[level])  # texts don't see each other
        assert np.array_equal(np.concatenate([t.features(i, i + 1)[level] for i in range(8)], axis=1), t.features(0, 8)[level])


def test_chances_of_all_words_and_the_unknown_add_up():
    """After one context: over known words, an unknown one of each part, and the end."""
    known = [f"w{i}" for i in range(400)]
    w = np.random.default_rng(1).normal(size=(lm.ROWS, lm.CLASSES)).astype(np.float32)
    kinds = lm.Tokens(pa.array([" ".join(known)])).kind[:-1]
    total = 0.0
    for word, k in zip(known, kinds, strict=True):
        n = (kinds == k).sum()
        share = 1.1 / (n * 1.1 + 0.1)
        total += 10 ** lm.chances(w, lm.Tokens(pa.array([f"before this {word}"])), 2, 3)[0] * share
    unknown = {}
    for i in range(5000):  # a word of each part, whose share is what the known ones leave
        t = lm.Tokens(pa.array([f"before this u{i}"]))
        unknown.setdefault(int(t.kind[2]), t)
    assert len(unknown) == lm.KINDS - lm.CLASSES
    for k, t in unknown.items():
        n = (kinds == k).sum()
        total += 10 ** lm.chances(w, t, 2, 3)[0] * 0.1 / (n * 1.1 + 0.1)
    total += 10 ** lm.chances(w, lm.Tokens(pa.array(["before this"])), 2, 3)[0]
    assert total == pytest.approx(1, abs=1e-4)


def test_odd_rows(spark):
    rows = [(None, None, True, 1), (1, "", False, 1), (1, "", False, 1), (2, "One two " * 200_000, False, 1), (3, "two three", True, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean, words int").repartition(2)
    got = sorted(((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in lm.scored(df).collect()), key=str)
    assert got == sorted(((*x[:3], round(x[3], 3)) for x in brute([r[:2] for r in rows], [r[2] for r in rows])), key=str)
    assert lm.scored(df.filter("false")).count() == 0
    assert {r.n_known for r in lm.scored(df.filter("held_out")).collect()} == {0}


def test_batches_are_stored_and_moved_in_small_rows(spark, monkeypatch):
    """Whatever the number of batches that a task reads, writes or sends to Python, it holds few rows, and these are small."""
    monkeypatch.setitem(lm.WIDE, "parquet.block.size", 1 << 20)
    monkeypatch.setattr(lm, "PACK", 5000)
    docs = [(i, " ".join(f"w{i * 7919 + k * 104729:x}" for k in range(2500)), i % 9 == 0) for i in range(400)]  # 8 MB, hardly a word twice
    df = spark.createDataFrame(docs, "doc_id long, text string, held_out boolean").repartition(1)
    table = lm.batched(df.select("doc_id", "held_out", "text"), np.zeros((lm.ROWS, lm.CLASSES), np.float32))
    largest = table.agg(F.max(F.octet_length("places") + F.octet_length("kinds") + 8 * F.size("words"))).first()[0]
    assert largest < 4 * lm.CHUNK and 1 < table.select("batch").distinct().count() < table.count()
    groups = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in table.inputFiles()]
    assert max(g.row_group(i).total_byte_size for g in groups for i in range(g.num_row_groups)) < 4 << 20
    out = lm.scored(df)
    assert "collect_list" not in out._jdf.queryExecution().toString()
    got = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in out.collect()}
    assert got == {d[0]: (*x[:3], round(x[3], 3)) for d, x in zip(docs, brute([d[:2] for d in docs], [d[2] for d in docs]), strict=True)}
