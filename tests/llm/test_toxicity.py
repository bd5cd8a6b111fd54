import numpy as np
import pyarrow as pa
from heddle.llm import toxicity as X


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = X.train(docs, labels.filter("doc_id % 3 <> 0"))
    out = X.scored(docs, model).join(labels.filter("doc_id % 3 = 0"), "doc_id").select("toxic", (X.F.col("severity") >= X.REJECT).alias("bad")).collect()
    right = sum(r.bad == bool(r.toxic) for r in out)
    assert right / len(out) > 0.95
    assert sum(r.bad for r in out if not r.toxic) <= 2


def test_ordered_grades():
    draw = np.random.default_rng(4)
    rows, grade = [], []
    for _ in range(2000):
        y = int(draw.integers(0, 4))
        rows.append(np.concatenate((draw.integers(100, 140, 5), np.arange(y * 3) if y else np.zeros(0, int))))
        grade.append(y)
    m = X.fit(rows, np.array(grade))
    assert np.all(np.diff(m.thresholds) > 0)
    got = [m.severity(r) for r in rows]
    assert np.mean([g == y for (_, g), y in zip(got, grade, strict=True)]) > 0.95
    assert all(0 <= s <= 3 for s, _ in got)
    means = [np.mean([s for (s, _), y in zip(got, grade, strict=True) if y == k]) for k in range(4)]
    assert means == sorted(means)


def test_stems_count_distinct_words():
    one, two = X.features(pa.array(["Abcdefg1 abcdefg, abcdefh", None]))
    assert len(one) == 4 and len(two) == 0 and (one >= X.PLACES // 2).sum() == 2


def test_nulls_ties_clashes_and_empty_tables(spark):
    schema = "doc_id long, text string, severity string, label int"
    docs = spark.createDataFrame([(1, "you idiot", "s", 1), (1, "you idiot", "s", 1), (None, None, None, None), (2, "", "s", 0), (3, "fine words " * 100_000, "s", 0)] + [(i, f"clean {i}", "s", 0) for i in range(4, 9)], schema)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None)] + [(i, 0) for i in range(4, 9)], "doc_id long, toxic int")
    kept = X.acceptable(docs, labels)
    assert kept.columns == docs.columns and kept.count() >= 8
    assert X.acceptable(docs, labels.filter("false")).count() == 10
    assert X.acceptable(docs.filter("false"), labels).count() == 0
    graded = labels.withColumn("level", X.F.col("toxic") * 2)
    assert len(X.train(docs, graded, grade="level").thresholds) == X.GRADES - 1


def test_query(spark, sf):
    rows = X.op2_toxicity(spark, sf).collect()
    assert len(rows) == 200 and all(r.rejected == (r.severity >= X.REJECT) for r in rows)


def brute_severity(text, model):
    """Expected grade by the model's own definition, a word at a time."""
    import math
    import re

    words = sorted(set(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.translate({c: c + 32 for c in range(65, 91)}))))
    half, one = X.PLACES // 2 - 1, lambda w, n: int(next(h for _, h in X.wordhash.stemmed(pa.array([w]), (n,), X.GAP))[0][0])
    count = {}
    for p in {one(w, 0) & half for w in words}:
        count[p] = 1
    for w in words:
        p = (one(w, X.STEM) & half) + half + 1
        count[p] = count.get(p, 0) + 1
    x = sum(float(model.weights[p]) * math.log2(1 + n) for p, n in count.items())
    at_most = [1 / (1 + math.exp(min(60, max(-60, x - t)))) for t in model.thresholds]
    return sum(1 - p for p in at_most)


def test_severity_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = X.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = X.scored(docs, model).collect()
    assert len(rows) == len(texts) and any(r.severity > 0.5 for r in rows)
    for r in rows:
        assert abs(r.severity - brute_severity(texts[r.doc_id] or "", model)) < 1e-3


def test_equal_texts_that_disagree_count_as_toxic_and_names_may_clash(spark):
    docs = spark.createDataFrame([(i, "vile words here" if i % 2 else "kind words there", 5, 6) for i in range(40)], "doc_id long, text string, _label int, label int")
    labels = spark.createDataFrame([(i, 1 if i in (1, 3) else 0, 9) for i in range(40)], "doc_id long, toxic int, text int")
    seen = [X.train(docs.repartition(n), labels) for n in (1, 4)]
    assert np.array_equal(seen[0].weights, seen[1].weights)
    got = {r.doc_id: r.severity for r in X.scored(docs, X.train(docs, labels)).collect()}
    assert len(got) == 40 and all(got[1] == got[i] for i in range(1, 40, 2))
