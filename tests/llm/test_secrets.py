import hashlib
import random
import re

from heddle.llm import secrets as S


def test_finds_the_assigned_tokens(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted((d, hashlib.sha256(m.encode()).hexdigest()) for d, t in docs for m in re.findall(r'token = "([0-9a-f]{40})"', t))
    rows = S.op3_secret_scan(spark, sf).collect()
    assert sorted((r.doc_id, r.value_sha256) for r in rows if r.is_secret) == want and want
    every = [m for _, t in docs for w in re.split(r"[\x20\x09-\x0D]+", t) if len(w) >= 16 and re.search("[0-9]", w) for m in re.findall(S.CANDIDATE % S.LEAST, w) if re.search("[0-9]", m)]
    assert len(rows) == len(every) > len(want)


def test_reviewed_findings_decide(spark):
    draw = random.Random(1)
    key = lambda: "".join(draw.choices("abcdef0123456789", k=32)) + "9"
    rows, found = [], []
    for i in range(200):
        k = key()
        rows.append((i, f'checksum {k} ok' if i % 2 else f'api_key: "{k}" end', "src/a.py", 1))
        found.append((i, k, 1 - i % 2))
    docs = spark.createDataFrame(rows + [(None, None, None, None), (900, "", "", 0), (1, rows[1][1], "x", 1), (901, "9" * 100_000 + " a" * 100_000, "test/x", 0)], "doc_id long, text string, source string, label int")
    out = S.scan(docs, spark.createDataFrame(found, "doc_id long, value string, label int").filter("doc_id % 3 > 0")).collect()
    held = [r for r in out if r.doc_id is not None and r.doc_id < 200 and r.doc_id % 3 == 0]
    assert all(r.is_secret == (r.doc_id % 2 == 0) for r in held) and len(held) >= 60
    assert len(out) == 202
    only = spark.createDataFrame([(1, found[1][1], 0)], "doc_id long, value string, label int")
    assert {r.is_secret for r in S.scan(docs, only).collect()} == {False}
    assert {r.is_secret for r in S.scan(docs, only.filter("false")).collect()} == {True}
    assert S.scan(docs.filter("false")).count() == 0


def plain_features(text, source, known):
    """(word, part, value) to features of each candidate, but for the hashed neighbours, in plain Python."""
    words, out = re.split(r"[\x20\x09-\x0D]+", text or ""), {}
    share = lambda v, p: 1 - len(re.sub(p, "", v)) / len(v)
    for i, w in enumerate(words):
        if len(w) < 16 or not re.search("[0-9]", w):
            continue
        for part, v in enumerate(re.findall(S.CANDIDATE % 16, w)):
            if not re.search("[0-9]", v):
                continue
            near = lambda k: words[i + k] if 0 <= i + k < len(words) else ""  # noqa: B023, E731
            seen = " ".join([near(-2), near(-1), w.partition(v)[0]])
            out[i, part, v] = {
                "length": len(v), "runs": len(re.sub("[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+", "x", v)) / len(v), "digits": share(v, "[0-9]"), "upper": share(v, "[A-Z]"),
                "distinct": len(set(v)) / len(v), "syllables": share(v.lower(), "[b-df-hj-np-tv-z][aeiou]"), "coverage": share(v.lower(), "|".join(sorted(known, key=lambda x: (-len(x), x)))),
                "slashes": w.count("/"), "dots": w.count("."), "at": "@" in w, "depth": (source or "").count("/"), "testing": bool(re.search(S.TESTING, source or "")),
                "assigned": bool(re.search(r"[=:]\s*[\"']?$", seen)), "quoted": bool(re.search("^[^A-Za-z0-9]*[\"'`]", w)), "named": bool(re.search(S.NAMED, seen)),
            }
    return out


def test_features_against_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known, want = S.dictionary(docs), {}
    for r in docs.collect():
        for k, v in plain_features(r.text, r.source, known).items():
            want[r.doc_id, *k] = v
    rows = S.candidates(docs, known).collect()
    assert len(rows) == len(want) > 40
    for r in rows:
        for name, value in want[r.doc_id, r.word, r.part, r.value].items():
            assert abs(r[name] - value) < 1e-9, (name, r)


def test_false_positives_go(spark):
    """Numbers, paths and checksums beside keys: precision on documents that the forest hasn't seen."""
    draw = random.Random(2)
    hexa = lambda n: "".join(draw.choices("0123456789abcdef", k=n))
    rows = []
    for i in range(600):
        kind = i % 4
        rows.append((i, f'some words api_key = "{hexa(40)}" more' if kind == 0 else f"call {draw.randrange(10**17)}123 now" if kind == 1 else f"see /usr/lib/module{i}/file_name_{i}.txt there" if kind == 2 else f"build_number_{i}_release_{i} done", "a/b"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = S.known_forms(S.candidates(docs, ["some", "words"]))
    out = S.classified(found.filter("doc_id % 5 = 0"), found.filter("doc_id % 5 > 0"))
    r = S.precision(out).first()
    assert r.before < 0.4 and r.after > 0.98 and r.recall > 0.98


def test_shorter_candidates_and_such_without_digits(spark):
    docs = spark.createDataFrame([(1, 'pwd = "hunter2hunter" and abcdefghijklmnopqrst')], "doc_id long, text string")
    value = lambda **k: sorted(r.value for r in S.candidates(docs, [], path=None, **k).collect())
    assert value() == [] and value(least=10) == ["hunter2hunter"] and value(digit=False) == ["abcdefghijklmnopqrst"]
