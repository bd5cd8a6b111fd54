import hashlib

import corpus_pipeline as P
import numpy as np
import public_tokenizers
import pytest
from heddle.llm import toxicity
from tokenizers import Tokenizer

from .test_decontamination import brute as leaks
from .test_exact_dedup import brute as copies  # noqa: F401  (same normalisation)
from .test_jaccard_join import brute as near


def reference(docs, keep, items):
    """The stages in plain Python, given the ids that toxicity keeps."""
    docs = [d for d in docs if d[0] in keep]
    first = {}
    for d, t in sorted(docs):
        import re

        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), (d, t))
    docs = sorted(first.values())
    docs = [d for d, (i, _, c) in zip(docs, sorted(near(docs, 5, 80, 100), key=lambda r: r[0]), strict=True) if i == c]
    bad = {r[0] for r in leaks(docs, items) if r[5]}
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for d, t in docs:
        if d not in bad:
            ids = lib.encode(t or "", add_special_tokens=False).ids
            out.append((d, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out)


def test_against_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in table.collect()]
    model = toxicity.train(table, spark.read.parquet(f"{sf}/labels.parquet"))
    keep = {r.doc_id for r in toxicity.scored(table, model).filter(f"severity < {toxicity.REJECT}").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = sorted(tuple(r) for r in P.run(spark, sf).collect())
    assert got == reference(docs, keep, items)
    assert 0 < len(got) < len(docs)


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_odd_rows_in_each_stage(spark, sf, name, stage, tmp_path):
    rows = [(None, None, None, None, None, "x"), (1, "", "en", "s", 0, None), (1, "", "en", "s", 0, None), (2, "one two " * 50_000, None, "s", 1, "y"), (3, "plain words here and there again", "en", None, 5, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row_key string")
    df.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    out = stage(spark, docs, sf)
    assert out.columns == (["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if name == "bpe" else docs.columns)
    assert {r.doc_id for r in out.collect()} >= {1, 2, 3} - ({1} if name == "exact_dedup" else set())
    assert stage(spark, docs.filter("false"), sf).count() == 0
