import zlib
from collections import Counter

from heddle.llm import sharding


def check(rows, docs, shards=24):
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in docs)
    sizes = Counter(r.shard for r in rows)
    counts = [sizes[s] for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = sharding.op1_shards(spark, sf).collect()
    check(rows, docs)
    texts = dict(docs)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)


def test_many_buckets_nulls_ties_and_clashes(spark):
    docs = [(None if i % 3 == 0 else i % 7, None if i % 5 == 0 else "" if i % 5 == 1 else "x" * (i % 50), i, i) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, bucket int, pos int").repartition(3)
    out = sharding.shard_documents(df, shards=7, bucket_bytes=500)
    assert {"in_bucket", "in_pos"} <= set(out.columns)
    check(out.collect(), [(d[0], d[1]) for d in docs], 7)
    order = [r.in_bucket for r in out.orderBy("shard", "slot").collect()]
    assert order != sorted(order)


def test_names_that_clash_stay(spark):
    names = ["shard", "slot", "_rows", "_Start", "_total", "bucket", "in_bucket", "_block"]
    rows = [(i, "t", *[i * 10 + k for k in range(len(names))]) for i in range(20)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, {', '.join(f'{n} int' for n in names)}")
    out = sharding.shard_documents(df, shards=3)
    check(out.collect(), [(r[0], r[1]) for r in rows], 3)
    for r in out.collect():
        assert (r.in_shard, r.in_slot, r.in__rows, r.in__Start, r.in__total, r.in_in_bucket, r.in_bucket, r.in__block) == tuple(r.doc_id * 10 + k for k in range(len(names)))


def test_order_does_not_follow_the_splits(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    one = sorted((r.shard, r.slot, r.doc_id) for r in sharding.shard_documents(df, bucket_bytes=100_000).collect())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    two = sorted((r.shard, r.slot, r.doc_id) for r in sharding.shard_documents(df, bucket_bytes=100_000).collect())
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert one == two


def test_more_shards_than_rows_and_empty(spark):
    df = spark.createDataFrame([(i, "a") for i in range(3)], "doc_id long, text string")
    check(sharding.shard_documents(df, shards=5).collect(), [(i, "a") for i in range(3)], 5)
    assert sharding.shard_documents(df.filter("false"), shards=5).count() == 0


def test_same_seed_same_order(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    a, b, c = (sorted((r.shard, r.slot, r.doc_id) for r in sharding.shard_documents(df, seed=s).collect()) for s in (1, 1, 2))
    assert a == b != c


def test_written_shards(spark, sf, tmp_path):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    sharding.write_shards(sharding.shard_documents(df, shards=4), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == df.count() and back.select("shard").distinct().count() == 4
