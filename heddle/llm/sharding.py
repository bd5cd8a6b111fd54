"""Operator 1: global shuffle into shards by a two-pass external shuffle.

Pass one scatters the records uniformly over memory-sized buckets by a seeded hash (Spark's
exchange is the external scatter). Pass two takes each bucket, which fits in a task by
construction, puts it in a canonical order, applies one Fisher-Yates shuffle with a generator
seeded by (seed, bucket), and writes it. The buckets in order are one global permutation; shard
boundaries are cut from it so that shards differ by one row at most (law ``rows``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

SHARDS, BUCKET_BYTES, SEED = 24, 8 << 20, 20240229
#: Tasks of the second pass at most, and buckets whose row counts are added up together.
MOST_TASKS, BLOCK = 100_000, 4096
WORKING = {"bucket", "pos", "_scatter", "shard", "slot", "_rows", "_start", "_total", "_block", "_before"}


def record_bytes(text: F.Column) -> F.Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def shuffled_buckets(df: DataFrame, size: F.Column, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Every row once, with ``bucket`` and ``pos`` (place within the shuffled bucket), written to
    the shared folder.

    The hash covers the row's place in the table (its file and row, however the scan is split; for other
    frames its place in the scan), not its content: repeated rows, null keys and
    groups of copies scatter as evenly as anything else, so no bucket outgrows bucket_bytes by
    more than chance and one record. ``df`` must be a stable scan (a table), whose rows have the
    same places when a task is run again. Extra columns are kept, those named like working ones with
    ``in_`` before the name. An empty table gives no bucket.
    """
    df = shared.set_aside(df, WORKING)[0]
    total = df.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, -(-int(total) // bucket_bytes))
    try:
        place = [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
        df.select(*place).schema  # noqa: B018  only files have them
    except AnalysisException:
        place = [F.monotonically_increasing_id()]
    scattered = df.withColumn("_scatter", F.xxhash64(F.lit(seed), *place)).withColumn("bucket", F.pmod(F.col("_scatter"), F.lit(buckets)).cast("int"))
    # A task's share of buckets doesn't grow with the table.
    tasks = min(max(buckets, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), MOST_TASKS)

    def fisher_yates(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        canonical = np.argsort(group.column("_scatter").to_numpy(), kind="stable")
        draw = np.random.Generator(np.random.PCG64([seed, bucket]))
        order = np.arange(len(canonical))
        draw.shuffle(order)  # numpy's shuffle is Fisher-Yates
        rows = group.drop_columns(["_scatter"]).take(pa.array(canonical[order]))
        return rows.append_column("pos", pa.array(np.arange(len(order), dtype=np.int64)))

    schema = T.StructType([f for f in scattered.schema if f.name != "_scatter"] + [T.StructField("pos", T.LongType())])
    return shared.stored(scattered.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(fisher_yates, schema), "shuffled")


def cut_shards(shuffled: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Adds ``shard`` and ``slot``: the global order cut into equal runs, the first ones a row
    longer where the count doesn't divide. Only the buckets' row counts, one small row each, are
    added up, within blocks of BLOCK buckets and then over the blocks; records are not moved again."""
    counts = shuffled.groupBy("bucket").agg(F.count("*").alias("_rows")).withColumn("_block", F.floor(F.col("bucket") / BLOCK))
    blocks = counts.groupBy("_block").agg(F.sum("_rows").alias("_before"))
    blocks = blocks.select("_block", (F.sum("_before").over(Window.orderBy("_block")) - F.col("_before")).alias("_before"))
    within = F.sum("_rows").over(Window.partitionBy("_block").orderBy("bucket")) - F.col("_rows")
    starts = counts.withColumn("_start", within).join(blocks, "_block").select("bucket", "_rows", (F.col("_start") + F.col("_before")).alias("_start"))
    total = counts.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("_total"))
    # Both are a row for each bucket, or one row: at 8 MB a bucket 100 TB make 13 million of them,
    # so Spark broadcasts them only while they are below its own threshold.
    placed = shuffled.join(starts.crossJoin(F.broadcast(total)), "bucket")
    at, base, longer = F.col("_start") + F.col("pos"), F.floor(F.col("_total") / shards), F.col("_total") % shards
    head = longer * (base + 1)
    shard = F.when(at < head, F.floor(at / (base + 1))).otherwise(longer + F.floor((at - head) / F.greatest(base, F.lit(1))))
    first = shard * base + F.least(shard, longer)
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", (at - first).cast("long")).drop("_rows", "_start", "_total")


def shard_documents(df: DataFrame, text: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Rows of ``df`` in shuffled order with ``shard`` (0 to shards-1) and ``slot`` (gapless from 0
    in each shard). Null and empty texts weigh 8 bytes and are kept; repeated rows are kept; an
    empty table gives an empty result; input columns named like the working ones get ``in_``."""
    out = cut_shards(shuffled_buckets(df, record_bytes(F.col(text)), seed, bucket_bytes), shards)
    return out.drop("bucket", "pos")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, rows sorted by slot. A bucket's rows lie in one shard or two, so
    each task writes few files and nothing is exchanged."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return shard_documents(docs).select(
        "doc_id",
        record_bytes(F.col("text")).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
