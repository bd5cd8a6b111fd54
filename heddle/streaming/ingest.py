"""Structured Streaming forms of ingest and assembly (ST03-ST07, ST12), equal to their batch forms.

A stream reads what there is and stops. It can be started again from its checkpoint: batches that
were committed are not read again, and one that wasn't is run again under its number and writes what it wrote
before. No null key or text stops a stream; rows that repeat are told apart only by what is said below; without input the
result is empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import assembly as A
from ..sources.tables import scratch
from .deltas import Deltas

#: Article numbers of a folder of stored headers.
RANGE = 1 << 20
#: Folders that a batch's look-up names at most; a batch that touches more reads all.
NAMED = 1000
#: Where open sessions are kept: on executors' disks, in a fixed share of memory outside the heap. Spark's default holds each of them in the heap.
SESSION_STATE = {
    "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "rocksdb.changelogCheckpointing.enabled": "true",
    "rocksdb.boundedMemoryUsage": "true",
    "rocksdb.maxMemoryUsageMB": "500",
}
EVENTS = ("settled", "aged_out")


def each_batch(path: str, like: DataFrame, out: str, fold: Callable[[DataFrame, int], None], files: int = 8):
    """Runs ``fold(batch, number)`` over files that aren't committed yet; returns the query."""
    stream = like.sparkSession.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)
    query = stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


@contextmanager
def state_kept(spark: SparkSession, options: dict[str, str]) -> Iterator[None]:
    """Streams that start in here keep their state so; the session is afterwards as it was."""
    names = {f"spark.sql.streaming.stateStore.{k}": v for k, v in options.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def exists(spark: SparkSession, path: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def stored_headers(like: DataFrame, out: str) -> DataFrame:
    """What stream_ingest() has stored under ``out``, with the folder's columns range and batch."""
    spark = like.sparkSession
    schema = T.StructType([*like.schema.fields, T.StructField("range", T.LongType()), T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).parquet(out) if exists(spark, out) else spark.createDataFrame([], schema)


def stream_ingest(headers_path: str, like: DataFrame, out: str | None = None, files: int = 8) -> DataFrame:
    """ST04: header files as a stream. Of rows of one natural key in a batch the one with the smallest message id stays (as S05), unless
    an earlier batch has stored one. No state is kept in Spark: a batch is compared with stored rows of the ranges of article numbers
    it touches, which are folders of the table, so that what it reads follows from what it brings and not from how long the stream has run."""
    out = out or scratch(like.sparkSession, "ingested")

    def fold(batch: DataFrame, number: int) -> None:
        new = A.distinct_on(batch, A.NATURAL, "message_id").withColumn("range", F.floor(F.col("article_number") / RANGE))
        touched = [r[0] for r in new.select("range").distinct().limit(NAMED + 1).collect()]
        before = stored_headers(like, out).filter(F.col("batch") < number)
        if len(touched) <= NAMED:
            before = before.filter(F.col("range").isin([t for t in touched if t is not None]) | F.col("range").isNull())
        fresh = A.not_existing(new, before, A.NATURAL).withColumn("batch", F.lit(number).cast("long"))
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("range", "batch").parquet(out)

    each_batch(headers_path, like, out, fold, files)
    return stored_headers(like, out).select(*like.columns)


def stream_assemble(parts_path: str, like: DataFrame, out: str | None = None, files: int = 8) -> DataFrame:
    """ST05, ST12: parts in any order as a stream. What binaries keep of each batch is a delta under the batch's number; deltas are
    compacted as they come (Deltas), so reading touches few tables, however many batches there were. Late articles count as
    any. The deltas merge to the binaries (A03), single ones and collections."""
    out = out or scratch(like.sparkSession, "deltas")
    deltas = Deltas(like.sparkSession, out, A.partials(like).schema, A.merged)
    each_batch(parts_path, like, out, lambda batch, number: deltas.add(A.partials(batch), number), files)
    return A.merge_partials(deltas.read())


def watermark_advance(headers_path: str, like: DataFrame) -> DataFrame:
    """ST03: the last position of each group after the batches that were committed. Each is written under its
    number before the stream's checkpoint moves on: one that fails leaves the position where it was and is
    run again into the same place."""
    spark, out = like.sparkSession, scratch(like.sparkSession, "positions")
    kinds = [like.schema[c].dataType for c in ("group_id", "article_number")]
    highest = lambda rows: rows.groupBy("group_id").agg(F.max("position").alias("position"))
    deltas = Deltas(spark, out, T.StructType([T.StructField("group_id", kinds[0]), T.StructField("position", kinds[1])]), highest)
    each_batch(headers_path, like, out, lambda batch, number: deltas.add(highest(batch.select("group_id", F.col("article_number").alias("position"))), number))
    return highest(deltas.read())


def stream_idle(parts_path: str, like: DataFrame, released: DataFrame, quiet: str, stale: str, out: str | None = None, files: int = 8, events: tuple[str, ...] = EVENTS) -> DataFrame:
    """ST06, ST07: what becomes of binaries when no article comes any more, as rows (binary_id, event, idle_since, parts, files). Each binary's
    articles form sessions with gaps ``quiet`` and ``stale``: once the stream's time, which other binaries' articles carry on, has passed the
    last article by such a gap, Spark closes the session and drops its state. A quiet session of a collection of unknown size settles it; a
    stale one ages out what isn't complete and isn't in ``released`` (binary_id), which is looked up when the session closes.
    Each of the ``events`` is a stream of its own. An article with a later time begins another session. Time is posted_at, in order up to ``quiet`` over all binaries: what comes later still
    reopens nothing here, though ST05 counts it."""
    spark, out = like.sparkSession, out or scratch(like.sparkSession, "idle")
    have = F.when(F.col("single"), F.col("parts")).otherwise(F.col("files"))
    full = F.when(F.col("single"), F.col("total_parts") == 0).otherwise(F.lit(False)) | ((F.col("total_parts") > 0) & (have >= F.col("total_parts")))
    closed = T.StructType([T.StructField("binary_id", T.StringType()), T.StructField("event", T.StringType()), T.StructField("idle_since", T.TimestampType()), T.StructField("parts", T.LongType()), T.StructField("files", T.LongType()), T.StructField("total_parts", T.IntegerType()), T.StructField("single", T.BooleanType())])

    def sessions(rows: DataFrame, event: str, gap: str) -> DataFrame:
        window = F.session_window("at", gap)
        # A set of at most as many numbers as the release has files.
        return rows.groupBy("binary_id", window).agg(F.max("at").alias("idle_since"), F.count("*").alias("parts"), F.size(F.collect_set("file_number")).cast("long").alias("files"), F.max("total").alias("total_parts"), F.min(F.col("collection_key") == "").alias("single")).select("binary_id", F.lit(event).alias("event"), "idle_since", "parts", "files", "total_parts", "single")

    for event in events:
        gap = dict(zip(EVENTS, (quiet, stale), strict=True))[event]
        stream = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(parts_path)
        total = F.when(F.col("collection_key") != "", F.col("collection_files")).otherwise(F.col("total_parts")).cast("int")
        rows = A.link_parts(stream).filter("binary_id IS NOT NULL").withColumns({"at": F.col("posted_at").cast("timestamp"), "total": total}).withWatermark("at", quiet)
        done = sessions(rows, event, gap)

        def keep(batch: DataFrame, number: int, event: str = event) -> None:
            if event == "settled":
                found = batch.filter((F.col("total_parts") == 0) & ~F.col("single"))
            else:
                found = batch.filter(~full).join(released.select("binary_id"), "binary_id", "left_anti")
            found.select(*closed.fieldNames()).write.mode("overwrite").parquet(f"{out}/event={event}/batch={number}")

        with state_kept(spark, SESSION_STATE):
            query = done.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{out}-state-{event}").trigger(availableNow=True).start()
        query.awaitTermination()
    found = spark.read.schema(closed).option("recursiveFileLookup", "true").parquet(out) if exists(spark, out) else spark.createDataFrame([], closed)
    return found.select("binary_id", "event", F.col("idle_since").cast("timestamp_ntz").alias("idle_since"), "parts", "files")
