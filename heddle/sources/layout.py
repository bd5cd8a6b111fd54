"""Physical layouts: rows numbered over a whole table, and tables bucketed by the key of their joins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import scratch, stored


def positions(df: DataFrame, order: list[Column], name: str = "at") -> DataFrame:
    """``df`` in order, each row with its place from 0. Rows are sorted in ranges, and only the ranges' sizes, a row
    for each partition, are added up; no value of the order's first columns, however frequent, is sorted alone. Rows that are equal in all
    of ``order`` are numbered in any order. A column called ``name`` is replaced."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.drop(name).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kept = stored(ranged.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33)), "positions")
    sizes = kept.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return kept.join(starts, "_part").withColumn(name, F.col("_before") + F.col("_row") - F.shiftleft("_part", 33)).drop("_row", "_part", "_before")


def bucketed(df: DataFrame, name: str, key: str, buckets: int | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """``df`` as a table in buckets of ``key``, sorted by it (and ``also``) within: joins and groups by the key with other tables of as many
    buckets move no rows and sort none. Files lie in the shared folder. For a key with a hot value choose another layout: a bucket is read by one task."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key, *also).option("compression", "zstd").option("path", scratch(spark, name)).format("parquet").saveAsTable(table)
    return spark.table(table)
