"""Tables written to the folder that driver and executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:  # tests and laptops
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes this application's scratch tables, once what was made of them is written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _KNOWN.clear()


def stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of the tables in a folder: other ones after a table has changed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)))


def free(name: str, *frames: DataFrame) -> str:
    """A name for a working column that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def held(df: DataFrame) -> tuple[DataFrame, Column]:
    """``df`` and a condition, always true, that keeps a filter which holds it from being pushed below ``df``'s columns, so that dear
    ones are computed once and not in the filter again. Nothing is written."""
    name = free("_held", df)
    return df.withColumn(name, F.monotonically_increasing_id()), F.col(name) >= 0


def stored(df: DataFrame, name: str) -> DataFrame:
    """Parts, binaries and releases are tables: they are parsed and folded once and read many times.
    It also keeps filters on parsed fields from being pushed into, and so repeating, the parser."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folder(table: DataFrame) -> str:
    """Where a stored table lies."""
    return table.inputFiles()[0].rsplit("/", 1)[0]


_KNOWN: dict[tuple, DataFrame] = {}


def once(spark: SparkSession, sf_dir: str, name: str, make, store=stored) -> DataFrame:
    """The table of this application and input, built at its first use and after the input has changed. What ``make`` gives is stored, unless
    it is read from a table of its own already; then ``store`` is as_it_is."""
    key = (spark.sparkContext.applicationId, sf_dir, name, stamp(spark, sf_dir))
    if key not in _KNOWN:
        _KNOWN[key] = store(make(), name)
    return _KNOWN[key]


def as_it_is(df: DataFrame, name: str) -> DataFrame:
    return df
