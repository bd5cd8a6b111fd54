"""Reading tables, and tables written to the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the operators' contracts, as a Java pattern.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only where that is unset and Spark runs locally (tests, a laptop) a
    new local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes the scratch tables of this application, once what was made of them is written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """The rows written as a table to the shared folder and read again: later steps start from
    files that every executor can read, so a lost executor costs only its own tasks. ``options`` are the writer's."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of strings in a table that may be broadcast.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, rows: int) -> bool:
    """Whether a stored table may be broadcast: at most ``rows`` rows, and BROADCAST_BYTES of strings in all."""
    length = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"), F.lit(0).cast("long"))
    found = df.agg(F.count("*").alias("n"), F.sum(length).alias("bytes")).first()
    return found["n"] <= rows and (found["bytes"] or 0) <= BROADCAST_BYTES


#: Parts of a key's rows in a join that can't be broadcast.
SALTS = 16


def met(big: DataFrame, few: DataFrame, key: str, rows: int, how: str = "inner") -> DataFrame:
    """``big`` joined with ``few`` (a stored table with few rows for each key): broadcast if its counted rows and bytes allow it; else
    the rows of each key are dealt over SALTS parts, so that a hot key is split whatever the planner sees."""
    if small(few, rows):
        return big.join(F.broadcast(few), key, how)
    salt = names_free(big.join(few.limit(0), key, how), "_salt")["_salt"]
    dealt = big.withColumn(salt, (F.rand(SALTS) * SALTS).cast("int"))
    return dealt.join(few.withColumn(salt, F.explode(F.array(*map(F.lit, range(SALTS))))), [key, salt], how).drop(salt)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. lower() does just that on ASCII; translate() is for the rest."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def names_free(df: DataFrame, *wanted: str) -> dict[str, str]:
    """For each wanted working column a name that the rows don't have already."""
    have, out = {c.lower() for c in df.columns}, {}
    for w in wanted:
        name = w
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out[w] = name
    return out


def set_aside(df: DataFrame, reserved: set[str], keep: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns that are named like ``reserved`` ones (but for ``keep``) under ``in_`` names that are
    free, and what they were called before: {new: old}."""
    taken, back = {c.lower() for c in df.columns} | reserved, {}
    for c in df.columns:
        if c.lower() in reserved and c not in keep:
            name = f"in_{c}"
            while name.lower() in taken:
                name = f"in_{name}"
            taken.add(name.lower())
            back[name] = c
    return df.withColumnsRenamed({old: new for new, old in back.items()}), back


#: Bits of the filter that narrowed() broadcasts: 2 MB, whatever the input.
FILTER_BITS = 1 << 24


def narrowed(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key may be among ``keys`` (one column), without moving the others.

    The keys set bits of a bitmap of FILTER_BITS, broadcast as at most 512 rows of 4 KB. Rows that
    pass by chance remain, so an exact join follows; with very many keys all rows pass and that
    join alone decides.
    """
    used = names_free(df, "bit", "bucket", "bitmap")
    bit, bucket, bitmap = used["bit"], used["bucket"], used["bitmap"]
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)) + 1
    maps = (
        keys.select(at(keys[keys.columns[0]]).alias(bit))
        .groupBy(F.bitmap_bucket_number(bit).alias(bucket))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias(bitmap))
    )
    out = df.withColumn(bit, at(key)).withColumn(bucket, F.bitmap_bucket_number(bit)).join(F.broadcast(maps), bucket)
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return out.filter(F.getbit(byte, (place % 8).cast("int")) == 1).select(*[df[c] for c in df.columns])


def without(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose column ``key`` isn't among ``keys`` (one column of that name). Only rows that
    the bitmap of narrowed() can't clear are moved; ``df`` should be a stored table, as it is read twice."""
    used = names_free(df, "bit", "bucket", "bitmap")
    bit, bucket, bitmap = used["bit"], used["bucket"], used["bitmap"]
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)) + 1
    maps = keys.select(at(F.col(key)).alias(bit)).groupBy(F.bitmap_bucket_number(bit).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias(bitmap))
    out = df.withColumn(bit, at(F.col(key))).withColumn(bucket, F.bitmap_bucket_number(bit)).join(F.broadcast(maps), bucket, "left")
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    clear = out.filter(F.col(bitmap).isNull() | (F.getbit(byte, (place % 8).cast("int")) == 0)).select(*df.columns)
    return clear.unionByName(narrowed(df, F.col(key), keys).join(keys, key, "left_anti").select(*df.columns))
