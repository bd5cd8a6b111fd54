"""A table kept by month: a folder for each, so scans prune to the months they need and jobs rewrite or drop whole months.

Rows without a time form a month of their own (null), which never expires. An empty table has no months. Repeated rows stay.
A column of the rows that is called like the month is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import stored

#: The month as a number, 199701.
MONTH = "ingest_month"
NONE = "__HIVE_DEFAULT_PARTITION__"


def month_of(at: str) -> Column:
    return (F.year(at) * 100 + F.month(at)).cast("int")


@dataclass
class Monthly:
    spark: SparkSession
    path: str
    schema: T.StructType
    at: str = "posted_at"

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def months(self) -> list[int | None]:
        """From the names of folders: no file is opened."""
        fs, path = self._files()
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        found = [m[1] for n in names if (m := re.fullmatch(rf"{MONTH}=(.+)", n))]
        return sorted((None if x == NONE else int(x) for x in found), key=lambda m: (m is not None, m or 0))

    def read(self, months: Iterable[int | None] | None = None) -> DataFrame:
        """All rows, or those of some months, without the month; a filter on MONTH in ``rows`` prunes folders."""
        return self.rows(months).drop(MONTH)

    def rows(self, months: Iterable[int | None] | None = None) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(MONTH, T.IntegerType())])
        if not self.months():
            return self.spark.createDataFrame([], schema)
        out = self.spark.read.schema(schema).parquet(self.path)
        if months is None:
            return out
        months = list(months)
        hit = F.col(MONTH).isin([m for m in months if m is not None])
        return out.filter(hit | F.col(MONTH).isNull() if None in months else hit)

    def append(self, rows: DataFrame) -> None:
        self._write(self._dealt(rows), "append")

    def _dealt(self, rows: DataFrame, others: DataFrame | None = None) -> DataFrame:
        with_month = lambda df: df.select(*self.schema.fieldNames()).withColumn(MONTH, month_of(self.at))
        # Rebalancing splits a hot month over tasks and puts small ones together, so each month has few, even files.
        dealt = with_month(rows).hint("rebalance", MONTH)
        return dealt if others is None else dealt.unionByName(with_month(others))

    def _write(self, rows: DataFrame, mode: str) -> None:
        rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(MONTH).parquet(self.path)

    def replace(self, months: Iterable[int | None], rows: DataFrame) -> None:
        """``rows`` become all that these months hold; others aren't touched. The rows may come from the table itself: Spark writes them
        beside it and changes the months' folders once all are written, so they are written once."""
        left = {r[0] for r in rows.select(month_of(self.at)).distinct().collect()}  # a row for each month
        self._write(self._dealt(rows), "overwrite")
        self.drop(set(months) - left)

    def amend(self, changed: DataFrame, others: DataFrame) -> None:
        """Both together become all that their months hold, as replace() does where no month goes. Only the ``changed`` rows are dealt by month;
        the ``others``, read from the table, lie in files of their months already and are written by the task that reads them."""
        self._write(self._dealt(changed, others), "overwrite")

    def drop(self, months: Iterable[int | None]) -> None:
        """Deletes months' folders; no row is read."""
        fs, path = self._files()
        for m in months:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path, f"{MONTH}={NONE if m is None else m}"), True)


def create(rows: DataFrame, path: str, at: str = "posted_at") -> Monthly:
    table = Monthly(rows.sparkSession, path, T.StructType([f for f in rows.schema if f.name != MONTH]), at)
    table.append(rows)
    return table


def partitions(table: Monthly) -> DataFrame:
    """The months that there are, with name and bounds; the null month has neither."""
    rows = table.spark.createDataFrame([(m,) for m in table.months()], f"{MONTH} int")
    start = F.make_date(F.floor(F.col(MONTH) / 100).cast("int"), F.col(MONTH) % 100, F.lit(1))
    return rows.select(MONTH, F.concat(F.lit("parts_"), F.date_format(start, "yyyy_MM")).alias("partition_name"), start.cast("timestamp_ntz").alias("from_ts"), F.add_months(start, 1).cast("timestamp_ntz").alias("to_ts"))


def drop_expired(table: Monthly, cutoff: Column) -> DataFrame:
    """Drops months that end by the cutoff, and returns what it dropped."""
    gone = partitions(table).filter(F.col("to_ts") <= cutoff)
    months = [r[0] for r in gone.select(MONTH).collect()]  # of a row for each month
    table.drop(months)
    return table.spark.createDataFrame([(m,) for m in months], f"{MONTH} int")


def prune(table: Monthly, candidates: DataFrame, key: str = "part_id") -> DataFrame:
    """Deletes the candidates (key and time of rows) by rewriting the months that hold any, and returns for each the rows that went.
    Candidates that aren't there don't matter, nor do repeated ones."""
    gone = stored(candidates.select(key, month_of(table.at).alias(MONTH)).distinct(), "gone")
    months = [r[0] for r in gone.select(MONTH).distinct().collect()]
    before = table.rows(months)
    met = before.join(gone.select(key), key, "left_semi")
    counts = stored(met.groupBy(MONTH).agg(F.count("*").alias("deleted")), "deleted")
    table.replace(months, before.join(gone.select(key), key, "left_anti"))
    return counts
