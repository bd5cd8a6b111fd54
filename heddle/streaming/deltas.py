"""Deltas of a stream's batches, compacted as they come.

Batch n's delta is ``level0/n``. Whenever FAN deltas of a level are complete they are merged into one of the next level, so which tables
together hold batches 0 to n follows from the digits of n+1 in base FAN: few, however large n is, and each row is
rewritten once a level. A batch counts once its marker, written last, is there; until then readers use what was there before. A
batch that is run again writes the same tables again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FAN = 8


def covering(count: int, fan: int = FAN) -> list[tuple[int, int]]:
    """(level, number) of the tables that hold the first ``count`` batches."""
    out, level = [], 0
    while count:
        out += [(level, count - 1 - i) for i in range(count % fan)]
        count, level = count // fan, level + 1
    return out[::-1]


@dataclass
class Deltas:
    spark: SparkSession
    path: str
    schema: T.StructType
    merge: Callable[[DataFrame], DataFrame]
    fan: int = FAN

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def _table(self, level: int, number: int) -> str:
        return f"{self.path}/level{level}/{number}"

    def committed(self) -> int:
        """How many batches count."""
        fs, folder = self._fs(), self._path("committed")
        return max((int(f.getPath().getName()) + 1 for f in fs.listStatus(folder)), default=0) if fs.exists(folder) else 0

    def add(self, delta: DataFrame, number: int) -> None:
        """Batch ``number``'s delta, and the merges that it completes; numbers follow each other from 0."""
        delta.write.mode("overwrite").option("compression", "zstd").parquet(self._table(0, number))
        level, count = 0, number + 1
        while count % self.fan == 0:
            count //= self.fan
            parts = [self._table(level, count * self.fan - 1 - i) for i in range(self.fan)]
            level += 1
            self.merge(self._of(parts)).write.mode("overwrite").option("compression", "zstd").parquet(self._table(level, count - 1))
        fs = self._fs()
        fs.create(self._path("committed", str(number)), True).close()
        # Superseded tables go one commit later than the marker that supersedes them, so a reader that has just begun finds its own.
        for path in self._superseded(number):
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)
        if number:
            fs.delete(self._path("committed", str(number - 1)), True)

    def _superseded(self, number: int) -> list[str]:
        count, level, out = number, 0, []  # of the batch before
        while count and count % self.fan == 0:
            count //= self.fan
            out += [self._table(level, count * self.fan - 1 - i) for i in range(self.fan)]
            level += 1
        return out

    def _of(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def tables(self) -> list[str]:
        """Those that hold the committed batches."""
        return [self._table(*t) for t in covering(self.committed(), self.fan)]

    def read(self) -> DataFrame:
        return self._of(self.tables())
