"""Substring search by a stored index of trigrams.

Terms are the distinct words, or whole texts, in lower case. The index holds the grams of one to three letters of each term and the
rows of each term, both sorted, so a look-up reads the row groups that may hold its gram. What a gram finds is
verified exactly: the index narrows, it never decides. A gram is chosen by how many terms have it, which the index knows. Null texts have no
terms; repeated ids of a term count once; an empty needle is in every text, empty ones included.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.layout import positions
from ..sources.tables import scratch, stored
from .assembly import cap_per_key

LETTERS = 3
#: Names in the first block of a search by age; each further block is twice as long.
FIRST_BLOCK = 4096


def grams(term: Column, *sizes: int) -> Column:
    """Distinct grams of these sizes."""
    at = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(term) - n + 1, F.lit(1))), lambda i: F.substring(term, i, F.lit(n)))
    return F.filter(F.array_distinct(F.concat(*map(at, sizes))), lambda g: F.length(g) > 0)


def words(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), r"\s+")), lambda w: w != "")


def _sorted(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """A table whose files and row groups are ranges of the keys."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@dataclass
class Index:
    """``held``: gram, term; ``sizes``: gram, terms (how many have it); ``rows``: term, id; ``weight``: term, rows; ``ids``: all of them."""

    held: DataFrame
    sizes: DataFrame
    rows: DataFrame
    weight: DataFrame
    ids: DataFrame

    def terms(self, needle: str) -> DataFrame:
        """Terms that hold a needle (in lower case)."""
        if len(needle) <= LETTERS:
            return self.held.filter(F.col("gram") == needle).select("term")
        own = sorted({needle[i : i + LETTERS] for i in range(len(needle) - LETTERS + 1)})
        sizes = {r["gram"]: r["terms"] for r in self.sizes.filter(F.col("gram").isin(own)).collect()}  # of the needle's grams
        if len(sizes) < len(own):
            return self.held.filter("false").select("term")
        return self.held.filter(F.col("gram") == min(own, key=lambda g: (sizes[g], g))).filter(F.col("term").contains(needle)).select("term")

    def containing(self, needles: list[str]) -> DataFrame:
        """Ids of rows each of whose needles is in one of its terms."""
        wanted = sorted({n.lower() for n in needles if n}, key=lambda n: (-len(n), n))
        if not wanted:
            return self.ids
        each = [self.rows.join(self.terms(n), "term", "left_semi").select("id").distinct() for n in wanted]
        return reduce(lambda a, b: a.join(b, "id", "left_semi"), each)

    def terms_of_each(self, needles: DataFrame) -> DataFrame:
        """(t, term) for many needles ``t`` at once: each by its rarest gram."""
        own = needles.select("t").filter("t <> ''").distinct().withColumn("gram", F.explode(grams(F.col("t"), LETTERS)))
        rare = own.join(self.sizes, "gram", "left").groupBy("t").agg(F.min(F.struct(F.coalesce("terms", F.lit(0)).alias("terms"), "gram"))["gram"].alias("gram"))
        # The planner sees files of few bytes, as grams compress well, and would broadcast their many rows.
        return rare.join(self.held.hint("merge"), "gram").filter(F.col("term").contains(F.col("t"))).select("t", "term")


def build(df: DataFrame, key: str, text: str, whole: bool = False) -> Index:
    """The index of a table's texts: of their words, or with ``whole`` of the texts themselves, whose needles may hold spaces."""
    terms = F.array(F.lower(text)) if whole else words(F.col(text))
    found = df.filter(F.col(text).isNotNull()).select(F.explode(terms).alias("term"), F.col(key).alias("id")).distinct()
    rows = _sorted(found, "rows", "term", "id")
    weight = stored(rows.groupBy("term").agg(F.count("*").alias("rows")), "weight")
    held = _sorted(weight.select(F.explode(grams(F.col("term"), 1, 2, LETTERS)).alias("gram"), "term"), "grams", "gram", "term")
    sizes = _sorted(held.groupBy("gram").agg(F.count("*").alias("terms")), "sizes", "gram")  # a table of its own: nothing is joined
    ids = df.filter(F.col(text).isNotNull()).select(F.col(key).alias("id")).distinct()
    return Index(held, sizes, rows, weight, ids)


def matching(df: DataFrame, index: Index, key: str, needles: list[str]) -> DataFrame:
    """The rows of ``df`` that the index finds for all needles."""
    return df.join(index.containing(needles).withColumnRenamed("id", key), key, "left_semi")


def newest_with_all(index: Index, names: DataFrame, asked: DataFrame, k: int, first_block: int = FIRST_BLOCK) -> DataFrame:
    """J13's search: for each ``want`` (an array of needles) of ``asked`` the k newest of ``names`` (guid, posted_at, search_name) that hold
    all of its needles, with their place from the newest (at).

    Names are numbered from the newest and cut into blocks, each twice as long as those before it; a block is a folder. A want goes to
    the next block only while it has found fewer than k, so one whose needles are frequent is done within the first; the others look up
    the words of their rarest needle, whose rows are few. So the rows that are joined follow the names and what is found, not wants times names."""
    at = positions(names.select("guid", "posted_at", "search_name"), [F.col("posted_at").desc_nulls_last(), F.col("guid").desc()])
    block = F.floor(F.log2(F.col("at") / first_block + 1)).cast("int")
    spark, path = names.sparkSession, scratch(names.sparkSession, "blocks")
    cut = at.select("guid", "at", "search_name", F.explode(words(F.col("search_name"))).alias("term"), block.alias("block"))
    cut.write.option("compression", "zstd").partitionBy("block").parquet(path)
    blocks = spark.read.schema(cut.schema).parquet(path)
    wants = stored(asked.select("want").distinct(), "wants")
    inside = stored(index.terms_of_each(wants.select(F.explode("want").alias("t"))), "inside")
    often = inside.join(index.weight, "term").groupBy("t").agg(F.sum("rows").alias("rows"))
    rare = wants.withColumn("t", F.explode("want")).join(often, "t", "left").groupBy("want").agg(F.min(F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), "t")).alias("r"))
    left = stored(rare.filter("r.rows > 0").select("want", F.col("r.t").alias("t"), F.lit(0).cast("long").alias("have")), "left")
    last = blocks.agg(F.max("block")).first()[0]
    hits = None
    for b in range(-1 if last is None else last + 1):
        here = left.join(inside, "t").join(blocks.filter(F.col("block") == b), "term").select("want", "guid", "at", "search_name").distinct()
        met = stored(here.filter(F.forall("want", lambda x: F.col("search_name").contains(x))).select("want", "guid", "at"), "met")
        hits = met if hits is None else hits.unionByName(met)
        found = met.groupBy("want").agg(F.count("*").alias("more"))
        left = stored(left.join(found, "want", "left").select("want", "t", (F.col("have") + F.coalesce("more", F.lit(0))).alias("have")).filter(F.col("have") < k), "left")
        if not left.limit(1).count():
            break
    if hits is None:
        return wants.select("want", F.lit("").alias("guid"), F.lit(0).cast("long").alias("at")).filter("false")
    return cap_per_key(hits, ["want"], k, "at")
