"""Search, pages and catalogue joins.

Null names, categories and times match no search and no filter, and stand last in listings from the newest; rows with one time are ordered by
their guid, and rows that are equal in both in any order. Empty tables give empty pages and a count of zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.layout import positions
from . import trigrams


def newest_first() -> list[Column]:
    return [F.col("posted_at").desc_nulls_last(), F.col("guid").desc_nulls_last()]


def token_and_search(releases: DataFrame, query: str, index: trigrams.Index | None = None) -> DataFrame:
    """Every white-space token of the lowered query occurs in the search name. With an index of search names only what that
    finds is read."""
    if index:
        return trigrams.matching(releases, index, "guid", query.lower().split())
    out = releases
    for token in query.lower().split():
        out = out.filter(F.col("search_name").contains(token))
    return out


def category_expand(releases: DataFrame, categories: list[int]) -> DataFrame:
    """A thousand stands for all its categories."""
    hit = F.lit(False)
    for c in categories:
        hit |= F.col("category_id").between(c, c + 999) if c % 1000 == 0 else F.col("category_id") == c
    return releases.filter(hit)


def hide_obfuscated(releases: DataFrame, include: bool = False) -> DataFrame:
    """P07"""
    return releases if include else releases.filter("NOT obfuscated")


def identifier_all(releases: DataFrame, identifiers: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """Releases that carry all of the given (source, identifier)."""
    hit = F.concat_ws(":", "source", "identifier").isin([":".join(w) for w in wanted])
    full = identifiers.filter(hit).groupBy("guid").agg(F.count_distinct("source", "identifier").alias("n")).filter(F.col("n") == len(set(wanted)))
    return releases.join(full.select("guid"), "guid", "left_semi")


def search(releases: DataFrame, query: str = "", categories: list[int] | None = None, include_obfuscated: bool = False) -> DataFrame:
    out = hide_obfuscated(token_and_search(releases, query), include_obfuscated)
    return category_expand(out, categories) if categories else out


def offset_page(df: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """W06"""
    return df.orderBy(*newest_first()).offset(offset).limit(limit)


def keyset_pages(df: DataFrame, size: int) -> DataFrame:
    """W07 for a whole listing: each row's page and whether it is its page's last, whose (posted_at,
    guid) is the next page's cursor. Rows are numbered in ranges of that order, so a day, or a moment, with a third of all rows is cut too."""
    at = F.col("at") + 1
    return positions(df, newest_first()).select("*", F.ceil(at / size).cast("long").alias("page"), (at % size == 0).alias("last"))


def keyset_page(df: DataFrame, cursor: tuple | None, limit: int) -> DataFrame:
    """The page strictly after (posted_at, guid)."""
    if cursor:
        ts, guid = F.lit(cursor[0]).cast("timestamp_ntz"), F.lit(cursor[1])
        df = df.filter((F.col("posted_at") < ts) | ((F.col("posted_at") == ts) & (F.col("guid") < guid)))
    return df.orderBy(*newest_first()).limit(limit)


def capped_count(df: DataFrame, cap: int = 10_000) -> DataFrame:
    """At most cap, and whether there are more."""
    n = df.limit(cap + 1).agg(F.count("*").alias("n")) if cap >= 0 else df.agg(F.count("*").alias("n"))
    return n.select((F.least("n", F.lit(cap)) if cap >= 0 else F.col("n")).alias("total"), (F.col("n") > cap if cap >= 0 else F.lit(False)).alias("approximate"))


def needs_metadata(releases: DataFrame, metadata: DataFrame) -> DataFrame:
    """J06, without its batch limit: television releases without a metadata row."""
    return hide_obfuscated(releases).filter("category_id BETWEEN 5000 AND 5999").join(metadata.select("guid"), "guid", "left_anti")


def related_releases(releases: DataFrame, k: int = 5, index: trigrams.Index | None = None) -> DataFrame:
    """For each release the k newest others, obfuscated ones aside, whose search names hold its first three
    search tokens, as part of words too. A release without tokens has none. Releases that ask for the same tokens are answered
    together, by the stored index of names (built if none is given), newest names first."""
    want = F.array_sort(F.array_distinct(F.slice(F.filter(F.split("search_name", r"\s+"), lambda x: x != ""), 1, 3)))
    asking = releases.select(F.col("guid").alias("of"), want.alias("want")).filter(F.size("want") > 0)
    seen = hide_obfuscated(releases)
    newest = trigrams.newest_with_all(index or trigrams.build(seen, "guid", "search_name"), seen, asking, k + 1)
    found = asking.join(newest.select("want", "guid", "at"), "want").filter("of <> guid")
    return found.select("of", "guid", F.row_number().over(Window.partitionBy("of").orderBy("at")).alias("n")).filter(F.col("n") <= k)


def discovered_vs_known(names: DataFrame, groups: DataFrame) -> DataFrame:
    """J14"""
    return names.select("name").distinct().join(groups.select("name", F.lit(True).alias("k")), "name", "left").select("name", F.when(F.col("k"), "existing").otherwise("added").alias("status"))


def event_routing(events: DataFrame, destinations: DataFrame) -> DataFrame:
    """P10: events and the enabled destinations that take their type (none listed: all)."""
    d = destinations.filter("enabled").select("destination", F.explode_outer("types").alias("want"))
    named, every = d.filter("want IS NOT NULL"), d.filter("want IS NULL").select("destination")
    one = events.join(named, F.col("event_type") == F.col("want")).drop("want")
    to_all = every.agg(F.collect_list("destination")).scalar()  # destinations are configuration
    return one.unionByName(events.withColumn("destination", to_all).withColumn("destination", F.explode("destination")))


def due_queue(releases: DataFrame, now: Column) -> DataFrame:
    """W05, SET1, without its batch limit: pending ones, and failed ones that may be tried again; rank
    orders them."""
    pending = releases.filter("pp_status = 'pending'").withColumn("rank", F.lit(0))
    retry = releases.filter((F.col("pp_status") == "failed") & (F.col("pp_attempts") < 3) & ~F.col("permanent") & (F.col("next_retry") <= now)).withColumn("rank", F.lit(1))
    return pending.unionByName(retry)
