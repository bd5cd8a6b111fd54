"""Operator 9: benchmark passages in training documents, by a positional inverted index.

The index stores a posting (document, position) for every occurrence of a term of the test items.
Each window of an item is searched from its two rarest terms: their posting lists, adjusted by
the terms' offsets, meet in the places where the window may begin. The lists of the item's other
terms are intersected at those places alone. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

#: What parts words, before A-Z are lowered.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Words within which the two rarest terms of a window count as near each other.
SLOP = 20
#: Rows of a table of test terms that may be broadcast, if its strings are short too (shared.small); above, joins shuffle, frequent terms in parts.
BROADCAST_ROWS = 500_000
#: In the vocabulary this stands for a document's end; no word holds U+0000.
END = "\0"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def bounded(df: DataFrame) -> DataFrame:
    """To be broadcast if its counted rows and the bytes of their strings are few enough."""
    return F.broadcast(df) if shared.small(df, BROADCAST_ROWS) else df


def test_items(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Vocabulary (term, tid) and positions (iid, item_id, size, ipos, tid) of the items' words."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"), words(F.col(text)).alias("w"))
    items = items.withColumn("iid", F.monotonically_increasing_id()).select("iid", "item_id", F.size("w").alias("size"), F.posexplode("w").alias("ipos", "word"))
    items = shared.stored(items.select("iid", "item_id", "size", "ipos", shared.ascii_lower(F.col("word")).alias("term")), "items")
    terms = shared.stored(items.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()), "terms")
    return terms, shared.stored(items.join(terms, "term").drop("term"), "item_words")


def build_index(docs: DataFrame, terms: DataFrame, text: str = "text", *carried: str) -> DataFrame:
    """Postings (uid, pos, tid) of the terms in whole texts, stored. For each document one more with
    tid -1, whose pos is the number of words and which alone has the ``carried`` columns."""
    known = terms.unionByName(terms.sparkSession.createDataFrame([(END, -1)], terms.schema))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), text, *carried).select("uid", *carried, F.posexplode(F.array_append(words(F.col(text)), F.lit(END))).alias("pos", "word"))
    rows = shared.met(rows.withColumn("term", shared.ascii_lower(F.col("word"))), known, "term", BROADCAST_ROWS)
    return shared.stored(rows.select("uid", "pos", "tid", *[F.when(F.col("tid") == -1, F.col(c)).alias(c) for c in carried]), "postings")


def rarest(index: DataFrame, item_words: DataFrame, window: int = WINDOW, n: int = 2) -> DataFrame:
    """For each window all of whose terms occur in the index: its n rarest terms, as rows
    (iid, start, rank, ipos, tid, need), need being how many there are."""
    counts = index.filter("tid >= 0").groupBy("tid").agg(F.count("*").alias("cf"))
    placed = item_words.join(counts, "tid", "left").withColumn("span", F.least("size", F.lit(window)))
    starts = F.sequence(F.greatest(F.col("ipos") - F.col("span") + 1, F.lit(0)), F.least(F.col("ipos"), F.col("size") - F.col("span")))
    spread = placed.withColumn("start", F.explode(starts))
    one = Window.partitionBy("iid", "start")
    ranked = spread.withColumn("seen", F.count("cf").over(one)).filter("seen = span").withColumn("rank", F.row_number().over(one.orderBy("cf", "ipos")))
    return ranked.filter(F.col("rank") <= n).select("iid", "start", "rank", "ipos", "tid", F.least("span", F.lit(n)).alias("need"))


def exact_matches(index: DataFrame, item_words: DataFrame, window: int = WINDOW) -> DataFrame:
    """Positions (uid, pos, item_id) inside an occurrence of a window of the item. An item of fewer
    words is one window; one without words has none."""
    anchors = shared.stored(rarest(index, item_words, window).select("iid", "ipos", "tid", "need").distinct(), "anchors")
    met = shared.met(index.select("uid", "pos", "tid"), anchors, "tid", BROADCAST_ROWS).select("uid", "iid", (F.col("pos") - F.col("ipos")).alias("shift"), "need")
    places = shared.stored(met.groupBy("uid", "iid", "shift").agg(F.count("*").alias("n"), F.max("need").alias("need")).filter("n >= need").select("uid", "iid", "shift"), "places")
    wanted = shared.met(places, item_words, "iid", BROADCAST_ROWS).withColumn("pos", F.col("shift") + F.col("ipos"))
    there = shared.narrowed(index.select("uid", "pos", "tid"), F.col("uid"), places.select("uid"))
    found = wanted.join(there, ["uid", "pos", "tid"])
    # Runs of neighbouring positions on one alignment; no partition is longer than its item.
    line = Window.partitionBy("uid", "iid", "shift")
    runs = found.withColumn("run", F.col("ipos") - F.row_number().over(line.orderBy("ipos")))
    long = runs.withColumn("length", F.count("*").over(Window.partitionBy("uid", "iid", "shift", "run"))).filter(F.col("length") >= F.least("size", F.lit(window)))
    return long.select("uid", "pos", "item_id")


def proximity_matches(index: DataFrame, item_words: DataFrame, slop: int = SLOP, window: int = WINDOW) -> DataFrame:
    """Places (uid, item_id, start, pos, gap) where the two rarest terms of a window stand within
    ``slop`` words, in any order. Positions are joined by blocks of slop words, so frequent
    terms in one document don't meet all with all."""
    ranked = rarest(index, item_words, window)
    first = ranked.filter("rank = 1").select("iid", "start", F.col("tid").alias("a"))
    pairs = first.join(ranked.filter("rank = 2").select("iid", "start", F.col("tid").alias("b")), ["iid", "start"]).filter("a <> b")
    pairs = shared.stored(pairs.join(item_words.select("iid", "item_id").distinct(), "iid").select("item_id", "start", "a", "b"), "near_pairs")
    both = shared.stored(pairs.select("a", "b").distinct(), "near_terms")
    block = F.floor(F.col("pos") / slop)
    places = index.select("uid", "pos", "tid")
    left = shared.met(places, both.select(F.col("a").alias("tid"), "a", "b"), "tid", BROADCAST_ROWS).select("a", "b", "uid", "pos", F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    right = shared.met(places, shared.stored(both.select(F.col("b").alias("tid"), "b").distinct(), "near_second"), "tid", BROADCAST_ROWS).select("b", "uid", F.col("pos").alias("other"), F.floor(F.col("pos") / slop).alias("block"))
    gap = F.abs(F.col("pos") - F.col("other"))
    met = left.join(right, ["b", "uid", "block"]).filter(gap <= slop).groupBy("uid", "a", "b", "pos").agg(F.min(gap).alias("gap"))
    return met.join(bounded(pairs), ["a", "b"]).groupBy("uid", "item_id", "start", "pos").agg(F.min("gap").alias("gap"))


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, carried: tuple[str, ...] = ("doc_id",), slop: int | None = None) -> DataFrame:
    """For each document its carried columns, n_words, n_hit, n_items, items_sha256, contaminated; with ``slop``
    also n_near, the number of items of which a window's two rarest words stand within so many words.

    Null and empty texts have no words and no hits; rows that repeat are judged each; an item that
    repeats counts once by its id (a null id is the empty string); empty tables give empty or clean
    results; other columns aren't looked at.
    """
    terms, item_words = test_items(benchmark)
    index = build_index(docs, terms, text, *carried)
    hits = shared.stored(exact_matches(index, item_words, window), "hits")
    n_hit = hits.select("uid", "pos").distinct().groupBy("uid").agg(F.count("*").alias("n_hit"))
    items = hits.select("uid", "item_id").distinct().groupBy("uid").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item_id")), ","), 256).alias("items_sha256"))
    every = index.filter("tid = -1").select("uid", *carried, F.col("pos").cast("long").alias("n_words"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    found = n_hit.join(items, "uid")
    if slop is not None:
        near = proximity_matches(index, item_words, slop, window).select("uid", "item_id").distinct().groupBy("uid").agg(F.count("*").alias("n_near"))
        found = near.join(found, "uid", "full")
    out = every.join(found, "uid", "left")
    return out.select(*carried, "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(b""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), *[zero("n_near") for _ in [slop] if slop is not None])


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` (a stored table) without any hit, as they came."""
    key = shared.names_free(docs, "row_key")["row_key"]
    keyed = docs.withColumn(key, F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))  # equal texts have equal hits
    bad = shared.stored(contamination(keyed, benchmark, text, carried=(key,)).filter("contaminated").select(key).distinct(), "contaminated")
    return shared.without(keyed, key, bad).drop(key)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(shared.table(spark, sf_dir, "documents").select("doc_id", "text"), shared.table(spark, sf_dir, "benchmark"), slop=SLOP)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     i AS (SELECT CAST(item_id AS VARCHAR) AS item_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     k AS (SELECT item_id, w, least(10, len(w)) AS k FROM i WHERE len(w) > 0),
     s AS (SELECT item_id, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS p FROM k),
     iw AS (SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS g FROM s),
     dp AS (SELECT r, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS p FROM d, (SELECT DISTINCT k FROM k) WHERE len(w) >= k),
     m AS (SELECT r, p, dp.k, item_id FROM dp JOIN iw ON iw.k = dp.k AND iw.g = array_to_string(w[p : p + dp.k - 1], ' ')),
     q AS (SELECT DISTINCT r, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT r, p, k FROM m)),
     h AS (SELECT r, count(*) AS n_hit FROM q GROUP BY r),
     ii AS (SELECT row_number() OVER () AS iid, item_id, w, k FROM k),
     ip AS (SELECT iid, item_id, k, len(w) AS size, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS ipos FROM ii),
     dt AS (SELECT r, t, pos FROM (SELECT r, unnest(w) AS t, generate_subscripts(w, 1) AS pos FROM d) WHERE t IN (SELECT t FROM ip)),
     cf AS (SELECT t, count(*) AS cf FROM dt GROUP BY t),
     wt AS (SELECT iid, item_id, k, ipos, t, cf, unnest(range(greatest(ipos - k + 1, 0), least(ipos, size - k) + 1)) AS b FROM ip LEFT JOIN cf USING (t)),
     rk AS (SELECT *, count(cf) OVER (PARTITION BY iid, b) AS seen, row_number() OVER (PARTITION BY iid, b ORDER BY cf NULLS FIRST, ipos) AS rank FROM wt),
     pr AS (SELECT DISTINCT x.item_id, x.t AS a, y.t AS z FROM rk x JOIN rk y ON x.iid = y.iid AND x.b = y.b AND x.rank = 1 AND y.rank = 2 WHERE x.seen = x.k AND x.t <> y.t),
     nr AS (SELECT r, count(DISTINCT item_id) AS n_near FROM (SELECT DISTINCT p.r, p.t AS a, q.t AS z FROM dt p JOIN dt q ON p.r = q.r AND abs(p.pos - q.pos) <= 20 AND p.t <> q.t) JOIN pr USING (a, z) GROUP BY r),
     t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r) LEFT JOIN nr USING (r)
"""
