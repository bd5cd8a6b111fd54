"""Operator 6: similarity join of shingle sets by adaptive multi-match prefixes.

Sets with overlap T share at least l of their first |set|-T+l elements in any one order of
elements. Elements are ordered from rare to frequent, by counts over all documents in a sketch of
fixed size. A document whose prefix looks expensive (frequent elements, so many candidates) gets
a longer prefix, and its pairs must share as many more elements before their whole sets
are compared.

Documents with equal sets are one class from the start. A prefix holds all of its set up to its last
element. So a class lacks, of another's prefix up to there, the elements that no other prefix has;
that bounds the overlap of the two, and most pairs drop out before they meet. What comes later in the
longer prefix bounds nothing: it may lie in the first set after its prefix.
Pairs are then tested in three steps, and only pairs that still lie in different components go on:

1. Each class meets the most typical class at each of its prefix elements, which joins groups of near
   copies without their pairs. The typical class that most others meet is its hub.
2. Classes of one hub are compared by how they differ from it. With m elements of the hub h missing and
   e extra ones, a class costs c = den * m + num * e, and two classes that have s of these differences
   in common link exactly when (den - num) * |h| + (den + num) * s >= c + c'. A class links to the hub
   itself when c <= (den - num) * |h|. So of two classes, at least one of them apart from the hub, the
   other has s > c / (den + num): another prefix filter, over differences from rare to frequent, in
   which what near copies have in common with the hub, however many they are, doesn't occur at all.
3. All other pairs with a common prefix element, that is of different hubs or of none.

Step 3 sets out from the classes that aren't of an element's largest hub or component, so it costs
nothing where all are. No link between components is lost in any step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared, wordhash
from .components import connected

#: Cells of the frequency sketch and the rows it is moved in.
CELLS, SLICES = 1 << 20, 64
#: Estimated candidates that a prefix may have before it is lengthened, and the most shared elements asked for.
CHEAP, LONGEST = 64, 8
#: Classes that meet a typical one before it is a hub (fewer are compared in pairs), and how many times what
#: it may cost to link to the hub a class may differ from it (others are compared by their prefixes).
CROWD, FAR = 8, 4
#: Elements with the smallest hashes that tell how alike two classes may be. It only decides which get a hub.
SAMPLE = 24
SHIFT = np.uint64(64 - 20)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    return tuple(int(signed(np.array([wordhash.mixed(s, seed).sum(dtype=np.uint64)]))[0]) for seed in (0x5EED, 0xFACE))


def first_pass(docs: DataFrame, k: int) -> DataFrame:
    """Size and digest of each document's set, and at a partition's end its part of the sketch.
    A column ``row_key`` is passed on."""
    key = ["row_key"] if "row_key" in docs.columns else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        kind = None
        for b in batches:
            kind, out = b.schema.field(0).type, []
            for _, h in wordhash.words(b.column(1)):
                s = wordhash.shingles(h, k)
                if len(s):
                    np.add.at(cells, (s >> SHIFT).astype(np.int64), 1)
                out.append((len(s), *(digest(s) if len(s) else (0, 0))))
            n, d1, d2 = (pa.array([o[i] for o in out], pa.int64()) for i in range(3))
            yield pa.record_batch([b.column(0), n, d1, d2, pa.nulls(len(b), pa.int32()), pa.nulls(len(b), pa.binary()), *[b.column(2) for _ in key]], names=names)
        if kind is not None:
            parts = cells.reshape(SLICES, -1)
            none = pa.nulls(SLICES, pa.int64())
            yield pa.record_batch([pa.nulls(SLICES, kind), none, none, none, pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary()), *[pa.nulls(SLICES, pa.string()) for _ in key]], names=names)

    names = ["doc_id", "n", "d1", "d2", "slice", "cells", *key]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(c, T.LongType()) for c in names[1:4]], T.StructField("slice", T.IntegerType()), T.StructField("cells", T.BinaryType()), *[T.StructField(c, T.StringType()) for c in key]])
    return shared.stored(docs.select("doc_id", "text", *key).mapInArrow(run, schema), "sets")


def sketch(parts: DataFrame) -> bytes:
    """How frequent each cell's elements are, on a scale of 256 steps of an eighth of a doubling
    over the mean cell. A megabyte, whatever the input; added up in two steps, so no task gets
    the parts of all partitions."""

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, dtype=np.int64) for x in group.column("cells").to_pylist())
        return pa.table({"slice": group.column("slice")[:1], "cells": pa.array([total.tobytes()], pa.binary())})

    schema = "slice int, cells binary"
    some = parts.withColumn("salt", F.pmod(F.xxhash64("cells"), F.lit(256))).groupBy("slice", "salt").applyInArrow(add, schema)
    found = {r["slice"]: r["cells"] for r in some.groupBy("slice").applyInArrow(add, schema).collect()}
    cells = np.concatenate([np.frombuffer(found[i], dtype=np.int64) for i in range(SLICES)]) if found else np.zeros(CELLS, np.int64)
    over = np.maximum(cells - cells.mean(), 0)
    return np.minimum(np.rint(8 * np.log2(1 + over)), 255).astype(np.uint8).tobytes()


def prefix(s: np.ndarray, levels: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(The first |s|-T+l elements, their levels, the place of the last of them in the order of all elements, how
    frequent the first |s|-T+1 are): l grows with the prefix's estimated candidates."""
    n = len(s)
    overlap = -(-num * n // den)
    level = levels[(s >> SHIFT).astype(np.int64)]
    order = np.argsort(level, kind="stable")
    cost = float((np.exp2(level[order[: n - overlap + 1]] / 8) - 1).sum())
    more = min(LONGEST, overlap, 1 + int(np.log2(1 + cost / CHEAP)))
    last = order[n - overlap + more - 1]
    first = order[: n - overlap + more]
    return s[first], level[first], int(level[last]) << 55 | int(s[last]) >> 9, int(1000 * level[order[: n - overlap + 1]].mean())


def second_pass(docs: DataFrame, levels: bytes, k: int, num: int, den: int) -> DataFrame:
    shared_levels = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared_levels.value, dtype=np.uint8)
        for b in batches:
            keep, rows, prefixes, ranks, samples = [], [], [], [], []
            for i, h in wordhash.words(b.column(1)):
                s = wordhash.shingles(h, k)
                if len(s):
                    p, level, last, common = prefix(s, table, num, den)
                    keep.append(i)
                    rows.append((len(s), *digest(s), last, common))
                    prefixes.append(signed(p))
                    ranks.append(level.astype(np.int16))
                    samples.append((s[:SAMPLE] & np.uint64(0x7FFFFFFF)).astype(np.int32))
            n, d1, d2, last, common = (pa.array([r[i] for r in rows], pa.int64()) for i in range(5))
            ends = np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)))
            levels = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ranks) if ranks else np.zeros(0, np.int16)))
            yield pa.record_batch([b.column(0).take(pa.array(keep, pa.int64())), n, d1, d2, last, common, lists, levels, pa.array(samples, pa.list_(pa.int32()))], names=["doc_id", "n", "d1", "d2", "last", "common", "prefix", "levels", "sample"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(c, T.LongType()) for c in ("n", "d1", "d2", "last", "common")], T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("levels", T.ArrayType(T.ShortType())), T.StructField("sample", T.ArrayType(T.IntegerType()))])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def id_key(c: str = "doc_id") -> F.Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("null"))


def candidate_texts(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(cid, text) of the classes in ``pairs``: a text for each, from the row that stands for it."""
    wanted = shared.stored(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(classes, "cid").select("cid", "d1", "d2", id_key("rep").alias("key")), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:  # an id that repeats may bring other texts along, or the same again
            same = [digest(wordhash.shingles(h, k)) == (d1, d2) for (_, h), d1, d2 in zip(wordhash.words(b.column(3)), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            for i, c in enumerate(b.column(0).to_pylist()):
                same[i] = same[i] and c not in seen
                if same[i]:
                    seen.add(c)
            yield b.filter(pa.array(same, pa.bool_())).select(["cid", "text"])

    texts = shared.narrowed(docs.select("doc_id", "text"), id_key(), wanted.select("key")).withColumn("key", id_key())
    return shared.stored(texts.join(wanted.hint("merge"), "key").select("cid", "d1", "d2", "text").mapInArrow(run, "cid long, text string"), "texts")


def verified(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for (_, x), (_, y) in zip(wordhash.words(b.column(2)), wordhash.words(b.column(3)), strict=True):
                s, t = wordhash.shingles(x, k), wordhash.shingles(y, k)
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(bool(both) and den * both >= num * (len(s) + len(t) - both))
            yield b.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return with_texts(pairs, texts).mapInArrow(run, "a long, b long").distinct()


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    one = texts.select(F.col("cid").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("cid").alias("b"), F.col("text").alias("tb"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "ta", "tb")


def differences(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """For pairs of a class a and its hub b: (cid, hub, cost, free, deltas). ``free`` is what the cost may be
    to link to the hub; deltas are the hub's elements that the class lacks (as another hash of each) and
    those it has besides, or null where it costs more than FAR times that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            costs, frees, deltas = [], [], []
            for (_, x), (_, h) in zip(wordhash.words(b.column(2)), wordhash.words(b.column(3)), strict=True):
                x, h = wordhash.shingles(x, k), wordhash.shingles(h, k)
                extra, missing = np.setdiff1d(x, h, assume_unique=True), np.setdiff1d(h, x, assume_unique=True)
                costs.append(den * len(missing) + num * len(extra))
                frees.append((den - num) * len(h))
                deltas.append(signed(np.concatenate((extra, wordhash.mixed(missing, 0x1ACC)))) if costs[-1] <= FAR * frees[-1] else None)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(costs, pa.int64()), pa.array(frees, pa.int64()), pa.array(deltas, pa.list_(pa.int64()))], names=["cid", "hub", "cost", "free", "deltas"])

    return with_texts(pairs, texts).mapInArrow(run, "cid long, hub long, cost long, free long, deltas array<long>").dropDuplicates(["cid"])


def hubs_of(postings: DataFrame, leads: DataFrame, samples: DataFrame) -> DataFrame:
    """(cid, hub): of the typical classes (e, lead) that a class meets and that look at all like it (half of the
    smaller sample in common), the one of which most classes say so. Only hubs of more than CROWD classes."""
    met = postings.select("e", "cid").join(leads, "e").select("cid", "lead").distinct()
    met = met.join(samples, "cid").join(samples.select(F.col("cid").alias("lead"), F.col("sample").alias("other")), "lead")
    met = shared.stored(met.filter(2 * F.size(F.array_intersect("sample", "other")) >= F.least(F.size("sample"), F.size("other"))).select("cid", "lead"), "met")
    crowd = met.groupBy("lead").agg(F.count("*").alias("crowd")).filter(F.col("crowd") > CROWD)
    return met.join(crowd, "lead").groupBy("cid").agg(F.max(F.struct("crowd", "lead"))["lead"].alias("hub"))


def same_hub_links(members: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) of classes of one hub that lie in different components and aren't both linked to it."""
    both = den + num
    members = members.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    each = members.select("hub", "cid", F.explode("deltas").alias("d"))
    often = each.groupBy("hub", "d").agg(F.count("*").alias("times")).filter("times > 1")
    common = each.join(often, ["hub", "d"]).groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("times", "d"))).alias("common"))
    members = members.join(common, "cid").withColumn("apart", F.col("cost") > F.col("free"))
    # Differences that no other class has come first; of the others so many are in the prefix that needs
    # ``least`` common ones.
    cut = lambda least: F.slice("common", F.lit(1), F.greatest(F.size("common") - least + 1, F.lit(0)).cast("int"))["d"]
    near, far = F.floor(F.col("cost") / both) + 1, F.greatest(F.ceil((F.col("cost") - F.col("free")) / den), F.lit(1))
    members = shared.stored(members.select("cid", "hub", "cost", "free", "deltas", "root", "apart", cut(near).alias("near"), cut(far).alias("far")), "members")

    me = F.struct("cid", "cost", "free", "root", F.size("deltas").alias("n"))
    left = members.select("hub", F.explode("near").alias("d"), "apart", me.alias("x"))
    right = members.filter("apart").select("hub", F.explode(F.array(F.struct(F.lit(True).alias("apart"), F.col("near").alias("ds")), F.struct(F.lit(False).alias("apart"), F.col("far").alias("ds")))).alias("part"), me.alias("y"))
    right = right.select("hub", F.explode("part.ds").alias("d"), "part.apart", "y")
    can = (F.col("x.root") != F.col("y.root")) & (~F.col("apart") | (F.col("x.cid") < F.col("y.cid")))
    can &= both * F.least("x.n", "y.n") + F.col("x.free") >= F.col("x.cost") + F.col("y.cost")
    met = left.join(right, ["hub", "d", "apart"]).filter(can).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct()
    one = members.select(F.col("cid").alias("a"), F.col("deltas").alias("da"), F.col("cost").alias("ca"), "free")
    two = members.select(F.col("cid").alias("b"), F.col("deltas").alias("db"), F.col("cost").alias("cb"))
    exact = F.col("free") + both * F.size(F.array_intersect("da", "db")) >= F.col("ca") + F.col("cb")
    return met.join(one, "a").join(two, "b").filter(exact).select("a", "b")


def similar(m: F.Column, na: F.Column, nb: F.Column, num: int, den: int) -> F.Column:
    """Whether sets of these sizes with an overlap of at most m can be similar enough."""
    return den * m >= num * (na + nb - m)


def order_key(level: F.Column, e: F.Column) -> F.Column:
    """The place of an element in the order of all elements, as ``prefix`` gives it."""
    return F.shiftleft(level.cast("long"), 55).bitwiseOR(F.shiftrightunsigned(e, 9))


def reach(x: str, last: F.Column) -> F.Column:
    """How much of the set of class x another can have whose prefix ends at ``last``: the elements of
    x before that which no other prefix has are out, counted in quarters of all such."""
    known = F.when(F.col(f"{x}.own4") < last, F.col(f"{x}.own"))
    for i in (3, 2, 1):
        known = known.when(F.col(f"{x}.own{i}") < last, quarter(F.col(f"{x}.own"), i))
    return F.col(f"{x}.n") - known.otherwise(F.lit(0))


def quarter(own: F.Column, i: int) -> F.Column:
    return F.ceil(own * i / 4).cast("int")


def enough(counted: DataFrame, facts: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, b) with all their ``shared`` prefix elements those that share enough of them.

    Of two prefixes the one that ends first in the order has all of its set's elements up to there.
    So its other |set| - |prefix| elements and the shared ones bound the overlap: a prefix lengthened
    by l has as many fewer others, and asks for as many more shared elements.
    """
    one = facts.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("others").alias("oa"), F.col("last").alias("la"))
    two = facts.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("others").alias("ob"), F.col("last").alias("lb"))
    rest = F.when(F.col("la") < F.col("lb"), F.col("oa")).when(F.col("lb") < F.col("la"), F.col("ob")).otherwise(F.greatest("oa", "ob"))
    joined = counted.join(one, "a").join(two, "b").filter(similar(F.col("shared") + rest, F.col("na"), F.col("nb"), num, den))
    return joined.select("a", "b")


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100, row_key: str | None = None) -> DataFrame:
    """For each row doc_id, n_shingles and component_id (the smallest id reachable by links); with
    ``row_key`` also that column, and ``root``, which is null for a row without shingles.

    Rows link when den * |A and B| >= num * |A or B| for their sets of k-word shingles. Null and
    blank texts have no shingles and are their own component; rows with equal sets are one
    component; null ids count only where a component has no other; repeated rows come back each;
    an empty table gives an empty result; other columns aren't looked at.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *[F.col(c).alias("row_key") for c in [row_key] if c])
    first = first_pass(docs, k)
    extra = ["row_key"] if row_key else []
    sets = first.filter("slice IS NULL").select("doc_id", "n", "d1", "d2", *extra)
    levels = sketch(first.filter("slice IS NOT NULL").select("slice", "cells"))
    classes = shared.stored(sets.filter("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    keyed = second_pass(docs, levels, k, num, den).withColumn("key", id_key())
    prefixes = shared.stored(keyed.join(classes.select("d1", "d2", "cid", id_key("rep").alias("key")), ["d1", "d2", "key"]).select("cid", "n", "last", "common", "prefix", "levels", "sample").dropDuplicates(["cid"]), "prefixes")

    # Elements that no other class has in its prefix can't be shared with a class whose prefix ends later.
    elements = prefixes.select("cid", F.explode("prefix").alias("e"))
    met = elements.groupBy("e").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).filter("lo < hi").select("e")
    got = elements.join(met, "e").groupBy("cid").agg(F.collect_set("e").alias("got"))
    facts = prefixes.join(got, "cid").withColumn("alone", F.array_except("prefix", "got")).withColumn("own", F.size("alone"))
    marks = [F.try_element_at("alone", F.greatest(quarter(F.col("own"), i), F.lit(1))) for i in (1, 2, 3, 4)]
    marks = [order_key(F.element_at("levels", F.array_position("prefix", m).cast("int")), m).alias(f"own{i}") for i, m in enumerate(marks, 1)]
    facts = shared.stored(facts.select("cid", "n", "last", "common", (F.col("n") - F.size("prefix")).alias("others"), "own", *marks, "got", "sample"), "facts")
    bounds = ("cid", "n", "last", "own", "own1", "own2", "own3", "own4")
    postings = facts.select(*bounds, "common", F.explode("got").alias("e"))
    may_link = lambda x, y: similar(F.least(reach(x, F.col(f"{y}.last")), reach(y, F.col(f"{x}.last"))), F.col(f"{x}.n"), F.col(f"{y}.n"), num, den)

    # Each element's most typical class (the one with the most frequent prefix, as the original of many
    # copies has, which lacks their rare elements) and its least one.
    me = F.struct(*bounds)
    leads = postings.groupBy("e").agg(F.min(F.struct((-F.col("common")).alias("rare"), *bounds)).alias("t"), F.min(me).alias("f"))
    leads = shared.stored(leads.select("e", F.struct(*[f"t.{c}" for c in bounds]).alias("t"), "f"), "leads")
    hubs = shared.stored(hubs_of(postings, leads.select("e", F.col("t.cid").alias("lead")), facts.select("cid", "sample")), "hubs")
    own, hubs = hubs.filter("cid = hub"), hubs.filter("cid <> hub")
    star = postings.select("e", me.alias("x")).join(leads.select("e", F.array_distinct(F.array("t", "f")).alias("leads")), "e").select("x", F.explode("leads").alias("y")).filter((F.col("x.cid") != F.col("y.cid")) & may_link("x", "y"))
    star = star.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()
    star = shared.stored(star.join(hubs.select(F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b")), ["a", "b"], "left_anti"), "star")
    spokes = hubs.select(F.col("cid").alias("a"), F.col("hub").alias("b"))
    texts = candidate_texts(docs, classes, star.unionByName(spokes), k)
    members = shared.stored(differences(spokes, texts, k, num, den), "differences")
    links = verified(star, texts, k, num, den).unionByName(members.filter("cost <= free").select(F.col("cid").alias("a"), F.col("hub").alias("b")))
    links = shared.stored(links, "links")
    labels = connected(links)
    members = members.filter("deltas IS NOT NULL")
    links = shared.stored(links.unionByName(same_hub_links(members, labels, num, den)), "links")
    labels = connected(links)

    # All other pairs that share an element and are still apart: of each element the classes outside its
    # largest hub or component with all others.
    placed = postings.join(labels.withColumnRenamed("node", "cid"), "cid", "left").join(members.select("cid", "hub").unionByName(own), "cid", "left")
    placed = placed.withColumn("root", F.coalesce("root", "cid")).withColumn("kin", F.coalesce(-F.col("hub") - 1, "root"))
    kin = placed.groupBy("e", "kin").agg(F.count("*").alias("many"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    mixed = kin.groupBy("e").agg(F.max(F.struct("many", "kin"))["kin"].alias("main"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("kinds")).filter("lo < hi AND kinds > 1").select("e", "main")
    apart = shared.stored(placed.join(mixed, "e").select("e", F.struct(*bounds, "root", "kin", (F.col("kin") == F.col("main")).alias("main")).alias("x")), "apart")
    differ = (F.col("x.root") != F.col("y.root")) & (F.col("x.kin") != F.col("y.kin")) & (F.col("y.main") | (F.col("x.cid") < F.col("y.cid")))
    cross = apart.filter("NOT x.main").join(apart.select("e", F.col("x").alias("y")), "e").filter(differ & may_link("x", "y"))
    cross = cross.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).groupBy("a", "b").agg(F.count("*").alias("shared"))
    rest = shared.stored(enough(cross, facts, num, den).join(star, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        more = verified(rest, candidate_texts(docs, classes, rest, k), k, num, den)
        labels = connected(links.unionByName(more))

    named = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = shared.stored(named.join(least, "root").select("d1", "d2", "n", "component_id", "root"), "named")
    out = sets.join(named, ["d1", "d2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *extra, *["root" for _ in extra])


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` (a stored table) but for those that aren't their component's first, as
    they came. First is the smallest id and, where it repeats, the smallest digest of the text; rows
    that repeat both stay or go together. Rows without shingles stay."""
    key = shared.names_free(docs, "row_key")["row_key"]
    named = docs.withColumn(key, F.sha2(F.concat_ws(" ", id_key(doc_id), F.coalesce(text, F.lit(""))).cast("binary"), 256))
    found = shared.stored(near_components(named, doc_id, text, row_key=key).filter("root IS NOT NULL").select("root", "row_key", F.struct(F.col("doc_id").isNull(), "doc_id", "row_key").alias("place")), "found")
    first = found.groupBy("root").agg(F.min("place").alias("first"))
    gone = shared.stored(found.join(first, "root").filter("place <> first").select(F.col("row_key").alias(key)).distinct(), "gone")
    return shared.without(named, key, gone).drop(key)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(shared.table(spark, sf_dir, "documents"), k=4, num=85, den=100)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     g AS (SELECT doc_id, w, unnest(range(1, CAST(greatest(len(w) - 3, 1) AS BIGINT) + 1)) AS p FROM d WHERE len(w) > 0),
     s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 3], ' ') AS e FROM g),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (e) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
     l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
     r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
     c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""
