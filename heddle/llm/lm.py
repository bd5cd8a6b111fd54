"""Operator 4: log probabilities of texts by a hashed maximum-entropy model.

P(word | before) = P(class | before) * P(part | class, before) * P(word | class, part). A word's
class and the part of it are a hash of its last bytes, so they need no dictionary. The first two
factors are softmaxes over hashed features of the words before: the last one, the last two
together, the last but one (skipping the last) and both their classes; for the part each feature is
hashed together with the class, so a class has weights of its own. The last factor is the word's
smoothed share of its part, from counts over the whole corpus.

The text is dealt over two rounds by a hash. In each round every task trains on its share by
gradient updates on minibatches, from the round before's weights, and the weights of the tasks are
averaged by how much text each has seen. Counts grow with the corpus and are never broadcast:
texts are scored in sparse batches, whose distinct words are joined with the counts. A batch is stored and
moved as rows of a few hundred KB and meets its words' counts alone, so that no task holds more than one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared, wordhash

#: Classes, and parts of each (class 0, the end of a text, has one), last bytes that make them, the
#: binary logarithm of the weight table's rows, and bytes of text in a batch and in a row of it.
CLASSES, TAIL, ROW_BITS, BATCH, CHUNK = 8, -3, 16, 4 << 20, 1 << 18
ROWS, KINDS = 1 << ROW_BITS, CLASSES * CLASSES
#: Of so many hashes of an id the first one makes the first round.
FIRST = 4
SLICES, STEP, MINIBATCH, LEAST = 64, 0.15, 8192, -20
#: Counts of words that a task packs at once.
PACK = 1 << 20
START, END = np.uint64(0x51A27), np.uint64(0xE2D)
SMOOTH = 0.1
#: Parquet asks after every row how much it holds, instead of every hundred; a row group is what a task writes or reads at once.
WIDE = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


class Tokens:
    """Words of some texts one after another, each text closed by END."""

    def __init__(self, texts: pa.Array):
        both = [hs for _, hs in wordhash.stemmed(texts, (0, TAIL))]
        words, tails = [h for h, _ in both], [kinds_of(h) for _, h in both]
        self.length = np.array([len(h) + 1 for h in words], dtype=np.int64)
        one, kind = np.array([END]), np.zeros(1, np.int32)
        self.word = np.concatenate([x for h in words for x in (h, one)]) if words else np.zeros(0, np.uint64)
        self.kind = np.concatenate([x for h in tails for x in (h, kind)]) if tails else np.zeros(0, np.int32)
        starts = np.cumsum(self.length) - self.length
        self.first = np.zeros(len(self.word), bool)
        self.first[starts] = True

    def features(self, at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
        """Weight rows of the contexts of tokens at..to, a row of each kind of feature: for their classes and
        for their parts."""
        none, begin = self.first[at:to], max(at - 2, 0)
        second = np.concatenate((self.first[at - 1 : at] if at else [False], none[:-1]))
        pad = at - begin
        word = np.concatenate((np.full(2 - pad, START), self.word[begin:to]))
        kind = np.concatenate((np.zeros(2 - pad, np.int32), self.kind[begin:to]))
        one, two = np.where(none, START, word[1:-1]), np.where(none | second, START, word[:-2])
        pair = np.where(none, 0, kind[1:-1]) * KINDS + np.where(none | second, 0, kind[:-2])
        keys = (one, one * np.uint64(wordhash.BASE) + two, two, pair.astype(np.uint64))
        keys = np.stack([wordhash.mixed(x, 0xF00 + i) for i, x in enumerate(keys)])
        own = wordhash.mixed((self.kind[at:to] // CLASSES + 1).astype(np.uint64))
        down = np.uint64(64 - ROW_BITS)
        return (keys >> down).astype(np.uint16), ((keys ^ own) * np.uint64(wordhash.BASE) >> down).astype(np.uint16)


def kinds_of(tails: np.ndarray) -> np.ndarray:
    """CLASSES * class + part of words, by the hashes of their last bytes. Kind 0 is the end of a text."""
    return (CLASSES + tails % np.uint64(KINDS - CLASSES)).astype(np.int32)


def softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Chances of each column, scores being cut at LEAST and -LEAST so that none is 0."""
    x = np.take(weights, rows[0], axis=0)
    for r in rows[1:]:
        x += np.take(weights, r, axis=0)
    np.exp(np.clip(x, LEAST, -LEAST, out=x), out=x)
    x /= x @ np.ones((x.shape[1], 1), x.dtype)
    return x


def learn(weights: np.ndarray, squares: np.ndarray, tokens: Tokens) -> None:
    """Adaptive gradient updates of both softmaxes, minibatch after minibatch."""
    for at in range(0, len(tokens.word), MINIBATCH):
        k = tokens.kind[at : at + MINIBATCH]
        by_class, by_part = tokens.features(at, at + len(k))
        inner = np.flatnonzero(k)  # the end of a text has no parts
        update(weights, squares, by_class, k // CLASSES)
        update(weights, squares, by_part[:, inner], k[inner] % CLASSES)


def update(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, want: np.ndarray) -> None:
    if not len(want):
        return
    g = softmax(weights, rows)
    g[np.arange(len(want)), want] -= 1
    flat = rows.ravel()
    order = np.argsort(flat, kind="stable")  # a radix sort, rows being 16 bits wide
    flat = flat[order]
    first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    used, total = flat[first], np.add.reduceat(np.take(g, order % len(want), axis=0), first, axis=0)
    squares[used] = some = np.take(squares, used, axis=0) + total**2
    weights[used] -= STEP * total / np.sqrt(some + 1.0)


def chances(weights: np.ndarray, tokens: Tokens, at: int, to: int) -> np.ndarray:
    """log10 P(class | before) + log10 P(part | class, before) of tokens at..to."""
    k = tokens.kind[at:to]
    here = np.arange(len(k))
    by_class, by_part = tokens.features(at, to)
    out = np.log10(softmax(weights, by_class)[here, k // CLASSES].astype(np.float64))
    return out + np.where(k == 0, 0.0, np.log10(softmax(weights, by_part)[here, k % CLASSES].astype(np.float64)))


def pieces(texts: pa.Array, limit: int = BATCH) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``limit`` bytes."""
    sizes = np.array([0 if not x.is_valid else x.as_buffer().size for x in texts], dtype=np.int64)
    i = 0
    while i < len(sizes):
        j = max(i + 1, i + int(np.searchsorted(np.cumsum(sizes[i:]), limit, side="right")))
        yield i, j
        i = j


def planes(x: np.ndarray) -> bytes:
    """An array's bytes, first all lowest ones, then all next: nothing is lost, and what varies little is written in little."""
    return np.ascontiguousarray(x.reshape(-1, 1).view(np.uint8).T).tobytes()


def unplaned(raw: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def studied(docs: DataFrame, start: np.ndarray) -> DataFrame:
    """One pass over training texts (column text), stored: rows with word, kind and count; and for
    each task rows with slice, weights and seen, the number of tokens behind them."""
    table = docs.sparkSession.sparkContext.broadcast(start)  # 2 MB
    names = ["word", "kind", "count", "slice", "weights", "seen"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, squares, seen = table.value.copy(), np.zeros((ROWS, CLASSES), np.float32), 0
        for b in batches:
            for i, j in pieces(b.column(0)):
                t = Tokens(b.column(0).slice(i, j - i))
                learn(weights, squares, t)
                seen += len(t.word)
                word, first, count = np.unique(t.word, return_index=True, return_counts=True)
                n = len(word)
                yield pa.record_batch([pa.array(word.view(np.int64)), pa.array(t.kind[first].astype(np.int32)), pa.array(count), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], names=names)
        if seen:
            parts = weights.reshape(SLICES, -1)
            none = pa.nulls(SLICES, pa.int64())
            yield pa.record_batch([none, pa.nulls(SLICES, pa.int32()), none, pa.array(range(SLICES), pa.int32()), pa.array([planes(p) for p in parts], pa.binary()), pa.array([seen] * SLICES, pa.int64())], names=names)

    return shared.stored(docs.select("text").mapInArrow(run, "word long, kind int, count long, slice int, weights binary, seen long"), "studied")


def averaged(parts: DataFrame, start: np.ndarray) -> np.ndarray:
    """Mean of the tasks' weights, by tokens seen: a table of fixed size, added up in two steps. Without
    any, ``start``."""

    def total(group: pa.Table, parts: Iterator[np.ndarray]) -> pa.Table:
        return pa.table({"slice": group.column("slice")[:1], "weights": pa.array([sum(parts).tobytes()], pa.binary()), "seen": pa.array([sum(group.column("seen").to_pylist())], pa.int64())})

    def weighed(group: pa.Table) -> pa.Table:
        return total(group, (unplaned(x.as_py(), "<f4") * np.float32(n.as_py()) for x, n in zip(group.column("weights"), group.column("seen"), strict=True)))

    def add(group: pa.Table) -> pa.Table:
        return total(group, (np.frombuffer(x.as_py(), dtype=np.float32) for x in group.column("weights")))

    schema = "slice int, weights binary, seen long"
    some = parts.withColumn("salt", F.pmod(F.xxhash64("weights"), F.lit(16))).groupBy("slice", "salt").applyInArrow(weighed, schema)
    found = {r["slice"]: r for r in some.groupBy("slice").applyInArrow(add, schema).collect()}
    if not found:
        return start
    return np.concatenate([np.frombuffer(found[i]["weights"], dtype=np.float32) / max(found[i]["seen"], 1) for i in range(SLICES)]).reshape(ROWS, CLASSES)


def batched(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """Sparse batches of texts, stored in chunks: ids, lengths and class scores of the chunk's documents and
    which of them has which word of the batch how often; and a share of the batch's distinct words, from number ``at`` on, with their classes."""
    table = docs.sparkSession.sparkContext.broadcast(weights)  # 2 MB
    names = ["batch", "chunk", "ids", "flags", "lengths", "scores", "at", "words", "kinds", "places"]
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, task = 0, TaskContext.get().partitionId()
        for b in batches:
            for i, j in pieces(b.column(2)):
                t = Tokens(b.column(2).slice(i, j - i))
                doc = np.repeat(np.arange(j - i), t.length)
                score = np.zeros(j - i)
                for at in range(0, len(t.word), 1 << 15):
                    p = chances(table.value, t, at, min(at + (1 << 15), len(t.word)))
                    score += np.bincount(doc[at : at + (1 << 15)], p, minlength=j - i)
                word, first, local = np.unique(t.word, return_index=True, return_inverse=True)
                place, count = np.unique(doc.astype(np.int64) << 32 | local.reshape(-1), return_counts=True)
                of, named, kinds = place >> 32, place & 0xFFFFFFFF, t.kind[first].astype(np.uint8)
                chunks = list(pieces(b.column(2).slice(i, j - i), CHUNK))
                for n, (k, m) in enumerate(chunks):
                    p, q = np.searchsorted(of, (k, m))
                    at, to = (len(word) * x // len(chunks) for x in (n, n + 1))
                    sparse = np.concatenate([x.astype(np.uint32) for x in (of[p:q] - k, named[p:q], count[p:q])])
                    rows = [one(b.column(c).slice(i + k, m - k)) for c in (0, 1)]
                    yield pa.record_batch(
                        [pa.array([task << 32 | done], pa.int64()), pa.array([n], pa.int32()), *rows, one(pa.array(t.length[k:m])), one(pa.array(score[k:m])), pa.array([at], pa.int32()), one(pa.array(word[at:to].view(np.int64))), pa.array([kinds[at:to].tobytes()], pa.binary()), pa.array([planes(sparse)], pa.binary())],
                        names=names,
                    )
                done += 1

    kind = docs.schema["doc_id"].dataType
    types = [T.LongType(), T.IntegerType(), T.ArrayType(kind), T.ArrayType(T.BooleanType()), T.ArrayType(T.LongType()), T.ArrayType(T.DoubleType()), T.IntegerType(), T.ArrayType(T.LongType()), T.BinaryType(), T.BinaryType()]
    rows = docs.select("doc_id", "held_out", "text").mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in zip(names, types, strict=True)]))
    return shared.stored(rows, "batches", **WIDE)


def packed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each PACK rows (of, i, c) in a row, one for each batch ``of``: steps from place to place, and counts."""
    kept, n = [], 0

    def together() -> pa.RecordBatch:
        of, i, c = (np.concatenate(x) for x in zip(*kept, strict=True))
        batches, code = np.unique(of, return_inverse=True)
        order = np.argsort(code.reshape(-1) << 32 | i)
        at = np.searchsorted(code.reshape(-1)[order], np.arange(len(batches) + 1))
        i, c = i[order].astype(np.uint32), c[order].astype("<i8")
        steps = [planes(np.diff(i[a:b], prepend=np.uint32(0))) for a, b in zip(at, at[1:])]
        return pa.record_batch([pa.array(batches), pa.array(steps, pa.binary()), pa.array([planes(c[a:b]) for a, b in zip(at, at[1:])], pa.binary())], names=["of", "places", "counts"])

    for b in rows:
        if len(b):
            kept.append([x.to_numpy() for x in b.columns])
            n += len(b)
        if n >= PACK:
            yield together()
            kept.clear()
            n = 0
    if kept:
        yield together()


def scored(docs: DataFrame) -> DataFrame:
    """For each row doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``docs``: doc_id, text, held_out; rows not held out train the model. Null and blank texts are
    one token, the end; repeated rows count each; with no training rows all words are unknown; an
    empty table gives an empty result; other columns aren't looked at. A hashed word stands for its
    text (64 bits).
    """
    docs = docs.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    weights, passes = np.zeros((ROWS, CLASSES), np.float32), []
    first = F.pmod(F.xxhash64("doc_id"), F.lit(FIRST)) == 0
    for share in (first, ~first):
        passes.append(studied(docs.filter(~F.col("held_out") & share), weights))
        weights = averaged(passes[-1].filter("slice IS NOT NULL").select("slice", "weights", "seen"), weights)
    seen = passes[0].unionByName(passes[1])
    counts = shared.stored(seen.filter("word IS NOT NULL").groupBy("word").agg(F.first("kind").alias("kind"), F.sum("count").alias("c")), "counts")
    kinds = {r["kind"]: (r["n"], r["v"]) for r in counts.groupBy("kind").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}  # a row for each kind
    total, distinct = sum(n for n, _ in kinds.values()), sum(v for _, v in kinds.values())
    whole = total + SMOOTH * (distinct + 1)
    in_kind = np.array([n + SMOOTH * (v + 1) for n, v in (kinds.get(k, (0, 0)) for k in range(KINDS))])
    batches = batched(docs, weights)
    asked = batches.select("batch", "at", F.posexplode("words").alias("i", "word")).select(F.col("batch").alias("of"), (F.col("at") + F.col("i")).alias("i"), "word")
    known = asked.join(counts.select("word", "c"), "word").select("of", "i", "c").mapInArrow(packed, "of long, places binary, counts binary")

    def finish(chunks: pa.Table, found: pa.Table) -> pa.Table:
        names, out = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], []
        chunks = chunks.sort_by("chunk")
        kind = np.frombuffer(b"".join(chunks.column("kinds").to_pylist()), dtype=np.uint8)
        c = np.zeros(len(kind))
        for places, n in zip(found.column("places").to_pylist(), found.column("counts").to_pylist(), strict=True):
            c[np.cumsum(unplaned(places, "<u4"))] = unplaned(n, "<i8")
        base = np.log10((c + SMOOTH) / whole)
        within = np.where(kind == 0, 0.0, np.log10((c + SMOOTH) / in_kind[kind]))
        for r in range(len(chunks)):
            x = {name: chunks.column(name)[r] for name in ("ids", "flags", "lengths", "scores", "places")}
            n = len(x["ids"])
            doc, word, count = unplaned(x["places"].as_py(), "<u4").reshape(3, -1).astype(np.int64)
            add = lambda v: np.bincount(doc, v[word] * count, minlength=n)  # noqa: B023, E731
            out.append(
                pa.record_batch(
                    [x["ids"].values, x["flags"].values, x["lengths"].values, pa.array(add((c > 0) * 1.0).astype(np.int64)), pa.array(np.full(n, total, np.int64)), pa.array(add(base)), pa.array(add(within) + x["scores"].values.to_numpy())],
                    names=names,
                )
            )
        return pa.Table.from_batches(out)

    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")], T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]
    return batches.drop("at", "words").groupBy("batch").cogroup(known.groupBy("of")).applyInArrow(finish, T.StructType(fields))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10
    return scored(docs.withColumn("held_out", fold == 0))
