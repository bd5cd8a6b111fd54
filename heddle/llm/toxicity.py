"""Operator 2: severity of toxicity by cumulative-link ordinal regression.

P(grade <= j) = sigmoid(threshold_j - w.x): one weight for each sparse text feature, shared by all
ordered thresholds. The score of a text is its expected grade. Features are the presence of a
word (ASCII punctuation and digits part words, A-Z lowered) and the number of distinct words with
a stem, on a logarithmic scale, hashed to 2^18 places.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, wordhash

PLACES = 1 << 18
#: First bytes of a word that make its stem.
STEM = 6
#: Bound on the labelled rows that train the model: those whose ids have the smallest hashes.
TRAIN_ROWS = 8000
#: Expected severity from which a document is rejected.
REJECT = 0.5
GRADES = 4
#: Steps of the fit at most; it ends when the mean loss changes by less than this over ten steps.
STEPS, SETTLED = 400, 1e-6

GAP = np.zeros(256, bool)
GAP[:128] = [not chr(b).isalpha() for b in range(128)]


def features(texts: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray]:
    """Distinct places of a text's words, and for each distinct word the place of its stem, as often
    as words share it."""
    half = np.uint64(PLACES // 2 - 1)
    for _, (h, stems) in wordhash.stemmed(texts, (0, STEM), GAP):
        _, once = np.unique(h, return_index=True)
        yield np.concatenate((np.unique(h & half), (stems[once] & half) + (half + np.uint64(1)))).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def severity(self, places: np.ndarray) -> tuple[float, int]:
        """Expected and most probable grade of a text's feature places."""
        some, count = np.unique(places[self.weights[places] != 0], return_counts=True)
        at_most = 1 / (1 + np.exp(np.clip((self.weights[some] * np.log2(1 + count)).sum() - self.thresholds, -60, 60)))
        grades = np.diff(np.concatenate(([0.0], at_most, [1.0])))
        return float((1 - at_most).sum()), int(grades.argmax())


def graded(rows: list[np.ndarray], toxic: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """Ordered grades where labels say only whether a text is toxic: 0 if not; else by how many of
    its words mark toxic training texts (1: up to two, 2: up to five, 3: more)."""
    n, clean = np.zeros(PLACES), np.zeros(PLACES)
    for r, t in zip(rows, toxic, strict=True):
        (n if t else clean)[np.unique(r)] += 1
    odds = np.log((n + 0.5) / (toxic.sum() + 1)) - np.log((clean + 0.5) / ((~toxic).sum() + 1))
    marks = (odds > 3) & (n >= 5)
    counts = np.array([marks[r].sum() for r in rows])
    return np.where(toxic, np.minimum(1 + np.searchsorted([3, 6], counts, side="right"), grades - 1), 0)


def fit(rows: list[np.ndarray], grade: np.ndarray, grades: int = GRADES, least: int = 5, steps: int = STEPS, lasso: float = 1e-3) -> Model:
    """Proximal gradient on the mean log likelihood, over features of at least ``least`` rows.
    Without rows the model finds everything clean."""
    model = Model(np.zeros(PLACES), np.linspace(3.0, 6.0, grades - 1))
    if not len(rows):
        return model
    found = np.zeros(PLACES, np.int64)
    for r in rows:
        found[np.unique(r)] += 1
    often = found >= least
    used, at = np.flatnonzero(often), np.zeros(PLACES, np.int32)
    at[used] = np.arange(len(used), dtype=np.int32)
    columns, values = [], []
    for r in rows:  # other features have no weight
        found, n = np.unique(r[often[r]], return_counts=True)
        columns.append(at[found])
        values.append(np.log2(1 + n).astype(np.float32))
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(c) for c in columns])
    column, value = np.concatenate(columns), np.concatenate(values)
    del columns, values
    count = np.bincount(column, minlength=len(used))
    w, n = np.zeros(len(used)), len(rows)
    share = np.clip([(grade <= j).mean() for j in range(grades - 1)], 1e-3, 1 - 1e-3)
    cuts = np.log(share / (1 - share))
    past, past_cuts, losses = np.zeros(len(used)), np.zeros(grades - 1), []
    for _ in range(steps):
        x = np.bincount(row, w[column] * value, minlength=n)
        lower, upper = np.concatenate(([-60.0], cuts))[grade], np.concatenate((cuts, [60.0]))[grade]
        s = lambda v: 1 / (1 + np.exp(-np.clip(v, -60, 60)))
        low, high = np.where(grade == 0, 0.0, s(lower - x)), np.where(grade == grades - 1, 1.0, s(upper - x))
        mass = np.maximum(high - low, 1e-9)
        losses.append(-np.log(mass).mean() + lasso * np.abs(w).sum())
        if len(losses) > 10 and abs(losses[-11] - losses[-1]) < SETTLED:
            break
        slope_low, slope_high = low * (1 - low) / mass, high * (1 - high) / mass
        g = np.bincount(column, (slope_high - slope_low)[row] * value, minlength=len(used)) / n
        g_cuts = np.array([(slope_low[grade == j + 1].sum() - slope_high[grade == j].sum()) / n for j in range(grades - 1)])
        past, past_cuts = past + g**2, past_cuts + g_cuts**2
        rate = 0.3 / np.sqrt(past + 1e-8)
        w = w - rate * g
        w = np.sign(w) * np.maximum(np.abs(w) - rate * lasso, 0) * (count > 0)
        cuts = np.maximum.accumulate(cuts - 0.3 / np.sqrt(past_cuts + 1e-8) * g_cuts + np.arange(grades - 1) * 1e-6)
    model.weights[used], model.thresholds = w, cuts
    return model


def train(docs: DataFrame, labels: DataFrame, grade: str | None = None, rows: int = TRAIN_ROWS) -> Model:
    """The model of at most ``rows`` labelled documents. ``labels``: doc_id and either toxic (0 or 1)
    or an integer column named by ``grade``. An id with several labels counts as the highest;
    texts that repeat count once, by the highest label of any; null labels and ids don't count."""
    want = grade or "toxic"
    found = labels.filter(F.col("doc_id").isNotNull() & F.col(want).isNotNull()).groupBy("doc_id").agg(F.max(want).cast("int").alias("label"))
    some = found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = pa.array([np.sort(f).astype(np.int32).tobytes() for f in features(b.column(1))], pa.binary())
            yield pa.record_batch([b.column(0), lists], names=["label", "places"])

    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("label", "text")  # at most ``rows`` rows of two numbers
    got = texts.mapInArrow(places, "label int, places binary").groupBy("places").agg(F.max("label").alias("label")).orderBy(F.xxhash64("places"), "places").limit(rows).collect()
    lists = [np.frombuffer(r["places"], dtype=np.int32) for r in got]
    label = np.array([r["label"] for r in got], dtype=np.int64)
    return fit(lists, np.clip(label, 0, GRADES - 1) if grade else graded(lists, label > 0)) if got else fit([], label)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """All rows with ``severity`` (expected grade) and ``grade``. Null and empty texts have no features."""
    shared_model = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))  # 1 MB

    @F.arrow_udf("severity double, grade int")
    def score(texts: pa.Array) -> pa.Array:
        w, t = shared_model.value
        m = Model(w, t)
        found = [m.severity(f) for f in features(texts)]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int32())], ["severity", "grade"])

    names = shared.names_free(docs, "severity", "grade", "scored")
    s = names["scored"]
    return docs.withColumn(s, score(F.col("text"))).withColumns({names["severity"]: F.col(f"{s}.severity"), names["grade"]: F.col(f"{s}.grade")}).drop(s)


def acceptable(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, as they came."""
    out = scored(docs, train(docs, labels))
    name = shared.names_free(docs, "severity")["severity"]
    return out.filter(F.col(name) < REJECT).select(*docs.columns)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = shared.table(spark, sf_dir, "documents").select("doc_id", "text"), shared.table(spark, sf_dir, "labels")
    out = scored(docs, train(docs, labels))
    return out.select("doc_id", F.round("severity", 6).alias("severity"), "grade", (F.col("severity") >= REJECT).alias("rejected"))
