"""Operator 11: whitening of embeddings by Chebyshev-filtered subspace iteration.

Entries become whole numbers, whose sums are exact. The leading eigenvectors of their covariance V come from a
block of vectors Q that is multiplied by V again and again; V itself is never formed: each product is one
pass over the data, in which every task centres its rows X and adds up X'(XQ). Between two
Rayleigh-Ritz steps a Chebyshev polynomial of V, by its three-term recurrence, damps the spectrum below the
block's smallest Ritz value. The wanted vectors are certified when their residuals are down to rounding and a
fresh random block, filtered likewise beside them, finds nothing larger.

Vectors that are null or hold null or non-finite entries are left out, and so are those whose length isn't the one
that most have (of two the longer); empty ones too. A null id stays. Repeated rows count each. Where all
vectors are equal, or none is left, the result is empty; components without variance aren't
returned. 1024 times an entry saturates at 2**52 either way; a deviation beyond 64 bits is null. Only id and vector
are read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

KEEP, GUARD, SEED = 8, 16, 20240229
SCALE, OFFSET, LARGEST = 1024.0, 100_000, 2.0**52
#: Residuals count as rounding below this share of the largest eigenvalue; components below FLAT of it have no variance.
TOLERANCE, FLAT = 1e-13, 1e-11
#: Passes between two Rayleigh-Ritz steps at most. A block that needs more than SLOW passes to converge is doubled; once
#: it spans all dimensions one step is exact, so the iteration ends on any spectrum.
DEGREE, SLOW = 12, 48


@dataclass
class Whitening:
    """n vectors with sums S of each dimension; eigenvectors (columns) and eigenvalues of V, its trace, and the residual norms and
    passes of the iteration."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int


def packed(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Blocks of usable vectors of one length as whole numbers, less the block's smallest one, in as many bytes as they
    need, with the exact sum of each dimension; written to the shared folder, as every pass reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = b.column(0), b.column(1)
            n, starts, flat = len(lists), np.asarray(lists.offsets), lists.values
            entries = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(entries))))  # nulls are NaN here
            size = np.diff(starts)
            good = (bad[starts[1:]] == bad[starts[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False) & (size > 0)
            for dim in np.unique(size[good]) if n else ():
                at = np.flatnonzero(good & (size == dim))
                with np.errstate(over="ignore"):
                    x = np.clip(np.floor(SCALE * entries[starts[at][:, None] + np.arange(dim)]), -LARGEST, LARGEST).astype(np.int64) + OFFSET
                base = int(x.min())
                wide = np.min_scalar_type(int(x.max()) - base).newbyteorder("<")
                high, low = (x >> 26).sum(axis=0), (x & (1 << 26) - 1).sum(axis=0)
                sums = [Decimal((int(h) << 26) + int(lo)) for h, lo in zip(high, low, strict=True)]
                row = [pa.array([len(at)], pa.int64()), pa.array([int(dim)], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), ids.take(pa.array(at)))]
                row += [pa.array([base], pa.int64()), pa.array([wide.itemsize], pa.int32()), pa.array([(x - base).astype(wide).tobytes()], pa.binary()), pa.array([sums], pa.list_(pa.decimal128(38, 0)))]
                yield pa.record_batch(row, names=["n", "dim", "ids", "base", "width", "x", "sums"])

    kind = df.schema[vec_id].dataType
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("dim", T.IntegerType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("base", T.LongType()), T.StructField("width", T.IntegerType()), T.StructField("x", T.BinaryType()), T.StructField("sums", T.ArrayType(T.DecimalType(38, 0)))])
    return shared.stored(df.select(vec_id, vector).mapInArrow(run, schema), "vectors")


def unpacked(b: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, whole numbers) of the blocks of a batch with columns ids, base, width and x."""
    for i in range(b.num_rows):
        x = np.frombuffer(b.column("x")[i].as_buffer(), dtype=f"<u{b.column('width')[i].as_py()}").reshape(-1, dim)
        yield b.column("ids")[i].values if "ids" in b.schema.names else None, x.astype(np.int64) + b.column("base")[i].as_py()


class Passes:
    """Products of V with a block of vectors, each a pass over the blocks of one length."""

    def __init__(self, blocks: DataFrame, dim: int, n: int, sums: list[int]):
        self.blocks, self.dim, self.n, self.sums, self.done = blocks.filter(F.col("dim") == dim), dim, n, sums, 0
        # The mean as a whole number and a remainder: an entry less the first is exact, so only the last step rounds.
        self.whole = np.array([s // n for s in sums], dtype=np.int64)
        self.rest = np.array([s % n / n for s in sums])

    def added_up(self, make, height: int, width: int) -> np.ndarray:
        """The sum over all blocks of make(centred rows), of ``height`` by ``width``; tasks add up first, then Spark by row."""
        dim, whole, rest = self.dim, self.whole, self.rest

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((height, width))
            for b in batches:
                for _, x in unpacked(b, dim):
                    total += make((x - whole).astype(np.float64) - rest)
            yield pa.record_batch([pa.array(np.arange(height, dtype=np.int32)), *map(pa.array, np.ascontiguousarray(total.T))], names=["i", *names])

        names = [f"q{k}" for k in range(width)]
        rows = self.blocks.select("base", "width", "x").mapInArrow(run, ", ".join(["i int", *[f"{c} double" for c in names]]))
        out = np.zeros((height, width))
        for r in rows.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect():  # a row for each dimension
            out[r["i"]] = r[1:]
        self.done += 1
        return out

    def times(self, q: np.ndarray) -> np.ndarray:
        """VQ."""
        return self.added_up(lambda y: y.T @ (y @ q), self.dim, q.shape[1]) / self.n

    def times_and_trace(self, q: np.ndarray) -> tuple[np.ndarray, float]:
        out = self.added_up(lambda y: np.hstack([y.T @ (y @ q), np.einsum("ij,ij->j", y, y)[:, None]]), self.dim, q.shape[1] + 1) / self.n
        return out[:, :-1], float(out[:, -1].sum())

    def filtered(self, q: np.ndarray, v: np.ndarray, degree: int, cut: float, top: float) -> np.ndarray:
        """The Chebyshev polynomial of V that stays small on [0, cut], applied to Q (with VQ = v at hand) and scaled to 1 at ``top``."""
        half = cut / 2
        sigma = half / (top - half)
        last, now, step = q, (v - half * q) * (sigma / half), sigma
        for _ in range(1, degree):
            further = 1 / (2 / sigma - step)
            last, now = now, (self.times(now) - half * now) * (2 * further / half) - last * (step * further)
            step = further
        return now


def ritz(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz: Ritz values, falling, with Ritz vectors and their products with V."""
    h = q.T @ v
    values, turn = np.linalg.eigh((h + h.T) / 2)
    return values[::-1], q @ turn[:, ::-1], v @ turn[:, ::-1]


def fit(blocks: DataFrame, keep: int = KEEP, guard: int = GUARD, seed: int = SEED) -> Whitening | None:
    """The leading components of the blocks' vectors; None without vectors."""
    most = blocks.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if most is None:
        return None
    dim, n = most["dim"], most["n"]
    sums = [0] * dim
    for r in blocks.filter(F.col("dim") == dim).select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s")).collect():
        sums[r["at"]] = int(r["s"])
    work, draw = Passes(blocks, dim, n, sums), np.random.default_rng(seed)
    keep = min(keep, dim)
    fresh = lambda beside, k: np.linalg.qr(np.hstack([beside, draw.normal(size=(dim, k))]))[0][:, beside.shape[1] :]
    q = fresh(np.zeros((dim, 0)), min(dim, keep + guard))
    v, trace = work.times_and_trace(q)
    before = np.inf
    while True:
        values, q, v = ritz(q, v)
        size, top, cut = q.shape[1], values[0], max(values[-1], 0.0)
        if top <= 0:
            break
        residuals = np.linalg.norm(v - q * values, axis=0)[:keep]
        worst = residuals.max() / top
        if size == dim or worst <= TOLERANCE or (worst <= 1e3 * TOLERANCE and worst > before / 2):
            if size == dim or not (missed := uncovered(work, q, cut, values[keep - 1], fresh)):
                break
            q, v = np.hstack([q, missed[0]]), np.hstack([v, missed[1]])
            continue
        before = worst
        grows = lambda e: (lambda t: np.log(t + np.sqrt(max(t * t - 1, 0.0))))(2 * e / cut - 1) if cut > 0 else np.inf
        each = grows(max(values[keep - 1], cut))
        if each <= 0 or np.log(worst / TOLERANCE) / each > SLOW:
            more = fresh(q, min(size, dim - size))
            q, v = np.hstack([q, more]), np.hstack([v, work.times(more)])
            continue
        # No more than the largest direction may outgrow the smallest wanted one by without drowning it.
        degree = max(2, min(DEGREE, int(np.ceil(np.log(worst / TOLERANCE) / each)) + 1, int(23 / max(grows(top) - each, 1e-9))))
        q = np.linalg.qr(work.filtered(q, v, degree, cut, top) if cut > 0 else v)[0]
        v = work.times(q)
    real = np.flatnonzero(values[:keep] > FLAT * max(top, 0.0))
    left = np.linalg.norm(v - q * values, axis=0)[real]
    return Whitening(n, sums, q[:, real], values[real], trace, left, work.done)


def uncovered(work: Passes, q: np.ndarray, cut: float, least: float, fresh) -> tuple[np.ndarray, np.ndarray] | None:
    """A random block beside Q, filtered: (it, its product with V) if it holds a direction of more variance than the least wanted one."""
    out = lambda r: np.linalg.qr(r - q @ (q.T @ r))[0]
    r = fresh(q, min(4, work.dim - q.shape[1]))
    v = work.times(r)
    if cut > 0:
        r = out(work.filtered(r, v, 4, cut, max(least, cut * 1.001)))
        v = work.times(r)
    return (r, v) if ritz(r, v)[0][0] > least * (1 + 1e-9) else None


def identity_error(blocks: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity, by a pass of its own."""
    k, to = len(model.values), model.vectors / np.sqrt(model.values)
    white = Passes(blocks, len(model.sums), model.n, model.sums).added_up(lambda y: (y @ to).T @ (y @ to), k, k) / model.n
    return float(np.abs(white - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums over dimensions of (n*x-S)^2, exact; None beyond 64 bits. Plain arrays serve where they can't overflow."""
    least, most = int(x.min()), int(x.max())
    far = max(max(abs(n * least - s), abs(n * most - s)) for s in sums)
    if far * far * len(sums) < 1 << 63:
        y = n * x - np.array(sums, dtype=np.int64)
        return np.einsum("ij,ij->i", y, y).tolist()
    y = n * x.astype(object) - np.array(sums, dtype=object)
    return [d if d < 1 << 63 else None for d in (y * y).sum(axis=1).tolist()]


def whitened(blocks: DataFrame, model: Whitening, error: float, vec_id: str = "vec_id") -> DataFrame:
    """A row for each vector and component: the id, component (from 1), n, deviation, whitened, explained, identity_error."""
    dim, n, sums = len(model.sums), model.n, model.sums
    whole, rest = np.array([s // n for s in sums], dtype=np.int64), np.array([s % n / n for s in sums])
    to, k = model.vectors / np.sqrt(model.values), len(model.values)
    explained = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, x in unpacked(b, dim):
                if k == 0:
                    continue
                again = np.repeat(np.arange(len(x)), k)
                found = ((x - whole).astype(np.float64) - rest) @ to
                far = pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(again))
                columns = [ids.take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(again), n)), far, pa.array(found.reshape(-1)), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(again), error))]
                yield pa.record_batch(columns, names=[vec_id, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    schema = f"`{vec_id}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return blocks.filter(F.col("dim") == dim).select("ids", "base", "width", "x").mapInArrow(run, schema)


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", keep: int = KEEP) -> DataFrame:
    """Fits and applies: see whitened()."""
    blocks = packed(df, vec_id, vector)
    model = fit(blocks, keep)
    if model is None:
        model = Whitening(1, [0], np.zeros((1, 0)), np.zeros(0), 1.0, np.zeros(0), 0)
        return whitened(blocks.filter("false"), model, 0.0, vec_id)
    return whitened(blocks, model, identity_error(blocks, model) if len(model.values) else 0.0, vec_id)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(shared.table(spark, sf_dir, "embeddings"))
