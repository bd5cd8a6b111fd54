import math

import numpy as np
import pytest
from heddle.llm import whitening as W


def brute(rows, keep=8):
    """Exact sums, a formed covariance and a dense solver."""
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in x])
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1][:keep], q[:, ::-1][:, :keep]
    far = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    return n, far, y @ q / np.sqrt(e), e / np.trace(y.T @ y / n)


def compare(found, rows, keep=8, close=1e-6):
    n, far, white, share = brute(rows, keep)
    got = {(r.vec_id, r.component): r for r in found}
    assert len(got) == len(found) == len(rows) * white.shape[1]
    for k in range(white.shape[1]):
        mine = np.array([got[i, k + 1].whitened for i, _ in rows])
        sign = np.sign(mine @ white[:, k])
        assert np.abs(sign * mine - white[:, k]).max() < close
    for at, (i, _) in enumerate(rows):
        r = got[i, 1]
        assert (r.n, r.deviation) == (n, far[at]) and r.identity_error < 1e-9 and abs(r.explained / share[0] - 1) < 1e-9


def test_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    compare(W.op11_whitening(spark, sf).collect(), rows)


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


def test_filter_and_certificate_on_many_dimensions(spark):
    """A falling spectrum in 120 dimensions: the block never spans them all, so the filter decides."""
    draw = np.random.default_rng(3)
    a = draw.normal(size=(900, 120)) * np.exp(-np.arange(120) / 9) @ np.linalg.qr(draw.normal(size=(120, 120)))[0]
    rows = [(i, v.tolist()) for i, v in enumerate(a)]
    blocks = W.packed(frame(spark, rows, "double").repartition(5))
    model = W.fit(blocks)
    assert model.vectors.shape == (120, 8) and (model.residuals < 1e-12 * model.values[0]).all() and model.passes < 40
    compare(W.whitened(blocks, model, W.identity_error(blocks, model)).collect(), rows)


def test_flat_spectrum_widens_the_block(spark):
    draw = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(draw.normal(size=(3000, 48)))]
    blocks = W.packed(frame(spark, rows, "double"))
    model = W.fit(blocks)
    assert model.passes < 80
    compare(W.whitened(blocks, model, W.identity_error(blocks, model)).collect(), rows)


def test_a_hidden_direction_is_found():
    """A block that starts orthogonal to the largest direction: the certificate's fresh block finds it."""

    class Known(W.Passes):
        def __init__(self, v):
            self.v, self.dim = v, len(v)

        def times(self, q):
            return self.v @ q

    work = Known(np.diag([90.0, 50, 40, 30, 5, 4, 3, 2, 1, 1]))
    draw = np.random.default_rng(1)
    fresh = lambda beside, k: np.linalg.qr(np.hstack([beside, draw.normal(size=(10, k))]))[0][:, beside.shape[1] :]
    assert W.uncovered(work, np.eye(10)[:, 1:5], 5.0, 40.0, fresh) is not None
    assert W.uncovered(work, np.eye(10)[:, :4], 5.0, 30.0, fresh) is None


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.5, -3.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, []), (9, [1.0]), (10, [2.0, 2.0])]
    got = W.whiten(frame(spark, rows)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (10, 1), (10, 2)]
    assert {r.n for r in got} == {4} and got[0].identity_error < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(i, [3.0, 4.0]) for i in range(5)], [(1, None), (2, [])]])
def test_without_variance_there_is_nothing(spark, rows):
    out = W.whiten(frame(spark, rows))
    assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_one_dimension_varies_and_extra_columns(spark):
    df = spark.createDataFrame([(f"v{i}", [float(i), 7.0], 1, 2) for i in range(4)], "k string, v array<double>, x int, n int")
    got = W.whiten(df, "k", "v").collect()
    assert sorted(r.k for r in got) == ["v0", "v1", "v2", "v3"] and {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12


def test_deviations_of_any_size():
    x = np.array([[100_000, 2**40], [2**52, -(2**52)]])
    n, sums = 1000, [10**8, 2**50]
    want = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x.tolist()]
    assert W.deviations(x, n, sums) == [d if d < 2**63 else None for d in want]
    assert W.deviations(x[:1], 1, [0, 2**40]) == [10**10]


def test_huge_entries_saturate(spark):
    got = W.whiten(frame(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 5.0])])).collect()
    assert {r.vec_id for r in got} == {1, 2, 3} and {r.n for r in got} == {3}
