"""The learned weights against Newton's method on the same penalised likelihood."""

import math

import numpy as np
from pyspark.sql import functions as F

from tidemark.model import TERMS
from tidemark.operators import learned


def newton(x, y, strength, steps=60):
    """Weights and offset that minimise the sum of losses and |w|^2 / (2 C)."""
    z = np.c_[x, np.ones(len(x))]
    penalty = np.diag([1.0 / strength] * x.shape[1] + [0.0])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-z @ w))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + penalty, z.T @ (p - y) + penalty @ w)
        w -= step
    return w[:-1], w[-1]


def test_weights_are_the_penalised_optimum(spark):
    rng = np.random.default_rng(5)
    raw = rng.normal(size=(600, len(TERMS))) * [1.0, 5.0, 0.2, 3.0, 1.0, 0.5] + 2.0
    y = (rng.random(600) < 1.0 / (1.0 + np.exp(-(raw[:, 0] - 0.4 * raw[:, 1] + 3 * raw[:, 2])))).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(v), i) for i, (r, v) in enumerate(zip(raw, y))], [*TERMS, "label", "seq"])
    model = learned.logreg(df)
    scale = raw.std(axis=0, ddof=1)
    x = (raw - raw.mean(axis=0)) / scale
    w, offset = newton(x, y, 1.0)
    got = learned.weights(model)
    assert np.allclose([got[t] for t in TERMS], w / scale, atol=2e-4)
    margins = [r.score for r in learned.decision(model, df).orderBy("seq").select("score").collect()]
    assert np.allclose(margins, x @ w + offset, atol=2e-3)
    assert df.filter(F.col("label") == 1).count() == y.sum()


def test_equal_rows_are_boosted_as_one_that_weighs_as_many(spark):
    rng = np.random.default_rng(8)
    columns = [*TERMS, *learned.EXTRA]
    raw = np.c_[rng.integers(0, 4, (900, 2)) * 0.75 - 1.0, np.zeros(900), rng.integers(0, 3, (900, len(columns) - 3))]
    y = (rng.random(900) < 1.0 / (1.0 + np.exp(2.0 - raw[:, 0] * 2.0 - raw[:, 3]))).astype(int)
    # each of these rows 30 times over
    df = spark.createDataFrame([(*map(float, r), int(v), i) for i, (r, v) in enumerate(zip(raw, y))], [*columns, "label", "seq"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(30))))
    splits = learned.bin_splits(df, columns)
    assert learned.binned_groups(df, columns, splits)[1].agg(F.count(F.lit(1)), F.sum("_weight")).first() == (len({(*r, v) for r, v in zip(raw.tolist(), y)}), 27_000.0)
    once = df.filter("copy = 1")
    want, got = learned.gbt(df, trees=4, sampled=10**6), learned.gbt(df, trees=4)
    assert [s.uid.split("_")[0] for s in got.stages] == ["Bucketizer", "VectorAssembler", "GBTClassifier"] and len(want.stages) == 2
    a, b = ([r.score for r in learned.decision(m, once).orderBy("seq").select("score").collect()] for m in (want, got))
    assert np.allclose(a, b, atol=1e-9) and len(set(a)) > 10


def test_bins_are_of_all_rows(spark):
    values = np.r_[np.zeros(6000), np.linspace(1.0, 2.0, 6000), np.full(3000, 3.0)]
    df = spark.createDataFrame([(float(v), float(i % 7), 5.0) for i, v in enumerate(values)], ["a", "b", "c"])
    a, b, c = learned.bin_splits(df, ["a", "b", "c"])
    assert all(s[0] == -math.inf and s[-1] == math.inf and (np.diff(s) > 0).all() and 3 <= len(s) <= learned.BINS + 1 for s in (a, b, c))
    assert b[1:-1] == [i + 0.5 for i in range(6)]
    counts = np.histogram(values, np.r_[-9.0, a[1:-1], 9.0])[0]
    assert counts[counts > 0][0] == 6000 and counts[counts > 0][-1] == 3000 and counts[counts > 0][1:-1].max() < 2 * 15_000 / learned.BINS
