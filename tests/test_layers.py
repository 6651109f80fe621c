"""Convolutions, group norm, recurrence and attention against NumPy, step by step."""

import math

import numpy as np
import pytest
from framewright.operators import layers
from pyspark.sql import functions as F


def conv(x, w, b, stride):
    left, right = layers.padding(w.shape[2], stride)
    p = np.pad(x, ((0, 0), (left, right)), mode="reflect")
    n = (p.shape[1] - w.shape[2]) // stride + 1
    return np.stack([[b[o] + (w[o] * p[:, t * stride : t * stride + w.shape[2]]).sum() for t in range(n)] for o in range(len(w))])


def transposed(x, w, b, stride):
    y = np.zeros((w.shape[1], (x.shape[1] - 1) * stride + w.shape[2])) + b[:, None]
    for c in range(x.shape[0]):
        for t in range(x.shape[1]):
            y[:, t * stride : t * stride + w.shape[2]] += x[c, t] * w[c]
    return y


def lit(a):
    return F.lit(float(a)) if np.ndim(a) == 0 else F.array(*map(lit, a))


def run(spark, x, expression):
    df = spark.createDataFrame([(x.tolist(),)], "x array<array<double>>")
    return np.array(df.select(expression(F.col("x")).alias("y")).first().y)


@pytest.mark.parametrize("stride, taps", [(1, 3), (1, 7), (2, 4), (3, 4), (2, 2), (5, 9)])
def test_convolutions(spark, stride, taps):
    rng = np.random.default_rng(stride * 10 + taps)
    x, w, b = rng.normal(size=(2, 21)), rng.normal(size=(3, 2, taps)), rng.normal(size=3)
    assert np.allclose(run(spark, x, lambda c: layers.convolution(c, lit(w), lit(b), taps, stride)), conv(x, w, b, stride))
    w = rng.normal(size=(2, 3, taps))
    whole = transposed(x, w, b, stride)
    assert np.allclose(run(spark, x, lambda c: layers.transposed_convolution(c, lit(w), lit(b), taps, stride)), whole)
    left, right = layers.padding(taps, stride)
    assert np.allclose(run(spark, whole, lambda c: layers.trimmed(c, taps, stride)), whole[:, left : whole.shape[1] - right])


def test_group_norm(spark):
    rng = np.random.default_rng(1)
    x, scale, bias = rng.normal(size=(3, 8)), rng.normal(size=3), rng.normal(size=3)
    want = (x - x.mean()) / np.sqrt(x.var() + 1e-5) * scale[:, None] + bias[:, None]
    assert np.allclose(run(spark, x, lambda c: layers.group_norm(c, lit(scale), lit(bias))), want)


@pytest.mark.parametrize("steps, block", [(1, 64), (9, 4), (150, 64), (0, 64)])
def test_recurrence(spark, steps, block):
    rng = np.random.default_rng(steps)
    hidden, size = 3, 2
    x, w, r, b = rng.normal(size=(steps, size)), rng.normal(size=(4 * hidden, size)), rng.normal(size=(4 * hidden, hidden)), rng.normal(size=8 * hidden)
    h = c = np.zeros(hidden)
    out = []
    sig = lambda v: 1 / (1 + np.exp(-v))
    for t in range(steps):
        i, o, f, g = np.split(w @ x[t] + r @ h + b[: 4 * hidden] + b[4 * hidden :], 4)
        c = sig(f) * c + sig(i) * np.tanh(g)
        h = sig(o) * np.tanh(c)
        out.append(h)
    got = run(spark, x, lambda s: layers.recurrence(s, lit(w), lit(r), lit(b), hidden, block))
    assert np.allclose(got.reshape(steps, hidden), np.array(out).reshape(steps, hidden))


def attend(q, k, v, heads, past):
    out, width = np.zeros_like(q), q.shape[1] // heads
    with np.errstate(all="ignore"):
        for t in range(len(q)):
            first = max(0, t - past)
            for h in range(heads):
                s = slice(h * width, (h + 1) * width)
                score = np.array([float((q[t, s] * k[j, s]).sum()) / math.sqrt(width) for j in range(first, t + 1)])
                top = np.fmax.reduce(score)
                e = np.exp(score - top)
                p = e / e.sum() if np.isfinite(e.sum()) and e.sum() > 0 else np.full(len(score), 1 / len(score))
                out[t, s] = p @ v[first : t + 1, s]
    return out


@pytest.mark.parametrize("heads, past", [(1, 3), (2, 0), (4, 5), (2, 50)])
def test_attention(spark, heads, past):
    rng = np.random.default_rng(heads)
    q, k, v = (rng.normal(size=(20, 8)) * 4 for _ in "qkv")
    k[3], k[7] = 1e308, -1e308  # scores that overflow: infinite either way, or not a number
    q[9] = 0
    rows = [(1, t, q[t].tolist(), k[t].tolist(), v[t].tolist()) for t in range(20)] + [(2, t, v[t].tolist(), v[t].tolist(), q[t].tolist()) for t in range(5)]
    df = spark.createDataFrame(rows, "track long, t long, q array<double>, k array<double>, v array<double>").repartition(3)
    got = {(r.track, r.t): r.out for r in layers.attention(df, heads, past).collect()}
    for track, want in ((1, attend(q, k, v, heads, past)), (2, attend(v[:5], v[:5], q[:5], heads, past))):
        assert np.allclose(np.array([got[track, t] for t in range(len(want))]), want), track
    with pytest.raises(Exception, match="divisible"):
        layers.attention(df, 3, past).collect()


def test_weights_row(spark):
    rng = np.random.default_rng(2)
    w = rng.normal(size=(3, 2, 4))
    rows = [(o, i, t, float(w[o, i, t])) for o in range(3) for i in range(2) for t in range(4)]
    df = spark.createDataFrame(rows, "o int, i int, t int, x double").repartition(4)
    assert np.allclose(layers.weights_row(df, ["o", "i", "t"], "x", "w").first().w, w)
    with pytest.raises(Exception, match="weights"):
        layers.weights_row(df, ["o", "i", "t"], "x", "w", limit=23).collect()
