"""Operators of frame models over weight tables, as array expressions in a row: strided convolutions, group norm, a gated recurrence, sliding attention.

A signal is an array of channels, each an array of places; a segment is a row, so nothing is shuffled. Weights are arrays of a row of their
own that is broadcast (:func:`weights_row` checks how many values they are).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.binding import let
from .arrays import reflect_pad

def weights_row(weights: DataFrame, axes: list, value: str, name: str, limit: int = 1 << 24) -> DataFrame:
    """One row whose ``name`` holds a table (axes..., value) as nested arrays, the first axis outermost; an error over ``limit`` values.

    Places along an axis count in their order and may be any numbers.
    """
    rows = weights.select(*axes, F.col(value).cast("double").alias("__x"), F.lit(1).cast("long").alias("__n"))
    for k in range(len(axes), 0, -1):
        rows = rows.groupBy(*axes[: k - 1]).agg(F.array_sort(F.collect_list(F.struct(axes[k - 1], "__x"))).alias("__x"), F.sum("__n").alias("__n"))
        rows = rows.withColumn("__x", F.transform("__x", lambda s: s["__x"]))
    return rows.select(F.when(F.col("__n") > limit, F.raise_error(F.lit(f"more than {limit} weights")).cast(rows.schema["__x"].dataType)).otherwise(F.col("__x")).alias(name))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def padding(taps: int, stride: int) -> tuple[int, int]:
    """(left, right) places by which a kernel is longer than its stride: the odd one stands on the left."""
    right = (taps - stride) // 2
    return taps - stride - right, right


def convolution(signal: Column, weight: Column, bias: Column, taps: int, stride: int) -> Column:
    """Channels x places through ``weight`` [out][in][tap] and ``bias`` [out], one place in ``stride``, the signal reflected at both ends.

    Each output is a sum over the channels of products with a slice of ``taps`` places.
    """
    left, right = padding(taps, stride)
    padded = F.transform(signal, lambda c: reflect_pad(c, left, right))

    def run(x):
        places = F.floor((F.size(x[0]) - taps) / F.lit(stride)).cast("int")

        def out(w, o):
            def one(t):
                return F.get(bias, o) + _sum(F.zip_with(w, x, lambda wc, xc: _dot(wc, F.slice(xc, t * stride + 1, F.lit(taps)))))

            return F.transform(F.sequence(F.lit(0), places), one)

        return F.transform(weight, out)

    return let(padded, run)


def transposed_convolution(signal: Column, weight: Column, bias: Column, taps: int, stride: int) -> Column:
    """The transpose, untrimmed: places * stride + taps - stride of each output; ``weight`` is [in][out][tap].

    By phases: place j takes the taps j modulo ``stride``, one every ``stride``, so none meets a place that the stride leaves out.
    """
    phases = -(-taps // stride)
    length = (F.size(F.get(signal, F.lit(0))) - 1) * stride + taps
    outs = F.size(F.get(weight, F.lit(0)))

    def out(o):
        def one(j):
            def channel(xc, wc):
                w = F.get(wc, o)
                tap = lambda m: j % stride + m * stride
                place = lambda m: F.floor(j / F.lit(stride)).cast("int") - m
                return _sum(F.transform(F.array(*(F.lit(m) for m in range(phases))), lambda m: F.when((tap(m) < taps) & (place(m) >= 0) & (place(m) < F.size(xc)), F.get(xc, place(m)) * F.get(w, tap(m))).otherwise(F.lit(0.0))))

            return F.get(bias, o) + _sum(F.zip_with(signal, weight, channel))

        return F.transform(F.sequence(F.lit(0), length - 1), one)

    return F.transform(F.sequence(F.lit(0), outs - 1), out)


def trimmed(signal: Column, taps: int, stride: int) -> Column:
    """What a transposed convolution keeps: without the places by which a kernel is longer than its stride."""
    left, right = padding(taps, stride)
    return F.transform(signal, lambda c: F.slice(c, F.lit(left + 1), F.size(c) - left - right))


def group_norm(signal: Column, scale: Column, bias: Column, eps: float = 1e-5) -> Column:
    """All channels and places as one group: less their mean, by the root of their (population) variance, then each channel's scale and bias."""

    def run(x):
        flat = F.flatten(x)
        n = F.size(flat).cast("double")

        def spread(mean):
            variance = F.aggregate(flat, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / n
            return let(F.struct(mean.alias("mean"), F.sqrt(variance + eps).alias("root")), lambda m: F.transform(x, lambda c, o: F.transform(c, lambda v: (v - m["mean"]) / m["root"] * F.get(scale, o) + F.get(bias, o))))

        return let(_sum(flat) / n, spread)

    return let(signal, run)


def recurrence(steps: Column, weight: Column, recurrent: Column, bias: Column, hidden: int, block: int = 64) -> Column:
    """Outputs [step][hidden] of a long short-term memory over ``steps`` [step][input]; its gates stand in the order input, output, forget, cell.

    ``weight`` is [4 * hidden][input], ``recurrent`` [4 * hidden][hidden], ``bias`` the input's 4 * hidden and then the recurrent ones.
    One pass along the steps that carries the state; outputs are gathered in blocks, so their copies stay in proportion to the steps.
    """
    zeros = F.array(*[F.lit(0.0)] * hidden)
    sigmoid = lambda x: 1.0 / (1.0 + F.exp(-x))

    def step(s, x):
        gates = F.zip_with(F.zip_with(weight, recurrent, lambda w, r: _dot(w, x) + _dot(r, s["h"])), F.sequence(F.lit(0), F.lit(4 * hidden - 1)), lambda v, g: v + F.get(bias, g) + F.get(bias, g + 4 * hidden))

        def state(g):
            cell = F.transform(F.sequence(F.lit(0), F.lit(hidden - 1)), lambda k: sigmoid(F.get(g, k + 2 * hidden)) * F.get(s["c"], k) + sigmoid(F.get(g, k)) * F.tanh(F.get(g, k + 3 * hidden)))
            return let(cell, lambda c: let(F.zip_with(c, F.slice(g, hidden + 1, hidden), lambda v, o: sigmoid(o) * F.tanh(v)), lambda h: F.struct(h.alias("h"), c.alias("c"), F.array_append(s["out"], h).alias("out"))))

        return let(gates, state)

    empty = F.array().cast("array<array<double>>")

    def along(s, k):
        begin = F.struct(s["h"].alias("h"), s["c"].alias("c"), empty.alias("out"))
        done = F.aggregate(F.slice(steps, k * block + 1, F.lit(block)), begin, step)
        return let(done, lambda d: F.struct(d["h"].alias("h"), d["c"].alias("c"), F.array_append(s["out"], d["out"]).alias("out")))

    blocks = F.sequence(F.lit(0), F.ceil(F.size(steps) / F.lit(block)).cast("int") - 1)
    start = F.struct(zeros.alias("h"), zeros.alias("c"), F.array().cast("array<array<array<double>>>").alias("out"))
    return F.when(F.size(steps) == 0, empty).otherwise(F.flatten(F.aggregate(blocks, start, along)["out"]))


def attention(rows: DataFrame, heads: int, past: int, keys: tuple = ("track",), at: str = "t") -> DataFrame:
    """(keys, at, out): each step's attention over its own key and the ``past`` before it, from (keys, at, q, k, v) arrays of one length.

    The steps of a key meet in a window of ``past`` + 1 rows, never all with all. A head is a slice; its softmax takes one pass over
    the window: the highest score so far, and the sum and the weighted values, rescaled where it rises. Where the sum isn't a
    positive finite number the values are averaged. A length that the heads don't divide is an error.
    """
    frame = W.partitionBy(*keys).orderBy(at).rowsBetween(-past, 0)
    held = rows.withColumn("__held", F.collect_list(F.struct("k", "v")).over(frame))
    size = F.size("q")
    part = F.when(size % heads == 0, (size / F.lit(heads)).cast("int")).otherwise(F.raise_error(F.lit(f"length that isn't divisible by {heads} heads")).cast("int"))
    low = F.lit(float("-inf"))

    def head(width):
        def run(h):
            own = lambda a: F.slice(a, h * width + 1, width)
            zeros = F.transform(own(F.col("q")), lambda _: F.lit(0.0))
            scale = 1.0 / F.sqrt(width.cast("double"))

            def step(s, x):
                def with_score(score):
                    top = F.greatest(s["top"], score)
                    shrink = F.when(s["top"] == top, F.lit(1.0)).otherwise(F.exp(s["top"] - top))
                    e = F.when(score == low, F.lit(0.0)).otherwise(F.exp(score - top))

                    def add(f):
                        acc = F.zip_with(s["acc"], own(x["v"]), lambda a, v: a * f["shrink"] + v * f["e"])
                        mean = F.zip_with(s["mean"], own(x["v"]), lambda a, v: a + v)
                        return F.struct(f["top"].alias("top"), (s["sum"] * f["shrink"] + f["e"]).alias("sum"), acc.alias("acc"), mean.alias("mean"))

                    return let(F.struct(top.alias("top"), shrink.alias("shrink"), e.alias("e")), add)

                return let(_dot(own(F.col("q")), own(x["k"])) * scale, with_score)

            done = F.aggregate("__held", F.struct(low.alias("top"), F.lit(0.0).alias("sum"), zeros.alias("acc"), zeros.alias("mean")), step)
            usable = lambda d: ~F.isnan(d["sum"]) & (d["sum"] > 0) & (d["sum"] < float("inf"))
            return let(done, lambda d: F.when(usable(d), F.transform(d["acc"], lambda a: a / d["sum"])).otherwise(F.transform(d["mean"], lambda a: a / F.size("__held"))))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(heads - 1)), run))

    return held.select(*keys, at, let(part, head).alias("out"))
