"""From logits to whole-number cumulative distributions, a column of bins to a row: arrays throughout, no shuffle.

Sums run in bin order, so the result doesn't depend on how rows are dealt; allocation is in whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let as _let
from ..functions.layout import whole_div
from ..functions.quantise import quantise_logit

#: Fixed values of the bitstream.
RANGE_BITS, FP_SCALE, MIN_RANGE = 24, 8192, 2


def _sum(values: Column, kind: str) -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda s, x: s + x)


def softmax(logits: DataFrame, step: float, tau: float = 1.0, fp_scale: int = FP_SCALE) -> DataFrame:
    """(id, pdf, near_uniform) from (id, logits): quantised logits, then softmax; a column close to uniform becomes it."""
    quantised = F.transform("logits", lambda x: quantise_logit(x.cast("double") / tau, step))

    def finish(x):  # x: hi, lo, e, d
        broken = F.isnan(x["d"]) | (x["d"] <= 0) | (x["d"] == float("inf")) | x["d"].isNull()
        flat = F.transform(x["e"], lambda _: F.lit(1.0) / F.size("logits"))

        def judge(p):
            near = broken | (x["hi"] - x["lo"] <= 2 * step) | (F.array_max(p) - F.array_min(p) <= 0.25 / fp_scale)
            return F.struct(F.when(near, flat).otherwise(p).alias("pdf"), near.alias("near_uniform"))

        return _let(F.transform(x["e"], lambda e: e / x["d"]), judge)

    def scale(x):  # x: q, hi, lo
        e = F.transform(x["q"], lambda v: F.exp(v - x["hi"]))
        return _let(e, lambda e: _let(F.struct(x["hi"].alias("hi"), x["lo"].alias("lo"), e.alias("e"), _sum(e, "double").alias("d")), finish))

    made = _let(quantised, lambda q: _let(F.struct(q.alias("q"), F.array_max(q).alias("hi"), F.array_min(q).alias("lo")), scale))
    return logits.select("id", made.alias("made")).select("id", "made.pdf", "made.near_uniform")


def allocate(pdfs: DataFrame, bits: int = RANGE_BITS, fp_scale: int = FP_SCALE, min_range: int = MIN_RANGE) -> DataFrame:
    """(id, cdf) from (id, pdf): every bin gets ``min_range``, the rest goes by weight, remainders to the largest fractions.

    Weights are floor(p * fp_scale); a column without weight is shared evenly. The last value is 2^bits.
    """
    n = F.size("pdf")

    def weights(total):
        usable = (total > 0) & (total < float("inf")) & ~F.isnan(total)
        return F.transform("pdf", lambda p: F.when(usable, F.floor(F.greatest(F.coalesce(p, F.lit(0.0)), F.lit(0.0)) * fp_scale)).otherwise(F.lit(fp_scale)).cast("long"))

    def even(c):
        return _let(_sum(c, "bigint"), lambda s: F.when(s > 0, F.struct(c.alias("c"), s.alias("s"))).otherwise(F.struct(F.transform(c, lambda x: F.lit(1).cast("long")).alias("c"), n.cast("long").alias("s"))))

    def base(x):  # x: c, s
        a = F.lit(1 << bits).cast("long") - n * F.lit(min_range)
        return _let(a, lambda a: _let(F.transform(x["c"], lambda c: whole_div(a * c, x["s"])), lambda b: spread(a, x, b)))

    def spread(a, x, b):
        keys = F.transform(F.arrays_zip(x["c"].alias("c"), b.alias("b")), lambda y, r: (a * y["c"] - x["s"] * y["b"]) * (n + 1) - r)

        def share(k):  # k: keys, left
            return _let(F.when(k["left"] > 0, F.element_at(F.reverse(F.array_sort(k["keys"])), F.greatest(k["left"], F.lit(1)).cast("int"))), lambda kth: F.transform(F.arrays_zip(b.alias("b"), k["keys"].alias("k")), lambda y: y["b"] + min_range + F.when(y["k"] >= kth, 1).otherwise(0)))

        return _let(F.struct(keys.alias("keys"), (a - _sum(b, "bigint")).alias("left")), share)

    def run(shares):
        start = F.struct(F.array().cast("array<bigint>").alias("cdf"), F.lit(0).cast("long").alias("at"))
        return F.aggregate(shares, start, lambda s, x: F.struct(F.array_append(s["cdf"], s["at"] + x).alias("cdf"), (s["at"] + x).alias("at")))["cdf"]

    total = _sum(F.transform("pdf", lambda p: F.greatest(F.coalesce(p, F.lit(0.0)), F.lit(0.0))), "double")
    return pdfs.select("id", _let(total, lambda t: _let(weights(t), lambda c: _let(even(c), lambda x: _let(base(x), run)))).alias("cdf"))


def symbol_at(cdf: Column, target: Column) -> Column:
    """The first bin whose cumulative count is over ``target``, from 0: a search by halves in at most 65,535 bins."""

    def search(x):  # x: cdf, target
        halves = F.array(*(F.lit(1 << k) for k in range(15, -1, -1)))
        below = lambda at, step: (at + step <= F.size(x["cdf"])) & (F.get(x["cdf"], at + step - 1) <= x["target"])
        return F.aggregate(halves, F.lit(0), lambda at, step: F.when(below(at, step), at + step).otherwise(at))

    return _let(F.struct(cdf.alias("cdf"), target.alias("target")), search)
