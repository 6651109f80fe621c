"""Queries of the frame models' operators over weight tables, and their SQL.

Vectors are signals of two channels of 32 places, or 16 steps of 4 values; the weights are the mean vectors of the labels.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import layout
from ..operators import layers
from .queries import table

PLACES, STRIDES, HIDDEN, PAST, HEADS = 32, (2, 4, 5, 8), 2, 7, 4


def means(spark, sf, groups: int | None = None):
    """(label, bin, w): a label's mean vector, in millionths; with ``groups``, that of the labels that are equal modulo it."""
    label = F.col("label") if groups is None else F.col("label") % groups
    e = table(spark, sf, "embeddings").select(label.alias("label"), F.posexplode("embedding").alias("bin", "x"))
    return e.groupBy("label", "bin").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("w"))


def signals(spark, sf):
    x = lambda a: F.transform(F.slice("embedding", a, PLACES), lambda v: v.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", F.array(x(1), x(1 + PLACES)).alias("x"))


def spread(df, stride):
    return df.select("vec_id", F.posexplode_outer("y").alias("out", "y")).select("vec_id", "out", F.posexplode_outer("y").alias("t", "y")).select("vec_id", F.lit(stride).cast("long").alias("stride"), F.col("out").cast("long").alias("out"), F.col("t").cast("long").alias("t"), (F.round("y", 6) + 0.0).alias("y"))


def strided_convolution(spark, sf):
    """Each stride with a kernel of twice its length; a channel out for each label."""
    held, made = means(spark, sf), None
    for stride in STRIDES:
        taps = 2 * stride
        w = held.where(F.col("bin") < 2 * taps).select("label", layout.whole_div(F.col("bin"), taps).alias("c"), (F.col("bin") % taps).alias("tap"), "w")
        weight = layers.weights_row(w, ["label", "c", "tap"], "w", "weight")
        bias = layers.weights_row(held.where("bin = 63"), ["label"], "w", "bias")
        x = signals(spark, sf).join(F.broadcast(weight.join(F.broadcast(bias))))
        part = spread(x.select("vec_id", layers.convolution(F.col("x"), F.col("weight"), F.col("bias"), taps, stride).alias("y")), stride)
        made = part if made is None else made.union(part)
    return made


def transposed_convolution(spark, sf):
    """The transposes, normalised as one group and trimmed: two channels in, two out, of the even and the odd labels."""
    held, made = means(spark, sf, 2), None
    for stride in STRIDES:
        taps = 2 * stride
        w = held.where(F.col("bin") < 2 * taps).select("label", layout.whole_div(F.col("bin"), taps).alias("c"), (F.col("bin") % taps).alias("tap"), "w")
        weight = layers.weights_row(w, ["c", "label", "tap"], "w", "weight")
        rest = [layers.weights_row(held.where(F.col("bin") == b), ["label"], "w", n) for b, n in ((63, "bias"), (62, "scale"), (61, "shift"))]
        one = weight
        for r in rest:
            one = one.join(F.broadcast(r))
        x = signals(spark, sf).join(F.broadcast(one))
        y = layers.transposed_convolution(F.col("x"), F.col("weight"), F.col("bias"), taps, stride)
        x = x.select("vec_id", "scale", "shift", y.alias("y"))
        x = x.select("vec_id", layers.trimmed(layers.group_norm(F.col("y"), F.col("scale"), F.col("shift")), taps, stride).alias("y"))
        part = spread(x, stride)
        made = part if made is None else made.union(part)
    return made


def gated_recurrence(spark, sf):
    """Vectors as 16 steps of 4 values; the gates' weights are the first eight labels' means, eight times as large."""
    held = means(spark, sf).where("label < 8").withColumn("w", F.col("w") * 8)
    weight = layers.weights_row(held.where("bin < 4"), ["label", "bin"], "w", "weight")
    recurrent = layers.weights_row(held.where("bin IN (4, 5)"), ["label", "bin"], "w", "recurrent")
    bias = layers.weights_row(held.where("bin IN (6, 7)"), ["bin", "label"], "w", "bias")
    one = weight.join(F.broadcast(recurrent)).join(F.broadcast(bias))
    steps = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.transform(F.slice("embedding", t * 4 + 1, F.lit(4)), lambda v: v.cast("double")))
    x = table(spark, sf, "embeddings").select("vec_id", steps.alias("steps")).join(F.broadcast(one))
    out = x.select("vec_id", F.posexplode_outer(layers.recurrence(F.col("steps"), F.col("weight"), F.col("recurrent"), F.flatten("bias"), HIDDEN)).alias("t", "h"))
    return out.select("vec_id", F.col("t").cast("long").alias("t"), F.round(F.col("h")[0], 6).alias("h0"), F.round(F.col("h")[1], 6).alias("h1"))


def sliding_attention(spark, sf):
    """Vectors of a block of 64 as a sequence; a vector's parts are its query, key and value, in four heads."""
    part = lambda a: F.transform(F.slice("embedding", a, 16), lambda v: v.cast("double") * 8)
    rows = table(spark, sf, "embeddings").select(layout.whole_div(F.col("vec_id"), 64).alias("track"), F.col("vec_id").alias("t"), part(1).alias("q"), part(17).alias("k"), part(33).alias("v"))
    out = layers.attention(rows, HEADS, PAST)
    return out.select(F.col("t").alias("vec_id"), F.posexplode_outer("out").alias("bin", "y")).select("vec_id", F.col("bin").cast("long").alias("bin"), F.round("y", 6).alias("y"))


QUERIES = {f.__name__: f for f in (strided_convolution, transposed_convolution, gated_recurrence, sliding_attention)}

MEANS = "flat AS (SELECT vec_id, label, unnest(generate_series(0, 63)) AS bin, unnest(embedding)::DOUBLE AS x FROM embeddings), means AS (SELECT label, bin, round(avg(x), 6) AS w FROM flat GROUP BY 1, 2), places AS (SELECT row_number() OVER (ORDER BY label) - 1 AS out, label FROM (SELECT DISTINCT label FROM means))"
PAIRED = MEANS.replace("SELECT label, bin, round(avg", "SELECT label % 2 AS label, bin, round(avg")


def _each(one, strides=STRIDES):
    return " UNION ALL ".join(one(s, 2 * s, s - s // 2, s // 2) for s in strides)


CONVOLUTION = _each(lambda s, k, left, right: f"""SELECT x.vec_id, {s}::BIGINT AS stride, p.out, t.t, round(any_value(b.w) + sum(x.x * m.w), 6) + 0 AS y
FROM (SELECT unnest(generate_series(0, ({PLACES} + {left + right} - {k}) // {s})) AS t) t CROSS JOIN places p CROSS JOIN (SELECT unnest(generate_series(0, 1)) AS c) c CROSS JOIN (SELECT unnest(generate_series(0, {k - 1})) AS tap) k
JOIN means m ON m.label = p.label AND m.bin = c.c * {k} + k.tap JOIN means b ON b.label = p.label AND b.bin = 63
JOIN flat x ON x.bin = c.c * {PLACES} + CASE WHEN t.t * {s} + k.tap - {left} < 0 THEN {left} - t.t * {s} - k.tap WHEN t.t * {s} + k.tap - {left} >= {PLACES} THEN {2 * (PLACES - 1) + left} - t.t * {s} - k.tap ELSE t.t * {s} + k.tap - {left} END
GROUP BY 1, 2, 3, 4""")  # fmt: skip

TRANSPOSED = _each(lambda s, k, left, right: f"""SELECT vec_id, {s}::BIGINT AS stride, out, j - {left} AS t, round((y - mean) / sqrt(variance + 0.00001) * scale + shift, 6) + 0 AS y FROM (
  SELECT *, avg(y) OVER (PARTITION BY vec_id) AS mean, var_pop(y) OVER (PARTITION BY vec_id) AS variance FROM (
    SELECT x.vec_id, p.out, (x.bin % {PLACES}) * {s} + k.tap AS j, any_value(b.w) + sum(x.x * m.w) AS y, any_value(a.w) AS scale, any_value(h.w) AS shift
    FROM flat x CROSS JOIN places p CROSS JOIN (SELECT unnest(generate_series(0, {k - 1})) AS tap) k JOIN means m ON m.label = p.label AND m.bin = (x.bin // {PLACES}) * {k} + k.tap
    JOIN means b ON b.label = p.label AND b.bin = 63 JOIN means a ON a.label = p.label AND a.bin = 62 JOIN means h ON h.label = p.label AND h.bin = 61 GROUP BY 1, 2, 3) u) w
WHERE j >= {left} AND j < {(PLACES - 1) * s + k - right}""")  # fmt: skip


def _gate(g):
    dot = " + ".join(f"x[4 * t + {i + 1}]::DOUBLE * w[{g * 8 + i + 1}]" for i in range(4))
    return f"({dot} + h0 * w[{g * 8 + 5}] + h1 * w[{g * 8 + 6}] + w[{g * 8 + 7}] + w[{g * 8 + 8}])"


def _sigmoid(x):
    return f"1 / (1 + exp(-{x}))"


def _tanh(x):
    return f"(2 / (1 + exp(-2 * {x})) - 1)"


SQL = {
    "strided_convolution": f"WITH {MEANS} {CONVOLUTION}",
    "transposed_convolution": f"WITH {PAIRED} {TRANSPOSED}",
    "gated_recurrence": f"""WITH RECURSIVE {MEANS}, wide AS (SELECT list(w * 8 ORDER BY label, bin) AS w FROM means WHERE label < 8 AND bin < 8),
s AS (
  SELECT vec_id, 0::BIGINT AS t, embedding AS x, w, 0::DOUBLE AS h0, 0::DOUBLE AS h1, 0::DOUBLE AS c0, 0::DOUBLE AS c1 FROM embeddings CROSS JOIN wide
  UNION ALL SELECT vec_id, t + 1, x, w, {_sigmoid("o0")} * {_tanh("n0")}, {_sigmoid("o1")} * {_tanh("n1")}, n0, n1 FROM (
    SELECT *, {_sigmoid("f0")} * c0 + {_sigmoid("i0")} * {_tanh("g0")} AS n0, {_sigmoid("f1")} * c1 + {_sigmoid("i1")} * {_tanh("g1")} AS n1 FROM (
      SELECT *, {", ".join(f"{_gate(g)} AS {n}" for g, n in enumerate(("i0", "i1", "o0", "o1", "f0", "f1", "g0", "g1")))} FROM s WHERE t < 16) a) b)
SELECT vec_id, t - 1 AS t, round(h0, 6) AS h0, round(h1, 6) AS h1 FROM s WHERE t > 0""",
    "sliding_attention": f"""WITH e AS (SELECT vec_id AS t, vec_id // 64 AS track, row_number() OVER (PARTITION BY vec_id // 64 ORDER BY vec_id) AS place, list_transform(embedding, lambda x: x::DOUBLE * 8) AS e FROM embeddings),
h AS (SELECT unnest(generate_series(0, {HEADS - 1})) AS h),
s AS (SELECT a.t, h.h, b.e, list_sum(list_transform(generate_series(1, 4), lambda i: a.e[4 * h.h + i] * b.e[16 + 4 * h.h + i])) / 2 AS score FROM e a JOIN e b ON a.track = b.track AND b.place BETWEEN a.place - {PAST} AND a.place CROSS JOIN h),
p AS (SELECT *, exp(score - max(score) OVER (PARTITION BY t, h)) AS p FROM s)
SELECT t AS vec_id, 4 * h + i AS bin, round(sum(p * e[33 + 4 * h + i]) / sum(p), 6) AS y FROM (SELECT *, unnest(generate_series(0, 3)) AS i FROM p) x GROUP BY t, h, i""",
}
