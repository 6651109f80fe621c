"""Dense arrays: padding, normalisation, ordered joins of parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reflect_pad(x: Column, left: int, right: int) -> Column:
    """The array with its own mirror image (the edge value not repeated) at both ends; needs more values than it pads."""
    n = F.size(x)
    head = F.reverse(F.slice(x, F.lit(2), F.lit(left))) if left else F.slice(x, 1, 0)
    tail = F.reverse(F.slice(x, n - right, F.lit(right))) if right else F.slice(x, 1, 0)
    return F.when((n > left) & (n > right), F.concat(head, x, tail))


def zero_pad(x: Column, size: int) -> Column:
    """The array's first ``size`` values, filled up with zeros."""
    return F.concat(F.slice(x, 1, size), F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(size) - F.size(x))))


def layer_norm(x: Column, eps: float = 1e-5) -> Column:
    """Each value less the mean, over the square root of the population variance plus ``eps``."""
    n = F.size(x)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    centred = F.transform(F.array(total(x) / n), lambda m: F.transform(x, lambda v: v - m))[0]
    return F.transform(F.array(centred), lambda c: F.transform(F.array(F.sqrt(total(F.transform(c, lambda v: v * v)) / n + eps)), lambda d: F.transform(c, lambda v: v / d))[0])[0]


def framed_arrays(members: DataFrame, size: int) -> DataFrame:
    """(track, seg, n, pcm): a segment's samples in order as one array of ``size``, zeros at the end of a short one."""
    held = members.groupBy("track", "seg").agg(F.array_sort(F.collect_list(F.struct("place", "v"))).alias("x"))
    return held.select("track", "seg", F.size("x").cast("long").alias("n"), zero_pad(F.transform("x", lambda s: s["v"]), size).alias("pcm"))


def joined_parts(parts: DataFrame, key: str, order: str, data: str) -> DataFrame:
    """(key, content): a key's byte parts in order as one value (one file, so below the 2 GB of a value)."""
    return parts.groupBy(key).agg(F.expr(f"listagg(`{data}`, X'') WITHIN GROUP (ORDER BY `{order}`)").alias("content"))


def trimmed(x: Column, size: Column) -> Column:
    """The array's first ``size`` values."""
    return F.slice(x, F.lit(1), size)


def verified(assets: DataFrame, manifest: DataFrame, name: str = "name") -> DataFrame:
    """(name, status) of (name, content) against a manifest (name, digest): ok, differs, missing, or unlisted."""
    own = assets.select(name, F.sha2("content", 256).alias("own"))
    status = F.when(F.col("own").isNull(), "missing").when(F.col("digest").isNull(), "unlisted").when(F.col("own") == F.lower("digest"), "ok").otherwise("differs")
    return own.join(manifest.select(name, F.col("digest")), name, "full").select(name, status.alias("status"))


def numeric_suffix(name: Column) -> Column:
    """The number a name ends with; null if it ends with none."""
    digits = F.regexp_extract(name, r"([0-9]+)$", 1)
    return F.when(digits != "", digits.cast("long"))
