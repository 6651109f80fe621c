"""Index windows over sampled signals: segments, overlap-add, packets, model windows.

A signal is rows (track, i, v): sample i of a series. A segment is samples start .. start + samples of it.
Everything is keyed by (track, segment), which Spark deals evenly; a track's length bounds no task but the one that numbers its samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.layout import ceil_div, frame_length, segment_starts, whole_div


def segments(lengths: DataFrame, samples: int, stride: int, frames: int) -> DataFrame:
    """(track, seg, start, n, frames) from (track, total); no rows for an empty signal."""
    out = lengths.select("track", "total", F.posexplode(segment_starts(F.col("total"), stride)).alias("seg", "start"))
    n = F.least(F.lit(samples).cast("long"), F.col("total") - F.col("start"))
    return out.select("track", F.col("seg").cast("long").alias("seg"), "start", n.alias("n"), frame_length(n, samples, frames).alias("frames"))


def membership(signal: DataFrame, samples: int, stride: int) -> DataFrame:
    """The signal's rows once per segment they fall in: (track, seg, place, i, v). A projection: nothing is shuffled."""
    i = F.col("i").cast("long")
    first = F.greatest(F.lit(0).cast("long"), ceil_div(i - samples + 1, stride))
    first = F.when(i - samples + 1 <= 0, F.lit(0).cast("long")).otherwise(first)
    last = whole_div(i, stride)
    seg = F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))
    return signal.select("track", "i", "v", seg.alias("seg")).select("track", "seg", (F.col("i") - F.col("seg") * stride).alias("place"), "i", "v")


def triangle(place: Column, n: Column) -> Column:
    """Weight of a frame's sample: 0.5 - |t - 0.5| with t = (place + 1) / (n + 1)."""
    return F.lit(0.5) - F.abs((place + 1) / (n + 1).cast("double") - 0.5)


def overlap_add(frames: DataFrame, stride: int) -> DataFrame:
    """(track, i, v) from framed samples (track, seg, place, n, v): weighted mean of the frames at each place."""
    w = triangle(F.col("place"), F.col("n"))
    out = frames.select("track", (F.col("seg") * stride + F.col("place")).alias("i"), (F.col("v") * w).alias("vw"), w.alias("w"))
    return out.groupBy("track", "i").agg((F.sum("vw") / F.sum("w")).alias("v"))


def planar(signal: DataFrame, channels: int) -> DataFrame:
    """(track, channel, frame, v) of an interleaved signal."""
    return signal.select("track", (F.col("i") % channels).alias("channel"), whole_div(F.col("i"), channels).alias("frame"), "v")


def channel_errors(lengths: DataFrame, channels: int) -> DataFrame:
    """(track, total, error) of (track, total): why an interleaved signal can't be dealt to channels, null where it can."""
    error = F.when(F.lit(channels) < 1, "no channels").when(F.col("total") % max(channels, 1) != 0, F.concat(F.col("total").cast("string"), F.lit(f" samples don't divide into {channels} channels")))
    return lengths.select("track", "total", error.alias("error"))


def interleaved(rows: DataFrame, channels: int) -> DataFrame:
    """The inverse of :func:`planar`."""
    return rows.select("track", (F.col("frame") * channels + F.col("channel")).alias("i"), "v")


def packets(signal: DataFrame, size: int) -> DataFrame:
    """(track, packet, start, n, pcm): samples in packets of ``size``, the last one filled up with zeros."""
    held = signal.groupBy("track", whole_div(F.col("i"), size).alias("packet")).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("x"))
    values = F.transform("x", lambda s: s["v"])
    filled = F.concat(values, F.array_repeat(F.lit(0.0), F.lit(size) - F.size("x")))
    return held.select("track", "packet", (F.col("packet") * size).alias("start"), F.size("x").alias("n"), filled.alias("pcm"))


def model_inputs(tokens: DataFrame, window: int, reset_on=("track",)) -> DataFrame:
    """(track, t, win, at, previous): the symbol before each, plus one; zero at the start of every window of ``window`` steps."""
    win = whole_div(F.col("t"), window)
    before = F.lag("code").over(W.partitionBy(*reset_on, "win").orderBy("t"))
    out = tokens.withColumn("win", win)
    return out.select(*reset_on, "t", "win", (F.col("t") - F.col("win") * window).alias("at"), F.coalesce(before + 1, F.lit(0)).cast("long").alias("previous"))
