"""Reductions over segments: loudness, norms, errors, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.octets import FRAME_BYTES


def loudness(framed: DataFrame) -> DataFrame:
    """(track, seg, scale): root mean square of the channels' mean, plus 1e-8, from (track, seg, frame, v)."""
    mono = framed.groupBy("track", "seg", "frame").agg(F.avg("v").alias("m"))
    return mono.groupBy("track", "seg").agg((F.sqrt(F.avg(F.col("m") * F.col("m"))) + F.lit(1e-8)).alias("scale"))


def group_norms(framed: DataFrame, eps: float = 1e-5) -> DataFrame:
    """(track, seg, mean, variance, inverse): statistics of each segment over channels and time."""
    stats = framed.groupBy("track", "seg").agg(F.avg("v").alias("mean"), F.var_pop("v").alias("variance"))
    return stats.withColumn("inverse", 1 / F.sqrt(F.col("variance") + F.lit(eps)))


def errors(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, max_abs, mean_abs) of two columns; zero where there is nothing to compare."""
    gap = F.abs(F.col(a) - F.col(b))
    return rows.groupBy(key).agg(F.coalesce(F.max(gap), F.lit(0.0)).alias("max_abs"), F.coalesce(F.avg(gap), F.lit(0.0)).alias("mean_abs"))


def sizes(chunks: DataFrame, key: str) -> DataFrame:
    """Chunk count, framed and payload bytes and the mean framed size of each key, from (key, payload_bytes)."""
    whole = F.col("payload_bytes") + FRAME_BYTES
    return chunks.groupBy(key).agg(F.count(F.lit(1)).alias("chunks"), F.sum(whole).alias("chunk_bytes"), F.sum("payload_bytes").alias("payload_total"), F.avg(whole).alias("mean_chunk_bytes"))


def file_sizes(files: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Sizes of whole files beside those of their chunks, from (key, header_bytes, file_bytes) and (key, payload_bytes)."""
    of_files = files.groupBy(key).agg(F.sum("file_bytes").alias("file_bytes"), F.sum("header_bytes").alias("header_bytes"))
    return of_files.join(sizes(chunks, key), key, "left")


def realtime_factor(seconds: Column, samples: Column, rate: int) -> Column:
    """Seconds spent for a second of signal; null for an empty one."""
    return F.when(samples > 0, seconds * rate / samples)


def inspection(chunks: DataFrame, key: str, order: str) -> DataFrame:
    """Chunks in order with the bytes of a track so far, from (key, order, payload_bytes)."""
    so_far = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    whole = F.col("payload_bytes") + FRAME_BYTES
    return chunks.select(key, order, "payload_bytes", whole.alias("chunk_bytes"), F.sum(whole).over(so_far).alias("cumulative_bytes"))
