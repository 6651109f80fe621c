"""Job ledgers: what is still to do, what is cached, how jobs went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outstanding(jobs: DataFrame, done: DataFrame, key: str, size: Column | None = None) -> DataFrame:
    """Jobs that nothing in ``done`` says is finished; with ``size``, an output of no bytes (or of no known size) doesn't count."""
    finished = done if size is None else done.where(size > 0)
    return jobs.join(finished.select(key).distinct(), key, "left_anti")


def cached(jobs: DataFrame, cache: DataFrame, keys: list) -> DataFrame:
    """Jobs whose every key equals a cache entry's."""
    return jobs.join(cache.select(*keys).distinct(), keys, "left_semi")


def counters(jobs: DataFrame, by: list, states: dict) -> DataFrame:
    """Counts of rows in each named state (a condition), and of all rows."""
    return jobs.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in states.items()], F.count(F.lit(1)).alias("total"))


def repeated(names: DataFrame, name: str) -> DataFrame:
    """Names that occur more than once, with how often."""
    return names.groupBy(name).count().where("count > 1").withColumnRenamed("count", "times")


def provenance(encoded: DataFrame, decoded: DataFrame, key: str) -> DataFrame:
    """Every encoded job as a struct beside its decoded one (null if there is none)."""
    a = encoded.select(key, F.struct(*[c for c in encoded.columns if c != key]).alias("encode"))
    b = decoded.select(key, F.struct(*[c for c in decoded.columns if c != key]).alias("decode"))
    return a.join(b, key, "left")
