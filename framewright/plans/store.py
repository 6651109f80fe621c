"""Where jobs keep tables between steps: the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import ranges


_MADE: list[str] = []


@atexit.register
def _clear() -> None:
    """At the end of the program its folders go: nothing can read them any more."""
    for path in _MADE:
        with contextlib.suppress(Exception):
            disk, where = ranges.store(path)
            disk.delete_dir(where)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, removed when the program ends; a temporary one only in a local session where that isn't set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "framewright-scratch")
    _MADE.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: what reads it several times doesn't make it again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """``df`` with ``name``, its rows' places from 0 in the given order: parts are numbered by tasks, after those before them."""
    parts = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()), "numbered")
    sizes = sorted(parts.groupBy(F.shiftright(name, 33).alias("part")).count().collect())  # a row for each task that wrote
    before, so_far = [], 0
    for part, n in sizes:
        before.append((part, so_far))
        so_far += n
    starts = F.broadcast(df.sparkSession.createDataFrame(before, "__part long, __before long"))
    placed = parts.join(starts, F.shiftright(name, 33) == F.col("__part"))
    return placed.withColumn(name, F.col("__before") + F.col(name).bitwiseAND(F.lit(2**33 - 1))).drop("__part", "__before")
