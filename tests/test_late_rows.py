"""Windowed totals over two batches: what comes after the watermark has passed its window is left out, what comes in time counts."""

from datetime import datetime

from framewright.streaming import chunks as streams


def add(spark, folder, rows):
    spark.createDataFrame([(datetime(2024, 1, d, h), k) for d, h, k in rows], "ts timestamp, kind string").coalesce(1).write.mode("append").parquet(folder)


def totals(spark, tmp_path, name):
    rows = spark.readStream.schema("ts timestamp, kind string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = streams.totals(rows, "ts", "1 day", "1 hour", "kind")
    done = streams.latest(out, ["begin", "kind"], f"{tmp_path}/{name}", f"{tmp_path}/{name}-state")
    return {(r.begin.day, r.kind): r.n for r in done.collect()}


def test_late_rows(spark, tmp_path):
    add(spark, f"{tmp_path}/in", [(1, 3, "a"), (5, 0, "a"), (5, 2, "b")])
    assert totals(spark, tmp_path, "out") == {(1, "a"): 1, (5, "a"): 1, (5, "b"): 1}
    add(spark, f"{tmp_path}/in", [(1, 9, "a"), (2, 1, "b"), (5, 1, "a"), (5, 9, "b")])  # days 1 and 2 are over
    assert totals(spark, tmp_path, "out") == {(1, "a"): 1, (5, "a"): 2, (5, "b"): 2}
