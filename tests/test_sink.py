"""The sink of container parts: replayed batches, restarts, progress, observed metrics."""

import json
import os

import pytest
from framewright.functions import octets
from framewright.operators import containers
from framewright.streaming import sink
from pyspark.sql import functions as F

SCHEMA = "name string, chunk long, payload binary"


def add(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    return rows.select("name", "chunk", octets.chunk_frame(F.col("payload")).alias("frame"))


def meta():
    return containers.metadata_json({"m": F.lit("model"), "al": F.lit(7)})


def whole(spark, rows):
    return {r.name: bytes(r.content) for r in containers.build(spark.createDataFrame(rows, SCHEMA), "name", "chunk", meta()).collect()}


def test_batches_and_a_restart(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = [(f"n{k % 3}", k // 3, os.urandom(k % 7 * 50)) for k in range(40)]
    watch = sink.Watch("made")
    spark.streams.addListener(watch)
    for part in (rows[::4], rows[1::4]):
        add(spark, source, part)
    sink.write(sink.observed(stream(spark, source), "made"), out, state)
    for part in (rows[2::4], rows[3::4]):
        add(spark, source, part)
    sink.write(sink.observed(stream(spark, source), "made"), out, state)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    spark.streams.removeListener(watch)
    assert {r.name: bytes(r.content) for r in sink.joined(spark, out, meta()).collect()} == whole(spark, rows)
    size = sum(len(p) + 8 for _, _, p in rows)
    steps = sink.progress(spark, out).orderBy("batch").collect()
    assert [r.batch for r in steps] == list(range(len(steps))) and len(steps) >= 4
    assert steps[-1].bytes_written == size == sum(r.bytes for r in steps) and steps[-1].emissions == 40
    assert size == sum(os.path.getsize(f"{out}/parts/{f}") for f in os.listdir(f"{out}/parts") if f.endswith(".bytes"))
    assert watch.totals() == (40, size)


def test_a_replayed_batch_writes_nothing_twice(spark, tmp_path):
    """The last batch's commit is taken out of the checkpoint, so it runs again: its parts are thrown away."""
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = [("a", k, bytes([k]) * k) for k in range(9)]
    for part in (rows[:4], rows[4:]):
        add(spark, source, part)
    sink.write(stream(spark, source), out, state)
    before = {r.name: bytes(r.content) for r in sink.joined(spark, out, meta()).collect()}
    files = sorted(os.listdir(f"{out}/parts"))
    last = max(int(f) for f in os.listdir(f"{state}/commits") if f.isdigit())
    os.remove(f"{state}/commits/{last}")
    for f in (f"{state}/commits/.{last}.crc",):
        if os.path.exists(f):
            os.remove(f)
    sink.write(stream(spark, source), out, state)
    assert {r.name: bytes(r.content) for r in sink.joined(spark, out, meta()).collect()} == before == whole(spark, rows)
    assert sorted(f for f in os.listdir(f"{out}/parts") if not f.startswith(".")) == [f for f in files if not f.startswith(".")]


def test_parts_of_a_failed_batch_do_not_count(spark, tmp_path):
    writer = sink._Writer(str(tmp_path))
    row = type("Row", (), {"name": "a", "chunk": 0, "frame": b"abc"})
    lost, kept = writer.write(iter([row])), writer.write(iter([row]))
    writer.commit([kept, None, sink.Part(None, 0, 0)], 0)
    assert [r.frame for r in sink.frames(spark, str(tmp_path)).collect()] == [bytearray(b"abc")]
    writer.abort([lost, None], 1)
    assert len([f for f in os.listdir(tmp_path / "parts") if not f.startswith(".")]) == 2
    assert json.load(open(tmp_path / "progress/000000000000.json"))["emissions"] == 1
    with pytest.raises(ValueError, match="rows"):
        sink.ContainerParts({"path": str(tmp_path)}).streamWriter(spark.range(1).schema, False)
