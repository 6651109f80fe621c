"""Chunk framing and windowed totals as Structured Streaming jobs over files that arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.octets import chunk_frame


def stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files as a stream; the schema is read from what is there.

    ``path`` is a folder or one file: as a pattern it may be either (a plain path has to be a folder).
    """
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(pattern)


def framed(rows: DataFrame, key: str, payload) -> DataFrame:
    """(key, payload_bytes, frame): each row's payload as a chunk; stateless, so the sink decides on exactly-once."""
    return rows.select(key, payload.alias("payload")).select(key, F.octet_length("payload").cast("long").alias("payload_bytes"), chunk_frame(F.col("payload")).alias("frame"))


def totals(rows: DataFrame, ts: str, width: str, delay: str, by: str) -> DataFrame:
    """(begin, by, n) of tumbling event-time windows. Appended, a window comes out once the watermark has passed it; updated, with each batch."""
    timed = rows.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", delay)
    return timed.groupBy(F.window("at", width), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("begin"), by, "n")


def latest(stream_: DataFrame, keys: list, out: str, checkpoint: str) -> DataFrame:
    """Takes in all there is in update mode and gives the last state of each key, also of windows that are still open.

    A batch goes to a folder of its number, so one that runs again replaces itself.
    """
    schema = stream_.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream_.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    states = stream_.sparkSession.read.schema(schema.add("batch", "long")).option("basePath", out).parquet(out)
    rest = [f.name for f in schema.fields if f.name not in {*keys, "batch"}]
    return states.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")


def run_once(stream_: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Takes in all there is, writes to ``out`` exactly once (file sink and checkpoint), and reads the result."""
    query = stream_.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream_.sparkSession
    return spark.read.schema(stream_.schema).parquet(out)
