"""Queries of coding by context, batch and stream, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import layout, octets
from ..operators import codec, containers, feedback, framing
from ..streaming import chunks as streams
from ..streaming import coding, sink
from .oracles import ALLOCATION, ORACLES, TOKENS
from .queries import MEMBERS, SAMPLES, SEGS, SIGNAL, SPEC, STRIDE, lengths, payloads, segment_codes, table
from .store import scratch, written

CONTEXT = feedback.Context(books=2, cardinality=64, order=1, window=4)
BUNDLE, ARRIVING = 128, 30_000  # segments to a group of the keyed state, and to three of the files that arrive


def scales(spark, sf):
    return framing.segments(lengths(spark, sf), SAMPLES, STRIDE, SPEC.frames).select("track", "seg", (F.col("n") + 0.5).alias("scale"))


def context_counts(spark, sf):
    """Counts by codebook and symbol before, learned from all segments."""
    learned = feedback.learn(segment_codes(spark, sf), CONTEXT)
    return learned.select("model", F.posexplode_outer("cdf").alias("bin", "cdf")).select("model", F.col("bin").cast("long").alias("bin"), "cdf")


def context_roundtrip(spark, sf):
    """Containers coded with those counts, and decoded symbol by symbol."""
    codes = written(segment_codes(spark, sf), "codes")
    tables = written(feedback.learn(codes, CONTEXT), "counts")
    content = written(feedback.encode(codes, lengths(spark, sf), tables, SPEC, CONTEXT, scales(spark, sf)), "containers")
    codes, scale = codec.opened(feedback.decode(content, tables, SPEC, CONTEXT), SPEC)
    return codes.join(scale, ["track", "seg"]).select("track", "seg", "t", "book", "code", F.col("scale").cast("double").alias("scale"))


def segment_arrays(codes):
    held = codes.groupBy("track", "seg").agg(F.array_sort(F.collect_list(F.struct("t", "book", "code"))).alias("x"))
    return held.select("track", "seg", F.transform("x", lambda c: c["code"]).alias("codes"))


def context_errors(spark, sf):
    """What the even tracks have taught, tried on all: the first symbol of each segment whose context hasn't been seen."""
    codes = segment_codes(spark, sf)
    tables = feedback.learn(codes.where("track % 2 = 0"), CONTEXT)
    return feedback.encode_segments(segment_arrays(codes), tables, CONTEXT).select("track", "seg", "symbols", "error")


def streamed_coding(spark, sf):
    """Segments whose frames arrive as a stream, coded in keyed state; their codes again, and whether the bytes are the batch encoder's."""
    codes = written(segment_codes(spark, sf), "codes")
    tables = written(feedback.learn(codes, CONTEXT), "counts")
    frames = codes.groupBy("track", "seg", "t").agg(F.array_sort(F.collect_list(F.struct("book", "code"))).alias("x"))
    frames = frames.select("track", "seg", "t", F.transform("x", lambda c: c["code"]).alias("symbols"), (F.col("t") == SPEC.frames - 1).alias("last"))
    folder = scratch(spark, "frames")
    count = codes.count() // SAMPLES  # segments
    files = 3 * (1 + count // ARRIVING)
    frames.repartition(files).write.parquet(folder)
    arriving = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", files * 2 // 3).parquet(folder)  # so segments meet two batches
    done = streams.run_once(coding.coded(arriving, tables, CONTEXT, bundles=1 + count // BUNDLE), scratch(spark, "coded"), scratch(spark, "coded-state"))
    batch = feedback.encode_segments(segment_arrays(codes), tables, CONTEXT).select("track", "seg", F.col("payload").alias("whole"))
    back = feedback.decode_segments(done, tables, CONTEXT).select("track", "seg", F.posexplode("codes").alias("k", "code"))
    back = back.join(done.join(batch, ["track", "seg"]).select("track", "seg", (F.col("payload") == F.col("whole")).alias("same")), ["track", "seg"])
    return back.select("track", "seg", layout.whole_div(F.col("k"), 2).alias("t"), (F.col("k") % 2).cast("long").alias("book"), "code", "same")


def bit_streams(spark, sf):
    """The bits of each part's size, lowest first, written to bytes and read again one by one."""
    bits = F.array(*(F.shiftright("p_size", k).bitwiseAND(F.lit(1)) for k in range(6)))
    held = table(spark, sf, "part").groupBy("p_type").agg(F.array_sort(F.collect_list(F.struct("p_partkey", bits.alias("b")))).alias("x"))
    held = held.select("p_type", F.flatten(F.transform("x", lambda r: r["b"])).alias("bits"))
    data = held.select("p_type", F.size("bits").alias("n"), octets.pack_bits(F.col("bits"), 1).alias("data"))
    out = data.select("p_type", F.octet_length("data").cast("long").alias("bytes"), F.posexplode(octets.unpack_bits(F.col("data"), 1, F.col("n"))).alias("at", "bit"))
    return out.select("p_type", "bytes", F.col("at").cast("long").alias("at"), F.col("bit").cast("long").alias("bit"))


def sunk(spark, sf):
    """Conversations' texts as chunks that arrive in three files; where the sink has put them."""
    folder, out = scratch(spark, "chunks"), scratch(spark, "container-parts")
    rows = payloads(spark, sf).withColumn("name", F.col("track").cast("string")).select("name", "chunk", "payload")
    rows.repartition(3).write.parquet(folder)
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    sink.write(arriving.select("name", "chunk", octets.chunk_frame(F.col("payload")).alias("frame")), out, scratch(spark, "container-state"))
    return out


def streamed_containers(spark, sf):
    """The chunks of the containers that the sink's parts make together."""
    meta = containers.metadata_json({"m": F.lit("model"), "nc": F.lit(4), "lm": F.lit(True)})
    content = written(sink.joined(spark, sunk(spark, sf), meta), "containers")
    found = containers.chunks_of(content, "name")
    return found.select(F.col("name").cast("long").alias("track"), "chunk", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("digest"), "error")


def sink_progress(spark, sf):
    """Bytes and emissions up to the last batch, and the sums over all."""
    steps = sink.progress(spark, sunk(spark, sf))
    return steps.agg(F.max("bytes_written").alias("bytes_written"), F.max("emissions").alias("emissions"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))


QUERIES = {f.__name__: f for f in (context_counts, context_roundtrip, context_errors, streamed_coding, bit_streams, streamed_containers, sink_progress)}

#: All codes of padded segments, and the context of each.
CODES = f"""{SIGNAL}, {SEGS}, {MEMBERS}, g AS (SELECT track, start // {STRIDE} AS seg, unnest(generate_series(0, {SAMPLES - 1})) AS place FROM segs),
codes AS (SELECT g.track, g.seg, g.place // 2 AS t, g.place % 2 AS book, ((coalesce(floor(m.v), 0)::BIGINT % 64) + 64) % 64 AS code FROM g LEFT JOIN members m ON m.track = g.track AND m.seg = g.seg AND m.place = g.place),
contexts AS (SELECT *, book + 2 * CASE WHEN t % 4 = 0 THEN 0 ELSE 1 + lag(code) OVER (PARTITION BY track, seg, book ORDER BY t) END AS model FROM codes)"""

SQL = {
    "context_counts": f"""WITH {CODES}, n AS (SELECT model, code, count(*) AS n FROM contexts GROUP BY 1, 2), m AS (SELECT model, sum(n) AS total FROM n GROUP BY 1),
pdf AS (SELECT b.model AS id, b.bin, 64::BIGINT AS k, (coalesce(n.n, 0) + 1)::DOUBLE / (total + 64)::DOUBLE AS p FROM (SELECT model, total, unnest(generate_series(0, 63)) AS bin FROM m) b LEFT JOIN n ON n.model = b.model AND n.code = b.bin),
{ALLOCATION} SELECT id AS model, bin, cdf FROM cdf""",
    "context_roundtrip": ORACLES["codec_roundtrip"],
    "context_errors": f"""WITH {CODES}, seen AS (SELECT DISTINCT model FROM contexts WHERE track % 2 = 0), f AS (SELECT track, seg, min(2 * t + book) AS k FROM contexts WHERE model NOT IN (SELECT model FROM seen) GROUP BY 1, 2)
SELECT s.track, s.start // {STRIDE} AS seg, {SAMPLES}::BIGINT AS symbols, 'no counts for this context at symbol ' || k AS error FROM segs s LEFT JOIN f ON f.track = s.track AND f.seg = s.start // {STRIDE}""",
    "streamed_coding": f"WITH {CODES} SELECT track, seg, t, book, code, TRUE AS same FROM codes",
    "streamed_containers": f"WITH {TOKENS} SELECT track, t AS chunk, octet_length(encode(coalesce(text, '')))::BIGINT AS bytes, sha256(coalesce(text, '')) AS digest, NULL::VARCHAR AS error FROM tokens",
    "sink_progress": "WITH s AS (SELECT sum(octet_length(encode(coalesce(text, ''))) + 8)::BIGINT AS b, count(*) AS n FROM conversations) SELECT b AS bytes_written, n AS emissions, b AS bytes, n AS rows FROM s",
    "bit_streams": """WITH p AS (SELECT p_type, (row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1) * 6 AS first, count(*) OVER (PARTITION BY p_type) AS n, p_size, unnest(generate_series(0, 5)) AS k FROM part)
SELECT p_type, ((6 * n + 7) // 8)::BIGINT AS bytes, first + k AS "at", ((p_size >> k) & 1)::BIGINT AS bit FROM p""",
}
