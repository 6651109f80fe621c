"""Queries over the given tables that exercise each operator, and DuckDB SQL with the same rows.

There is no audio in the tables, so tables of the same shape stand in: a user's events are a track of samples,
embeddings are vectors and columns of logits, conversations are token streams, texts and pages are payloads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import layout, naming, octets, quantise
from ..operators import arrays, codec, containers, entropy, framing, ledger, measures, probability, vectors
from ..sources import files, packets, pcm, wav
from ..streaming import chunks as streams
from .store import scratch, written

SAMPLES, STRIDE, FRAMES = 16, 12, 5  # the segments' size in these queries
STEP, GAIN = layout.ENTROPY_LOGIT_STEP, 40.0


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def signal(spark, sf) -> DataFrame:
    """events as samples: track = user, i = place in time order."""
    i = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf, "events").select(F.col("user_id").alias("track"), i.cast("long").alias("i"), F.col("value").alias("v"))


def lengths(spark, sf) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("track")).agg(F.count(F.lit(1)).alias("total"))


def with_length(framed: DataFrame, totals: DataFrame) -> DataFrame:
    n = F.least(F.lit(SAMPLES).cast("long"), F.col("total") - F.col("seg") * STRIDE)
    return framed.join(totals, "track").withColumn("n", n)


SIGNAL = "signal AS (SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS v FROM events)"
SEGS = f"segs AS (SELECT track, total, unnest(generate_series(0, total - 1, {STRIDE})) AS start FROM (SELECT user_id AS track, count(*) AS total FROM events GROUP BY 1))"
MEMBERS = f"""members AS (SELECT g.track, g.start // {STRIDE} AS seg, s.i - g.start AS place, s.i, s.v, least({SAMPLES}, g.total - g.start) AS n
  FROM segs g JOIN signal s ON s.track = g.track AND s.i >= g.start AND s.i < g.start + {SAMPLES})"""


def segment_starts(spark, sf):
    return framing.segments(lengths(spark, sf), SAMPLES, STRIDE, FRAMES)


def segment_membership(spark, sf):
    return framing.membership(signal(spark, sf), SAMPLES, STRIDE)


def tumbling_frames(spark, sf):
    s = signal(spark, sf).groupBy("track", layout.whole_div(F.col("i"), SAMPLES).alias("seg"))
    return s.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("total"), F.max("i").alias("last"))


def overlap_add(spark, sf):
    framed = with_length(framing.membership(signal(spark, sf), SAMPLES, STRIDE), lengths(spark, sf))
    return framing.overlap_add(framed, STRIDE).select("track", "i", F.round("v", 6).alias("v"))


def triangle_weights(spark, sf):
    n = framing.segments(lengths(spark, sf), SAMPLES, STRIDE, FRAMES).select("n").distinct()
    rows = n.select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("place"))
    return rows.select("n", "place", F.round(framing.triangle(F.col("place"), F.col("n")), 12).alias("weight"))


def interleave_roundtrip(spark, sf):
    flat = framing.planar(signal(spark, sf), 2)
    return flat.select("track", "channel", "frame", "v", (F.col("frame") * 2 + F.col("channel")).alias("i"))


def packetise(spark, sf):
    return framing.packets(signal(spark, sf), 20).select("track", "packet", "start", F.col("n").cast("long").alias("n"), F.size("pcm").cast("long").alias("filled"), F.round(F.aggregate("pcm", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


def planar_segments(spark, sf):
    return framing.membership(signal(spark, sf), SAMPLES, STRIDE).withColumn("frame", layout.whole_div(F.col("place"), 2))


def rms_scale(spark, sf):
    return measures.loudness(planar_segments(spark, sf)).select("track", "seg", F.round("scale", 6).alias("scale"))


def group_norm_stats(spark, sf):
    s = measures.group_norms(planar_segments(spark, sf))
    return s.select("track", "seg", F.round("mean", 7).alias("mean"), F.round(F.sqrt("variance"), 7).alias("deviation"), F.round("inverse", 9).alias("inverse"))


def recon_error(spark, sf):
    x = signal(spark, sf).withColumn("x", F.col("v") / 500.0)
    coded = x.withColumn("y", quantise.pcm16_to_float(quantise.pcm16_truncated(F.col("x"))))
    return measures.errors(coded, "track", "x", "y").select("track", F.round("max_abs", 9).alias("max_abs"), F.round("mean_abs", 9).alias("mean_abs"))


def components(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.posexplode("embedding").alias("bin", "x")).select("vec_id", F.col("bin").cast("long").alias("bin"), (F.col("x").cast("double") * 4).alias("x"))


def pcm16_quantise(spark, sf):
    x = F.col("x")
    return components(spark, sf).select("vec_id", "bin", quantise.pcm16_truncated(x).alias("truncated"), quantise.pcm16_half_up(x).alias("half_up"), quantise.pcm16_half_away(x).alias("half_away"), quantise.pcm16_asymmetric(x).alias("asymmetric"))


def weight_rows_quantise(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.arrays_zip(quantise.symmetric_row(F.col("embedding"), 127, True).alias("a"), quantise.symmetric_row(F.col("embedding"), 32767, False).alias("b"))).alias("bin", "q"))
    return e.select("vec_id", F.col("bin").cast("long").alias("bin"), F.col("q.a").alias("int8"), F.col("q.b").alias("int16"))


def vectors_of(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def codebooks(spark, sf):
    e = table(spark, sf, "embeddings")
    one = e.where("vec_id < 16").select(F.col("vec_id").cast("int").alias("code"), F.col("embedding").alias("vector"))
    two = e.where("vec_id >= 16 AND vec_id < 32").select((F.col("vec_id") - 16).cast("int").alias("code"), F.transform("embedding", lambda x: x.cast("double") / 2).alias("vector"))
    return [one, two]


def coded(spark, sf):
    return vectors.encode(vectors_of(spark, sf), [vectors.codebook_row(b) for b in codebooks(spark, sf)])


def rvq_encode(spark, sf):
    energy = F.aggregate("residual", F.lit(0.0), lambda s, x: s + x * x)
    return coded(spark, sf).select("id", F.col("codes")[0].alias("code1"), F.col("codes")[1].alias("code2"), F.round(energy, 6).alias("energy"))


def rvq_decode(spark, sf):
    out = vectors.decode(coded(spark, sf), codebooks(spark, sf))
    return out.select("id", F.posexplode("vector").alias("bin", "x")).select("id", F.col("bin").cast("long").alias("bin"), F.round("x", 6).alias("x"))


def logits(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double") * GAIN).alias("logits"))


def quantised_softmax(spark, sf):
    p = probability.softmax(logits(spark, sf), STEP)
    return p.select("id", F.posexplode("pdf").alias("bin", "p")).select("id", F.col("bin").cast("long").alias("bin"), F.round("p", 9).alias("p"))


def near_uniform_columns(spark, sf):
    flat = logits(spark, sf).select("id", F.transform("logits", lambda x: x / F.lit(16.0)).alias("logits"))
    return probability.softmax(flat, STEP).select("id", "near_uniform")


def cdfs(spark, sf):
    return probability.allocate(probability.softmax(logits(spark, sf), STEP))


def cdf_allocation(spark, sf):
    # Outer, or the optimiser infers a filter on the array's size and makes the whole expression a second time for it.
    return cdfs(spark, sf).select("id", F.posexplode_outer("cdf").alias("bin", "cdf")).select("id", F.col("bin").cast("long").alias("bin"), "cdf")


def cdf_symbol_lookup(spark, sf):
    target = (F.col("id") * 7919 * 131) % (1 << probability.RANGE_BITS)
    return cdfs(spark, sf).select("id", target.alias("target"), probability.symbol_at(F.col("cdf"), target).cast("long").alias("symbol"))


def tokens(spark, sf):
    """conversations as token streams: t = turn's place, code = text length modulo 64."""
    c = table(spark, sf, "conversations")
    t = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    return c.select(F.col("conv_id").alias("track"), t.cast("long").alias("t"), (F.length("text") % 64).cast("long").alias("code"))


def lm_window_inputs(spark, sf):
    return framing.model_inputs(tokens(spark, sf), 4)


CODED = 32  # symbols of a track that are coded as one


def models(spark, sf):
    """A coding model for each token, its place modulo 64, and the vectors' distributions as the models' counts."""
    t = tokens(spark, sf).withColumnRenamed("code", "symbol")
    coded = t.withColumns({"model": F.col("t") % 64, "chunk": layout.whole_div(F.col("t"), CODED)})
    return coded, cdfs(spark, sf).where("id < 64").withColumnRenamed("id", "model")


def arith_roundtrip(spark, sf):
    symbols, tables = models(spark, sf)
    coded = entropy.encode(symbols, tables, keys=("track", "chunk"))
    return entropy.decode(coded, symbols.drop("symbol"), tables, keys=("track", "chunk")).select("track", "t", "symbol")


def arith_code_lengths(spark, sf):
    """Information of each coded sequence in bits, and whether its bytes are that many and no more than the coder's register over."""
    symbols, tables = models(spark, sf)
    coded = entropy.encode(symbols, tables, keys=("track", "chunk"))
    upto, below = F.element_at("cdf", F.col("symbol").cast("int") + 1), F.when(F.col("symbol") > 0, F.element_at("cdf", F.greatest(F.col("symbol"), F.lit(1)).cast("int"))).otherwise(0)
    bits = symbols.join(tables, "model").withColumn("bits", F.lit(probability.RANGE_BITS) - F.log2(upto - below))
    bits = bits.groupBy("track", "chunk").agg(F.sum("bits").alias("bits"))
    size = F.octet_length("payload") * 8
    out = coded.join(bits, ["track", "chunk"])
    return out.select("track", "chunk", "symbols", F.round("bits", 3).alias("bits"), ((size >= F.col("bits") - 1) & (size <= F.col("bits") + 40)).alias("fits"), "wide")


#: Segments' codes: two of a frame, eight frames of a segment; the frame's place in a window of four and the codebook pick the counts.
SPEC = codec.Spec("model", books=2, samples=SAMPLES, stride=STRIDE, frames=8, model_hash="5f2c", window=4, normalise=True, model_of=lambda at, book: 2 * at + book)


def segment_codes(spark, sf):
    """Each segment's samples, zero-padded, as codes below 64."""
    padded = arrays.framed_arrays(framing.membership(signal(spark, sf), SAMPLES, STRIDE), SAMPLES)
    codes = padded.select("track", "seg", F.posexplode("pcm").alias("place", "v"))
    return codes.select("track", "seg", layout.whole_div(F.col("place"), 2).alias("t"), (F.col("place") % 2).cast("long").alias("book"), F.pmod(F.floor("v"), F.lit(64)).cast("long").alias("code"))


def encoded_tracks(spark, sf):
    scales = framing.segments(lengths(spark, sf), SAMPLES, STRIDE, SPEC.frames).select("track", "seg", (F.col("n") + 0.5).alias("scale"))
    tables = cdfs(spark, sf).where("id < 8").withColumnRenamed("id", "model")
    return written(codec.encode(segment_codes(spark, sf), lengths(spark, sf), tables, SPEC, scales), "containers"), tables


def codec_roundtrip(spark, sf):
    content, tables = encoded_tracks(spark, sf)
    codes, scales = codec.decode(content, tables, SPEC)
    return codes.join(scales, ["track", "seg"]).select("track", "seg", "t", "book", "code", F.col("scale").cast("double").alias("scale"))


def codec_inspect(spark, sf):
    content, _ = encoded_tracks(spark, sf)
    found = codec.inspect(content, SPEC, rate=8000)
    return found.select("track", "chunk", "offset", "samples", F.round("duration_ms", 3).alias("duration_ms"), "frames", (F.col("chunk_bytes") - F.col("payload_bytes")).alias("framing"), (F.col("cumulative_bytes") >= F.col("chunk_bytes") + 13 * F.col("chunk")).alias("grows"), "error")


def payload_checks(spark, sf):
    """Made-up metadata of each part against one model: every kind of fault."""
    k, size = F.col("p_partkey"), F.col("p_size")
    meta = {"m": F.when(k % 7 == 0, "other").otherwise("model"), "nc": F.when(size % 5 == 0, 8).otherwise(4), "lm": k % 11 > 0, "acv": F.when(size % 9 == 0, 1).otherwise(2), "fl": F.when(k % 13 == 0, 0).when(k % 2 == 0, 75), "lmh": F.when(k % 3 == 0, "h").when(k % 3 == 1, "x")}
    meta = F.struct(*[c.alias(n) for n, c in meta.items()])
    violation = containers.violation(meta, "model", 4, "h", size % 4)
    shape = codec.shape_error((size - 2).cast("long"), F.when(k % 17 > 0, F.lit(30).cast("long")), (size * 4 - F.when(k % 5 == 0, 9).otherwise(8)).cast("long"), 4)
    return table(spark, sf, "part").select("p_partkey", violation.alias("violation"), shape.alias("shape"))


def payload_parts(spark, sf):
    return payloads(spark, sf).select("track", F.col("chunk").alias("packet"), F.col("payload").alias("data"))


def packet_cache_roundtrip(spark, sf):
    caches = packets.contents(payload_parts(spark, sf), "track", fields={"audioLength": F.count(F.lit(1)) * 960})
    found = packets.packets_of(written(caches, "caches"), "track")
    return found.select("track", "packet", F.octet_length("data").cast("long").alias("bytes"), F.sha2("data", 256).alias("digest"), F.get_json_object("payload", "$.audioLength").cast("long").alias("length"), "error")


def packet_changes(spark, sf):
    return packets.changing(table(spark, sf, "lineitem"), "l_orderkey", "l_returnflag", "l_linestatus")


def wav_blocks(spark, sf):
    """A user's events as a stereo file, the second channel upside down."""
    held = signal(spark, sf).groupBy("track").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("x"))
    v = held.select("track", F.concat(F.col("track").cast("string"), F.lit(".wav")).alias("path"), F.lit(8000).alias("rate"), F.lit(0).cast("long").alias("start"), F.transform("x", lambda x: (x["v"] / 500.0).cast("float")).alias("v"))
    other = v.withColumn("v", F.transform("v", lambda x: -x))
    return v.withColumn("channel", F.lit(0)).union(other.withColumn("channel", F.lit(1)))


def wav_scan(spark, sf):
    """Files of 16, 24 and 32 bits, written and read back."""
    folder, blocks = scratch(spark, "wav"), wav_blocks(spark, sf)
    for k, bits in enumerate((16, 24, 32)):
        files.write(wav.files(blocks.where(F.col("track") % 3 == k), bits).withColumnRenamed("path", "name"), folder).write.format("noop").mode("overwrite").save()
    rows = wav.samples(wav.read(spark, folder))
    return rows.select(F.regexp_extract("path", r"([0-9]+)\.wav$", 1).cast("long").alias("track"), F.col("channel").cast("long").alias("channel"), "i", F.round(F.col("v").cast("double"), 6).alias("v"))


def raw_pcm_roundtrip(spark, sf):
    folder = scratch(spark, "pcm")
    tracks = wav_blocks(spark, sf).where("channel = 0").select(F.regexp_replace("path", "wav$", "f32").alias("name"), "v")
    files.write(pcm.contents(tracks), folder).write.format("noop").mode("overwrite").save()
    rows = pcm.read(spark, folder).select("path", "start", F.posexplode("v").alias("k", "v"))
    return rows.select(F.regexp_extract("path", r"([0-9]+)\.f32$", 1).cast("long").alias("track"), (F.col("start") + F.col("k")).alias("i"), F.col("v").cast("double").alias("v"))


def payloads(spark, sf):
    c = table(spark, sf, "conversations")
    n = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    return c.select(F.col("conv_id").alias("track"), n.cast("long").alias("chunk"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("payload"))


def container_table(spark, sf):
    meta = containers.metadata_json({"m": F.lit("model"), "al": F.col("track") * 100, "nc": F.lit(4), "lm": F.lit(True), "fp": F.lit(8192), "mr": F.lit(2), "acv": F.lit(2), "tau": F.lit(1.0)})
    return containers.build(payloads(spark, sf), "track", "chunk", meta)


def container_inspect(spark, sf):
    found = containers.chunks_of(container_table(spark, sf), "track").where("error IS NULL")
    return measures.inspection(found.select("track", "chunk", F.octet_length("payload").cast("long").alias("payload_bytes")), "track", "chunk")


def container_headers(spark, sf):
    h = container_table(spark, sf).select("track", octets.read_header(F.col("content")).alias("h"), octets.first_chunk(F.col("content")).alias("first"))
    m = h.select("track", F.col("h.error").alias("error"), containers.parse_metadata(F.col("h.json")).alias("m"), "first")
    return m.select("track", "error", F.col("first.place").alias("first_place"), F.col("first.bytes").alias("first_bytes"), F.col("m.al").alias("length"), F.col("m.fp").alias("fp_scale"), containers.violation(F.col("m"), "model", 4).alias("violation"))


def container_sizes(spark, sf):
    """Each container's file, header and chunk bytes."""
    content = written(container_table(spark, sf), "containers")
    heads = content.select("track", F.octet_length("content").cast("long").alias("file_bytes"), octets.read_header(F.col("content"))["size"].cast("long").alias("header_bytes"))
    chunks = containers.chunks_of(content, "track").select("track", F.octet_length("payload").cast("long").alias("payload_bytes"))
    return measures.file_sizes(heads, chunks, "track").drop("mean_chunk_bytes")


def chunk_frame_bytes(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", octets.chunk_frame(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("frame"))
    back = d.select("doc_id", F.octet_length("frame").cast("long").alias("frame_bytes"), octets.read_u32(F.col("frame"), 1).alias("stored"), octets.chunk_payload(F.col("frame")).alias("p"))
    return back.select("doc_id", "frame_bytes", "stored", F.sha2("p.payload", 256).alias("payload_sha256"), F.col("p.error").alias("error"))


def size_report(spark, sf):
    d = table(spark, sf, "documents").select("source", F.octet_length("text").cast("long").alias("payload_bytes"))
    s = measures.sizes(d, "source")
    return s.withColumn("mean_chunk_bytes", F.round("mean_chunk_bytes", 6))


def bitpack_roundtrip(spark, sf):
    parts = tokens(spark, sf).withColumn("part", layout.whole_div(F.col("t"), 1024))
    c = parts.groupBy("track", "part").agg(F.array_sort(F.collect_list(F.struct("t", "code"))).alias("x")).select("track", "part", F.transform("x", lambda x: x["code"]).alias("codes"))
    packed = c.select("track", "part", F.size("codes").alias("n"), octets.pack_bits(F.col("codes"), 10).alias("data"))
    out = packed.select("track", "part", F.octet_length("data").cast("long").alias("bytes"), F.posexplode(octets.unpack_bits(F.col("data"), 10, F.col("n"))).alias("t", "code"))
    return out.select("track", "bytes", (F.col("part") * 1024 + F.col("t")).alias("t"), F.col("code").cast("long").alias("code"))


def stable_hash(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", naming.stable_hash(F.col("text")).alias("digest"), F.substring(naming.stable_hash(F.col("text")), 1, 12).alias("short"))


def slugify(spark, sf):
    return table(spark, sf, "pages").select("page_id", naming.slug(naming.base_name(F.col("url"))).alias("slug"), naming.slug(F.col("url")).alias("whole"))


def format_normalise(spark, sf):
    return table(spark, sf, "part").select("p_partkey", naming.format_name(F.when(F.col("p_partkey") % 3 == 0, F.lit(None)).otherwise(F.col("p_type")), F.col("p_brand")).alias("format"))


def metadata_json(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.from_json("props", "map<string,string>")["k"].cast("long").alias("k"), containers.metadata_json({"m": F.col("event_type"), "al": F.col("user_id")}).alias("json"))


def job_anti_join(spark, sf):
    return ledger.outstanding(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), "doc_id")


def job_cached(spark, sf):
    """Orders whose customer and priority both are those of a finished one."""
    o = table(spark, sf, "orders")
    return ledger.cached(o.select("o_orderkey", "o_custkey", "o_orderpriority"), o.where("o_orderstatus = 'F'"), ["o_custkey", "o_orderpriority"])


def job_counters(spark, sf):
    jobs = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    return ledger.counters(jobs, ["source"], {"encoded": F.col("quality") == 1, "failed": F.col("toxic") == 1, "waiting": F.col("quality").isNull()})


def repeated_payloads(spark, sf):
    return ledger.repeated(table(spark, sf, "documents").select(F.sha2("text", 256).alias("digest")), "digest")


def op_histogram(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


def layout_from_ms(spark, sf):
    ms = F.col("o_totalprice") % 4000 - 100
    packet = layout.packet_size_of_ms(F.col("o_orderkey") % 120)
    return table(spark, sf, "orders").select("o_orderkey", layout.samples_of_ms(ms).alias("samples"), packet.alias("packet"))


def residual_layout(spark, sf):
    """Flat buffers of each of the kinds that a decoder may hand over, and of odd lengths."""
    total = F.col("o_custkey") % 100
    n = layout.segment_count(total, STRIDE)
    own = layout.segment_starts(total, STRIDE)
    sum_ = lambda f: F.aggregate(F.transform(own, lambda s: f(F.least(F.lit(SAMPLES).cast("long"), total - s))), F.lit(0).cast("long"), lambda a, x: a + x)
    k = F.col("o_orderkey") % 5
    decoded = 2 * F.when(k == 0, n * SAMPLES).when(k == 1, sum_(lambda x: x)).when(k == 2, sum_(lambda x: layout.ceil_div(x, 4) * 4)).when(k == 3, n * 20).otherwise(n * 6) + F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0)
    x = codec.residual_samples(total, decoded.cast("long"), SAMPLES, STRIDE, SAMPLES, 4, 2)
    return table(spark, sf, "orders").select("o_orderkey", x["each"].alias("each"), x["error"].alias("error"))


def layout_resolution(spark, sf):
    o = table(spark, sf, "orders")
    a, b = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 5 * 1000), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_custkey") % 7 * 900)
    x = layout.resolve_layout(a, b, 48000, 47520)
    total = F.col("o_custkey") * 997
    y = layout.layout_for_count(total, layout.segment_count(total, F.when(F.col("o_orderkey") % 2 == 0, 86400).otherwise(63998)), 48000, 47520)
    return o.select("o_orderkey", x["samples"].alias("samples"), x["stride"].alias("stride"), x["valid"].alias("valid"), y["stride"].alias("inferred"))


def preset_lookup(spark, sf):
    kbps = F.when(F.col("l_linenumber") > 1, 6 + F.col("l_orderkey") % 7 + F.col("l_linenumber") / 4000.0 - 0.0005)
    ms = F.when(F.col("l_suppkey") % 4 > 0, 1325.0 + F.col("l_partkey") % 500)
    return table(spark, sf, "lineitem").groupBy(layout.bandwidth_preset(kbps).alias("kbps"), layout.chunk_preset(ms).alias("ms")).agg(F.count(F.lit(1)).alias("n"))


def padded_segments(spark, sf):
    padded = arrays.framed_arrays(framing.membership(signal(spark, sf), SAMPLES, STRIDE), SAMPLES)
    return padded.select("track", "seg", "n", F.posexplode("pcm").alias("place", "v")).select("track", "seg", "n", F.col("place").cast("long").alias("place"), "v")


def reflect_padded(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode(arrays.reflect_pad(F.col("embedding"), 3, 5)).alias("place", "x"))
    return e.select("vec_id", F.col("place").cast("long").alias("place"), F.col("x").cast("double").alias("x"))


def layer_norms(spark, sf):
    x = F.transform("embedding", lambda v: v.cast("double"))
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode(arrays.layer_norm(x)).alias("place", "x"))
    return e.select("vec_id", F.col("place").cast("long").alias("place"), F.round("x", 8).alias("x"))


def activations(spark, sf):
    x = F.col("x")
    return components(spark, sf).select("vec_id", "bin", F.round(quantise.elu(x), 9).alias("elu"), F.round(quantise.sigmoid(x), 9).alias("sigmoid"), F.round(F.tanh(x), 9).alias("tanh"), F.round(quantise.gelu(x), 9).alias("gelu"))


def cdf_digests(spark, sf):
    """The determinism probe: counts and a symbol made from the column's number, digested together."""
    symbol = ((17 * F.col("id") + 31) % 64).cast("string")
    return cdfs(spark, sf).select("id", F.sha2(F.concat(F.array_join(F.transform("cdf", lambda c: c.cast("string")), ","), F.lit(";"), symbol), 256).alias("digest"))


def quantised_linear(spark, sf):
    """Vectors as int16 times four int8 weight rows, in whole numbers, and back to single precision."""
    e = table(spark, sf, "embeddings")
    part = lambda limit, even: (quantise.symmetric_row(F.col("embedding"), limit, even), quantise.symmetric_scale(F.col("embedding"), limit))
    weights = e.where("vec_id < 4").select(F.struct(F.col("vec_id").alias("row"), part(127, True)[0].alias("q"), part(127, True)[1].alias("scale")).alias("w"))
    weights = weights.agg(F.array_sort(F.collect_list("w")).alias("weights"))
    x = e.select("vec_id", part(32767, False)[0].alias("q"), part(32767, False)[1].alias("scale")).join(F.broadcast(weights))
    out = x.select("vec_id", "q", "scale", F.explode("weights").alias("w")).select("vec_id", F.col("w.row").alias("row"), quantise.whole_dot(F.col("q"), F.col("w.q")).alias("dot"), "scale", F.col("w.scale").alias("row_scale"))
    return out.select("vec_id", "row", "dot", F.round(quantise.dequantised(F.col("dot"), F.col("scale"), F.col("row_scale"), F.col("row") / 8).cast("double"), 4).alias("value"))


def asset_manifest(spark, sf):
    """Pages against a manifest of their digests that leaves some out, has some wrong, and lists some that aren't there."""
    p = table(spark, sf, "pages").select(F.col("page_id").alias("name"), F.coalesce("html", F.lit("")).cast("binary").alias("content"))
    digest = F.when(F.col("name") % 5 == 0, F.upper(F.sha2(F.lit("other"), 256))).otherwise(F.upper(F.sha2("content", 256)))
    manifest = p.where("name % 3 <> 0").select("name", digest.alias("digest")).union(p.where("name % 50 = 1").select(-F.col("name"), F.lit("0")))
    return arrays.verified(p, manifest)


def joined_assets(spark, sf):
    size = 1000
    p = table(spark, sf, "pages").select("page_id", F.coalesce("html", F.lit("")).cast("binary").alias("data"))
    count = F.greatest(F.lit(1), layout.ceil_div(F.octet_length("data"), size).cast("int"))
    parts = p.select("page_id", "data", F.explode(F.sequence(F.lit(0), count - 1)).alias("part")).select("page_id", "part", F.substring("data", F.col("part") * size + 1, F.lit(size)).alias("data"))
    whole = arrays.joined_parts(parts, "page_id", "part", "data")
    return whole.select("page_id", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("digest"))


def suffix_order(spark, sf):
    p = table(spark, sf, "part")
    place = F.row_number().over(W.partitionBy("p_type").orderBy(arrays.numeric_suffix(F.col("p_brand")), "p_partkey"))
    return p.select("p_partkey", arrays.numeric_suffix(F.col("p_brand")).alias("number"), place.cast("long").alias("place"))


def cache_keys(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", naming.cache_key(F.col("o_orderkey").alias("sha"), F.col("o_orderpriority").alias("format"), F.lit(20).alias("frame_ms")).alias("key"))


def bundle_getters(spark, sf):
    p = table(spark, sf, "part")
    bits = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size"))
    book, model = F.when(F.col("p_partkey") % 2 == 0, F.lit(2048)), F.when(F.col("p_partkey") % 5 == 0, F.lit(512))
    step = F.when(F.col("p_size") > 25, F.col("p_size") / 10.0)
    return p.select("p_partkey", layout.bits_per_codebook(bits, book, model).alias("bits"), layout.model_cardinality(book, model).alias("cardinality"), layout.entropy_logit_step(step, F.lit(None).cast("double")).alias("step"))


def buffer_lookup(spark, sf):
    """Each order's line numbers looked up among its lines: those that are missing stand with a null."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "l_quantity")
    asked = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.explode(F.sequence(F.lit(1), (F.col("o_orderkey") % 4 + 1).cast("int"))).alias("n"))
    best = lines.groupBy("k", "n").agg(F.max("l_quantity").alias("quantity"))
    return asked.join(best, ["k", "n"], "left").select("k", "n", "quantity", F.col("quantity").isNull().alias("missing"))


def streamed_frames(spark, sf):
    rows = streams.stream(spark, f"{sf}/conversations.parquet")
    out = streams.framed(rows, "conv_id", F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    done = streams.run_once(out, scratch(spark, "frames"), scratch(spark, "frames-state"))
    return done.select("conv_id", "payload_bytes", F.sha2(octets.chunk_payload(F.col("frame"))["payload"], 256).alias("payload_sha256"))


def streamed_totals(spark, sf):
    rows = streams.stream(spark, f"{sf}/events.parquet")
    out = streams.totals(rows, "ts", "1 day", "1 hour", "event_type")
    done = streams.latest(out, ["begin", "event_type"], scratch(spark, "totals"), scratch(spark, "totals-state"))
    return done.select(F.date_format("begin", "yyyy-MM-dd").alias("day"), "event_type", "n")


QUERIES = {f.__name__: f for f in (
    segment_starts, segment_membership, tumbling_frames, overlap_add, triangle_weights, interleave_roundtrip, packetise, rms_scale, group_norm_stats,
    recon_error, pcm16_quantise, weight_rows_quantise, rvq_encode, rvq_decode, quantised_softmax, near_uniform_columns, cdf_allocation, cdf_symbol_lookup,
    lm_window_inputs, arith_roundtrip, arith_code_lengths, container_inspect, container_headers, chunk_frame_bytes, size_report, bitpack_roundtrip,
    stable_hash, slugify, format_normalise, metadata_json, job_anti_join, job_cached, job_counters, repeated_payloads, op_histogram, layout_from_ms,
    layout_resolution, preset_lookup, padded_segments, reflect_padded, layer_norms, activations, cdf_digests, joined_assets, suffix_order, cache_keys,
    bundle_getters, buffer_lookup, streamed_frames, streamed_totals, codec_roundtrip, codec_inspect, container_sizes, payload_checks,
    packet_cache_roundtrip, packet_changes, wav_scan, raw_pcm_roundtrip, residual_layout, quantised_linear, asset_manifest,
)}
