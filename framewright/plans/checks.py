"""Queries of checks, job runs and reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import octets
from ..operators import arrays, feedback, framing, ledger, measures
from ..sources import jobs
from .oracles import CDF, TOKENS
from .queries import cdfs, lengths, payloads, table, tokens
from .store import scratch, written


def job_restart(spark, sf):
    """Conversations as jobs of a shared folder: a run over two thirds of them, then one over all; each job's states and its output's size."""
    folder = scratch(spark, "jobs")
    texts = payloads(spark, sf).groupBy("track").agg(F.array_sort(F.collect_list(F.struct("chunk", F.col("payload").cast("string").alias("text")))).alias("x"))
    texts = texts.select(F.col("track").cast("string").alias("track"), F.array_join(F.transform("x", lambda c: c["text"]), "\n").alias("text"))
    work = lambda row: row["text"].encode()
    first = written(jobs.run(texts.where("CAST(track AS long) % 3 > 0"), "track", work, folder), "job-states")
    second = written(jobs.run(texts, "track", work, folder), "job-states")
    found = second.join(first.select("key", F.col("state").alias("before")), "key", "left").join(jobs.outputs(spark, folder).select(F.col("name").alias("key"), F.col("bytes").alias("there"), "done"), "key")
    return found.select(F.col("key").cast("long").alias("conv_id"), "before", "state", "there", "done")


def job_outputs(spark, sf):
    """Pages whose output is missing or empty: outputs are the pages' texts, without those of every fifth."""
    p = table(spark, sf, "pages").select("page_id", F.coalesce(F.octet_length("html"), F.lit(0)).alias("bytes"))
    made = p.withColumn("bytes", F.when(F.col("page_id") % 7 == 0, 0).otherwise(F.col("bytes"))).where("page_id % 5 > 0")
    return ledger.outstanding(p.select("page_id"), made, "page_id", F.col("bytes"))


def job_provenance(spark, sf):
    """Documents beside what their labels say, null where there are none."""
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    found = ledger.provenance(d, table(spark, sf, "labels"), "doc_id")
    return found.select("doc_id", F.col("encode.source").alias("source"), F.col("encode.n_chars").alias("n_chars"), F.col("decode.quality").alias("quality"), F.col("decode").isNull().alias("missing"))


def throughput(spark, sf):
    """Orders as runs: samples by price, elapsed seconds by customer; seconds spent for a second of signal, and the inverse."""
    samples, spent = F.when(F.col("o_orderkey") % 5 == 0, 0).otherwise(F.col("o_totalprice").cast("long")), (F.col("o_custkey") + 1) / 100.0
    factor = measures.realtime_factor(spent, samples, 8000)
    return table(spark, sf, "orders").select("o_orderkey", F.round(factor, 9).alias("factor"), F.round(F.try_divide(F.lit(1.0), factor), 6).alias("inverse"))


def trimmed_vectors(spark, sf):
    """Vectors cut to a length of their own, some longer than they are."""
    e = table(spark, sf, "embeddings")
    x = arrays.trimmed(F.col("embedding"), (F.col("vec_id") % 80).cast("int"))
    return e.select("vec_id", F.size(x).cast("long").alias("n"), F.round(F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double")), 6).alias("total"))


def symbol_ranges(spark, sf):
    """Token streams coded with 64 counts: the first symbol of each that these don't have."""
    t = tokens(spark, sf).withColumn("code", (F.col("code") * 3 + F.col("t")) % 66)
    held = t.groupBy("track").agg(F.array_sort(F.collect_list(F.struct("t", "code"))).alias("x")).select("track", F.transform("x", lambda c: c["code"]).alias("codes"))
    even = spark.range(1).select(F.col("id").alias("model"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: k.cast("long") * (1 << 18)).alias("cdf"))
    return feedback.encode_segments(held, even, feedback.Context(1, 64, order=0), keys=("track",)).select("track", "symbols", "error")


def frame_ends(spark, sf):
    """Documents as frames that some bytes are missing from, or follow."""
    frame = octets.chunk_frame(F.coalesce("text", F.lit("")).cast("binary"))
    k = F.col("doc_id") % 4
    odd = F.when(k == 1, F.concat(frame, F.lit(b"xy"))).when(k == 2, F.substring(frame, F.lit(1), F.octet_length(frame) - 1)).when(k == 3, F.substring(frame, F.lit(1), F.lit(7))).otherwise(frame)
    p = table(spark, sf, "documents").select("doc_id", octets.chunk_payload(odd).alias("p"))
    return p.select("doc_id", F.octet_length("p.payload").cast("long").alias("bytes"), F.col("p.error").alias("error"))


def probe_digests(spark, sf):
    """The determinism probe over all steps and codebooks: 64 columns of counts are eight steps of eight codebooks, each with its symbol, digested as one."""
    c = cdfs(spark, sf)
    step, book = F.expr("(id % 64) div 8"), F.col("id") % 8
    line = F.concat(F.array_join(F.transform("cdf", lambda x: x.cast("string")), ","), F.lit(";"), ((17 * step + 31 * book) % 64).cast("string"), F.lit("\n"))
    rows = c.select(F.expr("id div 64").alias("probe"), "id", line.alias("line"))
    return rows.groupBy("probe").agg(F.array_sort(F.collect_list(F.struct("id", "line"))).alias("x")).select("probe", F.size("x").cast("long").alias("columns"), F.sha2(F.array_join(F.transform("x", lambda r: r["line"]), ""), 256).alias("digest"))


def channel_checks(spark, sf):
    """Which tracks' samples don't divide into three channels."""
    return framing.channel_errors(lengths(spark, sf), 3)


QUERIES = {f.__name__: f for f in (channel_checks, job_restart, job_outputs, job_provenance, throughput, trimmed_vectors, symbol_ranges, frame_ends, probe_digests)}

SQL = {
    "channel_checks": "SELECT user_id AS track, count(*) AS total, CASE WHEN count(*) % 3 > 0 THEN count(*) || ' samples don''t divide into 3 channels' END AS error FROM events GROUP BY 1",
    "job_restart": f"""WITH {TOKENS}, o AS (SELECT track, octet_length(encode(string_agg(coalesce(text, ''), chr(10) ORDER BY t)))::BIGINT AS there FROM tokens GROUP BY 1)
SELECT track AS conv_id, CASE WHEN track % 3 > 0 THEN 'encoded' END AS before, CASE WHEN track % 3 > 0 AND there > 0 THEN 'skipped' ELSE 'encoded' END AS state, there, TRUE AS done FROM o""",
    "job_outputs": "SELECT page_id FROM pages WHERE page_id % 5 = 0 OR page_id % 7 = 0 OR coalesce(html, '') = ''",
    "job_provenance": "SELECT d.doc_id, d.source, d.n_chars, l.quality, l.doc_id IS NULL AS missing FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "throughput": "WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE trunc(o_totalprice)::BIGINT END AS n, (o_custkey + 1) / 100.0::DOUBLE AS s FROM orders) SELECT o_orderkey, round(CASE WHEN n > 0 THEN s * 8000 / n END, 9) AS factor, round(CASE WHEN n > 0 THEN 1 / (s * 8000 / n) END, 6) AS inverse FROM o",
    "trimmed_vectors": "WITH e AS (SELECT vec_id, embedding[1:vec_id % 80] AS x FROM embeddings) SELECT vec_id, len(x)::BIGINT AS n, round(coalesce(list_sum(list_transform(x, lambda v: v::DOUBLE)), 0), 6) AS total FROM e",
    "symbol_ranges": f"""WITH {TOKENS}, c AS (SELECT track, t, (code * 3 + t) % 66 AS code FROM tokens)
SELECT track, count(*) AS symbols, 'symbol is out of range at symbol ' || min(t) FILTER (code > 63) AS error FROM c GROUP BY 1""",
    "frame_ends": """WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN n END AS bytes, CASE doc_id % 4 WHEN 1 THEN 'bytes follow' WHEN 2 THEN CASE WHEN n = 0 THEN 'frame cut short' ELSE 'payload cut short' END WHEN 3 THEN 'frame cut short' END AS error FROM d""",
    "probe_digests": f"""WITH {CDF}, l AS (SELECT id, string_agg(cdf::VARCHAR, ',' ORDER BY bin) || ';' || (17 * (id % 64 // 8) + 31 * (id % 8)) % 64 || chr(10) AS line FROM cdf GROUP BY id)
SELECT id // 64 AS probe, count(*) AS columns, sha256(string_agg(line, '' ORDER BY id)) AS digest FROM l GROUP BY 1""",
}
