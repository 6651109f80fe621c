"""DuckDB SQL for the queries of this package, written apart from the Spark plans."""

from __future__ import annotations

from .queries import FRAMES, GAIN, MEMBERS, SAMPLES, SEGS, SIGNAL, STEP, STRIDE

HALF = "sign({0}) * floor(abs({0}) + 0.5)"
COMPONENTS = "comps AS (SELECT vec_id, unnest(generate_series(0, len(embedding) - 1)) AS bin, embedding FROM embeddings), x AS (SELECT vec_id, bin, embedding[bin + 1]::DOUBLE AS raw, embedding[bin + 1]::DOUBLE * 4 AS x FROM comps)"
TOKENS = "tokens AS (SELECT conv_id AS track, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS t, length(text) % 64 AS code, text FROM conversations)"


def softmax(gain: float) -> str:
    return f"""x AS (SELECT vec_id AS id, unnest(generate_series(0, len(embedding) - 1)) AS bin, embedding FROM embeddings),
q AS (SELECT id, bin, floor(embedding[bin + 1]::DOUBLE * {gain} / {STEP!r} + (0.5 - 9.094947017729282e-13)) * {STEP!r} AS v FROM x),
e AS (SELECT *, max(v) OVER (PARTITION BY id) AS hi, min(v) OVER (PARTITION BY id) AS lo, count(*) OVER (PARTITION BY id) AS k FROM q),
d AS (SELECT *, exp(v - hi) / sum(exp(v - hi)) OVER (PARTITION BY id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS p FROM e),
n AS (SELECT *, hi - lo <= 2 * {STEP!r} OR max(p) OVER (PARTITION BY id) - min(p) OVER (PARTITION BY id) <= 0.25 / 8192 AS near FROM d),
pdf AS (SELECT id, bin, k, near, CASE WHEN near THEN 1.0::DOUBLE / k ELSE p END AS p FROM n)"""


#: Counts from a table pdf (id, bin, k, p) of k bins each.
ALLOCATION = """c0 AS (SELECT id, bin, k, floor(p * 8192)::BIGINT AS c FROM pdf),
c1 AS (SELECT *, (sum(c) OVER (PARTITION BY id))::BIGINT AS s FROM c0),
c2 AS (SELECT id, bin, k, CASE WHEN s > 0 THEN c ELSE 1 END AS c, CASE WHEN s > 0 THEN s ELSE k END AS s, 16777216 - 2 * k AS a FROM c1),
b AS (SELECT *, (a * c) // s AS base FROM c2),
r AS (SELECT *, a - (sum(base) OVER (PARTITION BY id))::BIGINT AS more, row_number() OVER (PARTITION BY id ORDER BY (a * c - s * base) * (k + 1) - bin DESC) AS place FROM b),
cdf AS (SELECT id, bin, (sum(base + 2 + CASE WHEN place <= more THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY bin))::BIGINT AS cdf FROM r)"""
CDF = f"{softmax(GAIN)},\n{ALLOCATION}"

VQ = """v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s1 AS (SELECT v.id, v.e, b.id AS code, b.e AS w, list_sum(list_transform(generate_series(1, len(v.e)), lambda i: (v.e[i] - b.e[i]) * (v.e[i] - b.e[i]))) AS d FROM v JOIN v b ON b.id < 16),
r1 AS (SELECT id, arg_min(code, (d, code)) AS code1, list_transform(generate_series(1, 64), lambda i: any_value(e)[i] - arg_min(w, (d, code))[i]) AS e FROM s1 GROUP BY id),
s2 AS (SELECT r.id, r.code1, r.e, b.id - 16 AS code, list_transform(b.e, lambda x: x / 2) AS w FROM r1 r JOIN v b ON b.id >= 16 AND b.id < 32),
d2 AS (SELECT *, list_sum(list_transform(generate_series(1, 64), lambda i: (e[i] - w[i]) * (e[i] - w[i]))) AS d FROM s2),
r2 AS (SELECT id, any_value(code1) AS code1, arg_min(code, (d, code)) AS code2, min(d) AS energy FROM d2 GROUP BY id)"""

#: The error function by a power series with logarithms of factorials.
ERF = """f AS (SELECT vec_id, bin, x, CASE WHEN x = 0 THEN 0 ELSE sign(x) * 1.1283791670955126::DOUBLE * exp(-x * x / 2) * list_sum(list_transform(generate_series(0, 119),
  lambda n: exp(2 * n * ln(2.0::DOUBLE) + (2 * n + 1) * ln(abs(x) / sqrt(2.0::DOUBLE)) + lgamma(n + 1.0::DOUBLE) - lgamma(2 * n + 2.0::DOUBLE)))) END AS erf FROM x)"""

HEADER_JSON = "'{\"m\":\"model\",\"al\":' || track * 100 || ',\"nc\":4,\"lm\":true,\"fp\":8192,\"mr\":2,\"acv\":2,\"tau\":1.0}'"

SLUG = "coalesce(nullif(regexp_replace(regexp_replace(lower(regexp_replace({0}, '\\.[^.]*$', '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'track')"

ORACLES = {
    "segment_starts": f"WITH {SEGS} SELECT track, start // {STRIDE} AS seg, start, least({SAMPLES}, total - start) AS n, (least({SAMPLES}, total - start) * {FRAMES} + {SAMPLES - 1}) // {SAMPLES} AS frames FROM segs",
    "segment_membership": f"WITH {SIGNAL}, {SEGS}, {MEMBERS} SELECT track, seg, place, i, v FROM members",
    "tumbling_frames": f"WITH {SIGNAL} SELECT track, i // {SAMPLES} AS seg, count(*) AS n, round(sum(v), 4) AS total, max(i) AS last FROM signal GROUP BY 1, 2",
    "overlap_add": f"WITH {SIGNAL} SELECT track, i, round(v, 6) AS v FROM signal",
    "triangle_weights": f"WITH {SEGS}, n AS (SELECT DISTINCT least({SAMPLES}, total - start) AS n FROM segs), p AS (SELECT n, unnest(generate_series(0, n - 1)) AS place FROM n) SELECT n, place, round(0.5 - abs((place + 1) / (n + 1)::DOUBLE - 0.5), 12) AS weight FROM p",
    "interleave_roundtrip": f"WITH {SIGNAL} SELECT track, i % 2 AS channel, i // 2 AS frame, v, i FROM signal",
    "packetise": f"WITH {SIGNAL} SELECT track, i // 20 AS packet, i // 20 * 20 AS start, count(*) AS n, 20::BIGINT AS filled, round(sum(v), 4) AS total FROM signal GROUP BY 1, 2, 3",
    "rms_scale": f"WITH {SIGNAL}, {SEGS}, {MEMBERS}, m AS (SELECT track, seg, place // 2 AS f, avg(v) AS m FROM members GROUP BY 1, 2, 3) SELECT track, seg, round(sqrt(avg(m * m)) + 1e-8, 6) AS scale FROM m GROUP BY 1, 2",
    "group_norm_stats": f"WITH {SIGNAL}, {SEGS}, {MEMBERS} SELECT track, seg, round(avg(v), 7) AS mean, round(sqrt(var_pop(v)), 7) AS deviation, round(1 / sqrt(var_pop(v) + 1e-5), 9) AS inverse FROM members GROUP BY 1, 2",
    "recon_error": f"WITH {SIGNAL}, x AS (SELECT track, v / 500.0::DOUBLE AS x FROM signal), y AS (SELECT track, x, trunc(greatest(-0.99, least(0.99, x)) * 32767) / 32767.0::DOUBLE AS y FROM x) SELECT track, round(max(abs(x - y)), 9) AS max_abs, round(avg(abs(x - y)), 9) AS mean_abs FROM y GROUP BY 1",
    "pcm16_quantise": f"WITH {COMPONENTS}, c AS (SELECT *, greatest(-0.99::DOUBLE, least(0.99::DOUBLE, x)) * 32767 AS a, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, x)) AS b FROM x) SELECT vec_id, bin, trunc(a)::INT AS truncated, floor(a + 0.5)::INT AS half_up, ({HALF.format('(b * 32767)')})::INT AS half_away, ({HALF.format('(CASE WHEN b < 0 THEN b * 32768 ELSE b * 32767 END)')})::INT AS asymmetric FROM c",
    "weight_rows_quantise": f"WITH {COMPONENTS}, m AS (SELECT *, max(abs(raw)) OVER (PARTITION BY vec_id) AS top FROM x) SELECT vec_id, bin, round_even(raw / (top / 127.0::DOUBLE), 0)::INT AS int8, ({HALF.format('(raw / (top / 32767.0::DOUBLE))')})::INT AS int16 FROM m",
    "rvq_encode": f"WITH {VQ} SELECT id, code1::INT AS code1, code2::INT AS code2, round(energy, 6) AS energy FROM r2",
    "rvq_decode": f"WITH {VQ}, o AS (SELECT r.id, a.e AS a, b.e AS b, unnest(generate_series(0, 63)) AS bin FROM r2 r JOIN v a ON a.id = r.code1 JOIN v b ON b.id = r.code2 + 16) SELECT id, bin, round(a[bin + 1] + b[bin + 1] / 2, 6) AS x FROM o",
    "quantised_softmax": f"WITH {softmax(GAIN)} SELECT id, bin, round(p, 9) AS p FROM pdf",
    "near_uniform_columns": f"WITH {softmax(GAIN / 16)} SELECT DISTINCT id, near AS near_uniform FROM pdf",
    "cdf_allocation": f"WITH {CDF} SELECT id, bin, cdf FROM cdf",
    "cdf_symbol_lookup": f"WITH {CDF}, t AS (SELECT *, (id * 7919 * 131) % 16777216 AS target FROM cdf) SELECT id, target, min(bin) AS symbol FROM t WHERE target < cdf GROUP BY 1, 2",
    "lm_window_inputs": f"WITH {TOKENS} SELECT track, t, t // 4 AS win, t % 4 AS at, coalesce(lag(code) OVER (PARTITION BY track, t // 4 ORDER BY t) + 1, 0) AS previous FROM tokens",
    "arith_code_lengths": f"""WITH {TOKENS}, {CDF}, w AS (SELECT a.id, a.bin, a.cdf - coalesce(b.cdf, 0) AS width FROM cdf a LEFT JOIN cdf b ON b.id = a.id AND b.bin = a.bin - 1)
SELECT track, t // 32 AS chunk, count(*) AS symbols, round(sum(24 - log2(width)), 3) AS bits, TRUE AS fits, FALSE AS wide FROM tokens JOIN w ON w.id = t % 64 AND w.bin = code GROUP BY 1, 2""",
    "codec_roundtrip": f"""WITH {SIGNAL}, {SEGS}, {MEMBERS}, g AS (SELECT track, start // {STRIDE} AS seg, least({SAMPLES}, total - start) AS n FROM segs),
p AS (SELECT *, unnest(generate_series(0, (n + 1) // 2 * 2 - 1)) AS place FROM g)
SELECT p.track, p.seg, p.place // 2 AS t, p.place % 2 AS book, ((coalesce(floor(m.v), 0)::BIGINT % 64) + 64) % 64 AS code, p.n + 0.5::DOUBLE AS scale FROM p LEFT JOIN members m ON m.track = p.track AND m.seg = p.seg AND m.place = p.place""",
    "codec_inspect": f"""WITH {SEGS}, g AS (SELECT track, start, least({SAMPLES}, total - start) AS n FROM segs)
SELECT track, start // {STRIDE} AS chunk, start AS offset, n AS samples, round(n * 1000 / 8000.0::DOUBLE, 3) AS duration_ms, (n * 8 + {SAMPLES - 1}) // {SAMPLES} AS frames, 8::BIGINT AS framing, TRUE AS grows, NULL::VARCHAR AS error FROM g""",
    "container_sizes": f"""WITH {TOKENS}, c AS (SELECT track, count(*) AS chunks, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS payload_total FROM tokens GROUP BY 1),
h AS (SELECT *, 9 + length({HEADER_JSON}) AS header_bytes FROM c)
SELECT track, payload_total + 8 * chunks + header_bytes AS file_bytes, header_bytes, chunks, payload_total + 8 * chunks AS chunk_bytes, payload_total FROM h""",
    "payload_checks": """WITH p AS (SELECT p_partkey, p_partkey AS k, p_size AS s, CASE WHEN p_partkey % 13 = 0 THEN 0 WHEN p_partkey % 2 = 0 THEN 75 END AS fl, CASE WHEN p_partkey % 3 = 0 THEN 'h' WHEN p_partkey % 3 = 1 THEN 'x' END AS lmh FROM part)
SELECT p_partkey, CASE WHEN k % 7 = 0 THEN 'model differs' WHEN s % 5 = 0 THEN 'codebooks differ' WHEN s % 9 = 0 THEN 'bitstream version differs' WHEN k % 11 = 0 THEN 'no model coding' WHEN fl <= 0 THEN 'frame length isn''t positive'
  WHEN s % 4 > 0 AND lmh IS NULL THEN 'model hash is missing' WHEN s % 4 > 0 AND lmh <> 'h' THEN 'model hash differs' END AS violation,
  CASE WHEN s < 3 OR s > 32 OR k % 17 = 0 THEN 'frame length out of range' WHEN k % 5 = 0 THEN 'codes don''t fill the frames' END AS shape FROM p""",
    "packet_cache_roundtrip": f"WITH {TOKENS} SELECT track, t AS packet, octet_length(encode(coalesce(text, '')))::BIGINT AS bytes, sha256(coalesce(text, '')) AS digest, count(*) OVER (PARTITION BY track) * 960 AS length, NULL::VARCHAR AS error FROM tokens",
    "packet_changes": "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1 OR count(DISTINCT l_linestatus) > 1",
    "wav_scan": f"""WITH {SIGNAL}, x AS (SELECT track, i, (v / 500.0::DOUBLE)::FLOAT::DOUBLE AS x, unnest([0, 1]) AS channel FROM signal), y AS (SELECT track, channel::BIGINT AS channel, i, CASE channel WHEN 0 THEN x ELSE -x END AS x FROM x)
SELECT track, channel, i, round((CASE track % 3 WHEN 0 THEN trunc(greatest(-0.99, least(0.99, x)) * 32767) / 32767.0::DOUBLE WHEN 1 THEN round_even(greatest(-8388608, least(8388607, x * 8388608)), 0) / 8388608.0::DOUBLE ELSE x END)::FLOAT::DOUBLE, 6) AS v FROM y""",
    "raw_pcm_roundtrip": f"WITH {SIGNAL} SELECT track, i, (v / 500.0::DOUBLE)::FLOAT::DOUBLE AS v FROM signal",
    "residual_layout": f"""WITH o AS (SELECT o_orderkey, o_custkey % 100 AS total, generate_series(0, o_custkey % 100 - 1, {STRIDE}) AS starts FROM orders),
l AS (SELECT *, len(starts) AS n, list_transform(starts, lambda s: least({SAMPLES}, total - s)) AS own FROM o),
a AS (SELECT *, list_transform(own, lambda x: (x + 3) // 4 * 4) AS native FROM l),
d AS (SELECT *, coalesce(list_sum(own), 0)::BIGINT AS sum_own, coalesce(list_sum(native), 0)::BIGINT AS sum_native FROM a),
b AS (SELECT *, 2 * (CASE o_orderkey % 5 WHEN 0 THEN n * {SAMPLES} WHEN 1 THEN sum_own WHEN 2 THEN sum_native WHEN 3 THEN n * 20 ELSE n * 6 END) + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS size FROM d),
e AS (SELECT *, CASE WHEN size = 2 * sum_native THEN -1 WHEN size = 2 * n * {SAMPLES} THEN {SAMPLES} WHEN size = 2 * sum_own THEN -2 ELSE size // greatest(2 * n, 1) END::BIGINT AS k FROM b)
SELECT o_orderkey, CASE WHEN n > 0 THEN k END AS each, CASE WHEN n = 0 THEN NULL WHEN k >= 0 AND size % (2 * n) <> 0 THEN 'buffer doesn''t divide' WHEN k >= 0 AND k < list_max(own) THEN 'chunk too short' END AS error FROM e""",
    "quantised_linear": f"""WITH {COMPONENTS}, m AS (SELECT *, max(abs(raw)) OVER (PARTITION BY vec_id) AS top FROM x),
q AS (SELECT vec_id, bin, top, round_even(raw / (top / 127.0::DOUBLE), 0)::BIGINT AS q8, ({HALF.format('(raw / (top / 32767.0::DOUBLE))')})::BIGINT AS q16 FROM m),
d AS (SELECT a.vec_id, b.vec_id AS row, sum(a.q16 * b.q8)::BIGINT AS dot, any_value(a.top) AS ta, any_value(b.top) AS tb FROM q a JOIN q b ON b.bin = a.bin AND b.vec_id < 4 GROUP BY 1, 2)
SELECT vec_id, row, dot, round(((row / 8.0::DOUBLE)::FLOAT + (dot::FLOAT * (ta / 32767.0::DOUBLE)::FLOAT) * (tb / 127.0::DOUBLE)::FLOAT)::DOUBLE, 4) AS value FROM d""",
    "asset_manifest": """SELECT page_id AS name, CASE WHEN page_id % 3 = 0 THEN 'unlisted' WHEN page_id % 5 = 0 THEN 'differs' ELSE 'ok' END AS status FROM pages UNION ALL SELECT -page_id, 'missing' FROM pages WHERE page_id % 50 = 1""",
    "arith_roundtrip": f"WITH {TOKENS} SELECT track, t, code AS symbol FROM tokens",
    "container_inspect": f"WITH {TOKENS}, c AS (SELECT track, t AS chunk, octet_length(encode(coalesce(text, '')))::BIGINT AS payload_bytes FROM tokens) SELECT track, chunk, payload_bytes, payload_bytes + 8 AS chunk_bytes, (sum(payload_bytes + 8) OVER (PARTITION BY track ORDER BY chunk))::BIGINT AS cumulative_bytes FROM c",
    "container_headers": f"WITH {TOKENS} SELECT track, NULL::VARCHAR AS error, 9 + length({HEADER_JSON}) AS first_place, octet_length(encode(coalesce(text, '')))::BIGINT + 8 AS first_bytes, track * 100 AS length, 8192::BIGINT AS fp_scale, NULL::VARCHAR AS violation FROM tokens WHERE t = 0",
    "chunk_frame_bytes": "SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 8 AS frame_bytes, octet_length(encode(coalesce(text, '')))::BIGINT AS stored, sha256(coalesce(text, '')) AS payload_sha256, NULL::VARCHAR AS error FROM documents",
    "size_report": "WITH d AS (SELECT source, octet_length(encode(text))::BIGINT AS b FROM documents) SELECT source, count(*) AS chunks, sum(b + 8)::BIGINT AS chunk_bytes, sum(b)::BIGINT AS payload_total, round(avg(b + 8), 6) AS mean_chunk_bytes FROM d GROUP BY 1",
    "bitpack_roundtrip": f"WITH {TOKENS} SELECT track, (count(*) OVER (PARTITION BY track, t // 1024) * 10 + 7) // 8 AS bytes, t, code FROM tokens",
    "stable_hash": "SELECT doc_id, sha256(text) AS digest, left(sha256(text), 12) AS short FROM documents",
    "slugify": f"SELECT page_id, {SLUG.format(chr(114) + 'egexp_replace(url, ' + repr('^.*/') + ', ' + repr('') + ')')} AS slug, {SLUG.format('url')} AS whole FROM pages",
    "format_normalise": "SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(coalesce(CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END, p_brand))), '[^a-z0-9]', '_', 'g'), '^_+|_+$', '', 'g') AS format FROM part",
    "metadata_json": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"m\":\"' || event_type || '\",\"al\":' || user_id || '}' AS json FROM events",
    "job_anti_join": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "job_cached": "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE (o_custkey, o_orderpriority) IN (SELECT (o_custkey, o_orderpriority) FROM orders WHERE o_orderstatus = 'F')",
    "job_counters": "SELECT source, count(*) FILTER (quality = 1) AS encoded, count(*) FILTER (toxic = 1) AS failed, count(*) FILTER (quality IS NULL) AS waiting, count(*) AS total FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "repeated_payloads": "SELECT sha256(text) AS digest, count(*) AS times FROM documents GROUP BY 1 HAVING count(*) > 1",
    "op_histogram": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "layout_from_ms": "WITH m AS (SELECT o_orderkey, o_totalprice % 4000 - 100 AS ms FROM orders) SELECT o_orderkey, CASE WHEN ms > 0 AND ms * 48000 / 1000.0::DOUBLE >= 1 THEN round(ms * 48000 / 1000.0::DOUBLE)::BIGINT END AS samples, CASE WHEN o_orderkey % 120 <= 85 THEN greatest(1, o_orderkey % 120 * 48)::BIGINT END AS packet FROM m",
    "layout_resolution": """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5 * 1000 END AS a, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 7 * 900 END AS b, o_custkey * 997 AS total,
  CASE WHEN o_orderkey % 2 = 0 THEN 86400 ELSE 63998 END AS s FROM orders),
n AS (SELECT *, coalesce(a, 48000) AS samples, coalesce(b, 47520) AS stride, (total + s - 1) // s AS k FROM o)
SELECT o_orderkey, samples, stride, samples <> 0 AND stride <> 0 AS valid, CASE WHEN (total + 47519) // 47520 = k THEN 47520::BIGINT WHEN (total + 63997) // 63998 = k THEN 63998 WHEN (total + 86399) // 86400 = k THEN 86400 END AS inferred FROM n""",
    "preset_lookup": """WITH l AS (SELECT CASE WHEN l_linenumber > 1 THEN 6 + l_orderkey % 7 + l_linenumber / 4000.0::DOUBLE - 0.0005 END AS kbps, CASE WHEN l_suppkey % 4 > 0 THEN 1325.0::DOUBLE + l_partkey % 500 END AS ms FROM lineitem)
SELECT CASE WHEN kbps IS NULL OR abs(kbps - 6.0) <= 0.001 THEN 6 WHEN abs(kbps - 12.0) <= 0.001 THEN 12 END AS kbps, CASE WHEN ms IS NULL OR abs(ms - 1333) <= 5 OR abs(ms - 1333.3::DOUBLE) <= 5 THEN 1333 WHEN abs(ms - 1800) <= 5 THEN 1800 END AS ms, count(*) AS n FROM l GROUP BY 1, 2""",
    "padded_segments": f"WITH {SIGNAL}, {SEGS}, {MEMBERS}, g AS (SELECT track, start // {STRIDE} AS seg, least({SAMPLES}, total - start) AS n, unnest(generate_series(0, {SAMPLES - 1})) AS place FROM segs) SELECT g.track, g.seg, g.n, g.place, coalesce(m.v, 0) AS v FROM g LEFT JOIN members m ON m.track = g.track AND m.seg = g.seg AND m.place = g.place",
    "reflect_padded": "WITH p AS (SELECT vec_id, unnest(generate_series(0, 71)) AS place, embedding AS e FROM embeddings) SELECT vec_id, place, (CASE WHEN place < 3 THEN e[4 - place] WHEN place < 67 THEN e[place - 2] ELSE e[130 - place] END)::DOUBLE AS x FROM p",
    "layer_norms": f"WITH {COMPONENTS} SELECT vec_id, bin AS place, round((raw - avg(raw) OVER w) / sqrt(var_pop(raw) OVER w + 1e-5), 8) AS x FROM x WINDOW w AS (PARTITION BY vec_id)",
    "activations": f"WITH {COMPONENTS}, {ERF} SELECT vec_id, bin, round(CASE WHEN x > 0 THEN x ELSE exp(x) - 1 END, 9) AS elu, round(1 / (1 + exp(-x)), 9) AS sigmoid, round(tanh(x), 9) AS tanh, round(x / 2 * (1 + erf), 9) AS gelu FROM f",
    "cdf_digests": f"WITH {CDF} SELECT id, sha256(string_agg(cdf::VARCHAR, ',' ORDER BY bin) || ';' || (17 * id + 31) % 64) AS digest FROM cdf GROUP BY id",
    "joined_assets": "SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS bytes, sha256(coalesce(html, '')) AS digest FROM pages",
    "suffix_order": "WITH p AS (SELECT p_partkey, p_type, nullif(regexp_extract(p_brand, '([0-9]+)$', 1), '')::BIGINT AS number FROM part) SELECT p_partkey, number, row_number() OVER (PARTITION BY p_type ORDER BY number NULLS FIRST, p_partkey) AS place FROM p",
    "cache_keys": "SELECT o_orderkey, sha256('{\"sha\":' || o_orderkey || ',\"format\":\"' || o_orderpriority || '\",\"frame_ms\":20}') AS key FROM orders",
    "bundle_getters": """WITH p AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS bits, CASE WHEN p_partkey % 2 = 0 THEN 2048 END AS book, CASE WHEN p_partkey % 5 = 0 THEN 512 END AS model FROM part)
SELECT p_partkey, coalesce(bits, floor(log2(coalesce(book, model, 1024)) + 1e-9))::BIGINT AS bits, coalesce(model, book, 1024)::BIGINT AS cardinality, greatest(coalesce(CASE WHEN p_size > 25 THEN p_size / 10.0::DOUBLE END, 1 / 64.0::DOUBLE), 2.0999999046325684::DOUBLE) AS step FROM p""",
    "buffer_lookup": "WITH a AS (SELECT o_orderkey AS k, unnest(generate_series(1, o_orderkey % 4 + 1))::INT AS n FROM orders), b AS (SELECT l_orderkey AS k, l_linenumber AS n, max(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2) SELECT k, n, quantity, quantity IS NULL AS missing FROM a LEFT JOIN b USING (k, n)",
    "streamed_frames": "SELECT conv_id, octet_length(encode(coalesce(text, '')))::BIGINT AS payload_bytes, sha256(coalesce(text, '')) AS payload_sha256 FROM conversations",
    "streamed_totals": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
