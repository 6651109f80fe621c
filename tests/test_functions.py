"""Fixed vectors, round trips and damaged inputs of the codec library."""

import hashlib
import json
import math
import struct
import zlib

import numpy as np
import pytest
from framewright.functions import layout, naming, octets, quantise
from framewright.operators import arrays, codec, containers, entropy, framing, ledger, measures, probability, vectors
from framewright.sources import files, packets, pcm, wav
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def values(spark, rows, schema, **columns):
    return spark.createDataFrame(rows, schema).select(*[c.alias(k) for k, c in columns.items()]).collect()


def test_layout_vectors(spark):
    rows = values(spark, [(48000,), (24000,), (1,)], "n long", f=layout.frame_length(F.col("n"), 48000, 75))
    assert [r.f for r in rows] == [75, 38, 1]
    ms = [250.0, 1333.3, 1333.333333, -1.0, 0.0, float("nan"), float("inf"), 0.001, None]
    assert [r.s for r in values(spark, [(m,) for m in ms], "ms double", s=layout.samples_of_ms(F.col("ms")))] == [12000, 63998, 64000, None, None, None, None, None, None]
    rows = values(spark, [(n,) for n in (0, 1, 47519, 47520, 47521)], "n long", c=layout.segment_count(F.col("n"), 47520), s=layout.segment_starts(F.col("n"), 47520))
    assert [r.c for r in rows] == [0, 1, 1, 1, 2] and [len(r.s) for r in rows] == [0, 1, 1, 1, 2]
    rows = values(spark, [(6.0, 1333.0), (12.0005, 1338.0), (7.0, 1500.0), (None, None), (6.002, 1796.0)], "k double, m double", k=layout.bandwidth_preset(F.col("k")), m=layout.chunk_preset(F.col("m")))
    assert [(r.k, r.m) for r in rows] == [(6, 1333), (12, 1333), (None, None), (6, 1333), (None, 1800)]
    rows = values(spark, [(None, None, None), (10, None, 512), (None, 2048, 512)], "b int, c int, l int", b=layout.bits_per_codebook(F.col("b"), F.col("c"), F.col("l")), m=layout.model_cardinality(F.col("c"), F.col("l")))
    assert [(r.b, r.m) for r in rows] == [(10, 1024), (10, 512), (11, 512)]


def test_samples_and_weights(spark):
    x = [1.7, -1.7, 0.0, 0.5 / 32767, -0.5 / 32767, -0.995]
    rows = values(spark, [(v,) for v in x], "x double", a=quantise.pcm16_truncated(F.col("x")), b=quantise.pcm16_half_up(F.col("x")), c=quantise.pcm16_half_away(F.col("x")), d=quantise.pcm16_asymmetric(F.col("x")))
    assert [r.a for r in rows] == [32439, -32439, 0, 0, 0, -32439]
    assert [r.b for r in rows] == [32439, -32439, 0, 1, 0, -32439]
    assert [r.c for r in rows] == [32767, -32767, 0, 1, -1, -32603]
    assert [r.d for r in rows] == [32767, -32768, 0, 1, -1, -32604]
    rows = values(spark, [([0.0, 0.0],), ([1.0, -0.5],), ([float("inf"), 1.0],)], "r array<double>", q=quantise.symmetric_row(F.col("r"), 127, True))
    assert [r.q for r in rows] == [[0, 0], [127, -64], [0, 0]]
    assert [r.v for r in values(spark, [(255, 255, 255), (0, 0, 128)], "a int, b int, c int", v=quantise.pcm24_to_float(F.col("a"), F.col("b"), F.col("c")))] == [-1 / 8388608, -1.0]


def test_names(spark):
    rows = values(spark, [("My Song (1).WAV",), ("...",), (None,), ("a.b.c",)], "n string", s=naming.slug(F.col("n")))
    assert [r.s for r in rows] == ["my-song-1", "track", "track", "a-b"]
    assert values(spark, [(None, " Opus/48 ")], "a string, b string", f=naming.format_name(F.col("a"), F.col("b")))[0].f == "opus_48"


def test_frames_and_headers(spark):
    payloads = [b"", b"\x00", b"hello chunk", bytes(range(256)) * 257]
    rows = values(spark, [(p,) for p in payloads], "p binary", f=octets.chunk_frame(F.col("p")))
    good = [struct.pack(">II", len(p), zlib.crc32(p)) + p for p in payloads]
    assert [bytes(r.f) for r in rows] == good
    bad = [good[2][:5], good[2][:-1], good[2] + b"x", good[2][:-1] + b"X"]
    rows = values(spark, [(f,) for f in good + bad], "f binary", p=octets.chunk_payload(F.col("f")))
    assert [bytes(r.p.payload) for r in rows[:4]] == payloads and [r.p.error for r in rows[4:]] == ["frame cut short", "payload cut short", "bytes follow", "checksum differs"]
    heads = values(spark, [('{"m":"x","al":5,"osr":7}',)], "j string", h=octets.header(F.col("j")))
    raw = bytes(heads[0].h)
    assert raw == b"ECDC\x00" + struct.pack(">I", 24) + b'{"m":"x","al":5,"osr":7}'
    rows = values(spark, [(raw + b"more",), (raw[:-1],), (b"XXXX" + raw[4:],), (b"ECDC\x01" + raw[5:],), (b"EC",)], "c binary", h=octets.read_header(F.col("c")))
    assert (rows[0].h.json, rows[0].h.size) == ('{"m":"x","al":5,"osr":7}', len(raw))
    assert [r.h.error for r in rows[1:]] == ["header cut short", "not a container", "unknown version", "header cut short"]
    meta = values(spark, [(rows[0].h.json,)], "j string", m=containers.parse_metadata(F.col("j")))[0].m
    assert (meta.m, meta.al, meta.fp, meta.mr, meta.acv, meta.extra) == ("x", 5, 8192, 2, 0, {"osr": "7"})


def test_bit_packing(spark):
    v = [0, 1, 5, 1023, 17, 999, 2, 511, 255]
    row = values(spark, [(v,), ([],)], "v array<int>", d=octets.pack_bits(F.col("v"), 10), n=F.size("v"))
    whole = sum(x << (10 * k) for k, x in enumerate(v))
    assert bytes(row[0].d) == whole.to_bytes(12, "little") and bytes(row[1].d) == b""
    back = values(spark, [(bytes(r.d), r.n) for r in row], "d binary, n int", v=octets.unpack_bits(F.col("d"), 10, F.col("n")))
    assert [r.v for r in back] == [v, []]


def brute_cdf(pdf, bits=24, scale=8192, least=2):
    n = len(pdf)
    p = [max(x, 0.0) for x in pdf]
    if not 0 < sum(p) < float("inf"):
        p = [1.0] * n
    c = []
    for k, x in enumerate(p):
        y = x * scale
        if y % 1 <= 2.0**-40 or y % 1 >= 1 - 2.0**-40:
            y = max(0.0, y + (1 if k % 2 else -1) * 2.0**-60)
        c.append(int(y))
    if sum(c) <= 0:
        c = [1] * n
    room, s = (1 << bits) - least * n, sum(c)
    base = [room * x // s for x in c]
    for k in sorted(range(n), key=lambda k: (-(room * c[k] - s * base[k]), k))[: room - sum(base)]:
        base[k] += 1
    return np.cumsum([b + least for b in base]).tolist()


def test_allocation_against_brute_force(spark):
    r = np.random.default_rng(0)
    pdfs = [r.dirichlet(np.full(n, a)).tolist() for n in (1, 3, 64, 257) for a in (0.05, 1.0, 50.0)]
    pdfs += [[0.0] * 5, [1e-9] * 4, [0.5, 0.5], [1.0, 0.0, 0.0], [0.2, -1.0, 0.8], [1 / 3] * 3]
    df = spark.createDataFrame(list(enumerate(pdfs)), "id long, pdf array<double>")
    for row in probability.allocate(df).collect():
        assert row.cdf == brute_cdf(pdfs[row.id]) and row.cdf[-1] == 1 << 24


def test_softmax_corner_cases(spark):
    step = layout.ENTROPY_LOGIT_STEP
    rows = [(0, [1.0, 1.0, 1.0]), (1, [0.0, 2 * step, 0.0]), (2, [0.0, 3 * step + 0.1, 0.0]), (3, [float("nan"), 0.0, 0.0]), (4, [float("inf"), 0.0, 0.0])]
    out = {r.id: r for r in probability.softmax(spark.createDataFrame(rows, "id long, logits array<double>"), step).collect()}
    assert [out[k].near_uniform for k in range(5)] == [True, True, False, True, True]
    assert abs(sum(out[2].pdf) - 1) < 1e-12 and out[3].pdf == [1 / 3] * 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.floats(0, 1), min_size=1, max_size=9), st.integers(0, 100)), max_size=40))
def test_coder_round_trip(columns):
    cdfs = [brute_cdf(p) for p, _ in columns]
    symbols = [k % len(c) for (_, k), c in zip(columns, cdfs)]
    data, _ = entropy.encode_symbols(symbols, cdfs)
    assert entropy.decode_symbols(data, cdfs) == symbols


def test_coder_refuses_what_it_cannot_code():
    cdf = brute_cdf([0.5, 0.5])
    with pytest.raises(ValueError):
        entropy.encode_symbols([2], [cdf])
    data, _ = entropy.encode_symbols([0, 1] * 40, [cdf] * 80)
    with pytest.raises(ValueError):
        entropy.decode_symbols(data[:2], [cdf] * 80)


def test_containers_damaged_and_whole(spark):
    chunks = spark.createDataFrame([(1, 0, b""), (1, 1, b"ab"), (2, 0, b"x" * 70000)], "track long, chunk long, payload binary")
    made = containers.build(chunks, "track", "chunk", F.lit('{"m":"x"}'))
    back = sorted((r.track, r.chunk, bytes(r.payload), r.error) for r in containers.chunks_of(made, "track").collect())
    assert back == [(1, 0, b"", None), (1, 1, b"ab", None), (2, 0, b"x" * 70000, None)]
    one = bytes(made.where("track = 1").head().content)
    broken = spark.createDataFrame([(1, one[:-1]), (2, one[:-1] + b"?"), (3, b"nothing"), (4, None), (5, one + b"\0")], "track long, content binary")
    errors = {r.track: r.error for r in containers.chunks_of(broken, "track").where("error IS NOT NULL").collect()}
    assert errors == {1: "payload cut short", 2: "checksum differs", 3: "not a container", 4: "not a container", 5: "frame cut short"}


@pytest.mark.parametrize("n", [0, 1, 11, 12, 13, 15, 16, 17, 47])
def test_framing_reconstructs(spark, n):
    signal = spark.createDataFrame([("t", i, float(i * i % 7)) for i in range(n)], "track string, i long, v double")
    framed = framing.membership(signal, 16, 12).withColumn("n", F.least(F.lit(16), F.lit(n) - F.col("seg") * 12))
    back = {r.i: r.v for r in framing.overlap_add(framed, 12).collect()}
    assert len(back) == n and all(abs(back[i] - i * i % 7) < 1e-9 for i in range(n))


def test_vector_quantiser(spark):
    r = np.random.default_rng(1)
    x, a, b = r.normal(size=(20, 4)), r.normal(size=(5, 4)), r.normal(size=(5, 4)) / 2
    frame = lambda m, k, v: spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(m)], f"{k} int, {v} array<double>")
    coded = vectors.encode(frame(x, "id", "vector"), [vectors.codebook_row(frame(m, "code", "vector")) for m in (a, b)])
    for row in coded.collect():
        one = ((x[row.id] - a) ** 2).sum(axis=1).argmin()
        two = ((x[row.id] - a[one] - b) ** 2).sum(axis=1).argmin()
        assert row.codes == [one, two]
    back = {row.id: row.vector for row in vectors.decode(coded, [frame(m, "code", "vector") for m in (a, b)]).collect()}
    assert all(np.allclose(back[r.id], a[r.codes[0]] + b[r.codes[1]]) for r in coded.collect())
    with pytest.raises(ValueError):
        vectors.codebook_row(frame(a, "code", "vector"), limit=4)


def test_wav_files(spark, tmp_path):
    tone = np.round(np.sin(np.arange(1000) / 9) * 20000).astype(np.int16)
    stereo = np.stack([tone, -tone])
    (tmp_path / "a.wav").write_bytes(wav.assemble(48000, stereo))
    pcm24 = b"".join(int(v).to_bytes(3, "little", signed=True) for v in (0, -1, 8388607, -8388608))
    ext = struct.pack("<HHIIHHHHI", 0xFFFE, 1, 8000, 24000, 3, 24, 22, 24, 4) + struct.pack("<H", 1) + b"\0" * 14
    odd = b"RIFF" + struct.pack("<I", 0) + b"WAVE" + b"junk" + struct.pack("<I", 1) + b"x\0" + b"fmt " + struct.pack("<I", len(ext)) + ext + b"data" + struct.pack("<I", 12) + pcm24
    (tmp_path / "b.wav").write_bytes(odd)
    flat = struct.pack("<4f", 0.5, -0.25, 2.0, 0.0)
    head = struct.pack("<HHIIHH", 3, 2, 44100, 0, 8, 32)
    (tmp_path / "c.wav").write_bytes(b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", 16) + flat)
    blocks = wav.read(spark, str(tmp_path))
    got = {}
    for r in wav.samples(blocks).orderBy("i").collect():
        got.setdefault((r.path.rsplit("/")[-1], r.channel), []).append(r.v)
    assert np.allclose(got["a.wav", 0], tone / 32767, atol=1e-6) and np.allclose(got["a.wav", 1], -tone / 32767, atol=1e-6)
    assert np.allclose(got["b.wav", 0], [0, -1 / 8388608, 8388607 / 8388608, -1.0]) and got["c.wav", 0] == [0.5, 2.0]
    made = {r.path.rsplit("/")[-1]: bytes(r.content) for r in wav.files(blocks).collect()}
    assert np.abs(wav.parse(made["a.wav"])[1] * 32767 - stereo).max() <= 1.01
    for bad in (b"", b"RIFF\0\0\0\0WAVE", odd.replace(b"\x18\x00\x16\x00", b"\x20\x00\x16\x00")):
        with pytest.raises(ValueError):
            wav.parse(bad)


def test_ledger(spark):
    jobs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "k int, by string")
    done = spark.createDataFrame([(2, "x"), (2, "y"), (None, "z")], "k int, out string")
    assert {r.k for r in ledger.outstanding(jobs, done, "k").collect()} == {1, 3}
    assert {r.k for r in ledger.cached(jobs, done, ["k"]).collect()} == {2}
    assert {(r.k, r.decode is None) for r in ledger.provenance(jobs, done.where("out = 'x'"), "k").collect()} == {(1, True), (2, False), (3, True)}


def test_long_bit_packing_and_short_bytes(spark):
    v = [k * 7919 % 1024 for k in range(100_000)]
    row = values(spark, [(v,)], "v array<int>", d=octets.pack_bits(F.col("v"), 10))[0]
    assert bytes(row.d) == sum(x << (10 * k) for k, x in enumerate(v)).to_bytes(125_000, "little")
    assert values(spark, [(bytes(row.d),)], "d binary", v=octets.unpack_bits(F.col("d"), 10, F.lit(100_000)))[0].v == v
    assert values(spark, [(b"\xff\x03",)], "d binary", v=octets.unpack_bits(F.col("d"), 10, F.lit(3)))[0].v == [1023, None, None]


def test_error_function_dots_and_sizes(spark):
    x = [-7.0, -2.5, -0.1, 0.0, 1e-9, 0.7, 3.0, 5.9, 6.5]
    for r in values(spark, [(v,) for v in x], "x double", x=F.col("x"), e=quantise.erf(F.col("x")), g=quantise.gelu(F.col("x"))):
        assert abs(r.e - math.erf(r.x)) < 1e-14 and abs(r.g - r.x / 2 * (1 + math.erf(r.x / math.sqrt(2)))) < 1e-13
    a, b = [32767] * 1000 + [-5], [127] * 1000 + [9, 9]
    assert values(spark, [(a, b)], "a array<int>, b array<int>", d=quantise.whole_dot(F.col("a"), F.col("b")))[0].d == 32767 * 127 * 1000 - 45
    one = values(spark, [(123456789, 0.1, 0.3, 0.7)], "d long, a double, b double, c double", v=quantise.dequantised(*(F.col(c) for c in "dabc")))[0].v
    f = np.float32
    assert one == float(f(0.7) + f(123456789) * f(0.1) * f(0.3))
    assert [r.p for r in values(spark, [(0,), (1,), (20,), (85,), (86,)], "ms int", p=layout.packet_size_of_ms(F.col("ms")))] == [1, 48, 960, 4080, None]
    assert [r.x for r in values(spark, [(2.0, 96000), (1.0, 0)], "s double, n long", x=measures.realtime_factor(F.col("s"), F.col("n"), 48000))] == [1.0, None]
    assert values(spark, [([1, 2, 3],)], "x array<int>", t=arrays.trimmed(F.col("x"), F.lit(2)))[0].t == [1, 2]


def test_coder_by_chunks_and_shared_tables(spark):
    tables = spark.createDataFrame([(m, brute_cdf(p)) for m, p in enumerate(([0.5, 0.5], [0.1, 0.2, 0.7], [1e-9] * 40))], "model int, cdf array<long>")
    rows = [(k % 3, t // 16, t, (t * 5 + k) % 2, t % 3) for k in range(5) for t in range(40 + k) if k != 3]
    df = spark.createDataFrame([(f"t{r[0]}-{r[3]}", *r[1:]) for r in {(k[0], k[2], k[3]): k for k in rows}.values()], "track string, chunk long, t long, symbol long, model int").dropDuplicates(["track", "chunk", "t"])
    coded = entropy.encode(df, tables, keys=("track", "chunk"))
    back = entropy.decode(coded, df.drop("symbol"), tables, keys=("track", "chunk"))
    want = {(r.track, r.chunk, r.t): r.symbol for r in df.collect()}
    assert {(r.track, r.chunk, r.t): r.symbol for r in back.collect()} == want
    assert entropy.decode(coded.limit(0), df.drop("symbol"), tables, keys=("track", "chunk")).count() == 0
    with pytest.raises(ValueError):
        entropy.encode(df, tables, limit=2)
    data, _ = entropy.encode_symbols([0, 1] * 50_000, [[1 << 23, 1 << 24]] * 100_000)  # linear: the bits used to be one growing number
    assert 12_500 <= len(data) <= 12_504


def codec_tables(spark, spec, seed=0):
    """Random codes of tracks of several lengths, with frames beyond the last segment's own, and the counts of each model."""
    r = np.random.default_rng(seed)
    tables = spark.createDataFrame([(m, brute_cdf(r.dirichlet(np.full(32, 0.5)).tolist())) for m in range(8)], "model long, cdf array<long>")
    lengths = {1: 0, 2: 1, 3: 12, 4: 13, 5: 100}
    codes, scales = [], []
    for track, total in lengths.items():
        for seg in range(-(-total // spec.stride)):
            codes += [(track, seg, t, b, int(r.integers(32))) for t in range(spec.frames) for b in range(spec.books)]
            scales.append((track, seg, float(np.float32(r.random()))))
    return spark.createDataFrame(codes, "track long, seg long, t long, book long, code long"), spark.createDataFrame(list(lengths.items()), "track long, total long"), tables, spark.createDataFrame(scales, "track long, seg long, scale double")


@pytest.mark.parametrize("normalise", [False, True])
def test_codec_round_trip(spark, normalise):
    spec = codec.Spec("m", books=2, samples=16, stride=12, frames=8, model_hash="h", window=3, normalise=normalise, model_of=lambda at, b: 2 * at + b)
    codes, tracks, tables, scales = codec_tables(spark, spec)
    made = codec.encode(codes, tracks, tables, spec, scales if normalise else None)
    content = {r.track: bytes(r.content) for r in made.collect()}
    assert set(content) == {1, 2, 3, 4, 5}
    back, back_scales = codec.decode(made, tables, spec)
    total = {r.track: r.total for r in tracks.collect()}
    frames = lambda track, seg: -(-min(16, total[track] - seg * 12) * 8 // 16)
    want = sorted(tuple(r) for r in codes.collect() if r.t < frames(r.track, r.seg))
    assert sorted(tuple(r) for r in back.collect()) == want
    if normalise:
        assert {(r.track, r.seg): r.scale for r in back_scales.collect()} == {(r.track, r.seg): r.scale for r in scales.collect()}
    seen = codec.inspect(made, spec, rate=1000).where("track = 5").orderBy("chunk").collect()
    assert [(r.offset, r.samples, r.duration_ms, r.frames) for r in seen] == [(12 * k, min(16, 100 - 12 * k), float(min(16, 100 - 12 * k)), frames(5, k)) for k in range(9)]
    assert seen[-1].cumulative_bytes == sum(r.chunk_bytes for r in seen) and codec.scan(made, spec)[0].where("track = 5 AND file_bytes = header_bytes + " + str(seen[-1].cumulative_bytes)).count() == 1

    # Containers that don't suit the model, or are damaged, give their error and no codes.
    other = lambda **kw: codec.Spec(**({k: getattr(spec, k) for k in spec.__dataclass_fields__} | kw))
    for kw, error in (({"model": "x"}, "model differs"), ({"books": 3}, "codebooks differ"), ({"model_hash": "y"}, "model hash differs")):
        errors = {r.track: r.error for r in codec.scan(made, other(**kw))[0].collect()}
        assert errors[5] == error and (errors[1] is None) == ("model_hash" in kw)  # without chunks there is nothing that the hash is for
        assert codec.decode(made, tables, other(**kw))[0].count() == 0
    five = content[5]
    damaged = spark.createDataFrame([(1, five[:-1]), (2, five[:-1] + bytes([five[-1] ^ 1])), (3, five + struct.pack(">II", 0, 0)), (4, b"?"), (5, five)], "track long, content binary")
    tracks_found, chunks_found = codec.scan(damaged, spec)
    assert {r.track: r.error for r in tracks_found.collect()} == {1: None, 2: None, 3: "chunk count differs", 4: "header cut short", 5: None}
    assert {r.track: r.error for r in chunks_found.where("error IS NOT NULL").collect()} == {1: "payload cut short", 2: "checksum differs", 4: "not a container"}
    found = {r.track: r.n for r in codec.decode(damaged, tables, spec)[0].groupBy("track").agg(F.countDistinct("seg").alias("n")).collect()}
    assert found == {1: 8, 2: 8, 5: 9}
    with pytest.raises(Exception, match="codes don't fill the frames"):
        codec.encode(codes.where("NOT (track = 5 AND seg = 3 AND t = 1 AND book = 1)"), tracks, tables, spec, scales).collect()
    with pytest.raises(Exception, match="frame length out of range"):
        codec.encode(codes.where("NOT (track = 5 AND seg = 3)"), tracks, tables, spec, scales).collect()


def test_containers_are_bounded(spark):
    chunks = spark.createDataFrame([(1, 0, b"abc"), (2, 0, None), (1, 1, b"d"), (1, 10, b"e"), (1, 9, b"f")], "track long, chunk long, payload binary")
    made = {r.track: bytes(r.content) for r in containers.build(chunks, "track", "chunk", F.lit("{}")).collect()}
    assert len(made[2]) == 11 and [p for _, _, p, _ in containers.scan_container(made[1])] == [b"abc", b"d", b"f", b"e"]
    first = values(spark, [(made[1],), (made[2],), (b"",)], "c binary", f=octets.first_chunk(F.col("c")))
    assert [tuple(r.f) for r in first] == [(11, 11), (None, None), (None, None)]
    with pytest.raises(Exception, match="at most 10 bytes"):
        containers.build(chunks, "track", "chunk", F.lit("{}"), limit=10).collect()


def test_packet_caches(spark):
    parts = [(1, k, bytes([k]) * k) for k in range(12)]
    df = spark.createDataFrame(parts, "k long, packet long, data binary").repartition(3)
    made = packets.contents(df, "k", fields={"sampleRate": F.lit(48000)})
    back = packets.packets_of(made, "k").orderBy("packet").collect()
    assert [(r.packet, bytes(r.data), r.error) for r in back] == [(k, d, None) for _, k, d in parts] and '"sampleRate": 48000' in back[0].payload
    whole = bytes(made.head().content)

    def cache(envelope, body=b"", magic=b"PKT1"):
        raw = json.dumps(envelope).encode()
        return magic + struct.pack(">I", len(raw)) + raw + body

    good = {"format": "packet-cache.v1", "payload": {"packets": [{"buffer": 0}]}, "buffers": [{"byteLength": 2}]}
    bad = {
        "not a packet cache": cache(good, b"ab", b"XXXX"), "envelope cut short": whole[:20], "envelope format differs": cache(good | {"format": "?"}), "payload is missing": cache({"format": good["format"]}),
        "buffers are missing": cache({k: good[k] for k in ("format", "payload")}), "buffer 0 has no length": cache(good | {"buffers": [{}]}), "buffer 0 is cut short": cache(good, b"a"),
        "no packets": cache(good | {"payload": {}}, b"ab"), "packet 0 names a missing buffer": cache(good | {"payload": {"packets": [{"buffer": 1}]}}, b"ab"),
    }
    rows = packets.packets_of(spark.createDataFrame([(k, c) for k, c in bad.items()] + [("good", cache(good, b"ab"))], "k string, content binary"), "k").collect()
    assert {r.k: r.error for r in rows} == {k: k for k in bad} | {"good": None}
    rates = spark.createDataFrame([(1, 48000, 2), (1, 48000, 2), (2, 48000, 1), (2, 44100, 1), (3, None, 1), (3, 8000, 1), (4, None, None), (4, None, None)], "k int, rate int, channels int")
    assert {r.k for r in packets.changing(rates, "k", "rate", "channels").collect()} == {2, 3}


def test_raw_samples_and_written_files(spark, tmp_path):
    v = [[0.5, -0.25, 1e-8, 3.0], [], [1.0, 2.0]]
    df = spark.createDataFrame([(f"{k}.f32", x) for k, x in enumerate(v)], "name string, v array<double>")
    done = files.write(pcm.contents(df), f"{tmp_path}/raw").collect()
    assert {(r.name, r.bytes) for r in done} == {("0.f32", 16), ("1.f32", 0), ("2.f32", 8)}
    assert (tmp_path / "raw/0.f32").read_bytes() == np.array(v[0], "<f4").tobytes()
    back = {r.path[-5:]: r.v for r in pcm.read(spark, f"{tmp_path}/raw", channels=2).collect()}
    assert back == {"0.f32": np.array(v[0], np.float32).tolist(), "2.f32": [1.0, 2.0]}
    with pytest.raises(Exception, match="bytes, 16 are needed"):
        pcm.read(spark, f"{tmp_path}/raw", channels=2, frames=2).collect()
    manifest = spark.createDataFrame([("a", hashlib.sha256(b"x").hexdigest().upper()), ("b", "0"), ("c", "0")], "name string, digest string")
    assets = spark.createDataFrame([("a", b"x"), ("b", b"y"), ("d", b"z")], "name string, content binary")
    assert {r.name: r.status for r in arrays.verified(assets, manifest).collect()} == {"a": "ok", "b": "differs", "c": "missing", "d": "unlisted"}


@pytest.mark.parametrize("bits", [16, 24, 32])
def test_wav_formats_round_trip(bits):
    line = np.array([0, 5, -9, 32000, -32000]) * (1 if bits == 16 else 200 if bits == 24 else 0.125)
    samples = np.stack([line, -line, line]).astype(np.float32 if bits == 32 else np.int32)
    rate, got = wav.parse(wav.assemble(44100, samples, bits))
    assert rate == 44100 and np.allclose(got * {16: 32767, 24: 8388608, 32: 1}[bits], samples, rtol=1e-6)
