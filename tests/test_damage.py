"""Lost, foreign and damaged data is told: no segment goes missing, no file ends a job."""

import json
import struct

import numpy as np
import pytest
from framewright.operators import codec, containers, ledger
from framewright.sources import packets, pcm, wav
from pyspark.sql import functions as F

SPEC = codec.Spec("model", books=1, samples=4, stride=4, frames=4, model_hash="h", window=4, normalise=True, model_of=lambda at, book: 0)


@pytest.fixture(scope="module")
def coded(spark):
    tracks = spark.createDataFrame([(1, 8), (2, 3), (3, 0)], "track long, total long")
    codes = spark.createDataFrame([(k, s, t, 0, (k + s + t) % 3) for k, s in ((1, 0), (1, 1), (2, 0)) for t in range(4)], "track long, seg long, t long, book long, code long")
    scales = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (2, 0, 3.0)], "track long, seg long, scale double")
    tables = spark.createDataFrame([(0, [2**22, 2**23, 2**24])], "model long, cdf array<long>")
    return codes, tracks, tables, scales


def test_segment_without_scale(coded):
    codes, tracks, tables, scales = coded
    with pytest.raises(Exception, match="segment 1 1 scale is missing"):
        codec.encode(codes, tracks, tables, SPEC, scales.where("seg = 0")).collect()
    assert codec.encode(codes, tracks, tables, SPEC, scales).count() == 3


def test_wide_payloads_are_marked(spark, coded):
    """A symbol that keeps its interval around the middle leaves the register's places unsettled."""
    tracks = spark.createDataFrame([(1, 200), (2, 200)], "track long, total long")
    middle = [2**23 - 1, 2**23 + 1, 2**24]
    tables = spark.createDataFrame([(0, middle)], "model long, cdf array<long>")
    spec = codec.Spec("model", books=1, samples=200, stride=200, frames=200, model_hash="h", window=200, model_of=lambda at, book: 0)
    codes = spark.createDataFrame([(k, 0, t, 0, 1 if k == 1 else 2 * (t % 2)) for k in (1, 2) for t in range(200)], "track long, seg long, t long, book long, code long")
    content = codec.encode(codes, tracks, tables, spec)
    assert {r.track: r.wide for r in content.collect()} == {1: True, 2: False}
    back = codec.decoded(content, tables, spec).collect()
    assert {r.track: list(r.codes) for r in back}[1] == [1] * 200


def test_foreign_settings(coded):
    codes, tracks, tables, scales = coded
    content = codec.encode(codes, tracks, tables, SPEC, scales)
    for name, other, said in (("tau", 0.5, "temperature differs"), ("fp", 4096, "probability scale differs"), ("mr", 1, "smallest share differs")):
        spec = codec.Spec(**{**SPEC.__dict__, name: other})
        assert {(r.track, r.error) for r in codec.scan(content, spec)[0].collect()} == {(1, said), (2, said), (3, None)}
        assert codec.decoded(content, tables, spec).count() == 0
        own = codec.encode(codes, tracks, tables, spec, scales)
        assert {r.error for r in codec.scan(own, spec)[0].collect()} == {None}


def test_payload_that_runs_out(spark, coded):
    codes, tracks, tables, scales = coded
    parts = spark.createDataFrame([(1, 0, struct.pack(">f", 1.5)), (1, 1, b"\0"), (2, 0, struct.pack(">f", 2.5) + b"\0" * 40)], "track long, chunk long, payload binary").withColumn("wide", F.lit(False))
    found = codec.decoded(codec.assembled(tracks, parts, SPEC), tables, SPEC)
    assert {(r.track, r.seg): (r.scale, r.codes is None, r.error) for r in found.collect()} == {(1, 0): (1.5, True, "arithmetic stream exhausted"), (1, 1): (None, True, "scale cut short"), (2, 0): (2.5, False, None)}
    codes, scales = codec.opened(found, SPEC)
    assert {r.track for r in codes.collect()} == {2} and scales.count() == 1


def test_packet_lengths(spark):
    def cache(buffers, body, marks=None):
        envelope = json.dumps({"format": "packet-cache.v1", "payload": {"packets": marks or [{"buffer": 0}]}, "buffers": buffers}).encode()
        return b"PKT1" + struct.pack(">I", len(envelope)) + envelope + body

    rows = {
        "negative": cache([{"byteLength": 4}, {"byteLength": -4}], b"abcd", [{"buffer": 1}]), "fraction": cache([{"byteLength": 1.5}], b"ab"), "text": cache([{"byteLength": "2"}], b"ab"),
        "truth": cache([{"byteLength": True}], b"a"), "left": cache([{"byteLength": 1}], b"ab"), "mark": cache([{"byteLength": 1}], b"a", [{"buffer": 0.0}]), "good": cache([{"byteLength": 2}], b"ab"),
    }
    got = {r.k: (r.data and bytes(r.data), r.error) for r in packets.packets_of(spark.createDataFrame(list(rows.items()), "k string, content binary"), "k").collect()}
    assert got.pop("good") == (b"ab", None) and all(d is None and e for d, e in got.values()) and len(got) == 6
    parts = spark.createDataFrame([(1, 0, b"a" * 60), (1, 1, b"b" * 60)], "k long, packet long, data binary")
    with pytest.raises(Exception, match="at most 100 bytes"):
        packets.contents(parts, "k", limit=100).collect()
    assert packets.contents(parts, "k", limit=120).count() == 1


def test_damaged_wav_files(spark, tmp_path):
    sound = wav.assemble(8000, np.array([[100, -200, 300]], np.int16))
    bad = {
        "no-channels": sound[:22] + b"\0\0" + sound[24:], "four-bits": sound[:34] + b"\4\0" + sound[36:], "short-format": b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<I", 8) + b"\1\0\1\0\0\0\0\0",
        "text": b"hello, I am not a WAV file", "no-data": sound[:36],
    }
    for name, data in {**bad, "sound": sound}.items():
        (tmp_path / f"{name}.wav").write_bytes(data)
    rows = wav.read(spark, str(tmp_path)).collect()
    errors = {r.path.rsplit("/")[-1][:-4]: r.error for r in rows if r.error}
    assert set(errors) == set(bad) and {r.path.rsplit("/")[-1] for r in rows if not r.error} == {"sound.wav"}
    assert [round(r.v * 32767) for r in wav.samples(wav.read(spark, str(tmp_path))).orderBy("i").collect()] == [100, -200, 300]
    assert {r.error for r in wav.read(spark, str(tmp_path), limit=10, pattern="sound.wav").collect()} == {"WAV file of over 10 bytes"}
    for data in bad.values():
        with pytest.raises(ValueError):
            wav.parse(data)


def test_raw_samples_with_error_rows(spark, tmp_path):
    (tmp_path / "a.f32").write_bytes(np.arange(4, dtype="<f4").tobytes())
    (tmp_path / "b.f32").write_bytes(b"12345")
    rows = {r.path[-5:]: (r.v and list(r.v), r.error and r.error[-40:]) for r in pcm.read(spark, str(tmp_path), strict=False).collect()}
    assert rows["a.f32"] == ([0, 1, 2, 3], None) and rows["b.f32"][0] is None and "5 bytes" in rows["b.f32"][1]


def test_empty_outputs_are_not_done(spark):
    jobs = spark.createDataFrame([(k,) for k in range(5)], "k int")
    done = spark.createDataFrame([(0, 10), (1, 0), (2, None), (3, 0), (3, 7)], "k int, bytes long")
    assert {r.k for r in ledger.outstanding(jobs, done, "k", F.col("bytes")).collect()} == {1, 2, 4}
    assert {r.k for r in ledger.outstanding(jobs, done, "k").collect()} == {4}


def test_metadata_defaults(spark):
    """A header without settings has the defaults, so it suits a model that has them."""
    row = spark.createDataFrame([('{"m":"model","nc":1,"lm":true,"acv":2,"lmh":"h"}',)], "j string")
    m = containers.parse_metadata(F.col("j"))
    assert row.select(containers.violation(m, "model", 1, "h", F.lit(1), SPEC.settings).alias("v")).first().v is None


def test_entry_without_the_training_data_operators(monkeypatch):
    """A package that they need and that isn't there leaves the other queries."""
    import sys

    import __spark_entry__ as entry
    from framewright.plans.catalog import ORACLES, QUERIES

    for name in [m for m in sys.modules if m.startswith("framewright.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "framewright.llm", None)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLES)


def test_no_plan_makes_its_expression_twice(spark):
    """The optimised plan of each allocation stays small: no inferred filter repeats the whole expression."""
    from framewright.plans.catalog import QUERIES

    for name in ("cdf_allocation", "context_counts"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("array_append") <= 2 and len(plan) < 20_000, (name, len(plan))
