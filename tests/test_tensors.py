"""Tensor files: layouts, ranged reading with conditions, archives and weight files written by many tasks."""

import hashlib
import json
import struct

import numpy as np
import pytest
from framewright.plans.store import written
from framewright.sources import ranges, tensors
from pyspark.sql import functions as F

DIMS = {"dim": 4, "layers": 1, "heads": 2, "codebooks": 2, "cardinality": 3, "frame_length": 5, "past_context": 7}


def keep(df):
    return written(df, "kept")


def weight_file(dims, quantised, rng):
    """A file made value by value, and what it holds by name."""
    out, held = (b"ELMQ0001" if quantised else b"ELMW0001") + struct.pack("<7I", *dims.values()), {}
    for name, shape, rows in tensors.weight_shapes(dims):
        if quantised and rows:
            scales, q = rng.random(shape[0]).astype("<f4"), rng.integers(-127, 128, shape).astype("i1")
            out += scales.tobytes() + q.tobytes()
            held[name] = (q.astype(float), scales)
        else:
            v = rng.normal(size=shape).astype("<f4")
            out += v.tobytes()
            held[name] = (v.astype(float), None)
    return out, held


def gathered(rows):
    """Values by name from rows that were read."""
    out = {}
    for r in sorted(tensors.values(rows).collect(), key=lambda r: (r.name, r.row)):
        out.setdefault(r.name, []).append((list(r.v), r.scale))
    return out


@pytest.mark.parametrize("quantised", [False, True])
def test_weight_files(spark, tmp_path, quantised):
    data, held = weight_file(DIMS, quantised, np.random.default_rng(1))
    (tmp_path / "w.bin").write_bytes(data)
    got = gathered(tensors.read(spark, str(tmp_path), bytes_a_task=64))
    assert set(got) == set(held)
    for name, (v, scales) in held.items():
        assert np.array_equal(np.concatenate([x for x, _ in got[name]]), v.ravel())
        assert [s for _, s in got[name]] == (scales.tolist() if scales is not None else [None] * len(got[name]))


def test_only_what_is_asked_for_is_read(spark, tmp_path):
    """The planned ranges are those of the tensors asked for, to the byte; two uses in one plan keep apart."""
    data, held = weight_file(DIMS, True, np.random.default_rng(2))
    (tmp_path / "w.bin").write_bytes(data)
    for options, names in (
        ({"names": {"pos_emb"}}, {"pos_emb"}), ({"names": {"emb.0", "emb.1", "none"}}, {"emb.0", "emb.1"}), ({"prefix": "layers.0.linear"}, {n for n in held if n.startswith("layers.0.linear")}),
        ({"names": {"emb.0", "pos_emb"}, "prefix": "emb"}, {"emb.0"}), ({"names": set()}, set()), ({}, set(held)),
    ):
        planned = tensors._Reader(str(tmp_path), 64, **options).partitions()
        assert {t.name for part in planned for t, _, _ in part.parts} == names
        assert sum(p.size for p in planned) == sum(held[n][0].size * (1 if held[n][1] is not None else 4) + (4 * len(held[n][1]) if held[n][1] is not None else 0) for n in names)
    path = str(tmp_path)
    both = tensors.read(spark, path, names=["emb.1"]).where("row > 1").union(tensors.read(spark, path, prefix="pos"))
    assert sorted((r.name, r.row) for r in both.collect()) == [("emb.1", 2), ("emb.1", 3)] + [("pos_emb", k) for k in range(5)]


def test_faulty_weight_files(spark, tmp_path):
    data, _ = weight_file(DIMS, True, np.random.default_rng(3))
    zero, odd = data[:8] + struct.pack("<I", 0) + data[12:], data[:16] + struct.pack("<I", 3) + data[20:]
    head = lambda d: struct.pack("<Q", len(d)) + d
    bad = {
        "early": data[:-1], "trailing": data + b"xy", "zero": zero, "heads": odd, "short": data[:20], "text": b"hello world, this is no file", "cut": b"ELM",
        "twice": head(b'{"a":{"dtype":"U8","shape":[1],"data_offsets":[0,1]},"a":{"dtype":"U8","shape":[1],"data_offsets":[0,1]}}') + b"x",
        "offsets": head(b'{"a":{"dtype":"U8","shape":[1],"data_offsets":[1,0]}}'), "size": head(b'{"a":{"dtype":"U8","shape":[1],"data_offsets":[0,1]}}') + b"xx",
        "shape": head(b'{"a":{"dtype":"F32","shape":[2],"data_offsets":[0,4]}}') + b"xxxx", "type": head(b'{"a":{"dtype":"Q3","shape":[1],"data_offsets":[0,1]}}') + b"x", "bare": head(b'{"a":{"dtype":"U8"}}'),
    }
    for name, content in {**bad, "good": data}.items():
        (tmp_path / name).write_bytes(content)
    rows = tensors.read(spark, str(tmp_path)).collect()
    errors = {r.path.rsplit("/")[-1]: r.error for r in rows if r.error}
    assert set(errors) == set(bad) and "2 trailing bytes" in errors["trailing"] and "zero" in errors["zero"] and "heads" in errors["heads"] and "twice" in errors["twice"]
    assert {r.path.rsplit("/")[-1] for r in rows if not r.error} == {"good"}


def archive_bytes(arrays, metadata=None):
    head, at = ({"__metadata__": metadata} if metadata else {}), 0
    for name, dtype, a in arrays:
        head[name] = {"dtype": dtype, "shape": list(a.shape), "data_offsets": [at, at + a.nbytes]}
        at += a.nbytes
    text = json.dumps(head, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 8)
    return struct.pack("<Q", len(text)) + text + b"".join(a.tobytes() for *_, a in arrays)


def rows_of(arrays, archive="a.bin", piece=3):
    out = []
    for place, (name, dtype, a) in enumerate(arrays):
        if a.ndim > 1:
            out += [(archive, name, place, dtype, list(a.shape[1:]), k, a[k].tobytes()) for k in range(len(a))]
        else:
            out += [(archive, name, place, dtype, None, k, a[k : k + piece].tobytes()) for k in range(0, len(a), piece)]
    return out


ROWS = "archive string, name string, place int, dtype string, row_shape array<long>, row long, data binary"


def arrays(rng):
    return [
        ("conv.weight", "F32", rng.normal(size=(6, 2, 3)).astype("<f4")), ('quote"d \\ name', "I8", rng.integers(-9, 9, (4, 5)).astype("i1")), ("bias", "F16", rng.normal(size=7).astype("<f2")),
        ("ids", "I64", rng.integers(-(2**60), 2**60, 10).astype("<i8")), ("flags", "BOOL", np.array([True, False, True])),
    ]


@pytest.mark.parametrize("metadata", [None, {"format": "np", "of": "7"}])
def test_archives(spark, tmp_path, metadata):
    rng = np.random.default_rng(4)
    made, other = arrays(rng), arrays(rng)[:2]
    rows = spark.createDataFrame(rows_of(made) + rows_of(other, "b.bin"), ROWS).repartition(5)
    done = {r.name: r for r in tensors.archives(rows, str(tmp_path), keep, metadata).collect()}
    for name, want in (("a.bin", archive_bytes(made, metadata)), ("b.bin", archive_bytes(other, metadata))):
        data = (tmp_path / name).read_bytes()
        assert data == want and done[name].error is None and (done[name].bytes, done[name].digest) == (len(want), hashlib.sha256(want).hexdigest())
    got = gathered(tensors.read(spark, str(tmp_path / "a.bin"), bytes_a_task=16))
    for name, _, a in made:
        assert np.array_equal(np.concatenate([x for x, _ in got[name]]), a.astype(float).ravel())


def test_archives_that_are_refused(spark, tmp_path):
    a = np.zeros((2, 2), "<f4")
    good = rows_of([("x", "F32", a), ("y", "F32", a)])

    def run(rows):
        return tensors.archives(spark.createDataFrame(rows, ROWS), str(tmp_path), keep).collect()

    with pytest.raises(Exception, match="x is in the archive twice"):
        run(good + rows_of([("z", "F32", a), ("x", "F32", a)]))
    with pytest.raises(Exception, match="y has a row of another size"):
        run(good + [("a.bin", "y", 1, "F32", [2], 2, b"1234")])
    assert run(good + good[:1])[0].error and run([r for r in good if r[5] == 1])[0].error
    assert not [f for f in tmp_path.iterdir() if f.name == "a.bin"]


def test_weight_files_are_written(spark, tmp_path):
    """Float rows to a file; read, quantised by rows, written again: scales and whole numbers as computed one by one."""
    data, held = weight_file(DIMS, False, np.random.default_rng(5))
    rows = [(n, k, (r if v.ndim > 1 else v).astype("<f4").tobytes()) for n, (v, _) in held.items() for k, r in enumerate(v if v.ndim > 1 else [v])]
    df = spark.createDataFrame(rows, "name string, row long, data binary").repartition(4)
    done = tensors.weights(df, DIMS, str(tmp_path), "w.bin", keep).first()
    assert done.error is None and (tmp_path / "w.bin").read_bytes() == data
    short = tensors.weights(df.where("NOT (name = 'linears.1.bias')"), DIMS, str(tmp_path / "other"), "w.bin", keep).first()
    assert short.error == "weight file ends early"
    gap = tensors.weights(df.where("NOT (name = 'pos_emb' AND row = 2)"), DIMS, str(tmp_path / "other"), "v.bin", keep).first()
    assert "followed" in gap.error


def test_read_at(spark, tmp_path):
    (tmp_path / "x").write_bytes(bytes(range(100)))
    rows = spark.createDataFrame([(str(tmp_path / "x"), k, n, "tag") for k, n in ((0, 3), (98, 9), (50, 0), (7, 2))], "path string, at long, size long, tag string")
    got = {r.at: (bytes(r.data), r.tag) for r in ranges.read_at(rows).collect()}
    assert got == {0: (b"\0\1\2", "tag"), 98: (b"bc", "tag"), 50: (b"", "tag"), 7: (b"\7\10", "tag")}
    assert ranges.read_at(rows.withColumn("length", F.lit(1))).columns == ["path", "at", "size", "tag", "length", "data"]
