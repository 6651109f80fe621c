"""Containers by range against whole values; files of over 2 GB; how much is read of a head."""

import os
import struct
import zlib

from framewright.operators import containers
from framewright.sources import container_files as cf


def container(payloads, json=b'{"m":"x"}'):
    return b"ECDC\0" + struct.pack(">I", len(json)) + json + b"".join(struct.pack(">II", len(p), zlib.crc32(p)) + p for p in payloads)


def test_against_whole_values(spark, tmp_path):
    good = container([os.urandom(k * 400) for k in range(30)] + [b""])
    files = {
        "good": good, "header": container([]), "cut": good[:-410], "frame": container([b"abc"]) + b"\0\0\1", "damaged": good[:-1] + bytes([good[-1] ^ 1]) if good[-1:] else good, "other": b"RIFF" + good[4:],
        "head-cut": good[:12], "nine": good[:9], "version": b"ECDC\1" + good[5:], "short": b"ECDC",
    }
    flipped = bytearray(good)
    flipped[len(container([])) + 8 + 8 + 3] ^= 1
    files["flipped"] = bytes(flipped)
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = {}
    for r in cf.chunks(cf.files(spark, str(tmp_path))).collect():
        rows.setdefault(r.path.rsplit("/")[-1], []).append((r.chunk, r.place, r.payload and bytes(r.payload), r.error))
    for name, data in files.items():
        want = [(k, at, p, e) for k, at, p, e in containers.scan_container(data)]
        got = sorted(rows.get(name, []))
        if want and want[0][3] in ("not a container", "header cut short"):
            assert [g[3] for g in got] == [{"version": "unknown version", "other": "not a container"}.get(name, "header cut short")]
        else:
            assert [(k, at, p or (b"" if e is None else None), e) for k, at, p, e in got] == want, name
    heads = {r.path.rsplit("/")[-1]: r for r in cf.heads(cf.files(spark, str(tmp_path))).collect()}
    assert (heads["good"].json, heads["good"].header_bytes, heads["good"].first_bytes, heads["good"].bytes_read) == ('{"m":"x"}', 18, 8, 26)
    assert heads["header"].first_bytes is None and heads["short"].error == "header cut short"


def test_files_of_over_two_gigabytes(spark, tmp_path):
    """Chunks of 800 MB (of zeros, as holes in the file) before small ones: the index and the small ones are there, few bytes are read."""
    path, small = tmp_path / "large", [b"first", b"last one"]
    with open(path, "wb") as f:
        f.write(b"ECDC\0" + struct.pack(">I", 2) + b"{}")
        for _ in range(3):
            f.write(struct.pack(">II", 800_000_000, 7))
            f.seek(800_000_000, 1)
        for p in small:
            f.write(struct.pack(">II", len(p), zlib.crc32(p)) + p)
    found = cf.files(spark, str(path))
    assert found.first().length > 2**31
    sizes = [r["size"] for r in cf.index(found).orderBy("chunk").collect()]
    assert sizes == [800_000_000] * 3 + [5, 8]
    assert [bytes(r.payload) for r in cf.chunks(found, "size < 1000").orderBy("chunk").collect()] == small
    head = cf.heads(found).first()
    assert (head.bytes_read, head.first_bytes) == (19, 800_000_008)


def test_no_file(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"x")
    assert cf.chunks(cf.files(spark, str(tmp_path), "*.none")).collect() == []
