"""Coding by context: against a coder of plain big integers, batch against stream, and its errors."""

import random

import numpy as np
import pytest
from framewright.operators import codec, entropy, feedback
from framewright.streaming import chunks as streams
from framewright.streaming import coding
from pyspark.sql import functions as F


def plain(shares, bits=24):
    """An arithmetic coder that never settles a digit: the whole interval as two numbers, the code as the lower one's digits."""
    low, high, digits = 0, 0, 0
    for below, upto in shares:
        while high - low + 1 < 1 << bits:
            low, high, digits = 2 * low, 2 * high + 1, digits + 1
        width = high - low + 1
        low, high = low + (width * below >> bits), low + (width * upto >> bits) - 1
    text = f"{low:0{digits}b}"[-digits:] if digits else ""
    return bytes(int(text[k : k + 8][::-1], 2) for k in range(0, len(text), 8))


def counts(rng, card):
    cuts = sorted(rng.sample(range(1, 2**24 - 1), card - 1))
    return [*cuts, 2**24]


@pytest.mark.parametrize("seed", range(6))
def test_bytes_against_big_integers(seed):
    rng = random.Random(seed)
    card = rng.choice([2, 5, 64])
    cdfs = [counts(rng, card) if rng.random() < 0.5 else [2 * k for k in range(1, card)] + [2**24] for _ in range(rng.randrange(1, 300))]
    symbols = [rng.randrange(card) for _ in cdfs]
    data, _ = entropy.encode_symbols(symbols, cdfs)
    assert data == plain([(c[s - 1] if s else 0, c[s]) for s, c in zip(symbols, cdfs)])
    assert entropy.decode_symbols(data, cdfs) == symbols


def brute_models(codes, books, card, order, window):
    out = []
    for k in range(len(codes)):
        t, b = divmod(k, books)
        number = 0
        for back in range(order, 0, -1):
            number = number * (card + 1) + (codes[k - back * books] + 1 if t % window >= back else 0)
        out.append(number * books + b)
    return out


@pytest.mark.parametrize("books, card, order, window", [(1, 3, 1, 4), (2, 5, 2, 3), (3, 4, 2, 75), (2, 4, 3, 2)])
def test_contexts(spark, books, card, order, window):
    rng = random.Random(7)
    rows = [(i, [rng.randrange(card) for _ in range(books * rng.randrange(0, 9))]) for i in range(20)]
    ctx = feedback.Context(books, card, order, window)
    got = spark.createDataFrame(rows, "i int, codes array<long>").select("i", ctx.models(F.col("codes")).alias("m")).collect()
    for r in got:
        codes = dict(rows)[r.i]
        assert list(r.m) == brute_models(codes, books, card, order, window)
        past, own = feedback.History(ctx), []
        for t in range(len(codes) // books):
            past.begin()
            own += [ctx.model(b, past.before[b]) for b in range(books)]
            past.end(codes[t * books : (t + 1) * books])
        assert own == list(r.m)


def made(spark, rng, ctx, tracks=6, frames=11):
    rows = [(k, s, t, b, rng.randrange(ctx.cardinality)) for k in range(tracks) for s in range(2) for t in range(frames - 3 * s) for b in range(ctx.books)]
    return rows, spark.createDataFrame(rows, "track long, seg long, t long, book long, code long")


def test_learned_counts(spark):
    ctx = feedback.Context(2, 4, 1, 5)
    rows, codes = made(spark, random.Random(1), ctx)
    held = {}
    for k, s, t, b, c in rows:
        held.setdefault((k, s), []).append(c)
    seen = {}
    for x in held.values():
        for m, c in zip(brute_models(x, 2, 4, 1, 5), x):
            seen.setdefault(m, [1] * 4)[c] += 1
    got = {r.model: r.cdf for r in feedback.learn(codes, ctx).collect()}
    assert set(got) == set(seen)
    for m, cdf in got.items():
        share = np.diff([0, *cdf]) / 2**24
        assert cdf[-1] == 2**24 and np.abs(share - np.array(seen[m]) / sum(seen[m])).max() < 1e-3


def test_roundtrip_and_errors(spark):
    ctx = feedback.Context(2, 4, 2, 4)
    spec = codec.Spec("model", books=2, samples=10, stride=10, frames=5, model_hash="h", window=4, normalise=True)
    rng = random.Random(3)
    tracks = spark.createDataFrame([(k, 10 * k + (k % 3)) for k in range(5)], "track long, total long")
    rows = [(k, s, t, b, rng.randrange(4)) for k in range(5) for s in range(k + (k % 3 > 0)) for t in range(5) for b in range(2)]
    codes = spark.createDataFrame(rows, "track long, seg long, t long, book long, code long")
    scales = codes.select("track", "seg", (F.col("seg") + 0.25).alias("scale")).distinct()
    tables = feedback.learn(codes, ctx)
    content = feedback.encode(codes, tracks, tables, spec, ctx, scales)
    back = feedback.decode(content, tables, spec, ctx).collect()
    want = {}
    for k, s, t, b, c in rows:
        n = min(10, 10 * k + k % 3 - 10 * s)
        if t < -(-n * 5 // 10):
            want.setdefault((k, s), []).append(c)
    assert {(r.track, r.seg): list(r.codes) for r in back} == want and all(r.scale == r.seg + 0.25 and r.error is None for r in back)
    # Bytes that run out, counts that lack a context: an error of that segment alone.
    fewer = tables.where(F.col("model") != tables.agg(F.max("model")).first()[0])
    errors = [r.error for r in feedback.decode(content, fewer, spec, ctx).collect()]
    assert "no counts for this context" in errors and None in errors
    with pytest.raises(Exception, match="no counts for this context"):
        feedback.encode(codes, tracks, fewer, spec, ctx, scales).collect()
    with pytest.raises(Exception, match="scale is missing"):
        feedback.encode(codes, tracks, tables, spec, ctx, scales.where("track <> 3")).collect()
    with pytest.raises(ValueError, match="contexts"):
        feedback.Tables(tables, ctx, limit=8)


def test_segments_that_cannot_be_coded(spark):
    ctx = feedback.Context(1, 3, 1, 9)
    tables = spark.createDataFrame([(0, [5, 9, 2**24]), (1, [5, 9, 2**24])], "model long, cdf array<long>")
    rows = spark.createDataFrame([(1, [0, 2]), (2, [1, 0]), (3, [7]), (4, []), (5, [0, 0, -1])], "track long, codes array<long>")
    got = {r.track: (r.payload is None, r.symbols, r.error) for r in feedback.encode_segments(rows, tables, ctx, keys=("track",)).collect()}
    assert got == {1: (False, 2, None), 2: (True, 2, "no counts for this context at symbol 1"), 3: (True, 1, "symbol is out of range at symbol 0"), 4: (False, 0, None), 5: (True, 3, "symbol is out of range at symbol 2")}


@pytest.mark.parametrize("seed, padded", [(1, 0), (2, 13)])
def test_any_batches_and_a_restart(spark, tmp_path, seed, padded):
    """Frames in random order over random files, a stop in the middle: the bytes of the batch encoder."""
    ctx = feedback.Context(2, 6, 1, 4)
    rng = random.Random(seed)
    rows, codes = made(spark, rng, ctx)
    held, frames = {}, []
    for k, s, t, b, c in rows:
        held.setdefault((k, s), []).append(c)
    for (k, s), x in held.items():
        frames += [(k, s, t, x[2 * t : 2 * t + 2], 2 * t + 2 == len(x)) for t in range(len(x) // 2)]
    padding = spark.createDataFrame([(90, 0, t, b, 0) for t in range(20) for b in range(2)] + [(91 + c, 0, t, b, c * (t % 4 == 0)) for c in range(6) for t in range(8) for b in range(2)], codes.schema)
    tables = feedback.learn(codes.union(padding), ctx)
    whole = spark.createDataFrame([(k, s, x + [0] * (2 * max(0, padded - len(x) // 2))) for (k, s), x in held.items()], "track long, seg long, codes array<long>")
    want = {(r.track, r.seg): (bytes(r.payload) if r.payload is not None else None, r.error) for r in feedback.encode_segments(whole, tables, ctx).collect()}
    rng.shuffle(frames)
    source, cuts = str(tmp_path / "in"), sorted(rng.sample(range(1, len(frames)), 5))
    schema = "track long, seg long, t long, symbols array<long>, last boolean"

    def add(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)

    def go():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        return streams.run_once(coding.coded(stream, tables, ctx, padded=padded), str(tmp_path / "out"), str(tmp_path / "state"))

    for a, b in zip([0, *cuts[:3]], cuts[:3]):
        add(frames[a:b])
    go()
    for a, b in zip(cuts[2:], [*cuts[3:], len(frames)]):
        add(frames[a:b])
    add(frames[:4])  # frames that come again
    got = go().collect()
    assert len({(r.track, r.seg) for r in got}) == len(want)
    assert {(r.track, r.seg): (bytes(r.payload) if r.payload is not None else None, r.error) for r in got} == want
    assert {r.frames for r in got} == ({11, 8} if not padded else {13})


def test_segments_share_rows_of_state(spark, tmp_path):
    ctx = feedback.Context(books=2, cardinality=8, order=1, window=4)
    rng = random.Random(5)
    segments = {(name, when): [rng.randrange(8) for _ in range(12)] for name in ("a", "", 'é"', None) for when in ("2024-01-01 00:00:00.000001", "2024-01-01 00:00:00.000002", None)}
    kinds = "name string, when timestamp"
    stamped = lambda df: df.withColumn("when", F.col("when").cast("timestamp"))
    whole = stamped(spark.createDataFrame([(*k, x) for k, x in segments.items()], "name string, when string, codes array<long>"))
    codes = whole.select("name", "when", F.posexplode("codes").alias("k", "code")).withColumns({"t": F.floor(F.col("k") / 2), "book": F.col("k").cast("long") % 2})
    tables = feedback.learn(codes, ctx, keys=("name", "when"))
    frames = [(*k, t, x[2 * t : 2 * t + 2], t == 5) for k, x in segments.items() for t in range(6)]
    source, state = str(tmp_path / "in"), str(tmp_path / "state")

    def go(part):
        stamped(spark.createDataFrame(part, "name string, when string, t long, symbols array<long>, last boolean")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(f"{kinds}, t long, symbols array<long>, last boolean").parquet(source)
        return streams.run_once(coding.coded(stream, tables, ctx, keys=("name", "when"), bundles=3), str(tmp_path / "out"), state)

    held = lambda: spark.read.format("statestore").load(state).count()
    assert go(frames[::2]).count() == 0
    assert 0 < held() <= 3 < len(segments)
    got = go(frames[1::2]).collect()
    assert held() == 0
    want = feedback.encode_segments(whole, tables, ctx, keys=("name", "when")).collect()
    assert sorted((str(r.name), str(r.when), bytes(r.payload)) for r in got) == sorted((str(r.name), str(r.when), bytes(r.payload)) for r in want)
    assert len(got) == len(segments)
