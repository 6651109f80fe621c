"""Phrases whose words stand together more often than they would by chance, counted by direct-address tiles.

Texts become chunks of whole documents of one language, as numbers into the chunk's own dictionary. Words of the
minimum frequency get ids in order of frequency over the whole corpus; each chunk fetches the ids of its own
dictionary by a join, so no vocabulary is ever broadcast. Two neighbouring ids are a cell of a large square that is
cut into tiles of ``side`` x ``side`` cells: a tile with many pairs in a chunk is counted densely by its addresses
(``numpy.bincount``), what falls into sparse tiles by sorting (value, count) lists. Spark adds up the
cells of all tasks. Pairs of the minimum frequency are ranked by frequency like the words before them and take the words' place:
a phrase of n + 1 words is a pair of two overlapping phrases of n words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, blobs, documents, mix, partition_id, spent, written

#: A-Z as a-z; tab as space; the characters that end a piece as line feeds.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 10 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
_BREAK = -1


class _Numbers(dict):
    """Numbers words from 0 as they come, beside two that have theirs from the start."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self) - 2
        return number


class _Chunk:
    """Token numbers of some texts of one language; ``_BREAK`` stands between pieces."""

    def __init__(self):
        self.words = _Numbers({b"": -2, b"\n": _BREAK})
        self.codes: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        tokens = text.translate(_FOLD).replace(b"\n", b" \n ").split(b" ")
        codes = np.fromiter(map(self.words.__getitem__, tokens), np.int32, len(tokens))
        codes = codes[codes > -2]
        self.codes += [codes, np.array([_BREAK], np.int32)]
        self.size += len(codes) + 1

    def row(self, number: int, lang: str) -> dict:
        codes = np.concatenate(self.codes)
        counts = np.bincount(codes[codes >= 0], minlength=len(self.words) - 2)
        return {"chunk": number, "lang": lang, "words": [w.decode() for w in list(self.words)[2:]], "counts": counts.tolist(), "codes": codes.tobytes()}


def chunk_words(langs_and_texts, limit: int):
    """Rows (chunk, lang, words, counts, codes) of batches (lang, text); at most ``limit`` words and one text more are held."""
    open_: dict[str, _Chunk] = {}
    number = partition_id() << 32
    for batch in batches(langs_and_texts, "text"):
        for lang, text in zip(batch.column(0).to_pylist(), blobs(batch, "text")):
            if text:
                open_.setdefault(lang, _Chunk()).add(text)
        while open_ and sum(c.size + 4 * len(c.words) for c in open_.values()) > limit:
            lang = max(open_, key=lambda k: open_[k].size)
            yield open_.pop(lang).row(number, lang)
            number += 1
    for lang, chunk in open_.items():
        yield chunk.row(number, lang)
        number += 1


def tiled_counts(x: np.ndarray, y: np.ndarray, side: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """(x << 32 | y, count) of each distinct pair, sorted: dense tiles by their addresses, sparse ones as sorted lists.

    A tile is dense if its pairs are at least a 32nd of its cells; only the first 64 x 64 tiles are asked, ids being in
    order of frequency.
    """
    keys, counts = [], []
    tile = np.where((x < 64 * side) & (y < 64 * side), (x // side) * 64 + y // side, 4096)
    full = np.flatnonzero(np.bincount(tile, minlength=4097)[:4096] * 32 >= side * side)
    for t in full.tolist():
        own = tile == t
        cells = np.bincount((x[own] % side) * side + y[own] % side, minlength=side * side)
        hit = np.flatnonzero(cells)
        keys.append(((t // 64 * side + hit // side) << 32) | (t % 64 * side + hit % side))
        counts.append(cells[hit])
    rest = ~np.isin(tile, full)
    k, n = np.unique((x[rest] << 32) | y[rest], return_counts=True)
    keys, counts = np.concatenate([*keys, k]), np.concatenate([*counts, n])
    order = np.argsort(keys, kind="stable")
    return keys[order], counts[order]


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(c) for c in zip(*parts))
    keys, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, at, counts)
    return keys, total


def _neighbours(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids side by side, both at least 0."""
    ok = (ids[:-1] >= 0) & (ids[1:] >= 0)
    return ids[:-1][ok].astype(np.int64), ids[1:][ok].astype(np.int64)


def _ranked(units: DataFrame, name: str) -> DataFrame:
    """``units`` with ``id`` from 0 in descending order of ``a``: each part is numbered by itself, after those before it."""
    order = [F.desc("a"), F.xxhash64("lang", "phrase"), F.col("phrase")]
    parts = written(units.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), name)
    sizes = sorted(parts.groupBy(F.shiftright("__at", 33).alias("part")).count().collect())  # a row for each task that wrote
    if sum(n for _, n in sizes) >= 2**31:
        raise ValueError("more than 2^31 phrases of one length")
    spark = units.sparkSession
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    starts = spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "part long, before long")
    numbered = parts.join(F.broadcast(starts), F.shiftright("__at", 33) == F.col("part"))
    numbered = written(numbered.withColumn("id", F.col("before") + F.col("__at").bitwiseAND(F.lit(2**33 - 1))).drop("__at", "part", "before"), name)
    spent(parts)
    return numbered


#: Bits of the filter that says which pairs may be frequent: 2 MB, whatever the corpus.
_BITS = 1 << 24


def _slots(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) & np.uint64(_BITS - 1)).astype(np.int64)


def collocations(docs: DataFrame, *, longest: int = 3, least: int = 10, top: int = 2000, covered: tuple[int, int] = (1, 2),
                 text: str = "text", lang: str = "lang", side: int = 2048, chunk: int = 1 << 21) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and at spaces and tabs into words. ``n`` is the number
    of words of the language, ``a`` that of the phrase's occurrences (at least ``least``), overlaps included. Of all cuts into
    two parts with ``l`` and ``r`` occurrences that with the lowest floor(1000000 * a * a / (l * r)) counts, the first if several
    have it. Phrases within one more word's phrase of at least ``covered`` (a fraction) of their occurrences are left out.
    Order: score, a, both descending, then the phrase's bytes.

    A null language is ``und``, together with rows that say so. Null, empty and blank texts hold no words; a language without
    words or frequent phrases has no rows. Repeated rows count each time. Very long texts are whole in one chunk. An
    empty table gives none. Other columns are ignored, whatever their names.
    """
    num, den = covered
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    schema = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("codes", pa.binary())])

    def encode(iterator):
        for row in chunk_words(iterator, chunk):
            yield pa.RecordBatch.from_pylist([row], schema)

    encoded = written(rows.mapInArrow(encode, "chunk long, lang string, words array<string>, counts array<long>, codes binary"), "chunks")
    own = encoded.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")).select("chunk", "lang", "at", F.col("w.words").alias("phrase"), F.col("w.counts").alias("count"))
    words = own.groupBy("lang", "phrase").agg(F.sum("count").alias("a"))
    total = encoded.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    units = _ranked(words.where(F.col("a") >= least).withColumns({"heads": F.array("a"), "tails": F.array("a")}), "phrases-1")

    def numbered(key, left, right):
        """A chunk's sequence in the ids of the corpus; -1 for a break and for what is rare."""
        if not left.num_rows:
            return pa.table({"chunk": pa.array([], pa.int64()), "ids": pa.array([], pa.binary())})
        codes = np.frombuffer(left["codes"][0].as_py(), np.int32)
        ids = np.full(int(codes.max(initial=-1)) + 2, -1, np.int32)
        ids[right["at"].to_numpy()] = right["id"].to_numpy()
        return pa.table({"chunk": left["chunk"], "ids": pa.array([ids[codes].tobytes()], pa.binary())})

    def paired(key, left, right):
        """The sequence of phrases of one more word: each pair of neighbours by its id."""
        if not left.num_rows:
            return pa.table({"chunk": pa.array([], pa.int64()), "ids": pa.array([], pa.binary())})
        ids = np.frombuffer(left["ids"][0].as_py(), np.int32)
        key = (right["x"].to_numpy().astype(np.int64) << 32) | right["y"].to_numpy()
        order = np.argsort(key)
        key, value = np.append(key[order], -1), np.append(right["id"].to_numpy()[order], -1)
        out = np.full(len(ids), -1, np.int32)
        at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        pair = (ids[at].astype(np.int64) << 32) | ids[at + 1]
        place = np.searchsorted(key[:-1], pair)
        out[at] = np.where(key[place] == pair, value[place], -1)
        return pa.table({"chunk": left["chunk"], "ids": pa.array([out.tobytes()], pa.binary())})

    def count(iterator):
        parts, held = [], 0
        for batch in iterator:
            for blob in batch.column(0):
                parts.append(tiled_counts(*_neighbours(np.frombuffer(blob.as_buffer(), np.int32)), side))
                held += len(parts[-1][0])
                if held > 1 << 22:
                    parts = [_merged(parts)]
                    held = len(parts[0][0])
                    if held > 1 << 21:
                        yield cells(parts.pop())
                        held = 0
        if parts:
            yield cells(_merged(parts))

    def cells(counted):
        keys, n = counted
        return pa.RecordBatch.from_arrays([pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], names=["x", "y", "n"])

    def pairs_of(kept):
        def run(iterator):
            bits = np.unpackbits(np.frombuffer(kept.value, np.uint8), bitorder="little")
            for batch in iterator:
                for number, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                    x, y = _neighbours(np.frombuffer(blob.as_buffer(), np.int32))
                    keys = np.unique((x << 32) | y)
                    keys = keys[bits[_slots(keys)] > 0]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), number)), pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32))], names=["chunk", "x", "y"])

        return run

    def bits_of(iterator):
        for batch in iterator:
            slot = np.unique(_slots((batch.column(0).to_numpy().astype(np.int64) << 32) | batch.column(1).to_numpy()))
            at, first = np.unique(slot >> 5, return_index=True)
            word = np.bitwise_or.reduceat(np.int64(1) << (slot & 31), first) if len(slot) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(word)], names=["at", "word"])

    sequences = found = None
    for size in range(2, longest + 1):
        before = sequences
        if size == 2:
            ids = own.join(units.select("lang", "phrase", "id"), ["lang", "phrase"]).select("chunk", "at", "id")
            sequences = encoded.select("chunk", "codes").groupBy("chunk").cogroup(ids.withColumnRenamed("chunk", "of").groupBy("of")).applyInArrow(numbered, "chunk long, ids binary")
        else:
            frequent = units.select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "id")
            words_ = frequent.select("x", "y").mapInArrow(bits_of, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()  # at most 2^19 rows
            bits = np.zeros(_BITS // 32, np.uint32)
            bits[words_["at"].to_numpy()] = words_["word"].to_numpy().astype(np.uint32)
            kept = docs.sparkSession.sparkContext.broadcast(bits.tobytes())
            ids = sequences.mapInArrow(pairs_of(kept), "chunk long, x int, y int").join(frequent, ["x", "y"]).select("chunk", "x", "y", "id")
            sequences = sequences.groupBy("chunk").cogroup(ids.withColumnRenamed("chunk", "of").groupBy("of")).applyInArrow(paired, "chunk long, ids binary")
        sequences = written(sequences, f"sequences-{size - 1}")
        if before is not None:
            spent(before)
        counted = sequences.select("ids").mapInArrow(count, "x int, y int, n long").groupBy("x", "y").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
        x = units.select(F.col("id").alias("x"), "lang", F.col("phrase").alias("first"), F.col("heads").alias("x_heads"))
        y = units.select(F.col("id").alias("y"), F.substring_index("phrase", " ", -1).alias("last"), F.col("tails").alias("y_tails"))
        longer = counted.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "a").join(x, "x").join(y, "y")
        longer = longer.select("lang", F.concat_ws(" ", "first", "last").alias("phrase"), "a", "x", "y", F.concat("x_heads", F.array("a")).alias("heads"), F.concat("y_tails", F.array("a")).alias("tails"))
        longer = _ranked(longer, f"phrases-{size}") if size < longest else written(longer, f"phrases-{size}")
        inside = longer.select(F.explode(F.array("x", "y")).alias("id"), F.col("a").alias("around")).groupBy("id").agg(F.max("around").alias("around"))
        if size > 2:
            part = units.join(inside, "id", "left").where(F.coalesce(F.col("around") * den < F.col("a") * num, F.lit(True))).select("lang", "phrase", "a", "heads", "tails")
            found = part if found is None else found.union(part)
        units = longer
    part = units.select("lang", "phrase", "a", "heads", "tails")
    found = part if found is None else found.union(part)

    # Whole numbers of 38 digits: exact up to 10^15 occurrences.
    cut = "struct((1000000BD * (whole.a * whole.a)) div (whole.heads[k - 1] * whole.tails[size(whole.tails) - k - 1]) AS score, k, heads[k - 1] AS l, tails[size(tails) - k - 1] AS r)"
    digits = F.struct(F.col("a").cast("decimal(15,0)").alias("a"), *(F.col(c).cast("array<decimal(15,0)>").alias(c) for c in ("heads", "tails")))
    scored = found.withColumn("whole", digits).withColumn("cut", F.expr(f"array_min(transform(sequence(1, size(heads) - 1), k -> {cut}))"))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = scored.withColumn("rank", place).where(F.col("rank") <= top)
    return first.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op11_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of two or three words in each language of all documents."""
    return collocations(documents(spark, sf_dir))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p
  FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(u.piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(p) AS piece FROM d) u),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, g, count(*) AS f FROM (
    SELECT lang, unnest(list_transform(generate_series(1, len(w)), lambda i: w[i:i])) AS g FROM w
    UNION ALL SELECT lang, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i:i + 1])) FROM w WHERE len(w) > 1
    UNION ALL SELECT lang, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i:i + 2])) FROM w WHERE len(w) > 2) x
  GROUP BY lang, g HAVING count(*) >= 10),
c AS (
  SELECT c.lang, c.g, c.f AS a, k, l.f AS l, r.f AS r, (1000000::HUGEINT * c.f * c.f) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT lang, g, f, unnest(generate_series(1, len(g) - 1)) AS k FROM f WHERE len(g) > 1) c
  JOIN f l ON l.lang = c.lang AND l.g = c.g[1:k] JOIN f r ON r.lang = c.lang AND r.g = c.g[k + 1:len(c.g)]),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
o AS (
  SELECT lang, g, max(around) AS around FROM (
    SELECT lang, g[1:2] AS g, f AS around FROM f WHERE len(g) = 3 UNION ALL SELECT lang, g[2:3], f FROM f WHERE len(g) = 3) y
  GROUP BY lang, g),
k AS (
  SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN o ON o.lang = b.lang AND o.g = b.g
  WHERE o.around IS NULL OR 100 * o.around < 50 * a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n.n, score::BIGINT AS score
FROM k JOIN n ON n.lang = k.lang QUALIFY rank <= 2000
"""
