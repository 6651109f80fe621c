"""Benchmark decontamination by spaced-seed hashing; DataFrame functions only.

A seed is a fixed mask over neighbouring words: the words under its ones are hashed, the others may be
anything. Seeds of the test items and of the training texts are joined on their hashes; each hit fixes how the
two texts line up, and the words on that diagonal are compared. A text is contaminated where ``overlap`` words in
a row agree with an item but for the allowed substitutions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, sheltered

#: For windows of so many words with so many substitutions at most: (shortest, longest, substitutions, masks). Wherever the
#: substitutions are, some mask fits somewhere in the window without one (the tests enumerate them all).
COVERS = (
    (20, 20, 4, ("1101111", "11101000011", "111010011")),
    (15, 19, 3, ("1101111", "11101000011", "111010011")),
    (10, 14, 2, ("110111", "11100011", "1101011")),
    (8, 9, 1, ("110111", "1101101")),
)


def cover(length: int, substitutions: int) -> tuple:
    """Masks of which one fits into every window of ``length`` words with at most ``substitutions`` substitutions.

    Beyond the table it is the run of words that so many substitutions must leave whole somewhere.
    """
    for shortest, longest, most, masks in COVERS:
        if shortest <= length <= longest and substitutions <= most:
            return masks
    return ("1" * max(1, -(-(length - substitutions) // (substitutions + 1))),)


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits, each as a 64-bit hash."""
    return F.transform(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""), lambda w: F.xxhash64(w))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for the row."""
    return F.transform(F.array(value), body)[0]


def seeds(rows: DataFrame, masks: list, keep: list) -> DataFrame:
    """(keep columns, at, mask, seed) of every place of column ``w`` where a mask fits."""
    span = max(len(m) for m in masks)
    shifted = [F.slice("w", k + 1, F.greatest(F.size("w") - k, F.lit(0))) for k in range(span)]
    placed = rows.where(F.size("w") >= min(len(m) for m in masks)).select(*keep, F.posexplode(F.arrays_zip(*[c.alias(f"w{k}") for k, c in enumerate(shifted)])).alias("at", "x"))
    hashed = []
    for mask in masks:
        seed = F.xxhash64(F.lit(mask), *[F.col("x").getField(f"w{k}") for k, one in enumerate(mask) if one == "1"])
        # Beyond the text's end the zipped words are null; asking its size here would split the text anew for each word.
        hashed.append(F.when(F.col("x").getField(f"w{len(mask) - 1}").isNotNull(), F.struct(F.lit(mask).alias("mask"), seed.alias("seed"))))
    found = placed.select(*keep, "at", F.explode(F.array(*hashed)).alias("s")).where("s IS NOT NULL")
    return found.select(*keep, "at", "s.mask", "s.seed")


def contaminated(
    docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    overlap: int = 20, percent: int = 80, whole: int = 8, broadcast_seeds: int = 1_000_000, lot: int = 1024,
) -> DataFrame:
    """A row per row of ``docs``: doc_id, contaminated, items (sorted ids of the items found in it), tag.

    An item is found where, lined up anyhow, ``overlap`` words in a row (or all words of a shorter item) agree in at least ``percent``
    per cent of the places; the masks for its length leave no such place out. Of an item of fewer than ``whole`` words all have to agree.
    An item without words is never found. Null and empty texts hold nothing, null item ids are left out. Repeated rows and rows
    that share a doc_id are each judged by their own text. Other columns are ignored; either table may be empty.
    The items' seeds are broadcast if there are at most ``broadcast_seeds``, else the join shuffles. A text meets its hits in lots of
    at most ``lot``, so one that repeats what many items share makes more rows, not a larger one.
    """
    tests = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), words_of(F.col(item_text)).alias("w")).where(F.size("w") > 0)
    tests = tests.distinct()
    tagged = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("tag", F.xxhash64("text"))
    rows = tagged.select("doc_id", "tag", words_of(F.col("text")).alias("w"))
    lengths = [r[0] for r in tests.select(F.least(F.size("w"), F.lit(overlap))).distinct().collect() if r[0]]
    by_masks: dict = {}
    for n in sorted(lengths):
        by_masks.setdefault(cover(n, n * (100 - percent) // 100 if n >= whole else 0), []).append(n)
    used = sorted({m for masks in by_masks for m in masks}) or ["1"]
    need = F.least(F.size("w"), F.lit(overlap))
    tests = tests.withColumn("n", F.size("w"))
    want = seeds(tests, used, ["item_id", "n"]).limit(0) if not by_masks else None
    for masks, sizes in by_masks.items():
        made = seeds(tests.where(need.isin(sizes)), list(masks), ["item_id", "n"])
        want = made if want is None else want.union(made)
    have = seeds(rows, used, ["doc_id", "tag"])
    want = want.withColumnRenamed("at", "item_at")
    total = want.count()
    want = F.broadcast(want) if total <= broadcast_seeds else want
    hits = have.join(want, ["mask", "seed"]).select("doc_id", "tag", "item_id", "n", (F.col("at") - F.col("item_at")).alias("shift")).distinct()

    # Hits of a text meet it as numbers, lot by lot; then each is a row of its own: the words beside the item on its diagonal.
    place = F.row_number().over(W.partitionBy("doc_id", "tag").orderBy("item_id", "n", "shift"))
    hits = hits.withColumn("lot", F.floor((place - 1) / lot)).groupBy(F.col("doc_id").alias("hit_doc"), F.col("tag").alias("hit_tag"), "lot").agg(F.collect_list(F.struct("item_id", "n", "shift")).alias("hits"))
    same_row = F.col("doc_id").eqNullSafe(F.col("hit_doc")) & F.col("tag").eqNullSafe(F.col("hit_tag"))
    beside = lambda w: F.transform("hits", lambda h: F.struct(h["item_id"].alias("item_id"), F.greatest(F.lit(0), -h["shift"]).alias("first"), F.slice(w, F.greatest(F.lit(0), h["shift"]) + 1, F.least(h["n"], h["n"] + h["shift"])).alias("x")))
    lined = tagged.join(hits, same_row).select("hit_doc", "hit_tag", F.explode(_let(words_of(F.col("text")), beside)).alias("h")).select("hit_doc", "hit_tag", "h.*")
    tests = tests.select("item_id", F.col("w").alias("t"))
    tests = F.broadcast(tests) if total <= broadcast_seeds else tests
    same = F.zip_with(F.slice("t", F.col("first") + 1, F.size("x")), "x", lambda a, b: F.when(a == b, 1).otherwise(0))
    length = F.least(F.lit(overlap), F.size("t"))
    share = F.when(F.size("t") < whole, 100).otherwise(percent)

    def found(same: Column) -> Column:
        """Whether a stretch of enough words agrees on the diagonal."""
        starts = F.when(F.size(same) >= length, F.sequence(F.lit(0), F.size(same) - length)).otherwise(F.array().cast("array<int>"))
        return F.exists(starts, lambda i: F.aggregate(F.slice(same, i + 1, length), F.lit(0), lambda s, x: s + x) * 100 >= length * share)

    judged = lined.join(tests, "item_id").where(_let(same, found)).select("hit_doc", "hit_tag", "item_id")
    judged = judged.groupBy("hit_doc", "hit_tag").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = tagged.select("doc_id", "tag").join(judged, same_row, "left").select("doc_id", "tag", F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))
    return out.select("doc_id", (F.size("items") > 0).alias("contaminated"), "items", "tag")


@sheltered
def without_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no item is found; all columns stay."""
    bad = contaminated(docs, items, **options).where("contaminated").select(F.col("doc_id").alias("__doc"), F.col("tag").alias("__tag")).distinct()
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64(F.col("text")) == F.col("__tag")), "left_anti")


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items: doc_id, contaminated, items (as text, joined by commas)."""
    found = contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "contaminated", F.concat_ws(",", F.transform("items", lambda i: i.cast("string"))).alias("items"))


#: Every alignment in which items and documents share words, without seeds or masks.
OP8_SQL = r"""
WITH t AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
a AS (
  SELECT kind, id, coalesce(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''), []) AS w FROM t),
p AS (SELECT kind, id, least(20, len(w)) AS need, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i, CASE WHEN len(w) < 8 THEN 100 ELSE 80 END AS share FROM a),
h AS (
  SELECT d.id AS doc, b.id AS item, d.i - b.i AS shift FROM p d JOIN p b ON d.word = b.word WHERE d.kind = 'd' AND b.kind = 'b'
  GROUP BY ALL HAVING 100 * count(*) >= any_value(b.share * b.need)),
g AS (
  SELECT h.doc, h.item, h.shift, d.w AS dw, b.w AS bw, greatest(0, -h.shift) AS f, least(20, len(b.w)) AS need, CASE WHEN len(b.w) < 8 THEN 100 ELSE 80 END AS share,
    least(len(b.w) - greatest(0, -h.shift), len(d.w) - greatest(0, -h.shift) - h.shift) AS n
  FROM h JOIN a d ON d.kind = 'd' AND d.id = h.doc JOIN a b ON b.kind = 'b' AND b.id = h.item),
e AS (
  SELECT doc, item, need, share, list_transform(generate_series(1, n), lambda k: CASE WHEN bw[f + k] = dw[f + shift + k] THEN 1 ELSE 0 END) AS same FROM g WHERE n >= need),
o AS (
  SELECT DISTINCT doc, item FROM (SELECT doc, item, need, share, same, unnest(generate_series(1, len(same) - need + 1)) AS i FROM e)
  WHERE 100 * list_sum(same[i : i + need - 1]) >= share * need)
SELECT a.id AS doc_id, count(o.item) > 0 AS contaminated, coalesce(string_agg(o.item::VARCHAR, ',' ORDER BY o.item), '') AS items
FROM a LEFT JOIN o ON o.doc = a.id WHERE a.kind = 'd' GROUP BY ALL
"""
