"""Queries of files read and written by ranges (tensor files, containers), and their SQL.

The files hold the given tables: each query writes all of a table and reads it again.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import quantise
from ..operators import containers
from ..sources import container_files, files, tensors
from .oracles import HEADER_JSON, TOKENS
from .queries import container_table, table
from .store import numbered, scratch, written

#: A weight file of one layer; its places' table holds all vectors, the other tensors are filled with them from some vector on.
LAYER = {"dim": 64, "layers": 1, "heads": 4, "codebooks": 1, "cardinality": 64, "past_context": 3}


def kept(df):
    return written(df, "parts")


def sound(done):
    """The files' rows (name, bytes, digest, error), if none has an error."""
    bad = done.where("error IS NOT NULL").head(1)
    if bad:
        raise ValueError(f"{bad[0].name}: {bad[0].error}")
    return done


def tensor_archive(spark, sf):
    """Embeddings as an archive, a tensor of each label's vectors and one of their ids; read again as rows."""
    e = table(spark, sf, "embeddings").withColumn("row", (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).cast("long"))
    number = F.col("label").cast("string")
    vector = e.select(F.concat(F.lit("vectors."), number).alias("name"), (2 * F.col("label")).alias("place"), F.lit("F32").alias("dtype"), F.array(F.size("embedding").cast("long")).alias("row_shape"), "row", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    ids = e.select(F.concat(F.lit("ids."), number), 2 * F.col("label") + 1, F.lit("I64"), F.lit(None).cast("array<long>"), "row", F.array(F.col("vec_id").cast("double")))
    rows = tensors.pack(vector.union(ids)).withColumn("archive", F.lit("embeddings.bin"))
    folder = scratch(spark, "archive")
    sound(tensors.archives(rows, folder, kept, {"format": "rows"}))
    read = tensors.values(tensors.read(spark, f"{folder}/embeddings.bin"))
    return read.select("name", "row", F.posexplode("v").alias("k", "v")).select("name", (F.col("row") + F.when(F.col("name").startswith("ids."), F.col("k")).otherwise(0)).alias("row"), F.when(F.col("name").startswith("ids."), 0).otherwise(F.col("k")).cast("long").alias("bin"), "v")


def weight_rows(spark, sf):
    """(dims, (name, row, v) of every tensor): block b of tensor j holds vector (17 j + b) modulo their number, by rank."""
    ranked = numbered(table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("float")).alias("v")), "vec_id").drop("vec_id")
    n = ranked.count()
    dims = {**LAYER, "frame_length": n}
    dims = {k: dims[k] for k in tensors.DIMENSIONS}
    shapes = [(j, name, shape[0] if len(shape) > 1 else 1, (shape[1] if len(shape) > 1 else shape[0]) // 64, quantised) for j, (name, shape, quantised) in enumerate(tensors.weight_shapes(dims))]
    layout = spark.createDataFrame(shapes, "j long, name string, rows long, wide long, quantised boolean")
    blocks = layout.select("name", "wide", "quantised", F.col("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") * F.col("wide") - 1)).alias("b"))
    placed = blocks.withColumn("rank", (17 * F.col("j") + F.col("b")) % n).join(ranked, "rank")
    held = placed.groupBy("name", "quantised", F.expr("b div wide").alias("row")).agg(F.array_sort(F.collect_list(F.struct("b", "v"))).alias("x"))
    return dims, held.select("name", "quantised", "row", F.flatten(F.transform("x", lambda y: y["v"])).alias("v"))


def plain_weights(spark, sf):
    dims, rows = weight_rows(spark, sf)
    folder = scratch(spark, "weights")
    sound(tensors.weights(tensors.pack(rows.withColumn("dtype", F.lit("F32"))), dims, folder, "weights.bin", kept))
    return dims, f"{folder}/weights.bin"


def weight_file_scan(spark, sf):
    """A weight file's rows: of the layer's linear weights, by a prefix, and the table of places, by its name."""
    _, path = plain_weights(spark, sf)
    some = tensors.read(spark, path, prefix="layers.0.linear").union(tensors.read(spark, path, names=["pos_emb"]))
    return tensors.values(some).select("name", "row", F.posexplode("v").alias("bin", "v")).select("name", "row", F.col("bin").cast("long").alias("bin"), "v")


def weight_file_quantise(spark, sf):
    """The file's rows as int8 with a scale each, written as a quantised file and read from it."""
    dims, path = plain_weights(spark, sf)
    quantised = [n for n, _, q in tensors.weight_shapes(dims) if q]
    v = tensors.values(tensors.read(spark, path)).select("name", "row", "v")
    small = F.col("name").isin(quantised)
    single = F.transform("v", lambda x: x.cast("float"))
    q = quantise.symmetric_row(single, 127, True)
    rows = v.select("name", "row", F.when(small, F.transform(q, lambda x: x.cast("double"))).otherwise(F.col("v")).alias("v"), F.when(small, "I8").otherwise("F32").alias("dtype"), F.when(small, quantise.symmetric_scale(single, 127).cast("float")).alias("scale"))
    folder = scratch(spark, "weights")
    sound(tensors.weights(tensors.pack(rows), dims, folder, "weights.bin", kept, quantised=True))
    read = tensors.values(tensors.read(spark, folder, prefix="l"))
    out = read.where("scale IS NOT NULL").select("name", "row", "scale", F.posexplode("v").alias("bin", "q"))
    return out.select("name", "row", F.round(F.col("scale").cast("double"), 9).alias("scale"), F.col("bin").cast("long").alias("bin"), F.col("q").cast("long").alias("q"))


def container_folder(spark, sf):
    folder = scratch(spark, "container-files")
    content = container_table(spark, sf).select(F.concat(F.col("track").cast("string"), F.lit(".chunks")).alias("name"), "content")
    files.write(content, folder).write.format("noop").mode("overwrite").save()
    return container_files.files(spark, folder, "*.chunks")


def track():
    return F.regexp_extract("path", r"([0-9]+)\.chunks$", 1).cast("long").alias("track")


def container_file_chunks(spark, sf):
    """Containers as files: their chunks by range."""
    found = container_files.chunks(container_folder(spark, sf))
    return found.select(track(), "chunk", "place", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("digest"), "error")


def container_file_heads(spark, sf):
    """The files' headers and first chunks' sizes from their first bytes, and how many were read."""
    found = container_files.heads(container_folder(spark, sf))
    meta = containers.parse_metadata(F.col("json"))
    return found.select(track(), meta["al"].alias("length"), "header_bytes", "first_bytes", "bytes_read", "error")


QUERIES = {f.__name__: f for f in (tensor_archive, weight_file_scan, weight_file_quantise, container_file_chunks, container_file_heads)}

#: Blocks of 64 values: tensor j has rows x wide of them.
WEIGHTS = """e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS rank, embedding AS v, count(*) OVER () AS n FROM embeddings),
shapes AS (SELECT * FROM (VALUES (2, 'pos_emb', (SELECT count(*) FROM embeddings), 1), (3, 'layers.0.in_proj.weight', 192, 1), (5, 'layers.0.out_proj.weight', 64, 1),
  (7, 'layers.0.linear1.weight', 256, 1), (8, 'layers.0.linear1.bias', 1, 4), (9, 'layers.0.linear2.weight', 64, 4), (10, 'layers.0.linear2.bias', 1, 1), (16, 'linears.0.weight', 64, 1)) t(j, name, rows, wide)),
blocks AS (SELECT j, name, wide, unnest(generate_series(0, rows * wide - 1)) AS b FROM shapes),
cells AS (SELECT name, b // wide AS row, (b % wide) * 64 + k AS bin, v[k + 1] AS v FROM (SELECT name, wide, b, e.v, unnest(generate_series(0, 63)) AS k FROM blocks JOIN e ON e.rank = (17 * j + b) % e.n) x)"""

SQL = {
    "tensor_archive": """WITH e AS (SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS row FROM embeddings)
SELECT 'vectors.' || label AS name, row, unnest(generate_series(0, len(embedding) - 1)) AS bin, unnest(embedding)::DOUBLE AS v FROM e UNION ALL SELECT 'ids.' || label, row, 0, vec_id::DOUBLE FROM e""",
    "weight_file_scan": f"WITH {WEIGHTS} SELECT name, row::BIGINT AS row, bin, v::DOUBLE AS v FROM cells WHERE name LIKE 'layers.0.linear%' OR name = 'pos_emb'",
    "weight_file_quantise": f"""WITH {WEIGHTS}, s AS (SELECT name, row, max(abs(v::DOUBLE)) / 127 AS scale FROM cells WHERE name LIKE '%.weight' GROUP BY 1, 2)
SELECT c.name, c.row::BIGINT AS row, round(scale::FLOAT::DOUBLE, 9) AS scale, bin, greatest(-127, least(127, round_even(v::DOUBLE / scale, 0)))::BIGINT AS q FROM cells c JOIN s ON s.name = c.name AND s.row = c.row""",
    "container_file_chunks": f"""WITH {TOKENS}, b AS (SELECT track, t, coalesce(text, '') AS text FROM tokens), h AS (SELECT track, 9 + length({HEADER_JSON}) AS begin FROM (SELECT DISTINCT track FROM b))
SELECT b.track, t AS chunk, (begin + coalesce(sum(octet_length(encode(text)) + 8) OVER (PARTITION BY b.track ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS place, octet_length(encode(text))::BIGINT AS bytes, sha256(text) AS digest, NULL::VARCHAR AS error FROM b JOIN h ON h.track = b.track""",
    "container_file_heads": f"""WITH {TOKENS} SELECT track, track * 100 AS length, 9 + length({HEADER_JSON}) AS header_bytes, octet_length(encode(coalesce(text, '')))::BIGINT + 8 AS first_bytes, 17 + length({HEADER_JSON}) AS bytes_read, NULL::VARCHAR AS error FROM tokens WHERE t = 0""",
}
