"""Residual vector quantisation over arrays: nearest code, residual, and the sum back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _checked(codebook: DataFrame, limit: int) -> DataFrame:
    if codebook.limit(limit + 1).count() > limit:
        raise ValueError(f"a codebook has at most {limit} codes")
    return codebook


def codebook_row(codebook: DataFrame, limit: int = 4_096) -> DataFrame:
    """A codebook (code, vector) as one row; its size is part of the model and checked against ``limit``."""
    return _checked(codebook, limit).agg(F.array_sort(F.collect_list(F.struct("code", F.transform("vector", lambda x: x.cast("double")).alias("vector")))).alias("book"))


def encode(vectors: DataFrame, books: list) -> DataFrame:
    """(id, codes, residual): per stage the nearest code (the lowest on ties), then what is left for the next stage.

    ``books``: one-row codebooks by :func:`codebook_row`, each joined to every row as a broadcast value.
    """
    out = vectors.select("id", F.transform("vector", lambda x: x.cast("double")).alias("residual"), F.array().cast("array<int>").alias("codes"))
    for book in books:
        out = out.join(F.broadcast(book))
        nearest = F.array_min(F.transform("book", lambda c: F.struct(_distance(F.col("residual"), c["vector"]).alias("d"), c["code"].alias("code"), c["vector"].alias("vector"))))
        out = out.withColumn("hit", nearest)
        out = out.select("id", F.concat("codes", F.array(F.col("hit.code").cast("int"))).alias("codes"), F.zip_with("residual", F.col("hit.vector"), lambda x, y: x - y).alias("residual"))
    return out


def decode(coded: DataFrame, codebooks: list, limit: int = 4_096) -> DataFrame:
    """(id, vector) from (id, codes): the sum of the codes' vectors; an unknown code gives null. Codebooks are broadcast after the same check."""
    out = coded.select("id", "codes")
    total = None
    for k, book in enumerate(codebooks):
        out = out.join(F.broadcast(_checked(book, limit).select(F.col("code").alias(f"c{k}"), F.transform("vector", lambda x: x.cast("double")).alias(f"v{k}"))), F.element_at("codes", k + 1) == F.col(f"c{k}"), "left")
        total = F.col(f"v{k}") if total is None else F.zip_with(total, F.col(f"v{k}"), lambda x, y: x + y)
    return out.select("id", total.alias("vector"))
