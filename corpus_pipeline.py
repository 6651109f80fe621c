"""A training corpus from ``documents``: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from framewright.llm import decontamination, language_id, near_duplicates, packing, repeated_spans
from framewright.llm.common import documents, spent, written
from framewright.llm.tokenizing import vocabulary_path
from pyspark.sql import DataFrame, SparkSession


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without an identifiable language (no letter, or a calibrated probability below one half).

    Null and empty texts go, repeated rows are judged alike, an empty table stays one; rows with a null id or lang are judged but teach nothing.
    """
    return language_id.identified(docs, language_id.train(language_id.learnable(docs)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts linked by a similarity of 0.8 or more of five-word shingles.

    That is the one of smallest id, null last; of repeated rows one stays. Texts without words are groups of their own. An empty table stays one.
    """
    return near_duplicates.one_of_each(docs)


def remove_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes 50-word passages that a document with a smaller doc_id also has; fully repeated documents go.

    Null texts and rows without an id stay as they are, rows of one id don't repeat each other; an empty table stays one.
    """
    return repeated_spans.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which an item of ``benchmark`` is found.

    Null and empty texts hold none and stay, each row is judged by its own text; either table may be empty.
    """
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 4,096 tokens: a row per piece.

    A null or empty text is its end id alone; repeated rows and null ids are packed as rows of their own; an empty table gives no rows.
    """
    return packing.pack_documents(docs, vocabulary_path("word_bpe_49k.json"))


STAGES = [
    ("language", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("repeated spans", remove_repeated_spans),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL can't train the language model or run the tokenizer; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all of ``documents``."""
    docs = before = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, before, sf_dir), f"stage-{name.replace(' ', '-')}")
        if k:
            spent(before)
        before = docs
    return docs
