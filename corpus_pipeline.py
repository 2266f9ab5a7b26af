"""From raw documents to packed sequences: quality, near-duplicates, repeated passages, packing.

In every stage texts are taken whole, however long; a table without rows gives one without rows; columns of docs may have any names,
and more columns than those of documents go through up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm import jaccard, packing, quality, simhash, suffix_dedup
from strataline.llm.common import saved, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps, with their columns.

    Null, empty and blank texts go. Rows without doc_id, repeated rows and rows under one doc_id are judged each, so ties need no
    order; a null source or lang is a site of its own. Without labels of both classes all other documents stay.
    """
    name = quality.verdict_column(docs)
    return quality.judge(docs, table(spark, sf_dir, "labels")).where(F.col(f"{name}.keep")).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least doc_id; rows under one doc_id stay or go together.

    Near: the sets of runs of five words have a Jaccard similarity of at least 0.8, verified for each pair.
    Rows without doc_id go if their group has a document with one, else stay. Null, empty and blank texts are one group. Which of
    several equal texts stays is settled by doc_id alone, so ties need no order.
    """
    found = saved(simhash.near_duplicates(docs, shingle=5, similarity=0.8), "near")
    gone = found.where("doc_id is not null and doc_id != component_id").select("doc_id").distinct()
    # an id may stand on several rows with different texts: it stays if it is the least of any of its groups
    gone = saved(gone.join(found.where("doc_id = component_id").select("doc_id").distinct(), "doc_id", "left_anti"), "gone")
    kept = docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti").where("doc_id is not null")
    # rows without doc_id are told apart by their sets
    name = "key" + "_" * len("".join(docs.columns))
    alone = found.where("component_id is null").select(F.col("key").alias("alone")).distinct()
    nameless = jaccard.with_key(docs.where("doc_id is null"), name)
    return kept.union(nameless.join(alone, nameless[name] == alone["alone"], "left_semi").select(*docs.columns))


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier ones have.

    A row that loses everything goes; null, empty and short texts stay as they are. Rows without doc_id are behind all others and take
    nothing from them; rows under one doc_id, repeated ones too, take nothing from each other.
    """
    return suffix_dedup.without_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens, with their ids (little-endian, 32 bits each).

    Each row is a document, also a repeated one or one without doc_id; a null or empty text has the end id alone; a null source is
    a queue of its own.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=True)


STAGES = [("quality classifier", quality_stage), ("simhash near-dedup", near_dedup_stage), ("suffix-array dedup", suffix_stage), ("packing", packing_stage)]
#: The classifier is fitted, and suffix arrays and encoders aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), "stage")
    return docs
