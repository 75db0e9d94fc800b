"""A corpus from raw documents to packed training windows, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet
and read again as the next stage's docs.  All but the last keep the columns of documents,
and columns beyond those, whatever their names.

In every stage an empty table stays empty, null ids are kept as they are, rows equal in id
and text are treated alike, and texts are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import op3_quality_rules, op4_packing, op5_line_dedup, op6_mixing, op8_simhash
from lumenframe.llm.common import fresh_name, read_table, shared_folder, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base or meet a learned rule go.

    Null and empty texts have no words, so they go.  Labels that are null, unknown or contradict one
    another teach nothing; without labels no rule is learned and the base alone decides.
    """
    rules = op3_quality_rules.fit(docs, read_table(spark, sf_dir, "labels"))
    name = fresh_name(docs, "stats")
    return op3_quality_rules.judge(docs, rules).filter(f"`{name}`.kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 20 characters in three documents or more stay in one, that with the largest id.

    A null id is below all others; null and empty texts have no such line and stay.
    """
    return op5_line_dedup.dedup_lines(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word shingles at least 0.8 similar stays, that with the smallest id.

    Texts without a word are one group, null ids come last; of equal texts with equal ids all rows stay or go.
    """
    return op8_simhash.near_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A null source is a source of its own; null and empty texts have no words and are not drawn beyond
    the whole copies that all documents of their source get.
    """
    return op6_mixing.mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of at most 2048 ids; a null or empty text is the end id alone, a null id stays null."""
    return op4_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Learned rules, fingerprints and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return docs
