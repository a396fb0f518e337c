"""From raw documents to packed sequences, in stages that each keep or rearrange what the one before returned.

All stages take empty tables and texts of any length, and all but the last keep every column, whatever its name: inside them a row travels as
one column. Rows without a doc_id are rows like others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tremorlake.llm import dedup, jaccard, mixing, packing, quality
from tremorlake.llm.common import prepare, read
from tremorlake.llm.queries import SEQUENCE
from tremorlake.session import shared_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the given documents and ``labels``, doesn't reject.

    A null text is scored as an empty one; repeated rows are all kept or all rejected; without labels of both kinds all stay.
    """
    prepare(spark)
    return quality.good_documents(docs, read(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, compared without white space: the longest, then the smallest doc_id, null before all others.

    Null, empty and blank texts are copies of each other. Of repeated rows one stays.
    """
    prepare(spark)
    return dedup.distinct_documents(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near duplicates: the smallest doc_id, null only if there is no other.

    Documents without words are no copies of each other and all stay. Of repeated rows one stays.
    """
    prepare(spark)
    return jaccard.first_of_each_class(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the weights of their sources, some of them repeated.

    A null source is a source of its own, the last. Documents without words stay once.
    """
    prepare(spark)
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences; repeated documents have rows for each time.

    Null and empty texts are a piece of the end id alone. A doc_id must be a whole number or null.
    """
    prepare(spark)
    pieces = packing.token_pieces(docs, SEQUENCE, public_tokenizers.path("byte_bpe_50k.json"), 0)
    return packing.pack(pieces, SEQUENCE, docs.count())


STAGES = [
    ("quality", good_quality), ("exact dedup", without_copies), ("near duplicates", without_near_copies), ("source mix", mixed), ("packing", packed)]
#: The quality classifier, the similarity join and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
