"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path, ship_package
from . import crossent, dedup, extraction, jaccard, merkle, mixing, packing, partitions, quality, sentencepiece_bpe, spelling, token_files, urls
from .common import read

Query = Callable[[SparkSession, str], DataFrame]

SEQUENCE = 2048
#: The rules (verdict, host, path) of the contract.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

_queries: dict[str, Query] = {}


def query(run: Query) -> Query:
    def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return run(spark, sf_dir)

    prepared.__name__ = run.__name__
    prepared.__doc__ = run.__doc__
    _queries[run.__name__] = prepared
    return prepared


def all_queries() -> dict[str, Query]:
    return dict(_queries)


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    pieces = packing.token_pieces(docs, SEQUENCE, public_tokenizers.path("byte_bpe_50k.json"), 0)
    return packing.pack(pieces, SEQUENCE, docs.count())


@query
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    token_files.write_token_files(read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 2, drops_space=True)
    return token_files.read_token_files(spark, path)


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitions.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op5_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target are the documents labelled as good and not toxic."""
    target = read(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0").select("doc_id")
    return crossent.score_documents(read(spark, sf_dir, "documents"), target)


@query
def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame(RULES, "verdict STRING, host STRING, path STRING")
    return urls.judge_urls(read(spark, sf_dir, "pages"), listed)


@query
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(read(spark, sf_dir, "pages"))


@query
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_duplicates(read(spark, sf_dir, "documents"))


@query
def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentencepiece_bpe.encode(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), decoded=True)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merkle.manifest(merkle.document_leaves(read(spark, sf_dir, "documents")))
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.digest(F.col("proof")).alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))


@query
def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(spelling.thinned_words(read(spark, sf_dir, "documents")))
