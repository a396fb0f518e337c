"""Exact copies, found by digest and full content in three combining steps that no hot text can overload.

1. Inside each task, rows of equal digest and content become one row (the map side of the first aggregation).
2. These meet in groups of (digest, salt), compared by content again.
3. The salts' winners meet in groups of the digest, compared by content again.

So of a text with a billion copies, a task of step 2 gets one row per input task and salt share, and step 3 one row per salt.

Nulls: a null text counts as empty, and empty texts are copies of each other. A null doc_id comes before all others when ties
are broken. Of rows equal in doc_id and text, one is kept. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import SPACE, text_or_empty

SALTS = 16


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def _winner() -> Column:
    """The most code points, then the smallest doc_id."""
    return F.min(F.struct((-F.col("points")).alias("neg_points"), "doc_id"))


def _content() -> Column:
    return F.regexp_replace(text_or_empty(), f"[{SPACE}]+", "")


def content_groups(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per distinct content: digest, content, winner, group_size. ``rows``: doc_id, points, digest, content."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    by_salt = salted.groupBy("digest", "content", "salt").agg(_winner().alias("winner"), F.count("*").alias("n"))
    return by_salt.groupBy("digest", "content").agg(F.min("winner").alias("winner"), F.sum("n").alias("group_size"))


def exact_duplicates(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are compared without white space. ``digest`` only deals texts out; equal digests of different texts are told apart.
    """
    rows = docs.select("doc_id", F.char_length(text_or_empty()).alias("points"), _content().alias("content"))
    rows = rows.withColumn("digest", digest(F.col("content")))
    groups = content_groups(rows, salts).withColumn("text_sha256", sha256(F.col("content")))
    by, kept = ["digest"], stored(groups.drop("content"), "copies")
    if not kept.groupBy("digest").count().filter("count > 1").isEmpty():  # different texts share a digest
        by, kept = ["digest", "content"], groups
    # Copies of a whole row are counted before they meet, and unfolded behind the join.
    light = rows.groupBy(*by, "doc_id", "points").agg(F.count("*").alias("copies"))
    joined = light.join(kept, by)
    one = F.col("winner.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("winner.neg_points") == -F.col("points"))
    unfolded = joined.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return unfolded.select("doc_id", F.col("winner.doc_id").alias("keep_id"), "group_size", (one & (F.col("copy") == 1)).alias("kept"),
                           "text_sha256")


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each content."""
    kept = exact_duplicates(docs).filter("kept").select(F.concat_ws("|", F.col("doc_id").cast("string"), "text_sha256").alias("key"))
    # A row travels as one column, so that none of its names can clash with those used here.
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.concat_ws("|", F.col("doc_id").cast("string"), sha256(_content())).alias("key"))
    found = keyed.join(kept, "key", "left_semi")
    # Only rows that repeat a doc_id and a content meet here; the longest is the one that stays.
    first = Window.partitionBy("key").orderBy(F.desc(F.char_length(F.coalesce("row.text", F.lit("")))))
    return found.withColumn("turn", F.row_number().over(first)).filter("turn = 1").select("row.*")
