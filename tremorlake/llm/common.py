"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

#: Fixed value: the white space of the contracts, [\x20\x09-\x0D], as Java and DuckDB patterns read it.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
SPACES = "\t\n\x0b\x0c\r "


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("bigint")


def parts(rows: int, per_part: int) -> int:
    return max(1, math.ceil(rows / per_part))


#: Rows of an Arrow batch of whole texts, which both the JVM and Python hold several times.
TEXTS_PER_BATCH = 1000


def prepare(spark: SparkSession) -> None:
    """Ship the package, and have texts go to Python in batches that stay small when texts are long (a setting of the session)."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXTS_PER_BATCH))


def give_back() -> None:
    """Return memory that a task no longer uses to the system; Spark's Python workers live on between stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only in some C libraries
    if trim is not None:
        trim(0)


def steps(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose text takes about ``most_bytes``; a longer single text is a run of its own.

    Behind the last one, memory goes back to the system."""
    try:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
            start, held = 0, 0
            for i, n in enumerate(sizes):
                if held and held + n > most_bytes:
                    yield batch.slice(start, i - start)
                    start, held = i, 0
                held += int(n)
            if start < batch.num_rows:
                yield batch.slice(start)
    finally:
        give_back()
