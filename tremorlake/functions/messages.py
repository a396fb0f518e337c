"""JSON messages on a topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .times import utc_now_text


def encode_json(*columns) -> Column:
    """The columns as one JSON object per row; null fields are written."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def stamp_injection(df: DataFrame, topic: str) -> DataFrame:
    """Add the time at which the rows are handed to the topic."""
    return df.withColumn(f"injected_to_{topic}_at", utc_now_text())


def decode_json(df: DataFrame, schema: str, value: str = "value", deserializer=None) -> DataFrame:
    """Add ``message`` (the decoded struct) and ``raw`` (the text, only where it is no JSON object).

    ``deserializer`` replaces the JSON decoding: a function from the text column to the message column.
    """
    text = F.col(value).cast("string")
    if deserializer is not None:
        return df.withColumn("message", deserializer(text)).withColumn(
            "raw", F.when(F.col("message").isNull(), text)
        )
    parsed = F.from_json(text, f"{schema}, _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"})
    broken = F.col("_parsed").isNull() | F.col("_parsed._corrupt").isNotNull()
    names = StructType.fromDDL(schema).names
    return (
        df.withColumn("_parsed", parsed)
        .withColumn("message", F.when(~broken, F.struct(*[F.col(f"_parsed.{n}").alias(n) for n in names])))
        .withColumn("raw", F.when(broken, text))
        .drop("_parsed")
    )

