"""Topics: publishing rows as JSON messages and reading them back.

The format is an argument: ``kafka`` with its options on a cluster that has the connector, ``text`` for files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.messages import decode_json, encode_json, stamp_injection


def as_messages(rows: DataFrame, topic: str, serializer=None) -> DataFrame:
    """One row per message: the JSON text of the row with its injection time (or ``serializer(columns)``)."""
    stamped = stamp_injection(rows, topic)
    return stamped.select((serializer or encode_json)(*stamped.columns).alias("value"))


def publish(rows: DataFrame, topic: str, fmt: str = "kafka", serializer=None, **options: str) -> None:
    writer = as_messages(rows, topic, serializer).write.format(fmt).options(**options)
    if fmt == "kafka":
        writer.option("topic", topic).save()
    else:
        writer.mode("append").save()


def subscribe(spark: SparkSession, schema: str, topic: str | None = None, fmt: str = "kafka", deserializer=None,
              **options: str) -> DataFrame:
    """A stream with ``message`` (decoded) and ``raw`` (text that is no JSON), from the newest offsets on."""
    reader = spark.readStream.format(fmt).options(**options)
    if fmt == "kafka":
        reader = reader.option("subscribe", topic).option("startingOffsets", options.get("startingOffsets", "latest"))
    return decode_json(reader.load(), schema, deserializer=deserializer)
