"""Station table: lookups, existence checks and change sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .blocks import running
from .neighbours import K, with_closest

SEQ_BLOCK = 4096


def lookup(stations: DataFrame, names: DataFrame) -> DataFrame:
    """The requested names with their station, or ``found = false``."""
    rows = stations.withColumn("found", F.lit(True))
    return names.join(rows, "name", "left").fillna(False, subset=["found"])


def new_names(changes: DataFrame, stations: DataFrame) -> DataFrame:
    return changes.join(stations.select("name"), "name", "left_anti")


def known_names(changes: DataFrame, stations: DataFrame) -> DataFrame:
    return changes.join(stations.select("name"), "name", "left_semi")


def judge_changes(stations: DataFrame, changes: DataFrame, seq_block: int = SEQ_BLOCK) -> DataFrame:
    """The changes with ``accepted`` and ``reason``, as if applied one by one in ``seq`` order.

    Whether a name exists before a change depends only on the last earlier insert or delete of the name (an
    insert leaves it existing whether accepted or not, a delete leaves it gone), and on the table when there is none.
    """
    structural = F.when(F.col("op").isin("insert", "delete"),
                        F.col("seq") * 2 + F.when(F.col("op") == "insert", 1).otherwise(0))
    rows = running(changes, ["name"], "seq", F.floor(F.col("seq") / F.lit(seq_block)),
                   {"_last": (structural, "max")}, inclusive=False)
    known = stations.select("name", F.lit(1).alias("_known"))
    rows = rows.join(known, "name", "left")
    exists = F.coalesce(F.pmod(F.col("_last"), F.lit(2)), F.col("_known"), F.lit(0)) == 1
    accepted = F.when(F.col("op") == "insert", ~exists).otherwise(exists)
    reason = F.when(~accepted, F.when(F.col("op") == "insert", F.lit("exists")).otherwise(F.lit("not found")))
    return rows.select(*changes.columns, accepted.alias("accepted"), reason.alias("reason"))


def fold_changes(stations: DataFrame, judged: DataFrame) -> DataFrame:
    """The station rows after the accepted changes."""
    attributes = ("description", "x", "y")
    writes = F.when(F.col("accepted") & F.col("op").isin("insert", "update"), F.col("seq"))
    structural = F.when(F.col("accepted") & (F.col("op") != "update"),
                        F.col("seq") * 2 + F.when(F.col("op") == "insert", 1).otherwise(0))
    final = judged.groupBy("name").agg(
        F.max(writes).alias("_write"), F.max(structural).alias("_structural"))
    written = judged.select("name", F.col("seq").alias("_write"), *[F.col(a).alias(f"_new_{a}") for a in attributes])
    final = final.join(written, ["name", "_write"], "left")
    merged = stations.select("name", *attributes, F.lit(True).alias("_known")).join(final, "name", "full")
    alive = F.coalesce(F.pmod(F.col("_structural"), F.lit(2)) == 1, F.col("_known"), F.lit(False))
    changed = F.col("_write").isNotNull()
    return merged.where(alive).select(
        "name", *[F.when(changed, F.col(f"_new_{a}")).otherwise(F.col(a)).alias(a) for a in attributes])


def apply_station_changes(stations: DataFrame, changes: DataFrame, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(snapshot with neighbours, rejected changes) after inserts, updates and deletes in ``seq`` order."""
    judged = stored(judge_changes(stations, changes), "judged")
    snapshot = with_closest(stored(fold_changes(stations, judged), "stations"), k)
    return snapshot, judged.where(~F.col("accepted"))
