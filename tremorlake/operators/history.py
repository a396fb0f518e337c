"""The station table over time: for how long each row held, and what held at a given change.

A history has one row for each state of a name: name, description, x, y, valid_from, valid_to. It holds for valid_from <= seq < valid_to,
``valid_to`` is null while it still holds, and the intervals of a name never overlap. A deleted name has a gap. Names and seqs must not be null,
a seq lies between -2^61 and 2^61, and those of a name differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import running
from .stations import SEQ_BLOCK, judge_changes

ATTRIBUTES = ("description", "x", "y")
#: Where the rows of a table without history begin.
FIRST = -(1 << 61)


def begin(stations: DataFrame) -> DataFrame:
    """The history of a table that nothing has changed yet."""
    return stations.select("name", *ATTRIBUTES, F.lit(FIRST).alias("valid_from"), F.lit(None).cast("bigint").alias("valid_to"))


def extended(history: DataFrame, changes: DataFrame, seq_block: int = SEQ_BLOCK) -> DataFrame:
    """The history behind further changes, whose seqs are above all of its own; rejected ones leave no trace.

    Only rows that still hold, of names that a change touches, are worked on. The end of a state is the next accepted change of its name,
    found block by block from the last change backwards, so a name may have any number of them.
    """
    open_rows, touched = history.where("valid_to IS NULL"), changes.select("name").distinct()
    changing = open_rows.join(touched, "name", "left_semi")
    judged = judge_changes(changing, changes, seq_block).where("accepted")
    starts = changing.select(F.col("valid_from").alias("seq"), F.lit("insert").alias("op"), "name", *ATTRIBUTES)
    writes = starts.unionByName(judged.select("seq", "op", "name", *ATTRIBUTES)).withColumn("_back", -F.col("seq"))
    ended = running(writes, ["name"], "_back", F.floor(F.col("_back") / F.lit(seq_block)), {"_later": (F.col("_back"), "max")}, inclusive=False)
    states = ended.where("op <> 'delete'").select("name", *ATTRIBUTES, F.col("seq").alias("valid_from"), (-F.col("_later")).alias("valid_to"))
    same = history.where("valid_to IS NOT NULL").unionByName(open_rows.join(touched, "name", "left_anti"))
    return same.select(*states.columns).unionByName(states)


def table_at(history: DataFrame, seq: int) -> DataFrame:
    """The station table as it was behind the change ``seq``, without neighbours."""
    holds = (F.col("valid_from") <= seq) & (F.col("valid_to").isNull() | (F.col("valid_to") > seq))
    return history.where(holds).select("name", *ATTRIBUTES)


def as_of(history: DataFrame, asked: DataFrame, seq_block: int = SEQ_BLOCK) -> DataFrame:
    """Each pair of ``asked`` (name, seq) once, with ``found`` and what held for the name at that seq; nulls in a pair find nothing.

    As intervals of a name don't overlap, only the last one that begins at or before a seq can hold there. It is the running maximum
    over beginnings and questions in one order, with the state carried along: no join of intervals, and a name with many of both is
    spread over tasks by blocks.
    """
    wanted = asked.select("name", F.col("seq").cast("bigint").alias("seq")).distinct()
    state = F.struct("valid_from", "valid_to", *ATTRIBUTES)
    starts = history.select("name", F.col("valid_from").alias("seq"), state.alias("_state"))
    known = wanted.where("name IS NOT NULL AND seq IS NOT NULL")
    both = starts.unionByName(known, allowMissingColumns=True)
    # A beginning stands before a question at the same seq.
    both = both.withColumn("_order", F.col("seq") * 2 + F.when(F.col("_state").isNull(), 1).otherwise(0))
    last = running(both, ["name"], "_order", F.floor(F.col("_order") / F.lit(2 * seq_block)), {"_last": (F.col("_state"), "max")})
    answers = last.where("_state IS NULL").select("name", "seq", "_last")
    rows = answers.unionByName(wanted.where("name IS NULL OR seq IS NULL"), allowMissingColumns=True)
    found = F.col("_last").isNotNull() & (F.col("_last.valid_to").isNull() | (F.col("seq") < F.col("_last.valid_to")))
    return rows.select("name", "seq", F.coalesce(found, F.lit(False)).alias("found"),
                       *[F.when(found, F.col(f"_last.{a}")).alias(a) for a in ATTRIBUTES])
