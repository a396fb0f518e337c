"""A mix of sources by weight: every source contributes its share of words, from documents in random order.

Documents get a random key from a hash of their doc_id and text and are sorted by it within their source. The order is cut into ranges
of the key with about ``rows_per_range`` rows each, so no task holds a source: words before a document are the words of earlier
ranges (prefix sums of range totals, in two levels) and of earlier documents of its own range. A source's budget is cut exactly:
whole epochs first, then documents in order, the last of them in part.

Nulls: a null text has size 0, a null source is a source of its own and comes last, a null doc_id hashes as empty text. Empty
texts take 0 words. Repeated rows each count, one behind the other; :func:`mix` counts them before they meet. Empty tables give no
rows; other columns are ignored by :func:`mix` and kept, whatever their names, by :func:`mixed_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import text_or_empty, word_count

_RANGES_TOGETHER = 1024


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Sources (source, n_rows, source_size) with rank, weight and target.

    Sources by code point, nulls last, take the weights in turn and share the words of all. A target stops at ``most`` times
    its source's size; the excess goes to the others by weight. Sources are levelled in order of size over weight: the level is
    that of the first source that doesn't reach its limit when all before it have. One row per source passes through one task.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    ranked = sources.withColumn("rank", turn).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("bigint"))
    limit = (F.col("source_size") * most).cast("bigint")
    order = Window.orderBy(limit / F.col("weight"), "rank")
    everything = Window.partitionBy(F.lit(0))
    total, weight = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = total - (F.sum(limit).over(before) - limit)
    level = left / (weight - (F.sum("weight").over(before) - F.col("weight")))
    levelled = ranked.withColumn("level", level)
    fits = F.col("level") * F.col("weight") <= limit
    first = F.min(F.when(fits, F.struct(limit / F.col("weight"), "rank", "level"))).over(everything)["level"]
    target = F.least(F.coalesce(first, F.lit(0.0)) * F.col("weight"), limit.cast("double"))
    return levelled.withColumn("target", target).drop("level")


def _placed(rows: DataFrame, light: DataFrame, weights: tuple[int, ...], most: int, rows_per_range: int) -> DataFrame:
    """``rows`` (with _mix_source, _mix_size, _mix_key, and any more columns) with _mix_epochs and _mix_part; ``light`` has the same rows."""
    sources = light.groupBy(F.col("_mix_source").alias("source")).agg(
        F.sum("_mix_copies").alias("n_rows"), F.sum(F.col("_mix_size") * F.col("_mix_copies")).alias("source_size"))
    targets = stored(source_targets(sources, weights, most).select(
        F.col("source").alias("_mix_of"), F.col("n_rows").alias("_mix_rows"), F.col("rank").alias("_mix_rank"), F.col("source_size").alias("_mix_source_size"), F.col("target").alias("_mix_target")), "targets")
    cuts = F.ceil(F.col("_mix_rows") / rows_per_range).cast("bigint")

    def ranged(some: DataFrame) -> DataFrame:
        joined = some.join(targets, F.col("_mix_source").eqNullSafe(F.col("_mix_of")))
        return joined.select(*some.columns, "_mix_rank", "_mix_source_size", "_mix_target", F.shiftright(F.col("_mix_key") * cuts, 32).alias("_mix_range"))

    ranges = ranged(light).groupBy("_mix_rank", "_mix_range").agg(F.sum(F.col("_mix_size") * F.col("_mix_copies")).alias("words")).withColumn("together", F.expr(f"_mix_range div {_RANGES_TOGETHER}"))
    groups = ranges.groupBy("_mix_rank", "together").agg(F.sum("words").alias("words"))
    groups = groups.select("_mix_rank", "together", F.expr("sum(words) OVER (PARTITION BY _mix_rank ORDER BY together) - words").alias("base"))
    ranges = ranges.withColumn("inner", F.expr("sum(words) OVER (PARTITION BY _mix_rank, together ORDER BY _mix_range) - words"))
    starts = stored(ranges.join(groups, ["_mix_rank", "together"]).select("_mix_rank", "_mix_range", (F.col("base") + F.col("inner")).alias("_mix_start")), "ranges")
    order = Window.partitionBy("_mix_rank", "_mix_range").orderBy("_mix_key", "doc_id", "_mix_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.col("_mix_size") * F.col("_mix_copies")
    before = F.col("_mix_start") + F.sum(own).over(order) - own
    epochs = F.when(F.col("_mix_source_size") > 0, F.expr("floor(_mix_target) div _mix_source_size")).otherwise(0).cast("bigint")
    placed = ranged(rows).join(starts, ["_mix_rank", "_mix_range"]).withColumn("_mix_before", before).withColumn("_mix_epochs", epochs)
    run = 1 << 16  # equal rows in runs, so that no list of all their numbers is made
    runs = placed.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(_mix_copies - 1) div {run}"))).alias("_mix_run"))
    in_run = F.least(F.lit(run), F.col("_mix_copies") - F.col("_mix_run") * run)
    rows = runs.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), in_run - 1)).alias("_mix_turn"))
    earlier = F.col("_mix_before") + (F.col("_mix_run") * run + F.col("_mix_turn")) * F.col("_mix_size")
    left = F.floor("_mix_target") - F.col("_mix_epochs") * F.col("_mix_source_size") - earlier
    return rows.withColumn("_mix_part", F.greatest(F.lit(0), F.least("_mix_size", left)).cast("bigint"))


def _measured(docs: DataFrame, *more: Column) -> DataFrame:
    """Source, words and key of each row, and columns ``more``; names of ``docs`` can't clash with those of this module."""
    name = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text_or_empty().cast("binary")))
    key = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("bigint")
    return docs.select("doc_id", F.col("source").cast("string").alias("_mix_source"), word_count().alias("_mix_size"), key.alias("_mix_key"), *more)


def _light(measured: DataFrame) -> DataFrame:
    return stored(measured.groupBy("doc_id", "_mix_source", "_mix_size", "_mix_key").agg(F.count("*").alias("_mix_copies")), "sizes")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, rows_per_range: int = 2048) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, epochs (whole ones), part (words of one more epoch), taken."""
    light = _light(_measured(docs))
    placed = _placed(light, light, weights, most, rows_per_range)
    names = {"_mix_source": "source", "_mix_size": "size", "_mix_source_size": "source_size", "_mix_target": "target", "_mix_epochs": "epochs", "_mix_part": "part"}
    taken = (F.col("_mix_epochs") * F.col("_mix_size") + F.col("_mix_part")).cast("bigint").alias("taken")
    return placed.select("doc_id", *[F.col(a).alias(b) for a, b in names.items()], taken)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, rows_per_range: int = 2048) -> DataFrame:
    """The documents of the mix, whole and with all columns, each as often as the mix takes it.

    The part of a document at a source's cut counts as once from half the document on. A document without words stays once.
    Rows that are equal in doc_id, source and text share a key here; the pipeline's exact dedup leaves none.
    """
    whole = _measured(docs, F.struct(*docs.columns).alias("_mix_row")).withColumn("_mix_copies", F.lit(1).cast("bigint"))
    placed = _placed(whole, _light(_measured(docs)), weights, most, rows_per_range)
    once_more = F.when(F.col("_mix_part") * 2 >= F.col("_mix_size"), 1).otherwise(0)
    times = F.when(F.col("_mix_size") == 0, 1).otherwise(F.col("_mix_epochs") + once_more).cast("int")
    repeated = placed.withColumn("_mix_times", times).filter("_mix_times > 0")
    return repeated.select("*", F.explode(F.sequence(F.lit(1), "_mix_times")).alias("_mix_time")).select("_mix_row.*")
