"""Words that differ by one code point, found exactly through pairs of trie nodes, and each word's more frequent form.

The words' trie and that of the reversed words get numbers for their nodes. A word with one position left open is a pair of numbers:
the node of what stands in front of the position and the node of what stands behind it. Words with equal pairs differ in that
position only; a word split at a point has the pair of each word with one more code point there. So neighbours meet on two
integers, however long the words are, and a pair determines what its words share, so nothing found is wrong.

Nodes are numbered range by range of the sorted words: a node's number is the code points of all words before the first one under it,
plus its depth. What a range shares with earlier ones at its border is looked up by prefix, one row per range and shared depth.
Words that meet on a pair differ in one code point there, so their number is bounded by the alphabet. A word removed at several places
of a run of equal code points gives one word: only the run's first place counts.

Nulls: a null text has no words; a null doc_id is empty in the hash. Empty texts and tables give no words, long runs are whole
words. Ties between forms go to the smaller word in code-point order. Repeated rows count again. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import parts, text_or_empty

#: Fixed value: the letters of the contract.
LETTERS = "A-Za-zÀ-ÿ"
RATIO = 10


def thinned_words(docs: DataFrame, least: int = 7, every: int = 31) -> DataFrame:
    """(word, n): runs of letters with A-Z lower-cased, one code point deleted where ``every`` divides the run's hash.

    Runs shorter than ``least`` can't become words and aren't unrolled.
    """
    runs = F.regexp_extract_all(text_or_empty(), F.lit(f"([{LETTERS}]{{{least},}})"), F.lit(1))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.withColumn("run", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    without = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
    word = F.when(F.col("h") % every == 0, without).otherwise(F.col("run"))
    counted = rows.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter((F.char_length("word") >= least) & (F.col("n") >= 2))


def _range_nodes(rows: pa.Table) -> pa.Table:
    """Numbers of the nodes of one range's words, as if it were the first."""
    order = sorted(rows.column("word").to_pylist())  # code points sort like their UTF-8 bytes
    found, before, nodes, start = [], "", [0], 0
    for word in order:
        shared, most = 0, min(len(word), len(before))
        while shared < most and word[shared] == before[shared]:
            shared += 1
        nodes = nodes[:shared + 1] + list(range(start + shared + 1, start + len(word) + 1))
        found.append(nodes)
        before, start = word, start + len(word)
    values = np.fromiter((x for one in found for x in one), np.int64)
    borders = np.concatenate([[0], np.cumsum([len(one) for one in found])])
    return pa.table({"range": pa.array([rows.column("range")[0].as_py()] * len(order), pa.int32()), "word": order,
                     "nodes": pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(values))})


def trie_nodes(words: DataFrame, words_per_range: int = 32_768) -> DataFrame:
    """``words`` (word, distinct and not empty) with ``nodes``: the numbers of the word's prefixes of 0, 1, ... code points.

    Numbers of whole words ascend in code-point order.
    """
    ranged = words.select("word").repartitionByRange(parts(words.count(), words_per_range), "word").withColumn("range", F.spark_partition_id())
    local = stored(stored(ranged, "word-ranges").groupBy("range").applyInArrow(_range_nodes, "range INT, word STRING, nodes ARRAY<BIGINT>"), "range-nodes")
    ends = local.groupBy("range").agg(F.min("word").alias("first"), F.max_by("nodes", "word").alias("last_nodes"), F.max("word").alias("last"),
                                      F.sum(F.size("nodes") - 1).alias("points"))
    turn = Window.orderBy("range")  # one row per range

    def shared(a: str, b: str) -> Column:
        return F.expr(f"filter(sequence(1, least(char_length({a}), char_length({b}))), i -> substring({a}, 1, i) = substring({b}, 1, i))")

    ends = ends.select("*", (F.sum("points").over(turn) - F.col("points")).alias("base"), F.lag("last").over(turn).alias("before"), F.lead("first").over(turn).alias("behind"))
    ends = stored(ends.select("range", "first", "last", "last_nodes", "base", F.coalesce(shared("first", "before"), F.array()).alias("seen"),
                              F.coalesce(shared("last", "behind"), F.array()).alias("passed")), "range-ends")
    # The first range that has a prefix gives its node the smallest number.
    made = ends.select("base", "last", "last_nodes", F.explode("passed").alias("i")).groupBy(F.expr("substring(last, 1, i)").alias("prefix")).agg(
        F.min(F.expr("base + last_nodes[i]")).alias("node"))
    asked = ends.select("range", "first", F.explode("seen").alias("i")).withColumn("prefix", F.expr("substring(first, 1, i)"))
    held = asked.join(made, "prefix").groupBy("range").agg(F.sort_array(F.collect_list(F.struct("i", "node"))).alias("held"))
    moved = stored(ends.select("range", "base").join(held, "range", "left").select("range", "base", F.coalesce(F.col("held.node"), F.array().cast("array<bigint>")).alias("held")), "range-bases")
    # Small numbers of a range are prefixes of its first word; those shared with earlier ranges have their numbers already.
    number = "transform(nodes, x -> CASE WHEN x = 0 THEN 0L WHEN x <= size(held) THEN held[cast(x - 1 AS INT)] ELSE base + x END)"
    return local.join(moved, "range").select("word", F.expr(number).alias("nodes"))


def word_pairs(words: DataFrame) -> DataFrame:
    """(id, n, front, back, open, first): the pairs of a word, with a position left open or split; ``words`` has id, n, word, forward, backward.

    ``first`` is false at an open position behind an equal code point.
    """
    # A code point equals the one before it just when the word without it is the word without that one: compared as letters.
    letters = F.split("word", "")
    first = F.transform(F.sequence(F.lit(0), F.size("letters") - 1),
                        lambda i: (i == 0) | (F.get("letters", i) != F.get("letters", i - 1)))
    n = F.size("forward") - 1
    rows = words.withColumn("letters", letters)
    gaps = rows.select("id", "n", F.inline(F.arrays_zip(F.slice("forward", 1, n).alias("front"), F.reverse(F.slice("backward", 1, n)).alias("back"), first.alias("first"))))
    splits = rows.select("id", "n", F.inline(F.arrays_zip(F.col("forward").alias("front"), F.reverse("backward").alias("back"))))
    return gaps.select("id", "n", "front", "back", F.lit(True).alias("open"), "first").unionByName(
        splits.select("id", "n", "front", "back", F.lit(False).alias("open"), F.lit(True).alias("first")))


def neighbours(pairs: DataFrame) -> DataFrame:
    """(id, n_near, best): the number of words one code point away, and of these the most frequent (n, minus its id)."""
    one = F.struct("n", (-F.col("id")).alias("minus"), "first")
    met = pairs.groupBy("front", "back").agg(
        F.sort_array(F.collect_list(F.when(F.col("open"), one)), asc=False).alias("gaps"), F.max(F.when(~F.col("open"), one)).alias("whole"))
    met = met.filter("size(gaps) > 1 OR (size(gaps) = 1 AND whole IS NOT NULL)")
    met = met.withColumn("longer", F.expr("filter(gaps, g -> g.first)"))
    # Of a pair's words each has all others as neighbours; the best of them is the first, or the second for the first.
    other = "named_struct('n', {0}.n, 'minus', {0}.minus)"
    best = f"""CASE WHEN g.first AND whole IS NOT NULL THEN greatest({other.format('whole')}, {{0}}) ELSE {{0}} END"""
    runner = f"CASE WHEN size(gaps) = 1 THEN NULL WHEN i = 0 THEN {other.format('gaps[1]')} ELSE {other.format('gaps[0]')} END"
    members = F.expr(f"""transform(gaps, (g, i) -> named_struct('id', -g.minus,
        'near', size(gaps) - 1 + if(g.first AND whole IS NOT NULL, 1, 0), 'best', {best.format(f'({runner})')}))""")
    whole = F.expr(f"""if(whole IS NOT NULL AND size(longer) > 0,
        array(named_struct('id', -whole.minus, 'near', size(longer), 'best', {other.format('longer[0]')})), array())""")
    rows = met.select(F.inline(F.concat(members, whole)))
    return rows.groupBy("id").agg(F.sum("near").cast("bigint").alias("n_near"), F.max("best").alias("best"))


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """(id, root): the last word of each word's chain of forms (id, form), which has ``steps`` links at most; doubled in each round."""
    found = stored(forms.select("id", F.col("form").alias("root")), "forms")
    for _ in range(math.ceil(math.log2(max(steps, 1)))):
        onward = found.select(F.col("id").alias("root"), F.col("root").alias("next"))
        found = stored(found.join(onward, "root", "left").select("id", F.coalesce("next", "root").alias("root")), "forms")
    return found


def spelling_groups(counted: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``counted``: (word, n), words distinct and not empty. Per word: word, form, root, n, n_near, form_n."""
    counted = stored(counted.select("word", "n"), "words")
    forward = trie_nodes(counted).withColumnRenamed("nodes", "forward")
    backward = trie_nodes(counted.select(F.reverse("word").alias("word"))).select(F.reverse("word").alias("word"), F.col("nodes").alias("backward"))
    words = stored(counted.join(forward, "word").join(backward, "word").withColumn("id", F.element_at("forward", -1)), "numbered-words")
    near = neighbours(word_pairs(words))
    chosen = F.col("best.n") >= F.col("n") * ratio
    light = words.select("id", "word", "n").join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(chosen, -F.col("best.minus")).alias("form"),
        F.when(chosen, F.col("best.n")).cast("bigint").alias("form_n"))
    light = stored(light, "word-forms")
    most = counted.agg(F.max("n")).first()[0] or 1
    ends = roots(light.filter("form IS NOT NULL").select("id", "form"), int(math.log(most, ratio)) + 1)
    names = light.select(F.col("id").alias("of"), F.col("word").alias("name"))
    rows = light.join(ends, "id", "left")
    rows = rows.join(names.withColumnRenamed("name", "form_word"), F.col("form") == F.col("of"), "left").drop("of")
    rows = rows.join(names.withColumnRenamed("name", "root_word"), F.col("root") == F.col("of"), "left").drop("of")
    return rows.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
