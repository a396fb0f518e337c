"""URL rules: a blocked Bloom filter of the listed URLs in front of an exact hash join.

A listed entry is a canonical host and path start; it fits its host and all subdomains. Every URL is turned into the entries that
could fit it (host suffixes times path starts of the listed lengths). The filter is a table of 256-bit blocks, one block per
entry and one bit in each of its eight lanes, joined on the block number; what passes meets the listed entries in an exact join,
which removes false positives. The longest entry wins.

Nulls: a null URL, or one without ``://``, has an empty host and path, no rule and the verdict for what isn't listed. Null
page_ids and repeated rows are kept. Empty tables give no rows; other columns are ignored. Repeated entries: ``block`` wins.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks of the filter at most: 32 MB of bits, so its table may be broadcast. Beyond, more false positives reach the exact join.
MOST_BLOCKS = 1 << 20
ENTRIES_PER_BLOCK = 16
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, URL, 1), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def _words(key: Column) -> list[Column]:
    """The four 64-bit words that an entry sets in its block, two lanes of 32 bits each."""
    h = F.xxhash64(key, F.lit("lanes"))
    bit = [F.shiftright(h, 5 * i).bitwiseAND(31).cast("int") for i in range(8)]
    one = F.lit(1).cast("bigint")
    return [F.call_function("shiftleft", one, bit[2 * i]).bitwiseOR(F.call_function("shiftleft", one, bit[2 * i + 1] + 32)) for i in range(4)]


def bloom_blocks(entries: DataFrame, n_blocks: int) -> DataFrame:
    """The filter of ``entries.entry``: block and its words w0..w3; blocks without a bit are left out."""
    hashed = entries.select(F.pmod(F.xxhash64("entry"), F.lit(n_blocks)).alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(_words(F.col("entry")))])
    return hashed.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])


def possible_hits(candidates: DataFrame, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """The candidates whose ``entry`` the filter may hold."""
    block = F.pmod(F.xxhash64("entry"), F.lit(n_blocks))
    needed = [(F.col(f"w{i}").bitwiseAND(w) == w) for i, w in enumerate(_words(F.col("entry")))]
    joined = candidates.join(F.broadcast(blocks), (block == F.col("block")) & reduce(lambda a, b: a & b, needed))
    return joined.select(*candidates.columns)


def judge_urls(pages: DataFrame, listed: DataFrame, unlisted: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule (null if none fits) and verdict. ``listed``: host, path, verdict."""
    entries = listed.groupBy(F.concat("host", "path").alias("entry")).agg(F.max("verdict").alias("verdict"))
    shape = listed.agg(F.count("*").alias("n"), F.max(F.size(F.split("host", r"\."))).alias("labels"),
                       F.collect_set(F.char_length("path")).alias("lengths")).first()  # as many lengths as a path has characters
    base = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not shape["n"]:
        return base.select("*", F.lit(None).cast("string").alias("rule"), F.lit(unlisted).alias("verdict"))
    n_blocks = min(MOST_BLOCKS, max(1, shape["n"] // ENTRIES_PER_BLOCK))
    labels = F.split("host", r"\.")
    count = F.size(labels)
    hosts = F.transform(F.sequence(F.greatest(F.lit(1), count - shape["labels"] + 1), count), lambda i: F.array_join(F.slice(labels, i, count), "."))
    starts = F.transform(F.filter(F.array(*[F.lit(n) for n in sorted(shape["lengths"])]), lambda n: n <= F.char_length("path")),
                         lambda n: F.substring(F.col("path"), F.lit(1), n))
    urls = base.select("host", "path").distinct()
    candidates = urls.select("*", F.explode(hosts).alias("suffix")).select("host", "path", F.explode(F.transform(starts, lambda p: F.concat("suffix", p))).alias("entry"))
    hits = possible_hits(candidates, bloom_blocks(entries, n_blocks), n_blocks).join(entries, "entry")
    best = F.max(F.struct(F.char_length("entry").alias("n"), F.col("entry").alias("rule"), "verdict"))
    judged = hits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict")
    return base.join(judged, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(unlisted)).alias("verdict"))
