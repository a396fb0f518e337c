"""Near duplicates by word shingles: a chosen-path join with exact checks.

A text is the set of its runs of five words. Recursive splitting: at a node of a random tree a set goes on to the child of every
token j with hash(node, j) < 1 / (similarity * size), one or a little more on average, so two sets meet in a child only by a
shared sampled token, and sets with an overlap of ``similarity`` of the larger keep at least one common child on average at every
level. Leaves of ``depth`` levels are the buckets. One run finds a pair of just that similarity with a probability that depends on
the depth alone; there are as many runs as ``recall`` asks for.

1. Texts with the same set become one vertex.
2. Every vertex is checked against one vertex that it often shares a bucket with and that has much company; confirmed pairs join
   components. In buckets that still hold several, every vertex is checked against one random member of another component, for
   some ``rounds``. So large groups of copies come together with a few checks for each member.
3. Buckets that then still hold several components are searched by brute force; those above ``bucket`` members are split deeper
   first and, whatever remains large, searched in pairs of blocks. Buckets with the same members are searched once, and a search
   returns a tree that connects what it found, not the pairs.
4. Inside each component all pairs are compared, in pairs of blocks, to count the links.

No pair of copies and no list of a group is ever emitted. Comparisons count common shingles exactly (by 32-bit hashes). In front of them
stands a bound that never errs: sets differ in at least as many shingles as their parity bits do, so pairs that cannot reach
``similarity`` by their sizes and 1,024 bits are left out before any set is shuffled, and only sets that a filter of the wanted
ones lets through are. Sets are written only where they share a bucket with another: they are made a second time for those, from
the texts, so the texts are read twice and must be the same both times.

Nulls: a null or empty text has no shingles and no links, and a class of its own with other such texts' rows being no copies of it.
A text of one to four words is one shingle. A null doc_id stays null. Repeated rows are copies. Empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import WORD, give_back, steps, text_or_empty
from .components import components
from .urls import ENTRIES_PER_BLOCK, MOST_BLOCKS, bloom_blocks, possible_hits

STEP_BYTES = 1 << 20
_DEEPER = 2  # levels that a further split adds
_BITS = 1024  # of a set's parity sketch, a power of two
_CHUNK = 2048  # rows of small groups that are searched at a time
_LARGE = 512  # rows of a group behind which memory is given back
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_DRAW = (np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def drawn(x: np.ndarray) -> np.ndarray:
    """A number for each token at a node, changed in place: 32 bits take a third of the time of 64."""
    for shift, factor in zip((16, 13), _DRAW):
        x ^= x >> np.uint32(shift)
        x *= factor
    return x


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts in a row, ascending within each text, and the n + 1 borders."""
    texts = pc.cast(pc.fill_null(texts, ""), pa.large_string())
    n = len(texts)
    lists = pc.split_pattern_regex(texts, r"[\t-\r ]+")
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    hashed = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), np.uint64, len(names))
    ends = lists.offsets.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(n), np.diff(ends))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    if "" in names:  # at the ends of a text
        real = codes != names.index("")
        text, codes = text[real], codes[real]
    word = hashed[codes]
    count = np.bincount(text, minlength=n)
    # A shingle at each word that enough words follow; the first word of a shorter text stands for all of it.
    place = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(words, count[text])
    starts = np.flatnonzero(place + length <= count[text])
    h = np.zeros(len(starts), np.uint64)
    for i in range(words):
        inside = i < length[starts]
        h[inside] = mixed((h[inside] + np.uint64(i + 1)) ^ word[starts[inside] + i])
    owner = text[starts]
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    owner, h = owner[new], h[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int64)


def descend(tokens: np.ndarray, nodes: np.ndarray, levels: int, similarity: float) -> np.ndarray:
    """The nodes ``levels`` below the given ones that the set reaches."""
    limit = np.uint32(min(2**32 - 1, int(2**32 / (similarity * max(len(tokens), 1)))))
    short = (tokens >> np.uint64(32)).astype(np.uint32)
    for _ in range(levels):
        below = [np.empty(0, np.uint64)]
        run = max(1, (1 << 16) // max(len(tokens), 1))
        own = (nodes >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(nodes), run):
            node, token = np.nonzero(drawn(short[None, :] ^ own[i:i + run, None]) <= limit)
            below.append(mixed((nodes[i + node] * _C) ^ tokens[token]))
        nodes = np.unique(np.concatenate(below))
    return nodes


def survival(levels: int) -> float:
    """The chance that a pair of just the similarity still shares a node: a branching process with one child on average."""
    q = 1.0
    for _ in range(levels):
        q = 1 - math.exp(-q)
    return q


def runs_for(recall: float, levels: int) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(levels)))


def _named(own: np.ndarray) -> bytes:
    """The 128-bit name of a set of shingles."""
    return xxhash.xxh3_128_digest(own.tobytes())


def _text_hash() -> Column:
    return F.xxhash64(text_or_empty())


def _signatures(docs: DataFrame, words: int, similarity: float, depth: int, runs: int) -> DataFrame:
    """One row per document: doc_id, text_hash, v (128-bit name of its set), nodes."""
    roots = mixed(np.arange(1, runs + 1, dtype=np.uint64) * _C)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", STEP_BYTES):
            h, borders = shingle_sets(batch.column("text"), words)
            names, nodes, known = [], [], {}
            for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
                if a == b:
                    names.append(None), nodes.append(None)
                    continue
                name = _named(h[a:b])
                if name not in known:
                    known[name] = descend(h[a:b], roots, depth, similarity).astype(np.int64)
                names.append(name), nodes.append(known[name])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(names, pa.binary()),
                                              pa.array(nodes, pa.list_(pa.int64()))], ["doc_id", "text_hash", "v", "nodes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", _text_hash().alias("text_hash"), text_or_empty().alias("text"))
    return texts.mapInArrow(sign, f"doc_id {kind}, text_hash BIGINT, v BINARY, nodes ARRAY<BIGINT>")


def _token_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(v, tokens: sorted 32-bit hashes) of the texts whose text_hash a filter of the ``wanted`` ones may hold; a set may come several times."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", STEP_BYTES):
            h, borders = shingle_sets(batch.column("text"), words)
            sets = {_named(h[a:b]): h[a:b] for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()) if a < b}
            tokens = [np.unique((own >> np.uint64(32)).astype("<u4")).tobytes() for own in sets.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.binary()), pa.array(tokens, pa.binary())], ["v", "tokens"])

    texts = docs.select(_text_hash().alias("text_hash"), text_or_empty().alias("text"))
    return _among(texts, wanted, "text_hash").select("text").mapInArrow(make, "v BINARY, tokens BINARY")


def _deeper(members: DataFrame, similarity: float, levels: int = _DEEPER) -> DataFrame:
    """The nodes (v, node) below those of (v, node, tokens)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [descend(mixed(np.frombuffer(t, "<u4").astype(np.uint64)), np.array([node], np.int64).astype(np.uint64), levels, similarity)
                     for t, node in zip(batch.column("tokens").to_pylist(), batch.column("node").to_pylist())]
            of = np.repeat(np.arange(batch.num_rows), [len(f) for f in found])
            nodes = np.concatenate([*found, np.empty(0, np.uint64)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("v").take(pa.array(of)), pa.array(nodes)], ["v", "node"])

    return members.select("v", "node", "tokens").mapInArrow(split, "v BINARY, node BIGINT").distinct()


def sketch(tokens: np.ndarray) -> bytes:
    """For each of the ranges that the hashes fall into, whether the set holds an odd number of its tokens."""
    place = tokens >> np.uint32(32 - (_BITS.bit_length() - 1))
    return np.packbits(np.bincount(place, minlength=_BITS) & 1).tobytes()


def _bits(column: list[bytes] | pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, _BITS // 8)


def _within(sizes_a: np.ndarray, sizes_b: np.ndarray, differing: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes with so many differing bits may be similar: at least so many tokens are in one of the two only."""
    common = np.minimum(np.minimum(sizes_a, sizes_b), (sizes_a + sizes_b - differing) // 2)
    return common >= similarity * (sizes_a + sizes_b - common)


def _sketches(tokens: DataFrame) -> DataFrame:
    """(v, size, bits) of the sets."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(t, "<u4") for t in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("v"), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary())],
                                             ["v", "size", "bits"])

    return tokens.select("v", "tokens").mapInArrow(draw, "v BINARY, size BIGINT, bits BINARY")


def _possible_pairs(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that their sketches don't rule out."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [batch.column(f"size_{x}").to_numpy(zero_copy_only=False) for x in "ab"]
            differing = np.bitwise_count(np.bitwise_xor(*(_bits(batch.column(f"bits_{x}").to_pylist()) for x in "ab"))).sum(axis=1, dtype=np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(_within(*sizes, differing, similarity)))

    side_a, side_b = (sketches.select(F.col("v").alias(x), F.col("size").alias(f"size_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab")
    return pairs.join(side_a, "a").join(side_b, "b").select("a", "b", "size_a", "size_b", "bits_a", "bits_b").mapInArrow(check, "a BINARY, b BINARY")


def _among(rows: DataFrame, wanted: DataFrame, by: str = "v") -> DataFrame:
    """The rows whose v (or ``by``) a filter of bounded size, made of those of ``wanted``, may hold: all that are wanted and few others."""
    n_blocks = min(MOST_BLOCKS, max(1, wanted.count() // ENTRIES_PER_BLOCK))
    blocks = bloom_blocks(wanted.select(F.col(by).alias("entry")), n_blocks)
    return possible_hits(rows.withColumn("entry", F.col(by)), blocks, n_blocks).drop("entry")


def _similar_pairs(pairs: DataFrame, similarity: float) -> DataFrame:
    """The rows (a, b) of (a, b, tokens_a, tokens_b) whose sets are similar."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("tokens_a"), batch.column("tokens_b")):
                p, q = np.frombuffer(x.as_py(), "<u4"), np.frombuffer(y.as_py(), "<u4")
                possible = min(len(p), len(q)) >= similarity * max(len(p), len(q))
                common = len(np.intersect1d(p, q, assume_unique=True)) if possible else 0
                keep.append(common >= similarity * (len(p) + len(q) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    return pairs.select("a", "b", "tokens_a", "tokens_b").mapInArrow(check, "a BINARY, b BINARY")


def similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sets ``left`` x ``right`` are similar, by products of membership matrices over the tokens they share."""
    sizes = np.array([len(s) for s in sets])
    owner, token = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    _, at, times = np.unique(token, return_inverse=True, return_counts=True)
    shared = times[at] > 1
    owner, at = owner[shared], np.unique(at[shared], return_inverse=True)[1]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    common = np.zeros((len(left), len(right)), np.float32)
    wide = 2048
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, wide):
        a, b = np.searchsorted(at, [low, low + wide])
        member = np.zeros((len(sets), wide), np.float32)
        member[owner[a:b], at[a:b] - low] = 1
        other = member[right].T
        for row in range(0, len(left), 1024):
            common[row:row + 1024] += member[left[row:row + 1024]] @ other
    return common >= similarity * (sizes[left][:, None] + sizes[right][None, :] - common)


def merged(codes: np.ndarray, near: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each code the smallest one that it is connected to by ``near`` (left x right)."""
    low = np.arange(int(codes.max()) + 1, dtype=np.int32)
    while True:
        own, found = low[codes], low.copy()
        for a in range(0, len(left), 512):
            part = near[a:a + 512]
            rows, here = left[a:a + 512], own[left[a:a + 512]]
            np.minimum.at(found, codes[rows], np.where(part, own[right][None, :], here[:, None]).min(axis=1, initial=len(low)))
            np.minimum.at(found, codes[right], np.where(part, here[:, None], own[right][None, :]).min(axis=0, initial=len(low)))
        found = np.minimum(found, low)[np.minimum(found, low)]
        if (found == low).all():
            return low
        low = found


def _in_blocks(members: DataFrame, by: str, size: Column, block: int) -> DataFrame:
    """Every member once in each pair of blocks of its group that it belongs to: adds first, second and mine."""
    n = F.greatest(F.lit(1), F.ceil(size / F.lit(block))).cast("int")
    own = members.withColumn("blocks", n).withColumn("mine", F.pmod(F.xxhash64("v", F.lit("block")), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return own.select("*", other).select(by, "v", "label", "copies", "n", "mine", F.least("mine", "other").alias("first"), F.greatest("mine", "other").alias("second"))


def _sides(rows: pd.DataFrame, key: tuple) -> tuple[np.ndarray, np.ndarray]:
    mine = rows["mine"].to_numpy()
    return np.flatnonzero(mine == key[1]), np.flatnonzero(mine == key[2])


def _links_between(members: DataFrame, similarity: float) -> DataFrame:
    """Edges that connect the components of a bucket which similar members join, fewer than there are components."""

    def search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("v", ignore_index=True)
        sets = [np.frombuffer(t, "<u4") for t in rows["tokens"]]
        left, right = _sides(rows, key)
        codes = pd.factorize(rows["label"])[0].astype(np.int32)
        joined = merged(codes, similar(sets, left, right, similarity), left, right)
        first = rows["v"].to_numpy()[np.unique(codes, return_index=True)[1]]
        moved = np.flatnonzero(joined != np.arange(len(joined)))
        if len(rows) > _LARGE:
            give_back()
        return pd.DataFrame({"a": first[moved], "b": first[joined[moved]]})

    return members.groupBy("node", "first", "second").applyInPandas(search, "a BINARY, b BINARY")


def possible(sizes: np.ndarray, bits: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sets ``left`` x ``right`` may be similar, as their sketches tell."""
    out = np.empty((len(left), len(right)), bool)
    other = np.unpackbits(bits[right], axis=1).astype(np.float32).T * 2 - 1
    for row in range(0, len(left), 512):
        part = left[row:row + 512]
        signs = np.unpackbits(bits[part], axis=1).astype(np.float32) * 2 - 1
        differing = ((_BITS - signs @ other) / 2).astype(np.int64)
        out[row:row + 512] = _within(sizes[part][:, None], sizes[right][None, :], differing, similarity)
    return out


def _possible_members(members: DataFrame, similarity: float, rows_at_least: int) -> DataFrame:
    """The members of a group that may be similar to one of another component, by their sketches. Small groups are searched many at a time."""

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        names = ["node", "first", "second"]
        rows = rows.sort_values(names, ignore_index=True)
        keys, mine, sizes, bits = rows[names].to_numpy(), rows["mine"].to_numpy(), rows["size"].to_numpy(), _bits(rows["bits"])
        codes = pd.factorize(rows["label"])[0]
        borders = (np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()
        kept = []
        for a, b in zip([0, *borders], [*borders, len(rows)]):
            left, right = a + np.flatnonzero(mine[a:b] == keys[a, 1]), a + np.flatnonzero(mine[a:b] == keys[a, 2])
            near = possible(sizes, bits, left, right, similarity)
            near &= codes[left][:, None] != codes[right][None, :]
            kept.append(np.union1d(left[near.any(axis=1)], right[near.any(axis=0)]))
        if len(rows) > _LARGE:
            give_back()
        return rows.iloc[np.concatenate(kept)][["node", "v", "label", "mine", "first", "second"]]

    chunks = max(1, rows_at_least // _CHUNK)
    chunk = F.when(F.col("n") > _LARGE // 4, F.xxhash64("node", "first", "second")).otherwise(F.pmod(F.xxhash64("node"), F.lit(chunks)))
    kind = "node BIGINT, v BINARY, label BINARY, mine INT, first INT, second INT"
    return members.withColumn("chunk", chunk).groupBy("chunk").applyInPandas(search, kind)


def _link_counts(members: DataFrame, similarity: float) -> DataFrame:
    """For each vertex, the documents of other vertices of its component that are similar to it."""

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("v", ignore_index=True)
        left, right = _sides(rows, key)
        near = similar([np.frombuffer(t, "<u4") for t in rows["tokens"]], left, right, similarity)
        near &= left[:, None] != right[None, :]
        copies = rows["copies"].to_numpy(float)
        links = np.zeros(len(rows))
        links[left] += near @ copies[right]
        if key[1] != key[2]:
            links[right] += copies[left] @ near
        if len(rows) > _LARGE:
            del near
            give_back()
        return pd.DataFrame({"v": rows["v"], "links": links.round().astype("int64")})

    found = members.groupBy("label", "first", "second").applyInPandas(count, "v BINARY, links BIGINT")
    return found.groupBy("v").agg(F.sum("links").alias("links"))


def _linked(docs: DataFrame, words: int = 5, similarity: float = 0.8, recall: float = 0.999, depth: int = 3, bucket: int = 512,
            block: int = 4096, splits: int = 1, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """The documents' signatures, and of each set v: first_id (smallest doc_id), copies, label (of its class) and links."""
    runs = runs_for(recall, depth + _DEEPER * splits)
    signed = stored(_signatures(docs, words, similarity, depth, runs), "signatures")
    vertices = stored(signed.filter("v IS NOT NULL").groupBy("v").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.min("text_hash").alias("text_hash"), F.first("nodes").alias("nodes"))
        .withColumn("number", F.monotonically_increasing_id()), "vertices")
    # Most leaves hold one set only. Until those are gone, sets have short numbers, fixed by the written table.
    leaves = vertices.select("number", F.explode("nodes").alias("node"))

    def several(rows: DataFrame, member: str) -> DataFrame:
        """The rows of nodes with several, and of each its node's number of rows and a sign of its members; shuffled once."""
        here = Window.partitionBy("node")
        return rows.select("*", F.count("*").over(here).alias("n"), F.bit_xor(F.xxhash64(member)).over(here).alias("members")).filter("n > 1")

    several_sets = several(leaves, "number")
    shared = stored(several_sets.join(vertices.select("number", "v"), "number").drop("number"), "shared")
    company = stored(shared.groupBy("v").agg(F.sum(F.log2("n")).alias("company")), "company")

    # Of the texts with the same set one is enough.
    wanted = stored(vertices.select("v", "text_hash").join(company.select("v"), "v"), "wanted")
    met_sets = _token_sets(docs, wanted, words).join(wanted.select("v"), "v")
    tokens = stored(met_sets.groupBy("v").agg(F.first("tokens").alias("tokens")), "tokens")
    sketches = stored(_sketches(tokens), "sketches")

    def checked(pairs: DataFrame) -> DataFrame:
        # Written first: Spark then knows how few they are, and shuffles no token sets to them where it can send the pairs around.
        left = stored(_possible_pairs(stored(pairs, "pairs"), sketches, similarity), "pairs")
        tokens_a, tokens_b = (_among(tokens, left.select(F.col(x).alias("v"))).select(F.col("v").alias(x), F.col("tokens").alias(f"tokens_{x}")) for x in "ab")
        return _similar_pairs(left.join(tokens_a, "a").join(tokens_b, "b"), similarity)

    def one_partner(rows: DataFrame, weight: Column) -> DataFrame:
        """Pairs (a, b): every bucket offers its member of most weight, every vertex takes what is offered to it most often."""
        own = F.struct(weight.alias("weight"), "v", "label")
        offers = rows.groupBy("node").agg(F.max(own).alias("offer"))
        met = rows.join(offers, "node").filter((F.col("offer.v") != F.col("v")) & ((F.col("offer.label") != F.col("label")) | F.col("label").isNull()))
        times = met.groupBy(F.col("v").alias("a"), F.col("offer.v").alias("b")).agg(F.count("*").alias("times"), F.max("offer.weight").alias("weight"))
        return times.groupBy("a").agg(F.max(F.struct("times", "weight", "b")).alias("best")).select("a", "best.b")

    met = shared.join(company, "v").select("node", "v", "company", F.lit(None).cast("binary").alias("label"))
    edges = stored(checked(one_partner(met, F.col("company"))), "confirmed")
    labels = stored(_labelled(company, components(edges)), "labels")

    def unresolved(rows: DataFrame) -> DataFrame:
        """Members (node, n, members, v, label) of the buckets that hold several components."""
        with_label = rows.join(labels, "v")
        mixed_nodes = with_label.groupBy("node").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high")
        return stored(with_label.join(mixed_nodes.select("node"), "node", "left_semi"), "unresolved")

    def once(rows: DataFrame) -> DataFrame:
        """One bucket of each set of members; only for those that are searched, as splitting needs every run."""
        chosen = rows.groupBy("n", "members").agg(F.min("node").alias("node")).select("node")
        return rows.join(chosen, "node", "left_semi").withColumn("copies", F.lit(1))

    open_buckets, searched = unresolved(shared), []
    for turn in range(rounds):
        found = stored(checked(one_partner(open_buckets, F.xxhash64("v", F.lit(turn)))), "confirmed")
        if found.isEmpty():
            break
        edges = edges.union(found)
        labels = stored(_labelled(company, components(stored(edges, "edges"))), "labels")
        open_buckets = unresolved(open_buckets.drop("label"))
    for _ in range(splits):
        large = open_buckets.filter(F.col("n") > bucket)
        if large.isEmpty():
            break
        searched.append(once(open_buckets.filter(F.col("n") <= bucket)))
        large = large.select("v", "node")
        deeper = stored(_deeper(large.join(_among(tokens, large), "v"), similarity), "deeper")
        open_buckets = unresolved(several(deeper, "v"))
    searched.append(once(open_buckets))
    for s in searched:
        found = stored(_possible_members(_in_blocks(s, "node", F.col("n"), block).join(sketches, "v"), similarity, s.count()), "possible")
        edges = edges.union(_links_between(found.join(_among(tokens, found), "v"), similarity))
    labels = stored(_labelled(company, components(stored(edges, "edges"))), "labels")

    sizes = labels.groupBy("label").agg(F.count("*").alias("n")).filter("n > 1")
    grouped = labels.join(sizes, "label").join(vertices.select("v", "copies"), "v")
    links = _link_counts(_in_blocks(grouped, "label", F.col("n"), block).join(_among(tokens, grouped), "v"), similarity)
    linked = vertices.drop("nodes", "number", "text_hash").join(labels, "v", "left").join(links, "v", "left").select(
        "v", "first_id", "copies", F.coalesce("label", "v").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
    return signed, stored(linked, "linked")


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, **settings: float) -> DataFrame:
    """One row per document: doc_id, class_id (its class's smallest doc_id), n_links (similar documents), n_copies (of its set)."""
    signed, linked = _linked(docs, words, similarity, **settings)
    classes = linked.groupBy("label").agg(F.min("first_id").alias("class_id"))
    named_classes = linked.join(classes, "label").select("v", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"))
    joined = signed.select("doc_id", "v").join(named_classes, "v", "left")
    alone = F.col("v").isNull()
    return joined.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                         F.when(alone, 0).otherwise(F.col("n_links")).cast("bigint").alias("n_links"),
                         F.when(alone, 1).otherwise(F.col("n_copies")).cast("bigint").alias("n_copies"))


def _labelled(vertices: DataFrame, found: DataFrame) -> DataFrame:
    return vertices.select("v").join(found, "v", "left").select("v", F.coalesce("label", "v").alias("label"))


def set_name(texts: pa.Array, words: int) -> pa.Array:
    """The 128-bit names of the texts' sets, null without words, as in the signatures."""
    names = []
    for batch in steps([pa.RecordBatch.from_arrays([texts], ["text"])], "text", STEP_BYTES):
        h, borders = shingle_sets(batch.column("text"), words)
        names += [_named(h[a:b]) if b > a else None for a, b in zip(borders[:-1].tolist(), borders[1:].tolist())]
    return pa.array(names, pa.binary())


def first_of_each_class(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of ``docs`` from each class, all columns: of its smallest doc_id (null only if it has no other), of that one's smallest
    set name, and of rows with both in common the smallest text hash. Rows without words are no copies of each other and all stay."""
    _, linked = _linked(docs, words, similarity)
    chosen = linked.groupBy("label").agg(F.min(F.struct(F.col("first_id").isNull(), "first_id", "v")).alias("first"))
    chosen = chosen.select(F.col("first.v").alias("v"), F.col("first.first_id").alias("first_id"))
    has_words = text_or_empty().rlike(WORD)
    name = F.arrow_udf(lambda texts: set_name(texts, words), "binary")
    # A row travels as one column, so that none of its names can clash with those used here.
    named = docs.filter(has_words).select(F.struct(*docs.columns).alias("row"), name(F.col("text")).alias("own"))
    same = (F.col("own") == F.col("v")) & F.col("row.doc_id").eqNullSafe(F.col("first_id"))
    turn = F.row_number().over(Window.partitionBy("v").orderBy(F.xxhash64("row.text"), "row.text"))
    kept = named.join(chosen, same).withColumn("turn", turn).filter("turn = 1")
    return kept.select("row.*").unionByName(docs.filter(~has_words))
