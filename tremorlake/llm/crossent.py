"""Cross-entropy difference: how much better a target model predicts a text than a background model does.

Two bigram models of lower-cased words share one vocabulary, the words that the target holds at least twice; all others are one
unknown word. The target model counts the target documents, the background model all documents, both completely. The background's
counts are scaled to the target's number of words, so that the matched models smooth alike: with c a count and k a constant,
p(w) = (c(w) + 1) / (n + vocabulary) and p(w | v) = (c(v, w) + k p(w)) / (c(v) + k). A text's score is the mean of its words'
differences of loss, target less background: the lower, the more the text is like the target.

No text is scored by models that have counted it: documents fall into two folds by a hash of their doc_id, and each fold is scored
by the models of the other.

Words and pairs are counted exactly, as text and as pairs of numbers of known words. Documents are tokenized once, into blocks of
about 16 MB of text of one fold. A block sends its distinct words, by ranges of their hashes, to where a range's counts are added up
and its known words numbered, and gets their numbers and counts back; then the same with its distinct pairs of known words. Ranges
are cut evenly from the amount of text, and a block sends each word or pair once, so frequent ones make no large group. Blocks and
the words' answers are written to the shared folder; only sums over the ranges (eleven numbers) come to the driver.

Nulls: a null or empty text has 0 words, losses and score 0. A null doc_id is scored, and is no target. Repeated rows count and
are scored each. Without target documents both models know no word and scores are near 0. Empty tables give no rows. Columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import parts, text_or_empty

BLOCK_BYTES = 16 << 20
LEAST_RANGES = 64
PRIOR_WORDS, LEAST = 50.0, 2


def _blob(*arrays: np.ndarray | bytes) -> bytes:
    small = [x if isinstance(x, bytes) or not len(x) else x.astype(np.min_scalar_type(int(x.max()))) for x in arrays]
    raw = pickle.dumps(small, 5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _arrays(blob: bytes) -> list:
    """int64, whatever they were kept as."""
    found = pickle.loads(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True))
    return [x if isinstance(x, bytes) else x.astype(np.int64) for x in found]


def _cut(of: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The runs of equal values."""
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(of)]):
        yield int(of[start]), slice(start, end)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of each text, all words in a row by their places among the distinct ones, and these."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.cast(pc.fill_null(texts, ""), pa.large_string())), r"[\t-\r ]+")
    coded = lists.flatten().dictionary_encode()
    codes, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    text = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy().astype(np.int64)))
    empty = pc.index(names, "").as_py()  # at the ends of a text
    if empty >= 0:
        real = codes != empty
        text, codes = text[real], codes[real]
        codes = codes - (codes > empty)
        names = pa.concat_arrays([names.slice(0, empty), names.slice(empty + 1)])
    return np.bincount(text, minlength=len(texts)), codes, names


def fold_of(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(2)).cast("int")


_WORDS = "block BIGINT, fold INT, at INT, data BINARY"


def blocks(docs: DataFrame, in_target: Column, ranges: int, kind: str) -> DataFrame:
    """Documents (at = -1) and distinct words (by range) of each block: block, fold, at, ids, data."""
    schema = pa.schema([("block", pa.int64()), ("fold", pa.int32()), ("at", pa.int32())])

    def tokenize(held: list[pa.RecordBatch], block: int, fold: int) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        sizes, codes, names = words_of(rows.column("text").combine_chunks())
        chosen = rows.column("target").to_numpy()
        hashed = np.fromiter((xxhash.xxh64_intdigest(w) % ranges for w in names.to_pylist()), np.int64, len(names))
        order = np.argsort(hashed, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        seq = place[codes]
        everything = np.bincount(seq, minlength=len(order))
        target = np.bincount(seq[np.repeat(chosen, sizes)], minlength=len(order))
        names = names.take(pa.array(order))
        ids = rows.column("doc_id").combine_chunks()
        out = [(-1, ids, _blob(sizes, chosen.astype(np.int64), seq))]
        for at, run in _cut(hashed[order]):
            out.append((at, None, _blob("\n".join(names[run.start:run.stop].to_pylist()).encode(), target[run], everything[run])))
        none = ids.slice(0, 0)
        for at, its, data in out:
            its = none if its is None else its
            listed = pa.LargeListArray.from_arrays(pa.array([0, len(its)], pa.int64()), its).cast(pa.list_(its.type))
            yield pa.RecordBatch.from_arrays([pa.array([block], schema.field(0).type), pa.array([fold], schema.field(1).type), pa.array([at], schema.field(2).type), listed, pa.array([data], pa.binary())], ["block", "fold", "at", "ids", "data"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, done = TaskContext.get().partitionId() << 32, 0
        held, size = ([], []), [0, 0]
        for batch in batches:
            for f in (0, 1):
                mine = batch.filter(pc.equal(batch.column("fold"), f))
                start, lengths = 0, pc.binary_length(mine.column("text")).to_numpy(zero_copy_only=False)
                for i, n in enumerate(lengths.tolist()):
                    if size[f] and size[f] + n > BLOCK_BYTES:
                        held[f].append(mine.slice(start, i - start))
                        yield from tokenize(held[f], first + done, f)
                        held[f].clear()
                        start, size[f], done = i, 0, done + 1
                    size[f] += n
                if start < mine.num_rows:
                    held[f].append(mine.slice(start))
        for f in (0, 1):
            if held[f]:
                yield from tokenize(held[f], first + done, f)
                done += 1

    rows = docs.select("doc_id", text_or_empty().alias("text"), F.coalesce(in_target, F.lit(False)).alias("target"), fold_of().alias("fold"))
    return rows.mapInArrow(cut, f"block BIGINT, fold INT, at INT, ids ARRAY<{kind}>, data BINARY")


#: Of either fold: words of the target and of all, known words, and how often target and all hold these.
_SUMS = [f"{what}_{f}" for f in (0, 1) for what in ("target", "all", "known", "target_known", "all_known")]


def _rows(table: pa.Table) -> list[tuple[int, int, list]]:
    return [(b, f, _arrays(x)) for b, f, x in zip(*(table.column(c).to_pylist() for c in ("block", "fold", "data")))]


def number_words(words: DataFrame, ranges: int) -> DataFrame:
    """For each block's words of a range, in their order: number + 1 (0: unknown to both folds), folds that know it as bits, and the
    other fold's counts. A row without a block has the range's sums."""

    def number(table: pa.Table) -> pa.Table:
        at, rows = table.column("at")[0].as_py(), _rows(table)
        listed = [pc.split_pattern(pa.array([x[0].decode()], pa.large_string()), "\n").flatten() for _, _, x in rows]
        coded = pa.concat_arrays(listed).dictionary_encode()
        codes, n = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)
        counts = np.zeros((2, 2, n), np.int64)  # fold, target or all
        start, places = 0, []
        for (_, f, (_, target, everything)), names in zip(rows, listed):
            places.append(place := codes[start:start + len(names)])
            start += len(names)
            counts[f, 0, place] += target  # a block has each word once
            counts[f, 1, place] += everything
        known = counts[:, 0] >= LEAST
        some = known.any(axis=0)
        numbers = np.where(some, (np.cumsum(some) - 1) * ranges + at + 1, 0)
        bits = known[0] + 2 * known[1]
        out = [(b, f, at, _blob(numbers[p], bits[p], *(np.where(known[1 - f], counts[1 - f, w], 0)[p] for w in (0, 1))), None) for (b, f, _), p in zip(rows, places)]
        sums = [int(x) for f in (0, 1) for x in (counts[f, 0].sum(), counts[f, 1].sum(), known[f].sum(), counts[f, 0][known[f]].sum(), counts[f, 1][known[f]].sum())]
        out.append((None, None, at, None, [*sums, int(some.sum())]))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())))], ["block", "fold", "at", "data", "sums"])

    return words.groupBy("at").applyInArrow(number, f"{_WORDS}, sums ARRAY<BIGINT>")


class Block:
    """A block's documents with what is known of their words."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("at")  # the documents, then the words by ranges
        self.block, self.fold = table.column("block")[0].as_py(), table.column("fold")[0].as_py()
        self.ids = table.column("ids").combine_chunks()[0].values
        first, *rest = [_arrays(x) for x in table.column("data").to_pylist()]
        self.sizes, self.chosen, self.seq = first
        nothing = np.zeros(0, np.int64)
        self.numbers, self.bits, *self.counts = [np.concatenate([nothing, *x]) for x in zip(*rest)] if rest else [nothing] * 4
        self.text = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def known(self, fold: int) -> np.ndarray:
        return (self.bits >> fold & 1).astype(bool)

    def pairs(self, ranges: int, most: int) -> tuple[np.ndarray, ...]:
        """Places in the row of the later words of all pairs that a fold knows both words of, and each pair's place among the distinct
        ones; these, ordered by range and key, with their ranges."""
        spot = np.flatnonzero(np.diff(self.text) == 0) + 1
        a, b = self.seq[spot - 1], self.seq[spot]
        use = (self.bits[a] & self.bits[b]) > 0
        spot = spot[use]
        local, inverse = np.unique(a[use] * max(1, len(self.bits)) + b[use], return_inverse=True)
        a, b = (self.numbers[x] - 1 for x in np.divmod(local, max(1, len(self.bits))))
        at, key = (a + b) % ranges, a * most + b // ranges  # at and a give b's range, b // ranges its rank there
        order = np.lexsort((key, at))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return spot, place[inverse], key[order], at[order]


def ask_pairs(known: DataFrame, ranges: int, most: int) -> DataFrame:
    """Of each block and range: distinct pairs with their counts in the target and in all."""

    def ask(table: pa.Table) -> pa.Table:
        block = Block(table)
        spot, pair, key, at = block.pairs(ranges, most)
        everything = np.bincount(pair, minlength=len(key))
        target = np.bincount(pair[block.chosen[block.text[spot]] > 0], minlength=len(key))
        out = [(block.block, block.fold, r, _blob(np.diff(key[run], prepend=0), target[run], everything[run])) for r, run in _cut(at)]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["block", "fold", "at", "data"])

    return known.groupBy("block").applyInArrow(ask, _WORDS)


def answer_pairs(asked: DataFrame) -> DataFrame:
    """For each block's pairs of a range, in their order: the other fold's counts."""

    def answer(table: pa.Table) -> pa.Table:
        at, rows = table.column("at")[0].as_py(), _rows(table)
        keys = [np.cumsum(x[0]) for _, _, x in rows]
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.zeros((2, 2, len(distinct)), np.int64)
        places = np.split(inverse, np.cumsum([len(x) for x in keys])[:-1])
        for (_, f, (_, target, everything)), place in zip(rows, places):
            counts[f, 0, place] += target
            counts[f, 1, place] += everything
        out = [(b, f, at, _blob(*(counts[1 - f, w][p] for w in (0, 1)))) for (b, f, _), p in zip(rows, places)]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["block", "fold", "at", "data"])

    return asked.groupBy("at").applyInArrow(answer, _WORDS)


def score_block(block: Block, pair_counts: pa.Table, sums: dict[str, int], ranges: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: words, and the mean losses of target and background, by the models of the other fold."""
    other = 1 - block.fold
    spot, pair, key, _ = block.pairs(ranges, most)
    answers = [_arrays(x) for x in pair_counts.sort_by("at").column("data").to_pylist()] if pair_counts.num_rows else []
    known, k = block.known(other), PRIOR_WORDS
    target, everything = sums[f"target_{other}"], sums[f"all_{other}"]
    total, vocabulary = max(target, 1), sums[f"known_{other}"] + 1
    seq, n = block.seq, np.bincount(block.text, minlength=len(block.sizes))
    before = np.concatenate([seq[:1], seq[:-1]])
    both = known[seq] & known[before] & (np.diff(block.text, prepend=-1) == 0)  # nothing stands before a first word
    mean = []
    for w, which in enumerate(("target", "all")):
        scale = 1.0 if which == "target" else target / everything if everything else 0.0
        words = block.counts[w] * scale
        alone = (np.where(known[seq], words[seq], max(total - sums[f"{which}_known_{other}"] * scale, 0.0)) + 1.0) / (total + vocabulary)
        held = np.where(both, words[before], 0.0)
        together = np.zeros(len(seq))
        if len(key):
            together[spot] = np.concatenate([x[w] for x in answers])[pair] * scale
        losses = -np.log((np.where(both, together, 0.0) + k * alone) / (held + k))
        mean.append(np.bincount(block.text, losses, len(block.sizes)) / np.maximum(n, 1))
    return n, mean[0], mean[1]


def score_documents(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, target_loss, background_loss, score. ``target_ids``: doc_id."""
    ids = target_ids.select(F.col("doc_id").alias("target_id")).filter("target_id IS NOT NULL").distinct()
    # The target's ids grow with the documents, so the texts are shuffled to them, whatever their number.
    flagged = docs.select("doc_id", "text").join(ids.hint("merge"), F.col("doc_id") == F.col("target_id"), "left")
    kind = docs.schema["doc_id"].dataType.simpleString()
    ranges = max(LEAST_RANGES, parts(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, BLOCK_BYTES))
    found = stored(blocks(flagged, F.col("target_id").isNotNull(), ranges, kind), "blocks")
    numbered = stored(number_words(found.filter("at >= 0").select("block", "fold", "at", "data"), ranges), "words")
    row = numbered.agg(*(F.sum(F.col("sums")[i]).alias(name) for i, name in enumerate(_SUMS)), F.max(F.col("sums")[len(_SUMS)]).alias("most")).first()
    sums, most = {name: int(row[name] or 0) for name in _SUMS}, int(row["most"] or 0) + 1

    answers = numbered.filter("block IS NOT NULL").select("block", "fold", "at", F.lit(None).cast(f"array<{kind}>").alias("ids"), "data")
    known = found.filter("at < 0").unionByName(answers)
    pairs = answer_pairs(ask_pairs(known, ranges, most))

    def score(table: pa.Table, counts: pa.Table) -> pa.Table:
        block = Block(table)
        n, target, background = score_block(block, counts, sums, ranges, most)
        columns = [block.ids, pa.array(n, pa.int64()), pa.array(target), pa.array(background), pa.array(target - background)]
        return pa.table(columns, ["doc_id", "n_words", "target_loss", "background_loss", "score"])

    return known.groupBy("block").cogroup(pairs.groupBy("block")).applyInArrow(
        score, f"doc_id {kind}, n_words BIGINT, target_loss DOUBLE, background_loss DOUBLE, score DOUBLE")
