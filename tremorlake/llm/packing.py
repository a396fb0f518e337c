"""Packing documents into sequences of a fixed number of tokens, improved by swaps between underfull sequences.

A document longer than a sequence is cut into full pieces behind one shorter first piece. Pieces are dealt at random,
by a hash of the row and a number for repeated rows, into groups of a bounded number of documents; each group is packed best-fit, longest first, and then improved: moves, exchanges of
one for one and of two for one between underfull bins, each of which raises the sum of squared fills, so that the fuller of two
bins fills up and the other empties. A group costs at most one or two bins beyond what its tokens need.

Nulls: a null text is a document of its end id alone; a null doc_id is kept. Repeated rows are packed once each. Empty tables
give no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, parts, steps
from .tokens import PieceEncoder

STEP_BYTES = 4 << 20
_PIECE = "doc_id BIGINT, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT"


@functools.cache
def _encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def first_length(tokens: int, capacity: int) -> int:
    """Tokens of a document's first piece; the further pieces are full."""
    return tokens if tokens <= capacity else (tokens % capacity or capacity)


def _cut_batch(batch: pa.RecordBatch, encoder: PieceEncoder, capacity: int, end_id: int, with_ids: bool) -> pa.RecordBatch:
    ids, borders = encoder.encode(batch.column("text"), end_id)
    raw = ids.astype("<u4", copy=False)
    lengths = np.diff(borders)
    first = np.where(lengths <= capacity, lengths, (lengths - 1) % capacity + 1)
    counts = 1 + (lengths - first) // capacity
    row = np.repeat(np.arange(len(lengths)), counts)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
    length = np.where(piece == 0, first[row], capacity)
    at = borders[:-1][row] + start
    crc = [zlib.crc32(raw[a:a + n]) for a, n in zip(at.tolist(), length.tolist())]
    columns = [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
               pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if with_ids:
        columns.append(pa.array([raw[a:a + n] for a, n in zip(at.tolist(), length.tolist())], pa.list_(pa.int32())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names)


def token_pieces(docs: DataFrame, capacity: int, tokenizer: str, end_id: int, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in steps(batches, "text", STEP_BYTES):
            yield _cut_batch(batch, encoder, capacity, end_id, with_ids)
            give_back()  # else a worker grows by some 10 MB with each step

    schema = _PIECE + (", ids ARRAY<INT>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


class _Bins:
    """Bins of lengths with an index from each length to the underfull bins that hold it."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.capacity = capacity
        self.items: list[dict[int, list[int]]] = []  # per bin: length -> pieces
        self.fill: list[int] = []
        self.holders: list[dict[int, None]] = [{} for _ in range(capacity + 1)]
        self.present = 0  # bit n: some underfull bin holds a piece of length n
        open_by_slack: list[list[int]] = [[] for _ in range(capacity + 1)]
        slacks = 0
        for i in np.argsort(-lengths, kind="stable").tolist():
            n = int(lengths[i])
            fitting = slacks >> n
            if fitting:
                slack = n + (fitting & -fitting).bit_length() - 1
                b = open_by_slack[slack].pop()
                if not open_by_slack[slack]:
                    slacks ^= 1 << slack
            else:
                slack, b = capacity, len(self.fill)
                self.items.append({})
                self.fill.append(0)
            self.items[b].setdefault(n, []).append(i)
            self.fill[b] += n
            if slack > n:
                open_by_slack[slack - n].append(b)
                slacks |= 1 << (slack - n)
        # Emptier bins come last in each index entry, and are the ones taken from.
        self.underfull = sorted((b for b, f in enumerate(self.fill) if f < capacity), key=lambda b: -self.fill[b])
        for b in self.underfull:
            for n in self.items[b]:
                self._show(n, b)

    def _show(self, n: int, b: int) -> None:
        self.holders[n][b] = None
        self.present |= 1 << n

    def _hide(self, n: int, b: int) -> None:
        self.holders[n].pop(b, None)
        if not self.holders[n]:
            self.present &= ~(1 << n)

    def _move(self, n: int, a: int, b: int) -> None:
        held = self.items[a][n]
        self.items[b].setdefault(n, []).append(held.pop())
        if not held:
            del self.items[a][n]
            self._hide(n, a)
        self._show(n, b)
        self.fill[a] -= n
        self.fill[b] += n

    def _donor(self, n: int, b: int, gain: int) -> int | None:
        """The emptiest known bin other than ``b`` that holds ``n`` and from which ``gain`` tokens raise the squared fills."""
        for a in reversed(self.holders[n]):
            if a != b and self.fill[b] + gain > self.fill[a]:
                return a
        return None

    def _largest(self, low: int, high: int) -> Iterator[int]:
        """Lengths that underfull bins hold, from high down to above low."""
        found = (self.present & ((1 << (high + 1)) - 1)) >> (low + 1)
        while found:
            top = found.bit_length() - 1
            yield low + 1 + top
            found ^= 1 << top

    def _best(self, b: int) -> tuple[int, tuple] | None:
        """The step that fills bin ``b`` most: (gain, (lengths in with their bins, lengths out))."""
        slack, best = self.capacity - self.fill[b], None
        low = 0

        def better(gain: int, step: tuple) -> bool:
            nonlocal best, low
            best, low = (gain, step), gain
            return gain == slack

        for n in self._largest(0, slack):  # a move
            if (a := self._donor(n, b, n)) is not None:
                if better(n, ([(n, a)], [])):
                    return best
                break
        own = sorted(self.items[b])
        for out in own:  # one for one
            for n in self._largest(out + low, min(out + slack, self.capacity)):
                if (a := self._donor(n, b, n - out)) is not None:
                    if better(n - out, ([(n, a)], [out])):
                        return best
                    break
        for i, x in enumerate(own):  # two of this bin for one
            for y in own[i if len(self.items[b][x]) > 1 else i + 1:]:
                if x + y + slack > self.capacity + slack:
                    break
                for n in self._largest(x + y + low, min(x + y + slack, self.capacity)):
                    if (a := self._donor(n, b, n - x - y)) is not None:
                        if better(n - x - y, ([(n, a)], [x, y])):
                            return best
                        break
        for out in own:  # two of another bin for one, the pair as full as possible
            for n in self._largest(0, out + slack):
                if n * 2 <= out + low:
                    break
                a = self._donor(n, b, slack)
                if a is None:
                    continue
                for m in sorted(self.items[a], reverse=True):
                    gain = n + m - out
                    if gain <= low:
                        break
                    if gain <= slack and (m != n or len(self.items[a][n]) > 1) and self.fill[b] + gain > self.fill[a]:
                        if better(gain, ([(n, a), (m, a)], [out])):
                            return best
                        break
        return best

    def improve(self) -> None:
        """Fill underfull bins, the fullest first, as long as a step raises the sum of squared fills."""
        for b in self.underfull:
            if not self.fill[b]:
                continue
            while self.fill[b] < self.capacity and (found := self._best(b)):
                taken, given = found[1]
                a = taken[0][1]
                for n, _ in taken:
                    self._move(n, a, b)
                for n in given:
                    self._move(n, b, a)
            for n in list(self.items[b]):  # this bin is done: others don't take from it
                self._hide(n, b)


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A bin number from 0 without gaps, and the offset in it, for each length (1 to ``capacity``)."""
    bins = _Bins(lengths, capacity)
    bins.improve()
    number, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    b = 0
    for items in bins.items:
        at = 0
        for n in sorted(items, reverse=True):
            for i in sorted(items[n]):
                number[i], offset[i] = b, at
                at += n
        b += at > 0
    return number, offset


def _dealt(pieces: DataFrame, groups: int) -> DataFrame:
    """The pieces with pack_group from a hash of the whole row and, of rows that are equal in everything, their number: neither rows
    without a doc_id nor repeated ones meet in one group."""
    run = 1 << 16
    counted = pieces.groupBy(*pieces.columns).agg(F.count("*").alias("pack_rows"))
    runs = counted.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(pack_rows - 1) div {run}"))).alias("pack_run"))
    left = F.least(F.lit(run), F.col("pack_rows") - F.col("pack_run") * run)
    rows = runs.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), left)).alias("pack_turn"))
    return rows.select(*pieces.columns, F.pmod(F.xxhash64(*pieces.columns, "pack_run", "pack_turn"), F.lit(groups)).alias("pack_group"))


def pack(pieces: DataFrame, capacity: int, n_docs: int, docs_per_group: int = 4096) -> DataFrame:
    """The pieces with sequence_id and offset. A group holds about as many pieces as ``docs_per_group`` documents have."""
    groups = parts(n_docs, docs_per_group)
    columns = [c for c in pieces.columns if c != "ids"]

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="pack_group").sort_values(["doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        number, offset = pack_lengths(rows["length"].to_numpy(), capacity)
        give_back()
        return rows.assign(sequence_id=(int(key[0]) << 32) + number, offset=offset)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(columns).schema)
    grouped = _dealt(pieces.select(*columns), groups)
    return grouped.groupBy("pack_group").applyInPandas(packed, f"{schema}, sequence_id BIGINT, offset BIGINT")


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id and ids. Needs pieces made ``with_ids`` and unique doc_ids."""
    joined = pieces.join(placed.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])
    held = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most one sequence's tokens
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(held, lambda x: x["ids"])).alias("ids"))
