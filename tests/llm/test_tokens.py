"""Packing and token files against direct encoding."""

from __future__ import annotations

import random
import unicodedata
import zlib
from unittest import mock

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tremorlake.llm import packing, token_files
from tremorlake.llm.elias_fano import EliasFano
from tremorlake.llm.tokens import PieceEncoder
from tremorlake.session import shared_path

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "  a", "a  b", "a \n b", "x\n", "don't we'll 's", "\x1f a", "<|endoftext|> a", "H̱ ẖ", "Å",
       "Σ ΣΣ.", "tab\t\t a \t b", "≠ x", "﷐ a b", "123 45", "".join(map(chr, range(0xFDD0, 0xFDF0))) + " a b"]


def direct(path: str, texts, end_id: int) -> list[list[int]]:
    tokenizer = Tokenizer.from_file(path)
    return [e.ids + [end_id] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize(("path", "drops"), [(BYTE, False), (WORD, True)])
@pytest.mark.parametrize("remembered", [0, 600_000])
def test_pieces_give_the_ids_of_whole_texts(path, drops, remembered):
    rnd = random.Random(3)
    signs = " \n\t\r ab'sE1.,  \x85\x1f\x0b-　́﷐"
    texts = ODD[:-1] + ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 25))) for _ in range(3000)]
    encoder = PieceEncoder(path, drops, remembered)
    for part in (texts, texts[::-1], ODD):
        ids, borders = encoder.encode(pa.array(part, pa.string()), 9)
        assert [ids[a:b].tolist() for a, b in zip(borders, borders[1:])] == direct(path, part, 9)


@pytest.mark.parametrize(("path", "drops"), [(BYTE, False), (WORD, True)])
def test_every_letter_in_front_of_signs(path, drops):
    letters = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if unicodedata.category(c)[0] in "LN"]
    signs = ".-,|("
    texts = [f"K{c}{signs[i % len(signs)]}1 {c}{signs[(i + 1) % len(signs)]}" for i, c in enumerate(letters)]
    encoder = PieceEncoder(path, drops)
    for i in range(0, len(texts), 20_000):
        part = texts[i:i + 20_000]
        ids, borders = encoder.encode(pa.array(part), 9)
        assert [ids[a:b].tolist() for a, b in zip(borders, borders[1:])] == direct(path, part, 9)


@pytest.mark.parametrize(("path", "drops"), [(BYTE, False), (WORD, True)])
def test_added_tokens_in_texts(path, drops):
    rnd = random.Random(9)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", " a", "B.", " ", "\n", "'s"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9))) for _ in range(2000)]
    ids, borders = PieceEncoder(path, drops).encode(pa.array(texts), 9)
    assert [ids[a:b].tolist() for a, b in zip(borders, borders[1:])] == direct(path, texts, 9)


def test_elias_fano_select():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 0), (1, 2**40), (3, 0), (5000, 10), (5000, 2**33)):
        x = np.sort(rng.integers(0, top + 1, n)).astype(np.uint64)
        code = EliasFano.of(x)
        at = rng.integers(0, n, 300) if n else np.empty(0, np.int64)
        assert (code.select(at) == x[at]).all()
        if n == 5000:
            bits = 8 * (len(code.low) + len(code.high) + len(code.ranks)) / n
            assert bits < 2.3 + np.log2(max(top / n, 1)) + 0.5


def test_swaps_empty_bins_that_best_fit_leaves():
    rng = np.random.default_rng(1)
    saved = 0
    for _ in range(60):
        lengths = rng.choice([rng.integers(1, 101), 26, 27, 34, 35, 51, 38, 60], 60).astype(np.int64)
        number, offset = packing.pack_lengths(lengths, 100)
        fills = np.bincount(number, weights=lengths)
        assert fills.max() <= 100 and fills.min() > 0
        for b in range(number.max() + 1):
            mine = np.flatnonzero(number == b)
            order = mine[np.argsort(offset[mine])]
            assert (offset[order] == np.concatenate([[0], np.cumsum(lengths[order])[:-1]])).all()
        saved += len(packing._Bins(lengths, 100).fill) - len(fills)
    assert saved > 0


def test_each_step_raises_the_squared_fill():
    rng = np.random.default_rng(2)
    for _ in range(30):
        bins = packing._Bins(rng.integers(20, 61, 50).astype(np.int64), 100)
        for b in bins.underfull:
            while bins.fill[b] and bins.fill[b] < 100 and (found := bins._best(b)):
                was = sum(f * f for f in bins.fill)
                taken, given = found[1]
                for n, a in taken:
                    bins._move(n, a, b)
                for n in given:
                    bins._move(n, b, taken[0][1])
                assert sum(f * f for f in bins.fill) > was and bins.fill[b] <= 100


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD[:-1])] + [(None, "no id", "y"), (3, "again", "z"), (3, "again", "z"), (99, "word " * 3000, None)]
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING, piece STRING")  # a column of a clashing name


def test_memory_goes_back_behind_each_step(monkeypatch):
    """A worker that gives memory back only behind its last row grows with each step."""
    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, cut, schema):
            return cut

    events = []
    monkeypatch.setattr(packing, "F", mock.MagicMock())
    monkeypatch.setattr(packing, "STEP_BYTES", 10)
    monkeypatch.setattr(packing, "give_back", lambda: events.append("back"))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["some words", "and more", None])], ["doc_id", "text"])
    for out in packing.token_pieces(Docs(), 64, BYTE, 0)(iter([batch])):
        events.append(out.column("doc_id").to_pylist())
    assert events == [[1], "back", [2, 3], "back"]


def test_packing(spark, docs):
    rows = packing.pack(packing.token_pieces(docs, 64, BYTE, 0), 64, docs.count(), docs_per_group=8).toPandas()
    wanted = {}
    for d, t in docs.select("doc_id", "text").collect():
        ids = direct(BYTE, [t], 0)[0]
        cuts = [0, *range(packing.first_length(len(ids), 64), len(ids) + 1, 64)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            wanted.setdefault((d if d is not None else -1, i), []).append((a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    found = {}
    for r in rows.fillna({"doc_id": -1}).itertuples():
        found.setdefault((int(r.doc_id), r.piece), []).append((r.start, r.length, r.ids_crc32))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in wanted.items()}
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 64 and (s.offset.to_numpy() == np.concatenate([[0], s.length.cumsum()[:-1]])).all()
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 64) + 3


def test_sequences_hold_the_ids(spark, docs):
    unique = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    pieces = packing.token_pieces(unique, 64, BYTE, 0, with_ids=True)
    placed = packing.pack(pieces, 64, 20)
    held = {r.sequence_id: r.ids for r in packing.sequences(pieces, placed).collect()}
    for r in placed.collect():
        assert zlib.crc32(np.array(held[r.sequence_id][r.offset:r.offset + r.length], "<u4").tobytes()) == r.ids_crc32


@pytest.mark.parametrize("block_ids", [1, 50, 1 << 20])
def test_token_files(spark, docs, block_ids):
    path = shared_path(spark, "test-files")
    token_files.write_token_files(docs, path, WORD, 2, True, block_ids)
    rows = token_files.read_token_files(spark, path, with_ids=True).toPandas().sort_values("start")
    ids = [d if d == d else None for d in rows.doc_id]
    assert ids == sorted((r.doc_id for r in docs.collect()), key=lambda d: (d is not None, d or 0))
    assert (rows.start.to_numpy() == np.concatenate([[0], rows.n_tokens.cumsum()[:-1]])).all()
    wanted = sorted(direct(WORD, [r.text for r in docs.collect()], 2))
    assert sorted(x.tolist() for x in rows.ids) == wanted
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.n_tokens for r in rows.itertuples())


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert packing.pack(packing.token_pieces(none, 64, BYTE, 0), 64, 0).count() == 0
    path = shared_path(spark, "test-empty")
    token_files.write_token_files(none, path, WORD, 2)
    assert token_files.read_token_files(spark, path).count() == 0


def test_rows_without_ids_are_spread_over_groups(spark):
    """Null doc_ids with different texts, and rows that are equal in everything."""
    rows = [(None, f"text {i}") for i in range(400)] + [(None, "the same")] * 400 + [(5, "more")] * 200
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    pieces = packing.token_pieces(docs, 64, BYTE, 0)
    placed = packing.pack(pieces, 64, len(rows), docs_per_group=50).toPandas()
    sizes = (placed.sequence_id // 2**32).value_counts()
    assert len(sizes) == 20 and sizes.max() < 100
    assert placed.groupby("sequence_id")["length"].sum().max() <= 64
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    before, after = (sorted(map(tuple, x[columns].fillna(-1).to_numpy().tolist())) for x in (pieces.toPandas(), placed))
    assert before == after
