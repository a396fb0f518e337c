"""Backtracking encoder against the library, and decoded texts."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tremorlake.llm import sentencepiece_bpe as spm
from tremorlake.llm.queries import all_queries

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoder():
    return spm.Encoder(PATH)


def any_text(rnd: random.Random, pieces: list[str]) -> str:
    kind = rnd.random()
    if kind < 0.3:
        return "".join(rnd.choice(" ab▁\n.é日\x00😀he1<s>") for _ in range(rnd.randint(0, 40)))
    if kind < 0.7:
        return "".join(rnd.choice(pieces).replace("▁", rnd.choice([" ", "▁"])) for _ in range(rnd.randint(1, 30)))
    spans = [(1, 0x7F), (0x80, 0xD7FF), (0xE000, 0x10FFFF), (32, 32)]
    return "".join(chr(rnd.randint(*rnd.choice(spans))) for _ in range(rnd.randint(1, 60)))


def test_ids_are_the_librarys(encoder):
    rnd, library = random.Random(3), encoder.vocabulary.library
    pieces = list(encoder.vocabulary.ids)
    odd = ["", " ", "  a  ", "▁", "<s>", "</s><unk><0x41>", "\n\n\t", "a" * 999, " " * 999, "=-" * 500, "﻿​ é", "日" * 300]
    for _ in range(40):
        texts = [any_text(rnd, pieces) for _ in range(50)] + odd + [None]
        ids, borders = encoder.encode(pa.array(texts))
        for i, text in enumerate(texts):
            assert ids[borders[i]:borders[i + 1]].tolist() == library.encode(text or "", add_bos=True, add_eos=True), repr(text)


def test_pieces_without_cutting_texts_first(encoder):
    """The backtracking itself over whole texts, with spaces and borders of all kinds."""
    rnd, vocabulary = random.Random(8), encoder.vocabulary
    for _ in range(300):
        text = any_text(rnd, list(vocabulary.ids))
        marked = "▁" + text.replace(" ", "▁") if text else ""
        assert encoder.part_ids(marked) == vocabulary.library.encode(text), repr(text)


def test_remembered_parts_are_bounded(encoder):
    rnd = random.Random(1)
    for _ in range(30):
        encoder.encode(pa.array(["".join(rnd.choice("abcdefgh") for _ in range(8)) + " " for _ in range(3000)]))
        assert encoder.known.nbytes + encoder.ids.nbytes + encoder.ends.nbytes <= spm.REMEMBERED_BYTES
    many = spm.Encoder(PATH)
    many.search.compatible = {("x", str(i)): True for i in range(spm.REMEMBERED_PAIRS)}
    assert many.part_ids("▁hello▁worlds") == encoder.vocabulary.library.encode("hello worlds") and len(many.search.compatible) < 100


def test_rows(spark, encoder):
    library = encoder.vocabulary.library
    texts = [None, "", "A text. " * 5000, "é😀", "same", "same"]
    docs = spark.createDataFrame([(None if t is None else len(t), t, b"x", 1) for t in texts], "doc_id BIGINT, text STRING, ids BINARY, n_tokens INT")
    rows = spm.encode(docs, PATH, decoded=True).collect()
    want = sorted((len(library.encode(t or "")) + 2, t or "") for t in texts)
    assert sorted((r.n_tokens, r.decoded) for r in rows) == want
    assert all(library.decode(np.frombuffer(r.ids, "<u4").tolist()) == r.decoded for r in rows)
    back = spm.decode(spm.encode(docs, PATH), PATH)
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for t in texts)
    assert spm.encode(docs.limit(0), PATH).count() == 0
    assert [r.text for r in spm.decode(spark.createDataFrame([(1, None)], "doc_id INT, ids BINARY"), PATH).collect()] == [""]


def test_query(spark, encoder):
    sf_dir, library = "/root/testdata/sf0.001", encoder.vocabulary.library
    rows = {r.doc_id: r for r in all_queries()["op11_sentencepiece"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_bos=True, add_eos=True)
        digests = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), library.decode(ids).encode())]
        assert [rows[d.doc_id].n_tokens, rows[d.doc_id].ids_sha256, rows[d.doc_id].decoded_sha256] == [len(ids), *digests]
