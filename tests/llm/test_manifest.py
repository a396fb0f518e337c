"""The dataset manifest against a tree built level by level, whole."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tremorlake.llm import merkle

COLUMNS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, grp INT, pos STRING, n INT, digest STRING"


def h(*inputs: str) -> str:
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def leaf(row: tuple, small: bool = False) -> str:
    doc_id, text, lang, source, n_chars = row[:5]
    if small and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def way_up(nodes: list[str], at: int) -> tuple[list[tuple[list[str], list[str]]], str]:
    """Siblings left and right on each level, and the root."""
    way = []
    while len(nodes) > 1:
        run = nodes[at // 8 * 8:at // 8 * 8 + 8]
        way.append((run[:at % 8], run[at % 8 + 1:]))
        nodes, at = [h(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)], at // 8
    return way, nodes[0]


def expected(rows: list[tuple]) -> list[tuple]:
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    groups = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs}
    subroots = [way_up([leaf(r) for r in groups[g]], 0)[1] for g in langs]
    found = []
    for j, g in enumerate(langs):
        upper, root = way_up(subroots, j)
        for i, row in enumerate(groups[g]):
            way = way_up([leaf(r) for r in groups[g]], i)[0] + upper
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            node, copies = leaf(row, changed), []
            for left, right in way:
                node = h(*left, node, *right)
                copies.append(node)
            proof = h(*[d for left, right in way for d in left + right])
            found.append((row[0], leaf(row), subroots[j], root, proof, node, node == root, copies if changed else None))
    return sorted(found, key=repr)


def mine(docs, **sizes) -> list[tuple]:
    rows = merkle.manifest(merkle.document_leaves(docs), **sizes)
    found = rows.select("doc_id", "leaf", "subroot", "root", merkle.digest(F.col("proof")), "folded_root", F.col("folded_root") == F.col("root"), "copied")
    return sorted((tuple(r) for r in found.collect()), key=repr)


def odd_rows(n: int) -> list[tuple]:
    rnd = random.Random(n)
    rows = [(None, None, None, None, None), (None, None, None, None, None), (7, "", "", "", 0), (7, "", "", "", 0), (7, "Other", "", "", 5),
            (-3, "É ABC zß日" * 300, "日本", None, -1), (12, "lower only", "de", "x", None)]
    langs = ["en"] * 6 + [None, "de", "é", "z"]
    for i in range(n):
        rows.append((rnd.randint(0, 3 * n), "".join(rnd.choice("aB ç") for _ in range(rnd.randint(0, 9))), rnd.choice(langs), rnd.choice(["s", None]), i))
    return rows


@pytest.mark.parametrize(("n", "levels", "rows_per_range"), [(300, 1, 16), (700, 2, 100), (700, 4, 65_536)])
def test_manifest(spark, n, levels, rows_per_range):
    rows = odd_rows(n)
    docs = spark.createDataFrame([(*r, 1, "p", 2, "clash") for r in rows], COLUMNS)
    assert mine(docs, levels=levels, rows_per_range=rows_per_range) == expected(rows)


def test_one_row_no_row_and_a_group_for_each_row(spark):
    one = spark.createDataFrame([(9, "Text", None, None, 4, 1, "p", 2, "x")], COLUMNS)
    assert mine(one) == expected([(9, "Text", None, None, 4)])
    assert mine(one.limit(0)) == []
    rows = [(i, "T", f"g{i}", "s", 1) for i in range(70)]
    assert mine(spark.createDataFrame([(*r, 1, "p", 2, "x") for r in rows], COLUMNS), levels=1) == expected(rows)


def test_equal_rows_are_spread_over_ranges(spark):
    docs = spark.range(3000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang"),
                                    F.lit("s").alias("source"), F.lit(4).alias("n_chars"))
    placed = merkle.in_order(merkle.document_leaves(docs), ["doc_id", "digest"], rows_per_range=200)
    assert sorted(r.pos for r in placed.select("pos").collect()) == list(range(3000))
    assert mine(docs, levels=2, rows_per_range=200) == expected([(None, "same", "en", "s", 4)] * 3000)


def test_a_changed_text_is_found(spark):
    rows = [(i, "ABC" if i % 2 else "abc", "en", "s", 3) for i in range(100)]
    docs = spark.createDataFrame([(*r, 1, "p", 2, "x") for r in rows], COLUMNS)
    for r in merkle.manifest(merkle.document_leaves(docs)).collect():
        changed = zlib.crc32(str(r.doc_id).encode()) % 3 == 0
        assert (r.folded_root == r.root) == (not changed or r.doc_id % 2 == 0)
        assert (r.copied is None) == (not changed) and (not changed or r.copied[-1] == r.folded_root)
