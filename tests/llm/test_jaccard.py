"""Near duplicates against all pairs of a small table."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tremorlake.llm import jaccard
from tremorlake.llm.components import components


def shingles(text):
    words = (text or "").split()
    n = min(5, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute(rows):
    """class_id, n_links, n_copies per row."""
    sets = [shingles(t) for _, t in rows]
    near = [[j for j, q in enumerate(sets) if j != i and p and len(p & q) >= 0.8 * len(p | q)] for i, p in enumerate(sets)]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min([label[i], *(label[j] for j in near[i])]) for i in range(len(rows))]
    ids = {}
    for (d, _), c in zip(rows, label):
        ids[c] = min(d, ids.get(c, d))
    return sorted((d, ids[c], len(n), max(1, sum(s == sets[i] for s in sets)) if sets[i] else 1) for i, ((d, _), c, n) in enumerate(zip(rows, label, near)))


def made_rows(seed: int, n: int = 60):
    rnd = random.Random(seed)
    passage = [f"p{i}" for i in range(40)]
    rows = [(0, ""), (1, None), (2, "  \n"), (3, "a b"), (4, "a  b"), (5, "a b c d e"), (6, "a b c d e f")]
    for _ in range(n):
        words = [f"w{rnd.randint(0, 3000)}" for _ in range(rnd.choice([6, 30, 120, 400]))]
        if rnd.random() < 0.4:
            words[3:3] = passage
        rows.append((len(rows), " ".join(words)))
        for _ in range(rnd.choice([0, 0, 1, 3, 8])):
            copy = list(words)
            for _ in range(rnd.randint(0, max(1, len(copy) // 40))):
                copy[rnd.randrange(len(copy))] = f"x{rnd.randint(0, 10**6)}"
            rows.append((len(rows), rnd.choice(["", " "]) + rnd.choice([" ", "\n"]).join(copy)))
    rows += [(len(rows) + i, rows[9][1]) for i in range(5)]
    return rows


@pytest.mark.parametrize("options", [{}, {"bucket": 4, "block": 5, "depth": 1, "splits": 2, "recall": 0.99999}])
def test_all_pairs(spark, options):
    rows = made_rows(5)
    docs = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id BIGINT, text STRING, v STRING")
    found = sorted(tuple(r) for r in jaccard.near_duplicates(docs, **options).collect())
    assert found == brute(rows)


def test_sketches_rule_out_no_similar_pair():
    rnd = np.random.default_rng(3)
    sets = []
    for n in (1, 2, 5, 40, 300, 3000):
        base = rnd.integers(0, 2**32, n, dtype=np.uint32)
        for share in (0, 0.05, 0.1, 0.15, 0.3, 0.6):
            other = np.where(rnd.random(n) < share, rnd.integers(0, 2**32, n, dtype=np.uint32), base)
            sets.append(np.unique(np.concatenate([other, rnd.integers(0, 2**32, rnd.integers(0, n // 8 + 1), dtype=np.uint32)])))
    every = np.arange(len(sets))
    sizes = np.array([len(s) for s in sets])
    bits = np.frombuffer(b"".join(map(jaccard.sketch, sets)), np.uint8).reshape(len(sets), -1)
    near = jaccard.similar(sets, every, every, 0.8)
    may = jaccard.possible(sizes, bits, every, every, 0.8)
    assert not (near & ~may).any() and near.sum() > len(sets)
    assert may.sum() < 2 * near.sum()  # most others are ruled out


def test_token_sets_are_shuffled_only_where_sketches_allow_a_link(spark, monkeypatch):
    """Texts that share just over half of their shingles meet in many buckets; none of their sets is compared there."""
    passage = " ".join(f"p{i}" for i in range(200))
    rows = [(i, f"{passage} " + " ".join(f"w{i}x{j}" for j in range(90))) for i in range(60)]
    met, compared = [], jaccard._links_between
    monkeypatch.setattr(jaccard, "_links_between", lambda members, similarity: (met.append(members.count()), compared(members, similarity))[1])
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()
    assert sorted(map(tuple, found)) == [(i, i, 0, 1) for i in range(60)]
    assert met and sum(met) == 0


def test_token_sets_are_written_only_where_texts_meet(spark, monkeypatch):
    """Forty texts that share no shingle with another, one of them twice, and two near copies: only the sets of those two are written."""
    texts = [" ".join(f"w{i}x{j}" for j in range(80)) for i in range(41)]
    rows = list(enumerate([*texts, f"{texts[40]} end", texts[7].replace(" ", "  ")]))
    written, store = [], jaccard.stored

    def stored(df, label):
        written.append(store(df, label))
        return written[-1]

    monkeypatch.setattr(jaccard, "stored", stored)
    found = sorted(tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect())
    assert found == brute(rows)
    assert sum(t.count() for t in written if "tokens" in t.columns) == 2


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(None, text), (7, text), (7, text), (None, None)], "doc_id BIGINT, text STRING")
    found = sorted((tuple(r) for r in jaccard.near_duplicates(docs).collect()), key=str)
    assert found == sorted([(None, 7, 2, 3), (7, 7, 2, 3), (7, 7, 2, 3), (None, None, 0, 1)], key=str)
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    rnd = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    rnd.shuffle(chain)
    edges = spark.createDataFrame(chain + [(1, 2), (5, 1), (9, 9)], "a BIGINT, b BIGINT")
    found = {r.v: r.label for r in components(edges).collect()}
    assert found == {**dict.fromkeys(range(100, 161), 100), 1: 1, 2: 1, 5: 1, 9: 9}


def test_one_row_of_each_class_stays_without_usable_ids(spark):
    """Near copies that share a doc_id or have none, and a copy without an id beside one that has it."""
    def near(mark, n):
        return [" ".join(f"{mark}{j}" for j in range(60)) + f" end{i}" for i in range(n)]

    same, none, mixed_ids, lone = near("s", 3), near("n", 4), near("m", 2), near("l", 1)
    rows = [*((7, t) for t in same), *((None, t) for t in none), (9, mixed_ids[0]), (None, mixed_ids[1]), (None, lone[0]), (None, lone[0]), (9, "another text"), (None, ""), (None, None), (9, " ")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id BIGINT, text STRING, extra INT")
    kept = jaccard.first_of_each_class(docs)
    assert kept.columns == docs.columns
    found = sorted((r.doc_id or 0, (r.text or " ")[0]) for r in kept.collect())
    assert found == sorted([(7, "s"), (0, "n"), (9, "m"), (0, "l"), (9, "a"), (0, " "), (0, " "), (9, " ")])
