"""Spelling variants against comparing all words with each other."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from tremorlake.llm import spelling


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected(counts: dict[str, int], ratio: int = 10) -> list[tuple]:
    best, close = {}, {}
    for w, n in counts.items():
        around = [(-counts[v], v) for v in counts if near(w, v)]
        close[w] = len(around)
        best[w] = min(around)[1] if around and -min(around)[0] >= ratio * n else None
    out = []
    for w, n in counts.items():
        root = w
        while best[root]:
            root = best[root]
        out.append((w, best[w], root, n, close[w], counts[best[w]] if best[w] else None))
    return sorted(out)


def found(frame) -> list[tuple]:
    return sorted(tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect())


def words_of(rows: list[tuple]) -> Counter:
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return Counter({w: n for w, n in counts.items() if len(w) >= 7 and n >= 2})


@pytest.mark.parametrize("seed", range(3))
def test_groups_of_any_words(spark, seed):
    rnd = random.Random(seed)
    words = {"".join(rnd.choice("aabé") for _ in range(rnd.randint(1, 7))) for _ in range(400)} | {"a" * i for i in range(1, 30)}
    words |= {"x" * 3000, "x" * 2999 + "y", "x" * 3001, "x" * 1500 + "y" + "x" * 1500}
    counts = {w: rnd.choice([1, 2, 2, 3, 20, 25, 300, 3000]) for w in words}
    table = spark.createDataFrame([(w, n, "clash", 5) for w, n in counts.items()], "word STRING, n BIGINT, id STRING, nodes INT")
    assert found(spelling.spelling_groups(table)) == expected(counts)


def test_nodes_are_those_of_the_trie(spark):
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 9))) for _ in range(300)})
    rows = spelling.trie_nodes(spark.createDataFrame([(w,) for w in words], "word STRING"), words_per_range=20).collect()
    number = {}
    for r in rows:
        assert len(r.nodes) == len(r.word) + 1
        for i, node in enumerate(r.nodes):
            assert number.setdefault(r.word[:i], node) == node
    assert len(set(number.values())) == len(number)
    assert [r.word for r in sorted(rows, key=lambda r: r.nodes[-1])] == words


def test_words_of_texts(spark):
    rnd = random.Random(2)
    letters = ["abcdefg", "ABCDEFG", "été÷×ÿÀü", "çedilles", "日本語abcdefgh", "straßenbahn", "short", "abcdefgabcdefg" * 30, "aaaaaaaa"]
    rows = [(rnd.choice([None, i]), rnd.choice([None, ""] + [" ".join(rnd.choice(letters) for _ in range(40))] * 8)) for i in range(120)]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id BIGINT, text STRING, word STRING, n INT")
    assert dict(tuple(r) for r in spelling.thinned_words(docs).collect()) == dict(words_of(rows))
    assert found(spelling.spelling_groups(spelling.thinned_words(docs))) == expected(words_of(rows))


def test_without_words(spark):
    docs = spark.createDataFrame([(1, None), (2, "short words")], "doc_id BIGINT, text STRING")
    assert found(spelling.spelling_groups(spelling.thinned_words(docs))) == []
    assert found(spelling.spelling_groups(spelling.thinned_words(docs.limit(0)))) == []
