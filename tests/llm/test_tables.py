"""URL rules, source mix, exact copies and the pipeline, on the given tables and on odd rows."""

from __future__ import annotations

import random
import sys
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import corpus_pipeline  # noqa: E402
from compare import connect, difference, table_of  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from tremorlake.llm import dedup, jaccard, mixing, urls  # noqa: E402
from tremorlake.llm.oracles import all_oracles, dedup_sql, mix_sql  # noqa: E402
from tremorlake.llm.queries import RULES, all_queries  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
#: Queries beyond SQL; each has a brute-force, round-trip or held-out test here.
BEYOND_SQL = {"op1_best_fit_packing", "op2_token_files", "op3_quality", "op4_nearest", "op5_cross_entropy", "op7_main_text", "op8_near_duplicates", "op11_sentencepiece", "pipeline"}


def test_every_query_is_registered():
    mine = set(all_queries()) | {"pipeline"}
    assert mine <= set(queries()) and len(mine) == 14
    assert mine - set(oracle_sql()) == BEYOND_SQL


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query_against_sql(spark, name):
    problem, rows, _ = difference(spark, connect(SF_DIR), queries()[name], all_oracles()[name], SF_DIR)
    assert problem is None and rows > 0


def in_duckdb(rows: list[tuple], columns: str, sql: str):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE documents ({columns})")
    if rows:
        con.executemany(f"INSERT INTO documents VALUES ({', '.join('?' * len(rows[0]))})", rows)
    found = con.execute(sql)
    return table_of([d[0] for d in found.description], found.fetchall())


def odd_documents(n: int = 150):
    rnd = random.Random(4)
    rows = [(None, None, None), (None, "", "a"), (1, " \t\n\x0b\x0c\r ", "a"), (2, " ", None), (2, " ", None), (3, "x y", "b"), (3, "xy", "b"), (4, "x\ny z", "ß")]
    for i in range(n):
        rows.append((10 + i, " ".join(rnd.choice(["w", "é", "　", "longer"]) for _ in range(rnd.choice([0, 1, 3, 40]))), rnd.choice(["a", "a", "a", "b", None, "z", "é"])))
    return rows


@pytest.mark.parametrize("weak", [False, True])
def test_exact_copies(spark, weak):
    rows = [r for r in odd_documents() if r[0] != 2] + [(2, " ", None)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, digest STRING")  # a column of a clashing name
    found = dedup.exact_duplicates(docs, digest=(lambda c: F.lit("same")) if weak else dedup.sha256, salts=3)
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    mine = table_of(columns, found.select(*columns).collect())
    assert mine == in_duckdb(rows, "doc_id BIGINT, text VARCHAR, digest VARCHAR", dedup_sql())


def test_repeated_rows_keep_one_copy(spark):
    docs = spark.createDataFrame([(5, "a b"), (5, "a b"), (5, "ab"), (7, "ab")], "doc_id BIGINT, text STRING")
    found = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in dedup.exact_duplicates(docs).collect())
    assert found == [(5, 5, 4, False), (5, 5, 4, False), (5, 5, 4, True), (7, 5, 4, False)]
    assert [tuple(r) for r in dedup.distinct_documents(docs).collect()] == [(5, "a b")]
    assert dedup.exact_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("rows_per_range", [1, 7, 2048])
def test_mix(spark, rows_per_range):
    rows = [(d, t, s) for d, t, s in odd_documents()]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING").withColumn("rank", F.lit(1))
    found = mixing.mix(docs, rows_per_range=rows_per_range)
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    mine = table_of(columns, found.select(*columns).collect())
    assert mine == in_duckdb(rows, "doc_id BIGINT, text VARCHAR, source VARCHAR", mix_sql())
    taken = defaultdict(int)
    for r in found.collect():
        taken[r.source, r.target] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    assert all(int(target) == words for (_, target), words in taken.items())


def filled(sizes: list[int]) -> list[float]:
    """Targets by resharing again and again."""
    weights, targets, capped = [i % 3 + 1 for i in range(len(sizes))], [0.0] * len(sizes), set()
    while True:
        left = sum(sizes) - sum(3 * sizes[i] for i in capped)
        free = [i for i in range(len(sizes)) if i not in capped]
        for i in free:
            targets[i] = left * weights[i] / sum(weights[j] for j in free)
        over = {i for i in free if targets[i] > 3 * sizes[i]}
        if not over:
            return targets
        for i in over:
            targets[i] = 3.0 * sizes[i]
        capped |= over


@pytest.mark.parametrize("sizes", [[5], [0, 0], [100, 1, 1], [1, 50, 3, 1000, 2, 7, 0], [9, 9, 9, 9]])
def test_targets(spark, sizes):
    sources = spark.createDataFrame([(f"s{i}", 1, n) for i, n in enumerate(sizes)], "source STRING, n_rows BIGINT, source_size BIGINT")
    found = {r.source: r.target for r in mixing.source_targets(sources).collect()}
    assert [found[f"s{i}"] for i in range(len(sizes))] == pytest.approx(filled(sizes))


def test_mixed_documents_repeat_whole_rows(spark):
    docs = spark.createDataFrame([(i, "w " * 5, "a", i) for i in range(40)] + [(100 + i, "w " * 5, "b", i) for i in range(4)] + [(200, None, "b", 0)],
                                 "doc_id BIGINT, text STRING, source STRING, size INT")
    out = mixing.mixed_documents(docs).collect()
    assert sum(r.doc_id >= 100 and r.doc_id < 200 for r in out) == 12 and sum(r.doc_id == 200 for r in out) == 1
    assert sum(r.doc_id < 100 for r in out) == 32 and set(out[0].asDict()) == {"doc_id", "text", "source", "size"}
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def judge(url: str | None):
    """host, path, rule and verdict by trying every rule."""
    after = (url or "").split("://", 1)
    rest = after[1] if len(after) == 2 else ""
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    path = tail[:min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    best = max(((len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls(spark):
    listed = ["", None, "no scheme", "http://", "http://COM/", "http://com", "http://a.b.WWW.example.com/en/x", "http://www.example.com/en/", "https://x.example.com/en/y?q#f",
              "http://notexample.com/en/", "http://net/es/", "http://a.net/es", "http://a.net/fr/z", "ftp://É.net/fr/z", "http://a.com?x=/en/", "http://a.com#/x://b.net/es/",
              "x://y://z.com/", "http://a.net//es/", "http://.com/", "http://com./", "http://" + "a." * 500 + "net/es/" + "p" * 5000, "\n://example.com/en/\n"]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(listed + listed[4:6])] + [(None, "http://a.com/", "r")], "page_id BIGINT, url STRING, rule STRING")
    rules = spark.createDataFrame(RULES, "verdict STRING, host STRING, path STRING")
    found = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, rules).collect()}
    assert found == {(r.page_id, *judge(r.url)) for r in pages.collect()}
    assert urls.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_the_filter_passes_all_that_is_listed_and_little_else(spark):
    entries = spark.range(4000).select(F.concat(F.lit("h"), "id", F.lit("/")).alias("entry"))
    n = 4000 // urls.ENTRIES_PER_BLOCK
    blocks = urls.bloom_blocks(entries, n)
    assert urls.possible_hits(entries, blocks, n).count() == 4000
    others = spark.range(4000).select(F.concat(F.lit("g"), "id", F.lit("/")).alias("entry"))
    assert urls.possible_hits(others, blocks, n).count() < 120


def test_pipeline(spark):
    docs, kept = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF_DIR).collect(), docs.schema)
        kept.append(docs.count())
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert 200 > kept[0] >= kept[1] >= kept[2] > 100
    texts = ["".join(r.text.split()) for r in docs.dropDuplicates(["doc_id"]).collect()]
    assert len(texts) == len(set(texts))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert packed.filter("piece = 0").count() == kept[3]


@pytest.mark.parametrize("stage", [0, 1, 2, 3, 4])
def test_stages_take_odd_and_empty_tables(spark, stage):
    schema = spark.read.parquet(f"{SF_DIR}/documents.parquet").schema
    odd = [(None, None, None, None, None), (1, "", "", "", 0), (1, "", "", "", 0), (2, "a b c " * 20000, "en", "s", 1), (2, "a b c " * 20000, "en", "s", 1)]
    run = corpus_pipeline.STAGES[stage][1]
    assert run(spark, spark.createDataFrame(odd, schema), SF_DIR).count() >= 1 - (stage == 0)
    assert run(spark, spark.createDataFrame([], schema), SF_DIR).count() == 0


def test_stages_keep_columns_of_any_names(spark):
    """Columns of the names that the stages use inside, and of plain ones that they might use."""
    names = ["_copy_key", "_copy_turn", "_class_v", "_class_own", "_class_turn", "_mix_size", "_mix_key", "_mix_source", "_mix_row", "key", "turn", "row", "own", "v"]
    rows = [(i, f"one two three four five {i} " * 3, "s", *[f"{n}{i}" for n in names]) for i in range(6)]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {t}" for n, t in [("doc_id", "BIGINT"), ("text", "STRING"), ("source", "STRING"), *[(n, "STRING") for n in names]]))
    for stage in (dedup.distinct_documents, jaccard.first_of_each_class, mixing.mixed_documents):
        out = stage(docs)
        assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(rows)


def test_mix_of_rows_without_ids(spark):
    """A third of the rows have no doc_id, another third are one row; each kind is dealt over the key ranges or counted first."""
    rows = [(None, f"w{i} " * (i % 7), "a") for i in range(300)] + [(5, "same words here", "a")] * 300 + [(1000 + i, "x y", "b") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")
    keys = mixing._measured(docs).groupBy("doc_id").agg(F.count_distinct("_mix_key").alias("n"))
    assert {r.doc_id: r.n for r in keys.filter("doc_id IS NULL OR doc_id = 5").collect()}[None] >= 250
    assert mixing._light(mixing._measured(docs)).count() <= 601
    found = mixing.mix(docs, rows_per_range=16)
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    assert table_of(columns, found.select(*columns).collect()) == in_duckdb(rows, "doc_id BIGINT, text VARCHAR, source VARCHAR", mix_sql())
