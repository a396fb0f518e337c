"""Trained operators: held-out accuracy, exact inference, recall against brute force."""

from __future__ import annotations

import itertools
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tremorlake.llm import crossent, extraction, partitions, quality
from tremorlake.llm.dom import KINDS, N_INPUTS, parse
from tremorlake.llm.labelled_pages import labelled_pages

SF_DIR = "/root/testdata/sf0.01"


# Quality


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.quality_scores(docs, labels).join(labels, "doc_id").toPandas()
    test = scored[scored.held_out]
    assert len(test) > 50 and (test.predicted == test.quality).mean() > 0.93
    assert scored.score.between(0, 1).all()


def test_only_learnt_labels_matter(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.train(docs, x)[0] for x in (labels, turned))
    assert all((p == q).all() for p, q in zip(a.weights, b.weights))


def test_risk_of_separable_rows():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(2, 1, (3000, 4)), rng.normal(-2, 1, (600, 4))
    unlabelled = np.concatenate([good[1500:], bad])
    prior = quality.estimate_prior(good[:1500], unlabelled)
    assert prior == pytest.approx(1500 / 2100, abs=0.08)
    model = quality.fit(good[:1500], unlabelled, prior)
    assert (model.score(good) > 0.5).mean() > 0.97 and (model.score(bad) < 0.5).mean() > 0.97


def test_quality_of_odd_rows(spark):
    rows = [(None, None), (1, ""), (2, " \n"), (3, "x" * 300000), (4, "a b"), (4, "a b"), (6, "ok then"), (7, "é 　 漢")]
    docs = spark.createDataFrame([(*r, 9.0) for r in rows], "doc_id BIGINT, text STRING, score DOUBLE")
    labels = spark.createDataFrame([(4, 1), (4, 0), (6, 1), (7, None), (None, 1)], "doc_id BIGINT, quality INT")
    assert quality.quality_scores(docs, labels).count() == 8
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    assert quality.good_documents(docs, labels.limit(0)).columns == ["doc_id", "text", "score"]
    x = quality.features(pa.array([None, "", "ab AB 12"]))
    assert (x[:2] == 0).all() and x.shape == (3, quality.N_FEATURES)


# Cross-entropy difference


def slow_models(texts: list[str], target: list[bool]):
    """Both models by dictionaries of words and pairs."""
    counts = {w: ({}, {}) for w in ("target", "all")}
    for text, chosen in zip(texts, target):
        words = (text or "").lower().split()
        for which in ("all", "target") if chosen else ("all",):
            one, two = counts[which]
            for a, b in zip([None, *words], words):
                one[b] = one.get(b, 0) + 1
                two[a, b] = two.get((a, b), 0) + 1
    n = {w: sum(c[0].values()) for w, c in counts.items()}
    known = {w for w, c in counts["target"][0].items() if c >= 2}

    def loss(which: str, text: str) -> float:
        scale = 1.0 if which == "target" else n["target"] / n["all"]
        one, two = ({k: v * scale for k, v in c.items()} for c in counts[which])
        rest, words, total = n["target"] - sum(one.get(w, 0) for w in known), text.lower().split(), 0.0
        for a, b in zip([None, *words], words):
            alone = ((one.get(b, 0) if b in known else rest) + 1) / (n["target"] + len(known) + 1)
            held = one.get(a, 0) if a in known and b in known else 0.0
            pair = min(two.get((a, b), 0), held)
            total -= np.log((pair + 50 * alone) / (held + 50))
        return total / max(1, len(words))

    return loss


def test_losses_against_plain_counts(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["The", "the", "cat", "dog", "ran", "x1", f"r{i}"], 30)) for i in range(60)] + ["", None, " \n", "the " * 5000]
    rows = [(i, t, i % 3 == 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, score BOOLEAN")
    target = docs.filter("score").select("doc_id")
    fold = {r.doc_id: r.f for r in docs.select("doc_id", crossent.fold_of().alias("f")).collect()}
    models = [slow_models([t for i, t, _ in rows if fold[i] == f], [c for i, _, c in rows if fold[i] == f]) for f in (0, 1)]
    found = {r.doc_id: r for r in crossent.score_documents(docs, target).collect()}
    assert len(found) == len(rows)
    for i, t, _ in rows:
        loss, words = models[1 - fold[i]], (t or "").split()
        assert found[i].n_words == len(words)
        if words:
            assert found[i].target_loss == pytest.approx(loss("target", t), abs=0.02)
            assert found[i].background_loss == pytest.approx(loss("all", t), abs=0.02)
        assert found[i].score == found[i].target_loss - found[i].background_loss


def test_rare_words_and_pairs_are_counted_exactly(spark, monkeypatch):
    """With more words than a fixed table of slots would tell apart, a word held twice is known and one held once is not."""
    monkeypatch.setattr(crossent, "BLOCK_BYTES", 1 << 18)  # several blocks, more ranges
    rows = []
    for i in range(2000):
        own = [f"w{i % 1000}x{j}" for j in range(200)]  # each in two documents, 200,000 in all
        rows.append((i, " ".join([*own, f"once{i}", "Also also", "z" * (i % 7)]), i % 2 == 0))
    rows += [(10_000 + i, t, True) for i, t in enumerate(["", None, "a", "a a a a"])] + [(None, "w1x1 w1x2 w1x3", True)] * 2
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, score BOOLEAN").repartition(4)
    fold = {r.doc_id: r.f for r in docs.select("doc_id", crossent.fold_of().alias("f")).distinct().collect()}
    target = [c and i is not None for i, _, c in rows]
    models = [slow_models([t for i, t, _ in rows if fold[i] == f], [c for (i, _, _), c in zip(rows, target) if fold[i] == f]) for f in (0, 1)]
    found = crossent.score_documents(docs, docs.filter("score").select("doc_id")).collect()
    assert len(found) == len(rows)
    texts = {i: t or "" for i, t, _ in rows}
    for r in found[::400] + [r for r in found if r.doc_id is None or r.doc_id >= 10_000]:
        text, loss = texts[r.doc_id], models[1 - fold[r.doc_id]]
        assert r.n_words == len(text.split())
        assert r.target_loss == pytest.approx(loss("target", text), abs=1e-9)
        assert r.background_loss == pytest.approx(loss("all", text), abs=1e-9)


def test_target_documents_score_lower(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    german = docs.filter("lang = 'de'").select("doc_id")
    scores = crossent.score_documents(docs, german.filter("doc_id % 2 = 0")).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    rest = scores[(scores.doc_id % 2 == 1) & (scores.n_words > 30)]
    assert rest[rest.lang == "de"].score.mean() < rest[rest.lang != "de"].score.mean() - 0.5


def test_cross_entropy_of_empty_tables(spark):
    docs = spark.createDataFrame([(None, None), (1, "a b"), (1, "a b")], "doc_id BIGINT, text STRING")
    assert crossent.score_documents(docs.limit(0), docs.select("doc_id")).count() == 0
    assert crossent.score_documents(docs, docs.select("doc_id").limit(0)).count() == 3


# Main text


def test_marginals_are_exact():
    rng = np.random.default_rng(1)
    page = parse("<div><p>a</p><ul><li>b</li><li>c</li></ul></div><p>d</p>")
    model = extraction.Model(rng.normal(size=N_INPUTS), rng.normal(size=(KINDS, 2, 2)))
    n = len(page.parent)
    weight = {}
    for y in itertools.product((0, 1), repeat=n):
        s = sum((page.inputs[i] @ model.unary) * y[i] for i in range(n))
        weight[y] = np.exp(s + sum(model.pair[page.kind[i], y[page.parent[i]], y[i]] for i in range(1, n)))
    main, joint = model.marginals(extraction.Forest.of([page, page]))
    total = sum(weight.values())
    for i in range(n):
        assert main[n + i] == pytest.approx(sum(w for y, w in weight.items() if y[i]) / total)
        if i:
            assert joint[i, 1, 0] == pytest.approx(sum(w for y, w in weight.items() if y[page.parent[i]] and not y[i]) / total)


def test_held_out_pages():
    model, right, blocks = extraction.default_model(), 0, 0
    for html in labelled_pages(150, seed=5):
        page = parse(html)
        main = model.marginals(extraction.Forest.of([page]))[0] >= 0.5
        for i in {i for i, _ in page.pieces if page.marks[i]}:
            blocks += 1
            right += main[i] == (page.marks[i] == "1")
    assert right / blocks > 0.98


PROSE = "The report came out on Monday. It said that the river had risen by two metres, and that it would fall again soon."


@pytest.mark.parametrize("box", ["article", 'div class="post"', "main", "div"])
def test_boilerplate_goes_and_prose_stays(box):
    html = f"""<!doctype html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>x</p>";</script></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class="cookie-banner">We use cookies. Accept them.</div>
<{box}><h1>A  title &amp; more</h1><p>{PROSE}<br>Next&nbsp;line &lt;b&gt; <b>bold</b>, <a href=/c>a link</a>.<p>{PROSE}<aside class="ad">Buy this now!</aside></{box.split()[0]}>
<section id="comments"><h3>Comments</h3><p>I liked this one a lot. Thanks.</p></section><aside class="sidebar"><h3>Related</h3><ul><li><a href=/x>One more story</a></li></ul></aside>
<form><label>Mail</label><input><button>Send</button></form><footer>&copy; 2020 Somebody. All rights reserved.</footer></body></html>"""
    assert extraction.texts_of([parse(html)], extraction.default_model()) == [f"A title & more\n{PROSE} Next line <b> bold, a link.\n{PROSE}"]


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "<p>" + PROSE + "</p>"
    odd = [None, "", "plain text only", "<", "<p", "&#0; &bogus; &amp", "</div></p>", "<script>never closed", "<p>" * 2000, deep, "<article>" + f"<p>{PROSE}</p>" * 3000, "<!-- x", "<a><a><p></a>"]
    pages = spark.createDataFrame([(i, None, h, 1) for i, h in enumerate(odd + odd[-3:-2])] + [(None, "u", None, 1)], "page_id BIGINT, url STRING, html STRING, text INT")
    found = extraction.extract(pages).collect()
    assert len(found) == len(odd) + 2 and all(r.text is not None and r.n_chars == len(r.text) for r in found)
    texts = {r.page_id: r.text for r in found}
    assert texts[0] == texts[1] == "" and texts[10] == "\n".join([PROSE] * 3000)
    assert extraction.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("html", ["<article>" + "<b>x " * 100_000, "<b>" * 20_000 + "<p>x</p>" * 5_000, "<b>" * 20_000 + "<svg><p>" * 10_000,
                                  "<section>" * 5_000 + "</div>" * 100_000, "<li><section>" * 5_000 + "</li>" * 50_000])
def test_unclosed_tags_take_linear_time(html):
    start = time.process_time()
    parse(html)
    assert time.process_time() - start < 5


def test_formulas_and_fallback_text_stay():
    html = f"""<body><nav><a href=/>Home</a></nav><article><p>{PROSE} <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p>
<p>{PROSE} <object data=o>A picture of the river.</object> <video src=v>Read the text instead.</video></p></article></body>"""
    assert extraction.texts_of([parse(html)], extraction.default_model()) == [f"{PROSE} x=2\n{PROSE} A picture of the river. Read the text instead."]


def test_given_pages(spark):
    """Every given page has its main text in one article element without boxes of other kinds."""
    rows = extraction.extract(spark.read.parquet(f"{SF_DIR}/pages.parquet")).collect()
    html = {r.page_id: r.html for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    for r in rows:
        article = html[r.page_id].split("<article>")[1].split("</article>")[0]
        whole = parse(article)
        assert r.text == "\n".join(t for _, t in whole.pieces)


# Nearest neighbours


def brute(ids, x, queries, k):
    out = {}
    for i in queries:
        s = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(float)
    vectors = spark.createDataFrame([(int(i), v.tolist(), "c") for i, v in zip(ids, x)], "vec_id BIGINT, embedding ARRAY<DOUBLE>, part STRING")
    found = partitions.nearest(vectors, F.col("vec_id") % 20 == 0, k=20, sample=1000, part_rows=100, block=64).toPandas()
    true = brute(ids, x, np.flatnonzero(ids % 20 == 0), 20)
    hits = [len(set(found[found.query_id == q].vec_id) & {i for i, _ in near}) / 20 for q, near in true.items()]
    assert np.mean(hits) >= 0.9 and found.groupby("query_id")["rank"].apply(list).map(lambda r: r == list(range(1, 21))).all()
    score = {(q, i): s for q, near in true.items() for i, s in near}
    assert all(score[r.query_id, r.vec_id] == pytest.approx(r.score, abs=1e-12) for r in found.itertuples() if (r.query_id, r.vec_id) in score)


def test_recall_in_many_parts(spark, tmp_path):
    """The query's own parameters, on a table of 49 parts of uneven clusters."""
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(300, 32))
    x = centre[np.minimum(rng.geometric(0.02, 50_000) - 1, 299)] + rng.normal(size=(50_000, 32)) * 0.6
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}), tmp_path / "v.parquet")
    vectors = spark.read.parquet(str(tmp_path / "v.parquet"))
    found = partitions.nearest(vectors, F.col("vec_id") % 20 == 0).toPandas()
    assert found.groupby("query_id").size().eq(20).all() and found.query_id.nunique() == 2500
    asked = np.arange(0, len(x), 20)
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    true = np.argpartition(-scores, 20, axis=1)[:, :20]
    near = found.groupby("query_id").vec_id.apply(set)
    recall = np.mean([len(near[q] & set(t)) / 20 for q, t in zip(asked, true.tolist())])
    print("recall", recall)
    assert recall >= 0.9


def test_small_parts_are_not_the_end(spark):
    """k is more than the probable parts hold, so the search goes on into others."""
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([rng.normal(c, 0.05, (100, 4)) for c in np.eye(4) * 5]))]
    vectors = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    for k, expected in ((150, 150), (500, 399)):
        found = partitions.nearest(vectors, F.col("vec_id") % 20 == 0, k=k, sample=400, part_rows=20, mass=0.1).groupBy("query_id").agg(
            F.count_distinct("vec_id").alias("n"), F.max("rank").alias("last")).collect()
        assert len(found) == 20 and {(r.n, r["last"]) for r in found} == {(expected, expected)}


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [2.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]),
            (9, [1.0, 2.0, 3.0]), (10, [-1.0, 0.5]), (None, [1.0, 1.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    found = partitions.nearest(vectors, F.col("vec_id") % 20 == 0, k=2).collect()
    first = sorted((r["rank"], r.vec_id, r.score) for r in found if r.query_id == 0)
    assert first == [(1, 1, 2.0), (2, 2, 2.0)]
    assert {r.vec_id for r in found if r.query_id == 20} <= {10, 0, 1}
    assert partitions.nearest(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_parts_are_balanced():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.1, (200, 8)) for c in np.eye(8)[:4] * 3])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    part = partitions.balanced_parts(x, partitions.neighbour_graph(x, 10), 8)
    assert np.bincount(part, minlength=8).max() <= 111
