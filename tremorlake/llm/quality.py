"""Text quality by positive-unlabelled learning.

Trusted positives and unlabelled texts give a small network that minimises the non-negative unbiased risk: with class prior p and
logistic loss, p * risk of positives as positive + max(0, risk of unlabelled as negative - p * risk of positives as negative).
The prior is estimated from the same rows: a classifier of positive against unlabelled orders them, and the share of unlabelled
over the share of positives above any threshold bounds the prior from above; the lowest bound over thresholds that a good part
of the positives pass is taken.

The fit reads a bounded sample, ``most_positive`` and ``most_unlabelled`` rows with the smallest hashes of their doc_ids; scores
cover every whole text. Inputs are shares of kinds of characters, lengths and repetition of words; nothing but the text counts.

Nulls: a null text counts as empty, an empty text has all inputs 0 and the score that the model gives them. Rows with a null
doc_id are scored, are not held out and not learnt from. A doc_id labelled both ways is no trusted positive; of a doc_id with
several texts the fit reads one. Without positives
or unlabelled rows every score is 0.5. Repeated rows are scored each; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import steps, text_or_empty

STEP_BYTES = 1 << 20
_LOWER, _UPPER, _DIGIT, _BLANK, _LINE, _HIGH, _STOP, _SIGN, _CALL, _SYMBOL = range(10)


def _kinds() -> np.ndarray:
    kinds = np.full(256, _SYMBOL, np.uint8)
    kinds[ord("a"):ord("z") + 1] = _LOWER
    kinds[ord("A"):ord("Z") + 1] = _UPPER
    kinds[ord("0"):ord("9") + 1] = _DIGIT
    kinds[128:] = _HIGH
    for chars, kind in (("\t\x0b\x0c ", _BLANK), ("\n\r", _LINE), (".,", _STOP), ("'\"-():;", _SIGN), ("!?", _CALL)):
        kinds[[ord(c) for c in chars]] = kind
    return kinds


_KIND = _kinds()
N_FEATURES = 18


def _distinct(owner: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct values of each owner, and the count of its most frequent one."""
    width = int(value.max()) + 1 if len(value) else 1
    pairs, counts = np.unique(owner.astype(np.int64) * width + value, return_counts=True)
    distinct = np.bincount(pairs // width, minlength=n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, pairs // width, counts)
    return distinct, top


def features(texts: pa.Array) -> np.ndarray:
    """One row of inputs per text."""
    texts = pc.cast(pc.fill_null(texts, ""), pa.large_string())
    n = len(texts)
    borders = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[borders[0]:borders[-1]]
    kind = _KIND[raw]
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(borders))
    counts = np.bincount(owner * np.int32(10) + kind, minlength=n * 10).reshape(n, 10)[:n].astype(float)
    space = (kind == _BLANK) | (kind == _LINE)
    first = np.ones(len(raw), bool)  # first byte of a text
    inner = owner[1:] == owner[:-1]
    first[1:] = ~inner
    starts_word = ~space & (first | np.concatenate([[True], space[:-1]]))
    alone = np.zeros(len(raw), bool)  # a sign between white space
    alone[:-1] = starts_word[:-1] & (space[1:] | first[1:])
    same = np.zeros(len(raw), bool)
    same[1:] = inner & ~space[1:] & (raw[1:] == raw[:-1])

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.bincount(owner[mask], minlength=n).astype(float)

    lists = pc.split_pattern_regex(texts, r"[\t-\r ]+")
    codes = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = lists.offsets.to_numpy().astype(np.int64)
    of = np.repeat(np.arange(n), np.diff(ends))
    words = np.maximum(np.diff(ends), 1).astype(float)
    distinct, top = _distinct(of, codes, n)
    together = of[1:] == of[:-1]
    again = np.bincount(of[1:][together & (codes[1:] == codes[:-1])], minlength=n)
    pairs = np.unique(codes[:-1] * (codes.max() + 1 if len(codes) else 1) + codes[1:], return_inverse=True)[1] if len(codes) > 1 else np.empty(0, np.int64)
    pair_kinds, pair_top = _distinct(of[1:][together], pairs[together], n)
    size = np.maximum(np.diff(borders), 1)
    shares = counts / size[:, None]
    bare = np.maximum(size - counts[:, _BLANK] - counts[:, _LINE], 1)
    return np.column_stack([
        np.log1p(words) / 5, np.log1p(bare / words), shares, per_text(same) / bare, per_text(alone & (kind >= _STOP)) / words,
        distinct / words, top / words, again / words, (pair_kinds - pair_top) / words]) * (np.diff(borders) > 0)[:, None]


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def margin(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ w1 + b1) @ w2 + b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, epochs: int = 40, hidden: int = 24,
        batch: int = 1024, rate: float = 4e-3, seed: int = 7) -> Model:
    """The network that minimises the non-negative risk, or without ``prior`` tells positive from unlabelled."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    d = p.shape[1]
    weights = [rng.normal(0, d ** -0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden ** -0.5, hidden), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    steps_per_epoch, t = max(1, min(40, max(len(p), len(u)) // batch)), 0
    for epoch in range(epochs):
        for _ in range(steps_per_epoch):
            xp, xu = p[rng.integers(0, len(p), batch)], u[rng.integers(0, len(u), batch)]
            x = np.concatenate([xp, xu])
            h = np.tanh(x @ weights[0] + weights[1])
            z = h @ weights[2] + weights[3][0]
            s = _sigmoid(z)
            as_positive, as_negative = (s - 1) / batch, s / batch  # gradients of the mean logistic losses
            slope = np.empty(2 * batch)
            if prior is None:
                slope[:batch], slope[batch:] = as_positive[:batch], as_negative[batch:]
            else:
                loss = np.logaddexp(0, z)  # of calling a row negative
                if loss[batch:].mean() - prior * loss[:batch].mean() >= 0:
                    slope[:batch], slope[batch:] = prior * (as_positive[:batch] - as_negative[:batch]), as_negative[batch:]
                else:  # the estimated risk of negatives is below 0: step back from it
                    slope[:batch], slope[batch:] = prior * as_negative[:batch], -as_negative[batch:]
            inner = (slope[:, None] * weights[2]) * (1 - h * h)
            grads = [x.T @ inner + 1e-4 * weights[0], inner.sum(0), h.T @ slope + 1e-4 * weights[2], np.array([slope.sum()])]
            t += 1
            now = rate * (0.5 if epoch * 2 > epochs else 1.0)
            for w, g, m, v in zip(weights, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= now * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return Model(mean, scale, weights)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, bounded by ratios of upper tails."""
    order = fit(positive, unlabelled, None, epochs=15)
    p, u = np.sort(order.margin(positive)), np.sort(order.margin(unlabelled))
    kept = np.linspace(0.5, 0.98, 49)  # shares of the positives above a threshold
    thresholds = np.quantile(p, 1 - kept)
    tail_p = 1 - np.searchsorted(p, thresholds) / len(p)
    tail_u = 1 - np.searchsorted(u, thresholds) / len(u)
    error = np.sqrt(tail_u * (1 - tail_u) / len(u)) / tail_p + tail_u * np.sqrt((1 - tail_p) / tail_p / len(p)) / tail_p
    return float(np.clip(np.min(tail_u / tail_p + error), 0.02, 0.99))


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that no label is learnt from; a null doc_id isn't in it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def with_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of ``keep`` and the inputs of each text."""
    fields = [docs.schema[c] for c in keep]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", STEP_BYTES):
            x = pa.FixedSizeListArray.from_arrays(pa.array(features(batch.column("text")).ravel()), N_FEATURES).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), x], [*keep, "x"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.select(*keep, text_or_empty().alias("text")).mapInArrow(rows, f"{schema}, x ARRAY<DOUBLE>")


def train(docs: DataFrame, labels: DataFrame, most_positive: int = 15_000, most_unlabelled: int = 30_000) -> tuple[Model, float] | None:
    """Model and prior from ``labels`` (doc_id, quality) and texts without a label; None if either kind is missing."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    draw = F.xxhash64("doc_id")
    trusted = known.filter((F.col("quality") == 1) & ~held_out()).orderBy(draw, "doc_id").limit(most_positive)
    free = docs.filter(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id").join(known, "doc_id", "left_anti")
    free = free.distinct().orderBy(draw, "doc_id").limit(most_unlabelled)
    ids = trusted.select(F.col("doc_id").alias("id"), F.lit(True).alias("trusted")).union(free.select("doc_id", F.lit(False)))
    # At most most_positive + most_unlabelled ids of 8 bytes, and as many rows: of a repeated doc_id one text.
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("id"))
    inputs = with_features(chosen, ["doc_id", "trusted"]).groupBy("doc_id").agg(F.min(F.struct("x", "trusted")).alias("one"))
    rows = inputs.select("one.*").toPandas()
    if not rows.trusted.any() or rows.trusted.all():
        return None
    x = np.stack(rows.x.to_numpy())
    order = np.lexsort([*x.T, rows.trusted.to_numpy()])  # the same fit, however the rows arrive
    x, trusted_rows = x[order], rows.trusted.to_numpy(bool)[order]
    prior = estimate_prior(x[trusted_rows], x[~trusted_rows])
    return fit(x[trusted_rows], x[~trusted_rows], prior), prior


def _scores(trained: tuple[Model, float] | None, texts: pa.Array) -> np.ndarray:
    return trained[0].score(features(texts)) if trained else np.full(len(texts), 0.5)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    trained = train(docs, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", STEP_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(trained, batch.column("text")))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(score, f"doc_id {kind}, score DOUBLE")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``."""
    trained = train(docs, labels)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", STEP_BYTES):
            yield batch.filter(pa.array(_scores(trained, batch.column("text")) >= threshold))

    return docs.mapInArrow(good, docs.schema)
