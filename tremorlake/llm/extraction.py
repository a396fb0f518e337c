"""Main text of pages by a tree-structured graphical model over the block elements of the DOM.

Each block element is main text or not. Inputs of an element (tag, names, links, lengths, forms) give its own potential; a
potential for each kind of child ties it to its parent. Sum-product messages go from the leaves up and from the root down and give
the exact marginal of every element; blocks with a marginal of one half or more are the text. Weights are trained by the exact
likelihood's gradient, marked less expected counts, on labelled pages.

Text of a block: character references decoded, white space (Unicode's) to one space, trimmed; blocks in page order joined by a line
break. Scripts, styles, controls and markup are never text. Nothing else is dropped or cut.

Nulls: a null or empty page gives an empty text, as does one without main text; null ids and URLs are kept. Repeated rows are read
each. Broken markup is mended the way of the tree builder: unclosed elements end with their parents. Empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps, text_or_empty
from .dom import KINDS, N_INPUTS, Page, parse
from .labelled_pages import labelled_pages

STEP_BYTES = 4 << 20


class Forest(NamedTuple):
    """The elements of several pages in one numbering, with those of each depth."""

    parent: np.ndarray
    kind: np.ndarray
    inputs: np.ndarray
    levels: list[np.ndarray]
    first: np.ndarray  # of each page

    @staticmethod
    def of(pages: list[Page]) -> Forest:
        sizes = np.array([len(p.parent) for p in pages])
        first = np.cumsum(sizes) - sizes
        depth = np.concatenate([p.depth for p in pages])
        order = np.argsort(depth, kind="stable")
        levels = np.split(order, np.cumsum(np.bincount(depth))[:-1])
        parent = np.concatenate([np.where(p.parent < 0, -1, p.parent + f) for p, f in zip(pages, first)])
        return Forest(parent, np.concatenate([p.kind for p in pages]), np.concatenate([p.inputs for p in pages]), levels, first)


class Model(NamedTuple):
    unary: np.ndarray  # weight of each input for "main text"
    pair: np.ndarray  # (kind of child, parent's state, child's state)

    def marginals(self, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
        """P(main text) of each element, and the joint of each element's parent and itself."""
        n = len(forest.parent)
        up = np.zeros((n, 2))
        up[:, 1] = forest.inputs @ self.unary
        edge = self.pair[forest.kind]
        message = np.zeros((n, 2))  # to the parent
        for level in forest.levels[:0:-1]:
            message[level] = np.logaddexp(edge[level, :, 0] + up[level, None, 0], edge[level, :, 1] + up[level, None, 1])
            # Only the parents are touched, so a page of very many levels takes no longer than a flat one.
            np.add.at(up, forest.parent[level], message[level])
        down = np.zeros((n, 2))  # from the parent
        joint = np.zeros((n, 2, 2))
        for level in forest.levels[1:]:
            p = forest.parent[level]
            rest = up[p] + down[p] - message[level]
            both = rest[:, :, None] + edge[level] + up[level][:, None, :]
            joint[level] = both - np.logaddexp.reduce(both, axis=(1, 2), keepdims=True)
            down[level] = np.logaddexp(rest[:, 0, None] + edge[level, 0], rest[:, 1, None] + edge[level, 1])
        belief = up + down
        return np.exp(belief[:, 1] - np.logaddexp(belief[:, 0], belief[:, 1])), np.exp(joint)


def train(pages: list[str], rounds: int = 150, rate: float = 0.15, decay: float = 1e-3) -> Model:
    """Weights from pages whose block elements carry ``data-label``; an element without takes its parent's."""
    parsed = [parse(p) for p in pages]
    forest = Forest.of(parsed)
    state = np.zeros(len(forest.parent), np.int64)
    marks = [m for p in parsed for m in p.marks]
    for i, mark in enumerate(marks):  # parents come first
        state[i] = int(mark) if mark in ("0", "1") else (state[forest.parent[i]] if forest.parent[i] >= 0 else 1)
    inner = np.flatnonzero(forest.parent >= 0)
    of_kind = [inner[forest.kind[inner] == k] for k in range(KINDS)]
    seen = np.stack([np.bincount(2 * state[forest.parent[i]] + state[i], minlength=4).reshape(2, 2) for i in of_kind])
    model = Model(np.zeros(N_INPUTS), np.zeros((KINDS, 2, 2)))
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in model]
    for t in range(1, rounds + 1):
        main, joint = model.marginals(forest)
        expected = np.stack([joint[i].sum(0) for i in of_kind])
        grads = ((state - main) @ forest.inputs / len(pages) - decay * model.unary, (seen - expected) / len(pages) - decay * model.pair)
        for w, g, (m, v) in zip(model, grads, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return model


@functools.cache
def default_model() -> Model:
    return train(labelled_pages())


def texts_of(pages: list[Page], model: Model) -> list[str]:
    forest = Forest.of(pages)
    main = model.marginals(forest)[0] >= 0.5
    return ["\n".join(text for i, text in p.pieces if main[f + i]) for p, f in zip(pages, forest.first.tolist())]


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    model = model or default_model()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "html", STEP_BYTES):
            texts = texts_of([parse(h) for h in batch.column("html").to_pylist()], model)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html"))
    found = rows.mapInArrow(read, f"page_id {kind}, url STRING, text STRING")
    return found.select("*", F.char_length("text").cast("bigint").alias("n_chars"))
