"""Nearest neighbours by learned partitions.

On a bounded sample a graph of nearest neighbours is cut into balanced parts that keep neighbours together. A small network learns
to tell a vector's part, and every vector is filed under its most probable one. A second network learns in which parts a vector's
neighbours are filed; a query is sent to the most probable of them until their probabilities reach ``mass``. Inside a part the
inner products with all its vectors are computed, in blocks of bounded size. The most probable part is searched first; the others return only what is no worse than a query's last neighbour from there.

The number of parts grows with the table, so a query meets about ``probes`` times ``part_rows`` vectors whatever the table holds, as
long as the sample can tell that many parts; beyond, parts grow and are cut into more blocks.

Vectors that are null, all zero, hold a null or a component that isn't finite, or differ in length from the most frequent length
take no part. Repeated vectors are all candidates; ties go to the smaller vec_id. A row is no candidate of a query with its own
vec_id. Without vectors there are no rows. Null vec_ids are no queries and no candidates. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import parts


def neighbour_graph(x: np.ndarray, k: int, run: int = 1024) -> np.ndarray:
    """The ``k`` rows with the largest inner product of each row."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), run):
        scores = x[a:a + run] @ x.T
        scores[np.arange(len(scores)), np.arange(a, a + len(scores))] = -np.inf
        out[a:a + run] = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, n: int, rounds: int = 12, slack: float = 1.1, seed: int = 3) -> np.ndarray:
    """A part for each row: start from near centres, then let rows follow their neighbours while parts stay within ``slack`` of even."""
    rng = np.random.default_rng(seed)
    room = int(np.ceil(len(x) / n * slack))
    centres = x[rng.permutation(len(x))[:n]]
    part = np.zeros(len(x), np.int64)

    def place(wish: np.ndarray) -> np.ndarray:
        """Rows take the part they wish for most that has room, the most certain rows first."""
        found, left = np.empty(len(x), np.int64), np.full(n, room)
        order = np.argsort(-wish, axis=1, kind="stable")
        top = np.take_along_axis(wish, order, axis=1)
        for i in np.argsort(top[:, min(1, n - 1)] - top[:, 0], kind="stable").tolist():
            for p in order[i].tolist():
                if left[p]:
                    found[i], left[p] = p, left[p] - 1
                    break
        return found

    for _ in range(4):
        part = place(x @ centres.T)
        centres = np.stack([x[part == p].mean(0) if (part == p).any() else centres[p] for p in range(n)])
    for _ in range(rounds):
        votes = np.zeros((len(x), n))
        for j in range(graph.shape[1]):
            votes[np.arange(len(x)), part[graph[:, j]]] += 1
            np.add.at(votes, (graph[:, j], part), 1)
        moved = place(votes + 1e-3 * (x @ centres.T))
        if (moved == part).mean() > 0.995:
            break
        part = moved
    return part


class Router(NamedTuple):
    """A network with one hidden layer that tells the probabilities of the parts."""

    weights: list[np.ndarray]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2, skip = self.weights
        z = np.maximum(x @ w1 + b1, 0) @ w2 + x @ skip + b2
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def fit_router(x: np.ndarray, wanted: np.ndarray, hidden: int = 128, epochs: int = 16, batch: int = 256, rate: float = 4e-3, seed: int = 5) -> Router:
    """The network closest, by cross entropy, to the given probabilities of each row."""
    rng = np.random.default_rng(seed)
    d, n = x.shape[1], wanted.shape[1]
    w = [rng.normal(0, d ** -0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden ** -0.5, (hidden, n)), np.zeros(n), np.zeros((d, n))]
    moments, t = [[np.zeros_like(a), np.zeros_like(a)] for a in w], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            rows = order[a:a + batch]
            xb = x[rows]
            h = np.maximum(xb @ w[0] + w[1], 0)
            z = h @ w[2] + xb @ w[4] + w[3]
            z = np.exp(z - z.max(1, keepdims=True))
            g = (z / z.sum(1, keepdims=True) - wanted[rows]) / len(rows)
            gh = (g @ w[2].T) * (h > 0)
            t += 1
            for weight, grad, (m, v) in zip(w, (xb.T @ gh, gh.sum(0), h.T @ g, g.sum(0), xb.T @ g), moments):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                weight -= rate * (0.3 if epoch * 3 > 2 * epochs else 1) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return Router(w)


class Index(NamedTuple):
    """``files`` tells a vector's own part, ``routes`` its neighbours' parts."""

    files: Router
    routes: Router


def fit(x: np.ndarray, n: int, neighbours: int = 20) -> Index:
    """Networks for ``n`` balanced parts of the sample's neighbour graph."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    graph = neighbour_graph(x, min(neighbours, len(x) - 1)) if len(x) > 1 else np.zeros((len(x), 1), np.int64)
    files = fit_router(unit, np.eye(n)[balanced_parts(unit, graph[:, :10], n)])
    part = files.probabilities(unit).argmax(1)
    wanted = np.zeros((len(x), n))
    for j in range(graph.shape[1]):
        wanted[np.arange(len(x)), part[graph[:, j]]] += 1 / graph.shape[1]
    return Index(files, fit_router(unit, wanted))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and the vector as doubles, of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.select("vec_id", x.alias("x")).filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite & F.exists("x", lambda v: v != 0))
    lengths = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("x") == (lengths["n"] if lengths else 0))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.empty((0, 0))


def _top(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of ``rows`` for each query, none below its ``floor``, with exact scores."""
    q, c = _matrix(queries["x"]), _matrix(rows["x"])
    ids, names, floor = rows["vec_id"].to_numpy(), queries["vec_id"].to_numpy(), queries["floor"].to_numpy()
    out = []
    for a in range(0, len(q), 256):
        scores = q[a:a + 256] @ c.T
        scores[names[a:a + 256, None] == ids[None, :]] = -np.inf
        keep = min(k, scores.shape[1])
        cut = np.maximum(-np.partition(-scores, keep - 1, axis=1)[:, keep - 1], floor[a:a + 256])
        # Whatever rounding could lift into the best is scored again, component by component.
        i, j = np.nonzero((scores >= (cut - 1e-9 * (1 + np.abs(cut)))[:, None]) & np.isfinite(scores))
        out.append(pd.DataFrame({"query_id": names[a + i], "vec_id": ids[j], "score": (q[a + i] * c[j]).sum(axis=1)}))
    found = pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
    return found.groupby("query_id", sort=False).head(k)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, sample: int = 8192, part_rows: int = 1024, most_parts: int = 64, mass: float = 0.92,
            block: int = 4096) -> DataFrame:
    """One row per query and neighbour: query_id, rank, vec_id, score.

    The router is fitted on the ``sample`` vectors with the smallest hashes of their vec_ids; there are as many parts as
    ``part_rows`` asks for, ``most_parts`` at most. A query goes to the parts that hold ``mass`` of its probability, and to further ones until
    they hold k other rows, so it gets k neighbours wherever the table has them. Rows that share a vec_id are no candidates of each other.
    """
    rows = usable(vectors)
    schema = "query_id BIGINT, rank INT, vec_id BIGINT, score DOUBLE"
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    if drawn.empty:
        return vectors.sparkSession.createDataFrame([], schema)
    total = rows.count()
    n = max(1, min(most_parts, parts(total, part_rows), len(drawn) // 32 or 1))
    index = fit(_matrix(drawn["x"]), n)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack(batch.column("x").to_numpy(zero_copy_only=False))
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            part, p = index.files.probabilities(unit).argmax(1), index.routes.probabilities(unit)
            order = np.argsort(-p, axis=1, kind="stable")
            before = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1) - np.take_along_axis(p, order, axis=1)
            probes = [o.tolist() if ask else [] for o, ask in zip(order, batch.column("asks").to_pylist())]
            likely = (before < mass).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(part, pa.int32()), pa.array(probes, pa.list_(pa.int32())), pa.array(likely, pa.int32())],
                                             ["vec_id", "x", "part", "probes", "likely"])

    filed = stored(rows.select("vec_id", "x", F.coalesce(is_query, F.lit(False)).alias("asks")).mapInArrow(
        file, "vec_id BIGINT, x ARRAY<DOUBLE>, part INT, probes ARRAY<INT>, likely INT"), "filed")
    counts = stored(filed.groupBy("part").agg(F.count("*").alias("rows")), "part-rows")
    held = counts.select("part", F.ceil(F.col("rows") / block).cast("int").alias("row_blocks"))
    rows_of = dict(counts.collect())  # at most most_parts numbers
    sizes = F.array(*[F.lit(rows_of.get(i, 0)).cast("bigint") for i in range(n)])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def searched(sent: DataFrame) -> DataFrame:
        """The best of the parts that queries (vec_id, x, floor, part) are sent to: query_id, vec_id, score."""
        asked = sent.groupBy("part").agg(F.ceil(F.count("*") / block).cast("int").alias("query_blocks"))
        shape = F.broadcast(held.join(asked, "part"))  # at most most_parts rows

        def dealt(side: DataFrame, own: str, other: str) -> GroupedData:
            """Each row in one block of its own kind, once for every block of the other kind."""
            mine = F.pmod(F.xxhash64("vec_id", F.lit(own)), F.col(own)).cast("int").alias(own)
            others = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other)
            # New names of the same columns, as both sides come from one table.
            return side.join(shape, "part").select(*[F.col(c).alias(c) for c in side.columns], mine, others).groupBy("part", "row_blocks", "query_blocks")

        def search(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
            n = min(len(queries), len(candidates))
            return _top(queries if n else queries[:0], candidates if n else candidates[:0], k).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

        pairs = dealt(sent, "query_blocks", "row_blocks").cogroup(dealt(filed.select("vec_id", "x", "part"), "row_blocks", "query_blocks"))
        return pairs.applyInPandas(search, "query_id BIGINT, vec_id BIGINT, score DOUBLE")

    def enough() -> Column:
        """The number of parts, the most probable first, that hold k rows besides the query's own."""
        none = F.struct(F.lit(0).cast("bigint").alias("rows"), F.lit(0).alias("parts"))
        return F.aggregate("probes", none, lambda s, p: F.struct(
            (s["rows"] + F.get(sizes, p)).alias("rows"), (s["parts"] + F.when(s["rows"] <= k, 1).otherwise(0)).alias("parts")), lambda s: s["parts"])

    queries = filed.filter(F.size("probes") > 0).withColumn("probes", F.slice("probes", 1, F.greatest(F.col("likely"), enough())))
    nothing = F.lit(float("-inf"))
    first = stored(best(searched(queries.select("vec_id", "x", nothing.alias("floor"), F.get("probes", F.lit(0)).alias("part")))), "first-part")
    floors = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(nothing).alias("floor"))
    further = queries.select("vec_id", "x", F.explode(F.slice("probes", 2, F.size("probes"))).alias("part")).join(floors, F.col("vec_id") == F.col("query_id"), "left")
    rest = searched(further.select("vec_id", "x", F.coalesce("floor", nothing).alias("floor"), "part"))
    return best(first.drop("rank").union(rest)).select("query_id", "rank", "vec_id", "score")
