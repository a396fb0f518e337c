"""Token ids in files: blocks of concatenated ids with Elias-Fano coded document boundaries.

The files are a Parquet table that Spark commits, one row for a block of consecutive documents in ascending doc_id order:

- ``part``, ``block``: place in the order; ``part_start``: ids of the part before the block; ``n_ids``, ``n_docs``.
- ``id_bytes`` (2 or 4) and ``ids``: all ids of the block in a row, little-endian.
- ``ends_*``: the documents' ends within ``ids``. ``doc_*``: the doc_ids less ``doc_first``; the first ``n_null`` documents have
  none. Each is an Elias-Fano code: ``*_width``, ``*_low``, ``*_high`` and the rank directory ``*_ranks`` for select.

There is no 64-bit table: a block's documents cost about 2 + log2(ids per document) bits each for their boundaries.

Nulls: a null text is an empty document, a null doc_id comes first. Rows with equal doc_ids are all kept, in the order of their
texts' hashes. Empty texts have the end id alone. Empty tables give empty files. Other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import steps, text_or_empty
from .elias_fano import EliasFano
from .tokens import PieceEncoder

STEP_BYTES = 4 << 20
_CODES = ("ends", "doc")
BLOCKS = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()),
    T.StructField("part_start", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("n_docs", T.LongType()),
    T.StructField("n_null", T.LongType()), T.StructField("doc_first", T.LongType()),
    T.StructField("id_bytes", T.IntegerType()), T.StructField("ids", T.BinaryType()),
    *[T.StructField(f"{c}_{f}", T.IntegerType() if f == "width" else T.BinaryType()) for c in _CODES
      for f in ("width", "low", "high", "ranks")]])


@functools.cache
def _encoder(path: str, drops_space: bool) -> PieceEncoder:
    return PieceEncoder(path, drops_space)


def block_row(ids: np.ndarray, ends: np.ndarray, doc_ids: list[int | None]) -> dict:
    """One block's columns. ``doc_ids`` ascend, nulls first."""
    known = [d for d in doc_ids if d is not None]
    first = known[0] if known else 0
    id_bytes = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    row = {"n_ids": len(ids), "n_docs": len(doc_ids), "n_null": len(doc_ids) - len(known), "doc_first": first,
           "id_bytes": id_bytes, "ids": ids.astype(f"<u{id_bytes}").tobytes()}
    for c, numbers in (("ends", ends), ("doc", np.array([d - first for d in known], np.uint64))):
        code = EliasFano.of(numbers)
        row |= {f"{c}_{f}": getattr(code, f) for f in ("width", "low", "high", "ranks")}
    return row


def open_block(row: dict) -> tuple[np.ndarray, np.ndarray, list[int | None]]:
    """The ids, the documents' ends by select, and the doc_ids of a block."""
    code = {c: EliasFano(n, *(row[f"{c}_{f}"] for f in ("width", "low", "high", "ranks")))
            for c, n in (("ends", row["n_docs"]), ("doc", row["n_docs"] - row["n_null"]))}
    ends, docs = (code[c].select(np.arange(code[c].count)) for c in _CODES)
    doc_ids = [None] * row["n_null"] + [row["doc_first"] + d for d in docs.tolist()]
    return np.frombuffer(row["ids"], f"<u{row['id_bytes']}"), ends.astype(np.int64), doc_ids


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, drops_space: bool = False,
                      block_ids: int = 1 << 20) -> None:
    """Write the ids of all texts, each with ``end_id`` behind it, in ascending doc_id order.

    Only texts are shuffled, once, by ranges of doc_id. A block ends with the document that brings it to ``block_ids`` ids.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, drops_space)
        part, block, written = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        ends: list[int] = []
        doc_ids: list[int | None] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, written, size
            row = block_row(np.concatenate(held), np.array(ends, np.int64), doc_ids)
            row |= {"part": part, "block": block, "part_start": written}
            block, written, size = block + 1, written + size, 0
            held.clear(), ends.clear(), doc_ids.clear()
            return pa.RecordBatch.from_pylist([row], arrow)

        for batch in steps(batches, "text", STEP_BYTES):
            ids, borders = encoder.encode(batch.column("text"), end_id)
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), borders[:-1].tolist(), borders[1:].tolist()):
                held.append(ids[a:b])
                size += b - a
                ends.append(size)
                doc_ids.append(doc_id)
                if size >= block_ids:
                    yield flush()
            held[:] = [x.copy() for x in held]  # a view would keep the whole step
        if doc_ids:
            yield flush()

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(BLOCKS)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    ordered.mapInArrow(blocks, BLOCKS).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids."""
    files = spark.read.schema(BLOCKS).parquet(path)
    # One row per part: as many as the writer had tasks, whatever the table holds.
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select(F.col("part").alias("p"), F.expr("sum(n) OVER (ORDER BY part) - n").alias("part_base"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one block at a time
                row = batch.slice(i, 1).to_pylist()[0]
                ids, ends, doc_ids = open_block(row)
                raw = ids.astype("<u4")
                starts = np.concatenate([[0], ends[:-1]])
                spans = list(zip(starts.tolist(), ends.tolist()))
                columns = [pa.array(doc_ids, pa.int64()), pa.array(starts + row["part_base"] + row["part_start"], pa.int64()),
                           pa.array(ends - starts, pa.int64()), pa.array([zlib.crc32(raw[a:b]) for a, b in spans], pa.int64())]
                if with_ids:
                    columns.append(pa.array([raw[a:b] for a, b in spans], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = "doc_id BIGINT, start BIGINT, n_tokens BIGINT, ids_crc32 BIGINT" + (", ids ARRAY<INT>" if with_ids else "")
    return files.join(F.broadcast(before), files["part"] == before["p"]).drop("p").mapInArrow(documents, schema)
