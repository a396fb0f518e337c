"""Waveform files of any size: an index of their records, and ranges of records read and decoded by many tasks.

Only a record itself tells how long it is, so the borders inside a file are found by walking through it. One task per file does that, in
windows of a few MB and without decoding, and gives ranges (path, first_record, offset, length) of whole records. The index is a small table
that can be kept. The ranges are dealt to all tasks, and each task opens the file at its place, so neither a file's size nor that of
a ``binaryFile`` row limits anything.

Tasks open files through pyarrow's file systems (local and mounted folders, HDFS, object stores). A range that is read again after an
executor is lost gives the same rows.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import SECOND_US
from ..operators.blocks import running
from ..schemas import RECORD_RANGE, WAVE_RECORD
from .waveform import FORMAT_ERRORS, channel_id, layout, record_frames, unrolled

RANGE_BYTES = 4 << 20
TASK_BYTES = 128 << 20
SEGMENT_BLOCK_S = 3600
#: Links between blockettes are 16-bit numbers, so whatever tells a record's length lies within this many bytes.
_HEADER_BYTES = 66_000
_WINDOW_BYTES = 4 << 20
#: A broken length must not put the rest of a file into one range.
_RECORD_BYTES = 1 << 24


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if re.match("[A-Za-z][A-Za-z0-9+.-]*:", path) and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)


def open_file(path: str) -> pa.NativeFile:
    system, name = _place(path)
    return system.open_input_file(name)


def write_file(path: str, content: bytes) -> None:
    """Write a file in one step: attempts of one task that run side by side leave one whole file."""
    system, name = _place(path)
    folder, _, last = name.rpartition("/")
    system.create_dir(folder, recursive=True)
    # Names with a leading dot are no input.
    draft = f"{folder}/.{last}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as file:
        file.write(content)
    system.move(draft, name)


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length) of the files of a folder; their content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length")


def _ranges(path: str, size: int, range_bytes: int) -> Iterator[tuple[str, int, int, int]]:
    with open_file(path) as file:
        window, base = b"", 0
        start = at = first = number = 0
        while at < size:
            if base + len(window) < min(size, at + _HEADER_BYTES):
                file.seek(at)
                window, base = file.read(_WINDOW_BYTES), at
            try:
                length = layout(window, at - base)[0]
            except FORMAT_ERRORS:
                # Decoding stops here too, with an error row, for which the bytes of a header are enough.
                yield path, first, start, min(size, at + _HEADER_BYTES) - start
                return
            stop = min(size, at + min(length, _RECORD_BYTES))
            at, number = at + length, number + 1
            if stop - start >= range_bytes or length > _RECORD_BYTES or at >= size:
                yield path, first, start, stop - start
                start, first = at, number


def index_files(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows (path, length) to ranges of whole records of about ``range_bytes``; an empty file has none."""
    columns = [part.split()[0] for part in RECORD_RANGE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, size in zip(batch["path"], batch["length"]):
                yield pd.DataFrame(_ranges(path, int(size), range_bytes), columns=columns)

    return files.select("path", "length").mapInPandas(run, RECORD_RANGE)


def decode_ranges(ranges: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The records of the ranges of a stored index, the rows that decoding whole files gives.

    The ranges of about ``task_bytes`` make a task. Their number is set, because the few bytes of the index would all go into one.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, first, offset, length in batch[["path", "first_record", "offset", "length"]].itertuples(index=False):
                with open_file(path) as file:
                    file.seek(offset)
                    content = file.read(length)
                yield from record_frames(path, content, first, offset)

    total = ranges.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return ranges.repartition(max(1, math.ceil(total / task_bytes))).mapInPandas(run, WAVE_RECORD)


def long_record_samples(records: DataFrame, block_s: int = SEGMENT_BLOCK_S) -> DataFrame:
    """Sample rows like ``record_samples``, for files whose channels are too long for one task.

    Segments are numbered from the records' times alone, block by block of ``block_s`` seconds; what a block starts from comes from one
    summary row per earlier block. The samples then join their record. ``records`` is read twice and should be a stored table.
    """
    at = F.struct("start_us", "record_no")
    step = F.lit(float(SECOND_US)) / F.col("sampling_rate")
    usable = records.where(F.col("error").isNull() & (F.col("npts") > 0) & (F.col("sampling_rate") > 0))
    meta = usable.select(*channel_id(), "record_no", "start_us", "sampling_rate", (F.col("start_us") + F.col("npts") * step).alias("_stop"), at.alias("_at"))
    block = F.floor(F.col("start_us") / F.lit(block_s * SECOND_US))
    last = F.struct("start_us", "record_no", "_stop", "sampling_rate")
    meta = running(meta, channel_id(), "_at", block, {"_before": (last, "max")}, inclusive=False)
    apart = F.abs(F.col("start_us") - F.col("_before._stop")) > step / 2
    jump = F.col("_before").isNull() | (F.col("_before.sampling_rate") != F.col("sampling_rate")) | apart
    meta = meta.withColumn("_jump", jump).drop("_before")
    placed = running(meta, channel_id(), "_at", block, {
        "segment": (F.col("_jump").cast("int"), "sum"), "_from": (F.when(F.col("_jump"), F.col("start_us")), "max")})
    return unrolled(usable.join(placed.select("file", "record_no", "segment", "_from"), ["file", "record_no"]))
