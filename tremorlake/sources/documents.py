"""Nested recording documents: name and list of traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import array_to_text


def trace_documents(traces: DataFrame) -> DataFrame:
    """(name, traces): one document per file, its traces in trace order, sample arrays as text.

    A document holds what one file holds. For files beyond a row's size use the trace rows themselves.
    """
    trace = F.struct(
        "trace_no", "network", "station", "location", "channel",
        F.date_format("starttime", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("starttime"),
        F.date_format("endtime", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("endtime"),
        "sampling_rate", "delta", "npts", "calib", array_to_text("data").alias("data"))
    rows = traces.select(F.col("file").alias("name"), trace.alias("trace"))
    return rows.groupBy("name").agg(F.array_sort(F.collect_list("trace")).alias("traces"))
