"""Consuming a topic: handlers for messages, bad rows and idle batches, and the counts of a run."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

Handler = Callable[[DataFrame, int], None]


def consume(stream: DataFrame, checkpoint: str, on_message: Handler, on_error: Handler,
            on_wait: Callable[[int], None] | None = None, available_now: bool = True) -> StreamingQuery:
    """Give each micro-batch's decoded rows to ``on_message`` and the undecodable ones to ``on_error``.

    ``stream`` has the columns ``message`` and ``raw``. A failed batch is run again from the checkpoint, so handlers
    must overwrite by batch id. ``on_wait`` is called with the number of idle reports so far whenever the running query reports
    that nothing has come, every ``spark.sql.streaming.noDataProgressEventInterval``. Totals: :class:`DeliveryCounts`.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            counts = batch.agg(F.count("message").alias("good"), F.count("raw").alias("bad")).first()
            if counts["good"]:
                on_message(batch.where(F.col("message").isNotNull()).select("message.*"), batch_id)
            if counts["bad"]:
                on_error(batch.where(F.col("raw").isNotNull()).select("raw"), batch_id)
        finally:
            batch.unpersist()

    observed = stream.observe("delivery", F.count("message").alias("delivered"), F.count("raw").alias("rejected"))
    writer = observed.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")
    if on_wait is not None:
        waiting = _Waiting(on_wait)
        stream.sparkSession.streams.addListener(waiting)
        query = writer.start()
        waiting.run_id = str(query.runId)
        return query
    return writer.start()


class _Waiting(StreamingQueryListener):
    """Passes the idle reports of one run on."""

    def __init__(self, on_wait: Callable[[int], None]):
        self.on_wait, self.run_id, self.times = on_wait, None, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        if str(event.runId) == self.run_id:
            self.times += 1
            self.on_wait(self.times)

    def onQueryTerminated(self, event) -> None:
        pass


class DeliveryCounts(StreamingQueryListener):
    """Rows delivered and rejected over whole runs, by run id; add it with ``spark.streams.addListener`` before the start."""

    def __init__(self):
        self.totals: dict[str, dict[str, int]] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        self.totals[str(event.runId)] = {"delivered": 0, "rejected": 0}

    def onQueryProgress(self, event) -> None:
        metrics = event.progress.observedMetrics.get("delivery")
        totals = self.totals.setdefault(str(event.progress.runId), {"delivered": 0, "rejected": 0})
        for name in totals if metrics is not None else ():
            totals[name] += metrics[name]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))

    def of(self, query: StreamingQuery, seconds: float = 30.0) -> dict[str, int]:
        """The totals of a run that has ended, once its last report is in."""
        until = time.monotonic() + seconds
        while str(query.runId) not in self.ended and time.monotonic() < until:
            time.sleep(0.05)
        return dict(self.totals[str(query.runId)])

    def store(self, spark: SparkSession, query: StreamingQuery, path: str) -> None:
        """Keep the totals of a run that has ended as a row of a table, by run id."""
        totals = self.of(query)
        row = spark.range(1).select(F.lit(str(query.id)).alias("query_id"), *[F.lit(n).cast("bigint").alias(c) for c, n in totals.items()])
        row.write.mode("overwrite").parquet(f"{path}/run={query.runId}")


RUN_COUNTS = "query_id STRING, delivered BIGINT, rejected BIGINT"


def table_handler(path: str) -> Handler:
    """Write each batch to its own folder, so that a repeated batch replaces itself."""
    return lambda rows, batch_id: rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def notifications_with_documents(stream: DataFrame, documents: DataFrame) -> DataFrame:
    """Each notification with the stored document of its recording, if there is one."""
    return stream.join(documents.withColumnRenamed("name", "mseed_name"), "mseed_name", "left")
