"""Search on streams: stored queries, refreshing snapshots and event windows."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.monitor import Monitor
from ..sources.store import IndexStore


def percolate(documents: DataFrame, monitor: Monitor, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A stream of (doc_id, query, score) of a stream of documents."""
    return monitor.match(documents, text, key)


def percolate_batches(documents: DataFrame, monitor: Callable[[], Monitor], sink: Callable[[DataFrame, int], None], checkpoint: str, text: str = "text", key: str = "doc_id", once: bool = True):
    """Each micro-batch against the queries registered when it starts; sink gets (matches, batch id)."""

    def run(batch: DataFrame, number: int) -> None:
        sink(monitor().match(batch, text, key), number)

    w = documents.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def index_stream(documents: DataFrame, store: IndexStore, fields: dict, checkpoint: str, once: bool = True, interval: str = "10 seconds"):
    """Every micro-batch as a segment; a batch that is replayed replaces its own documents."""

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.update(batch, fields)

    w = documents.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=interval)).start()


@dataclass
class SearcherManager:
    """Snapshots of a store: acquire() gives one that stays the same until refresh(); by token, older ones stay for paging."""

    store: IndexStore
    fields: dict
    version: int | None = None
    leases: dict[int, object] = field(default_factory=dict)

    def acquire(self):
        if self.version is None:
            self.refresh()
        return self.leases[self.version]

    def refresh(self) -> bool:
        """Whether there was something newer."""
        newest = (self.store.versions() or [None])[-1]
        if newest == self.version or newest is None:
            return False
        self.version = newest
        self.leases[newest] = self.store.open(self.fields, newest)
        return True

    def wait_for(self, version: int, seconds: float = 60.0, every: float = 0.05) -> bool:
        """Refreshes until the snapshot is of a version, or a later one; false if that takes too long."""
        end = time.monotonic() + seconds
        while (self.version or 0) < version:
            if not self.refresh() and (self.version or 0) < version:
                if time.monotonic() > end:
                    return False
                time.sleep(every)
        return True

    def token(self) -> int:
        self.acquire()
        return self.version

    def by_token(self, token: int):
        """The snapshot of a token, or None if it was pruned."""
        return self.leases.get(token)

    def prune(self, keep: int = 1) -> None:
        for v in sorted(self.leases)[:-keep]:
            del self.leases[v]


class SlowLog(StreamingQueryListener):
    """Micro-batches that took longer than a limit."""

    def __init__(self, limit_ms: int):
        self.limit_ms, self.slow = limit_ms, []

    def onQueryStarted(self, event):  # noqa: N802
        pass

    def onQueryProgress(self, event):  # noqa: N802
        if event.progress.batchDuration > self.limit_ms:
            self.slow.append((event.progress.batchId, event.progress.batchDuration))

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        pass


def tumbling(events: DataFrame, time: str, width: str, *by: str, late: str = "1 hour") -> DataFrame:
    """(start, by..., count, total) by fixed windows; rows later than `late` are left out of a stream."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    g = e.groupBy(F.window(time, width), *by).agg(F.count("*").alias("count"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), *by, "count", "total")


def sliding(events: DataFrame, time: str, width: str, slide: str, *by: str, late: str = "1 hour") -> DataFrame:
    e = events.withWatermark(time, late) if events.isStreaming else events
    g = e.groupBy(F.window(time, width, slide), *by).agg(F.count("*").alias("count"))
    return g.select(F.col("window.start").alias("start"), *by, "count")


def sessions(events: DataFrame, time: str, gap: str, by: str, late: str = "1 hour") -> DataFrame:
    """(start, stop, by, count) of runs of events without a gap."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    g = e.groupBy(F.session_window(time, gap), by).agg(F.count("*").alias("count"))
    return g.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), by, "count")


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that a stream has now, through a memory table."""
    spark: SparkSession = stream.sparkSession
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def run_complete(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """The whole result of an aggregation over all that a stream has now, written by the executors to the shared folder `out`: a memory table would hold it in the driver."""
    spark: SparkSession = stream.sparkSession
    written = []

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)
        written.append(number)

    stream.writeStream.foreachBatch(run).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out) if written else spark.createDataFrame([], stream.schema)
