"""File-change events as streams: source, filtering, debounced sessions, incremental sync; one refresh for many callers, progress and cancellation."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import Future

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomgraph.operators.cut import cut
from loomgraph.sources.worktree import SKIPPED_DIRS

# What a watcher ignores, beside the directories that a scan leaves out.
READS = ("view", "read")


def relevant(events: DataFrame) -> DataFrame:
    """Events that may change the index: no reads, and nothing below an ignored top directory where there is a path."""
    out = events.where(~F.col("event_type").isin(*READS))
    if "path" in events.columns:
        out = out.where(F.col("path").isNull() | ~F.element_at(F.split("path", "/"), 1).isin(*SKIPPED_DIRS))
    return out


def debounce(events: DataFrame, gap: str = "10 minutes", key: str = "user_id", watermark: str | None = None) -> DataFrame:
    """One row per quiet-separated burst of a key: opened, closed, events, overflow (an ``error`` event means dropped ones).

    Works on batch and streaming frames; a stream needs ``watermark``, beyond which late events are dropped.
    """
    source = events.withWatermark("ts", watermark) if watermark else events
    sessions = source.groupBy(F.session_window("ts", gap), F.col(key)).agg(F.count(F.lit(1)).alias("events"), F.max(F.col("event_type") == "error").alias("overflow"))
    return sessions.select(key, F.col("session_window.start").alias("opened"), F.col("session_window.end").alias("closed"), "events", "overflow")


def sync_stream(bursts: DataFrame, sync: Callable[[DataFrame, bool, int], None], checkpoint: str):
    """Runs ``sync(batch, full, batch_id)`` for every micro-batch; ``full`` after an overflow.

    Delivery is at least once, so ``sync`` writes the version named by the batch's id and then swaps the pointer: a repeat changes nothing.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        if batch.limit(1).count():
            sync(batch, bool(batch.agg(F.max("overflow").alias("o")).first()["o"]), batch_id)

    return bursts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()


def event_source(spark: SparkSession, folder: str, schema: StructType | str, pattern: str = "*.parquet", max_files: int = 16) -> DataFrame:
    """Files of events that arrive in a folder, as a stream of at most ``max_files`` files a batch: the bound of what waits."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(max_files)).option("pathGlobFilter", pattern).parquet(folder)


class Coalescer:
    """Runs one refresh for all callers that ask while it runs; callers share its result or its error."""

    def __init__(self, refresh: Callable[[], object]):
        self.refresh, self.lock, self.running = refresh, threading.Lock(), None

    def __call__(self) -> object:
        with self.lock:
            leads = self.running is None
            if leads:
                self.running = Future()
            own = self.running
        if leads:
            try:
                own.set_result(self.refresh())
            except BaseException as error:  # noqa: BLE001
                own.set_exception(error)
            finally:
                with self.lock:
                    self.running = None
        return own.result()


class Cancelled(Exception):
    """A run was asked to stop."""


class Progress:
    """Phases of a run, their rows as they are counted, and a way to stop it: the run's jobs carry a tag that ``cancel`` stops."""

    def __init__(self, spark: SparkSession, observe: Callable[[str, int], None] = lambda phase, rows: None):
        self.spark, self.observe, self.tag, self.stopped = spark, observe, f"run-{uuid.uuid4().hex}", False

    def phase(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` computed and kept for the next phase, its rows told to the observer; a cancelled run stops before it."""
        if self.stopped:
            raise Cancelled(name)
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            counted = Observation(name)
            out = cut(df.observe(counted, F.count(F.lit(1)).alias("rows")))
            self.observe(name, counted.get["rows"])
        except Exception as error:
            if self.stopped:
                raise Cancelled(name) from error
            raise
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)
        if self.stopped:
            raise Cancelled(name)
        return out

    def cancel(self) -> None:
        self.stopped = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)
