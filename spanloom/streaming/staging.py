"""Staged spans: a stream of span lines into a table, and settled traces out of it.

The stream only stages (append, one row for each trace and span key). A trace is settled once its last span
is older than the quiet period; settling is a batch over the staging table, run after each micro-batch or by
a scheduler, so the same operator answers files, streams and tests. Spans that come late find their trace's
id taken and are dropped.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import settled_traces
from ..operators.traces import assemble, dedupe_key
from ..sources.spans import parse_lines
from ..session import checkpointed
from ..sources.tables import Store

SETTLE = timedelta(seconds=30)
PAGE = 1000
POLL = "5 seconds"


def staged(spans: DataFrame, received_at) -> DataFrame:
    """Good spans as staging rows."""
    return spans.where("error is null").select("trace_id", dedupe_key(F.col("span_id"), F.col("raw")).alias("span_key"), received_at.cast("timestamp").alias("received_at"), F.col("raw").alias("span"))


def stage(store: Store, spans: DataFrame, received_at: datetime) -> int:
    """Insert or ignore by (trace, span key); the number of new rows."""
    return store.add("pending_spans", staged(spans, F.lit(received_at)), ["received_at"])


def span_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Span lines of a landing folder, as they arrive, with their arrival time."""
    lines = spark.readStream.text(folder).select(F.lit(0).cast("long").alias("line_no"), "value")
    return parse_lines(lines).withColumn("received_at", F.current_timestamp())


def deduplicated(stream: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Within the stream: one row for each trace and span key while the watermark remembers it."""
    rows = staged(stream, F.col("received_at"))
    return rows.withWatermark("received_at", lateness).dropDuplicatesWithinWatermark(["trace_id", "span_key"])


def run(store: Store, folder: str, checkpoint: str, settle: timedelta = SETTLE, once: bool = False, clock=lambda: datetime.now().astimezone()) -> StreamingQuery:
    """Stage what arrives, and flush what has settled, micro-batch by micro-batch."""

    def batch(rows: DataFrame, _: int) -> None:
        rows = rows.select("trace_id", "span_key", "received_at", "span")
        store.add("pending_spans", rows, ["received_at"])
        flush(store, clock(), settle)

    writer = deduplicated(span_stream(store.spark, folder)).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL)).start()


def flush(store: Store, now: datetime, settle: timedelta = SETTLE, limit: int | None = None, agent_id: str = "default") -> int:
    """Assemble settled traces, insert those that are new, and clear their staged spans; one transaction."""
    pending = store.table("pending_spans")
    ids = checkpointed(settled_traces(pending, now - settle, limit).select("trace_id"))
    if ids.isEmpty():
        return 0
    rows = pending.join(ids, "trace_id", "left_semi")
    lines = rows.select(F.lit(0).cast("long").alias("line_no"), F.col("span").alias("value"))
    with store.transaction():
        n = store.add("traces", assemble(parse_lines(lines).where("error is null"), agent_id))
        store.delete("pending_spans", rows.select("trace_id", "span_key"))
        for name in ("pending_spans", "traces"):
            store.compact_beyond(name)
    return n


def pending_count(store: Store) -> int:
    return store.table("pending_spans").count()


def sessions(stream: DataFrame, gap: str = "30 seconds") -> DataFrame:
    """The watermark form: a trace's spans gathered by quiet period, emitted once the watermark passes it."""
    rows = staged(stream, F.col("received_at")).withWatermark("received_at", gap)
    return quiet_periods(rows, gap, F.collect_set(F.struct("span_key", "span")).alias("spans"))


def quiet_periods(rows: DataFrame, gap: str, *facts) -> DataFrame:
    """Each trace's runs of rows (trace_id, received_at) without a pause of ``gap``; of a batch or a stream."""
    every = rows.groupBy("trace_id", F.session_window("received_at", gap)).agg(F.min("received_at").alias("first_at"), F.max("received_at").alias("last_at"), *facts)
    return every.drop("session_window")
