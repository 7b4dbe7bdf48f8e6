"""Traces settled inside the stream: a state for each trace, and a timer that ends it.

A trace's spans gather in keyed state, one for each span key, so a span that is sent again changes nothing. Every batch that brings a
trace something new sets its timer anew; once no span has come for the quiet period, the timer hands the spans on and leaves a
mark, which goes by itself after ``remember``. A span that comes while the mark stands is late: it is handed on as such, and never opens the trace again. State lives in
RocksDB under the query's checkpoint, so a batch touches the traces that it brings spans of and those that are due, not all that
wait, and a restarted query goes on where the last committed batch ended.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.traces import assemble
from ..session import ship
from ..sources.spans import parse_lines
from ..sources.tables import Store
from . import staging

#: How long a settled trace is known as such.
REMEMBER = timedelta(hours=1)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTLED = "trace_id string, span_key string, span string, late boolean"


class Settling(StatefulProcessor):
    def __init__(self, quiet_ms: int, remember_ms: int):
        self.quiet_ms, self.remember_ms = quiet_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getMapState("spans", "span_key string", "span string")
        self.done = handle.getValueState("done", "settled boolean", self.remember_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.done.exists():
            for batch in rows:
                yield batch[["trace_id", "span_key", "span"]].assign(late=True)
            return
        fresh = False
        for batch in rows:
            for name, span in zip(batch["span_key"], batch["span"], strict=True):
                if not self.spans.containsKey((name,)):
                    self.spans.updateValue((name,), (span,))
                    fresh = True
        if fresh:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [(key[0], k[0], v[0], False) for k, v in self.spans.iterator()]
        self.spans.clear()
        self.done.update((True,))
        yield pd.DataFrame(held, columns=["trace_id", "span_key", "span", "late"])

    def close(self) -> None:
        pass


def settled(staged: DataFrame, settle: timedelta = staging.SETTLE, remember: timedelta = REMEMBER) -> DataFrame:
    """A stream of staging rows -> (trace_id, span_key, span, late): the spans of traces that have settled, and late ones."""
    spark = staged.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    ms = lambda x: int(x.total_seconds() * 1000)
    rows = staged.select("trace_id", "span_key", "span")
    return rows.groupBy("trace_id").transformWithStateInPandas(Settling(ms(settle), ms(remember)), SETTLED, "append", "processingTime")


def run(store: Store, folder: str, checkpoint: str, settle: timedelta = staging.SETTLE, remember: timedelta = REMEMBER, poll: str = staging.POLL, agent_id: str = "default") -> StreamingQuery:
    """Span files as they arrive -> settled traces in ``traces``, late spans in ``late_spans``."""

    def batch(rows: DataFrame, _: int) -> None:
        rows = rows.persist()
        try:
            lines = rows.where("not late").select(F.lit(0).cast("long").alias("line_no"), F.col("span").alias("value"))
            with store.transaction():
                store.add("traces", assemble(parse_lines(lines).where("error is null"), agent_id))
                store.add("late_spans", rows.where("late").select("trace_id", "span_key", F.lit(datetime.now().astimezone()).alias("received_at"), "span"), ["received_at"])
        finally:
            rows.unpersist()

    rows = staging.staged(staging.span_stream(store.spark, folder), F.col("received_at"))
    return settled(rows, settle, remember).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=poll).start()
