"""The speed layer: decoded events to per-minute metrics and to the archive, as supervised streaming queries."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from inputlens.functions.events import event_count_exprs
from inputlens.operators.counts import minute_metrics
from inputlens.schema import EVENT
from inputlens.sources.archive import create_once
from inputlens.sources.events import decode, good

#: How long after its end a minute still takes late events.
LATENESS = "5 seconds"


def decoded_events(lines: DataFrame) -> DataFrame:
    """Good events of a stream of JSON lines. Each query started on it reads and decodes the source for itself."""
    return good(decode(lines))


def live_metrics(events: DataFrame, window_s: int = 60, lateness: str = LATENESS) -> DataFrame:
    """Per (user, minute) counts; in append mode a minute is emitted once, when the watermark passes its end."""
    return minute_metrics(events.withWatermark("event_time", lateness), window_s)


def live_sessions(events: DataFrame, gap_s: int = 300, lateness: str = LATENESS) -> DataFrame:
    """Sessions as they close: members as in the batch layer; the end is that of the last minute with an event."""
    w = F.session_window("event_time", f"{gap_s} seconds").alias("w")
    minute = F.date_trunc("minute", F.col("event_time"))
    counted = events.withWatermark("event_time", lateness).groupBy(w, "user").agg(
        F.min(minute).alias("session_start"), (F.max(minute) + F.expr("INTERVAL 1 MINUTE")).alias("session_end"),
        F.size(F.collect_set(minute)).cast("long").alias("window_count"), *event_count_exprs(),
    )
    # the stored gap counts from the last event, a gap of exactly gap_s belongs to the session in both layers
    return counted.select(F.unix_micros("w.start").alias("session_key"), "user", "session_start", "session_end", "window_count", "keystrokes", "words", "corrections", "clicks")


#: Rows of a stream that wait for the watermark: times as microseconds, other columns as in ``EVENT``.
_WAITING = T.StructType([T.StructField("us", T.LongType()), *EVENT.fields])


class MoveThinner(StatefulProcessor):
    """Thins one user's moves in the order of their times, whatever the order in which they come.

    A move waits until the watermark has passed it; then no earlier one can come, and it is kept or dropped for good. State is the last
    kept time and the moves that wait. A user that sends nothing for ``forget_s`` of event time is forgotten, which changes
    nothing: no later move can be that close."""

    def __init__(self, gap_us: int, forget_s: int):
        self.gap_us, self.forget_ms = gap_us, max(forget_s * 1000, gap_us // 1000 + 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [r for pdf in rows for r in pdf[_WAITING.names].astype(object).where(pdf[_WAITING.names].notna(), None).itertuples(index=False, name=None)]
        if new:
            self.waiting.appendList(new)
            # due when the watermark has passed the newest of them, whole milliseconds up
            self.handle.registerTimer(max(r[0] for r in new) // 1000 + 1)
        yield self.due(timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        out = self.due(now)
        if not self.waiting.exists() and self.last.exists():
            forget = self.last.get()[0] // 1000 + self.forget_ms
            if now >= forget:
                self.last.clear()
            else:
                self.handle.registerTimer(forget)
        yield out

    def due(self, watermark_ms: int) -> pd.DataFrame:
        """What the watermark has passed, thinned."""
        held = sorted(self.waiting.get() if self.waiting.exists() else [], key=lambda r: (r[0], _first(r[3]), _first(r[4])))
        ready = [r for r in held if r[0] < watermark_ms * 1000]
        if len(ready) < len(held):
            self.waiting.put([tuple(r) for r in held[len(ready) :]])
        elif held:
            self.waiting.clear()
        last = self.last.get()[0] if ready and self.last.exists() else None
        kept = []
        for r in ready:
            if last is None or r[0] - last >= self.gap_us:
                kept.append(r)
                last = r[0]
        if kept:
            self.last.update((last,))
        return pd.DataFrame([tuple(r) for r in kept], columns=_WAITING.names).astype({"us": "int64"})

    def close(self) -> None:
        pass


def _first(x: int | None) -> tuple:
    """Order of a coordinate, null first."""
    return (x is not None, x or 0)


def thin_moves_stream(events: DataFrame, min_gap_s: float = 0.02, lateness: str = LATENESS, forget_s: int = 3600) -> DataFrame:
    """Kept moves of a stream, as ``sessions.thin_moves`` keeps them of a table, if no move comes later than ``lateness``; what does is
    dropped and counted in the query's progress. A move comes out once the watermark has passed it. A gap of 0 keeps all moves.

    Needs the RocksDB state store (``rocksdb_state``)."""
    gap = round(min_gap_s * 1_000_000)
    moves = events.filter((F.col("type") == "move") & F.col("event_time").isNotNull())
    if gap <= 0:
        return moves.select(*EVENT.names, "event_time")
    timed = moves.withWatermark("event_time", lateness).select("event_time", F.unix_micros("event_time").alias("us"), *EVENT.names)
    thinned = timed.groupBy("user").transformWithStateInPandas(MoveThinner(gap, forget_s), _WAITING, "append", "eventTime")
    return thinned.select(*EVENT.names, F.timestamp_micros("us").alias("event_time"))


def rocksdb_state(spark: SparkSession) -> SparkSession:
    """The session, with the state store that timers and lists of state need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def start_sink(df: DataFrame, path: str, checkpoint: str, every: str | None = None, partition: str | None = None, name: str | None = None) -> StreamingQuery:
    """Append to Parquet with a checkpoint of its own; ``every`` is a trigger interval, None takes what is there
    and stops."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
    writer = writer.partitionBy(partition) if partition else writer
    writer = writer.queryName(name) if name else writer
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def start_speed_layer(lines: DataFrame, root: str, metrics_every: str | None = "30 seconds", archive_every: str | None = "60 seconds") -> list[StreamingQuery]:
    """Metrics and archive from one stream of JSON lines. The archive keeps late rows too; it is laid out by date."""
    events = decoded_events(lines)
    dated = events.withColumn("event_date", F.to_date("event_time"))
    return [
        start_sink(live_metrics(events), f"{root}/metrics", f"{root}/checkpoints/metrics", metrics_every, name="metrics"),
        start_sink(dated, f"{root}/events", f"{root}/checkpoints/events", archive_every, "event_date", name="archive"),
    ]


def supervise(spark: SparkSession, queries: list[StreamingQuery]) -> None:
    """Wait until one query ends, then stop the others; raises what ended it."""
    try:
        while all(q.isActive for q in queries):
            spark.streams.resetTerminated()  # ends of other queries, or of earlier ones, don't count
            try:
                spark.streams.awaitAnyTermination(1)
            except StreamingQueryException:
                continue
    finally:
        for q in queries:
            if q.isActive:
                q.stop()
    for q in queries:
        if (error := q.exception()) is not None:
            raise error


class ProgressLog(StreamingQueryListener):
    """Throughput, latency and late drops of every micro-batch, for ``table``; the newest ``most`` are kept."""

    SCHEMA = "query string, batch long, at timestamp, input_rows long, rows_per_second double, duration_ms long, dropped_late long"

    def __init__(self, most: int = 10_000):
        self.rows: list[tuple] = []
        self.most = most

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        at = dt.datetime.fromisoformat(p.timestamp.replace("Z", "+00:00"))
        self.rows.append((p.name, p.batchId, at, p.numInputRows, p.processedRowsPerSecond, p.batchDuration, late))
        del self.rows[: -self.most]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.SCHEMA)


class ProgressTable(ProgressLog):
    """Progress kept for good: rows go to files below ``root``, ``every`` so many and when a query ends; ``progress`` reads them. What a
    killed driver had not written yet is lost, at most ``every`` rows."""

    def __init__(self, spark: SparkSession, root: str, every: int = 50):
        super().__init__(most=1 << 62)
        self.spark, self.root, self.every = spark, root, every

    def onQueryProgress(self, event) -> None:
        super().onQueryProgress(event)
        if len(self.rows) >= self.every:
            self.flush()

    def onQueryTerminated(self, event) -> None:
        self.flush()

    def flush(self) -> None:
        rows, self.rows = self.rows, []
        if rows:
            names = [c.split()[0] for c in self.SCHEMA.split(", ")]
            text = "\n".join(json.dumps(dict(zip(names, r, strict=True)), default=lambda t: t.isoformat(timespec="microseconds")) for r in rows)
            create_once(self.spark, f"{self.root}/progress/{uuid.uuid4().hex}.json", text)


def progress(spark: SparkSession, root: str) -> DataFrame:
    """All progress that was written below ``root``, of every run; none before the first."""
    try:
        return spark.read.schema(ProgressLog.SCHEMA).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(f"{root}/progress")
    except AnalysisException:
        return spark.createDataFrame([], ProgressLog.SCHEMA)
