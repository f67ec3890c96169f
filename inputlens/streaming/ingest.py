"""Once-only ingest: a stream of lines, parsed once, becomes archive, quarantine and minute counts that are committed together.

A micro-batch writes its share of every table into folders of its own, named by the batch, and then one file of the ledger. Readers
take what the ledger names, so they see a batch in all tables or in none. A batch that is run again, after a crash between two writes,
writes over its own folders; one that was committed is passed over. No row is lost, none is there twice.

Minutes are kept as counts that add up. A row is late if its minute had closed, by the newest event of earlier batches, when it came:
its counts are kept apart, so that the speed layer's figures stay those it has shown, and ``repaired`` adds what they missed.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inputlens.functions.events import event_count_exprs, sums
from inputlens.operators.counts import flat
from inputlens.schema import ARCHIVED, COUNTS, SOURCE, TABLES
from inputlens.sources.archive import create_once
from inputlens.sources.events import decode, good
from inputlens.streaming.speed import LATENESS

LEDGER = "epoch string, batch long, rows long, bad long, late long, newest timestamp"
QUARANTINE = "raw string, source_partition int, source_offset long"
#: A task writes about so many rows of a day at most.
DAY_ROWS = 500_000
EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
PARTS = ", ".join(["window_start timestamp", "window_end timestamp", "user string", *(f"{c} long" for c in COUNTS)])


def once(decoded: DataFrame, within: str) -> DataFrame:
    """Rows of a stream without repeats: by source position where it has one, else by the line itself. State is kept for
    ``within`` behind the newest event; a row older than that is dropped and counted in the query's progress. Lines without a
    usable time are told apart within a micro-batch only, as no watermark passes them."""
    keys = list(SOURCE) if set(SOURCE) <= set(decoded.columns) else ["__line"]
    named = decoded if keys[0] in decoded.columns else decoded.withColumn("__line", F.md5("raw"))
    return named.withWatermark("event_time", within).dropDuplicatesWithinWatermark(keys).drop("__line")


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """A row for each committed batch; none before the first."""
    try:
        return spark.read.schema(LEDGER).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(f"{root}/ledger")
    except AnalysisException:
        return spark.createDataFrame([], LEDGER)


def _committed(spark: SparkSession, root: str) -> Column:
    """Whether a row's epoch and batch are committed. Batches follow one another, so an epoch has one highest."""
    last = ledger(spark, root).groupBy("epoch").agg(F.max("batch").alias("batch")).collect()  # a row for each reset of the checkpoint
    held = F.lit(False)
    for r in last:
        held = held | ((F.col("epoch") == r.epoch) & (F.col("batch") <= r.batch))
    return held


def _read(spark: SparkSession, root: str, name: str, schema: str, partitions: str = "epoch string, batch long") -> DataFrame:
    try:
        rows = spark.read.schema(f"{schema}, {partitions}").parquet(f"{root}/{name}")
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return rows.filter(_committed(spark, root)).select([f.split()[0] for f in schema.split(", ")])


def archived(spark: SparkSession, root: str) -> DataFrame:
    """Events of all committed batches, late ones too; nothing in it repeats, so it needs no deduplication."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ARCHIVED)
    return _read(spark, root, "events", schema, "epoch string, batch long, event_date date")


def refused(spark: SparkSession, root: str) -> DataFrame:
    """Lines that are no events, as they came."""
    return _read(spark, root, "quarantine", QUARANTINE)


def _parts(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, root, "minutes", f"{PARTS}, late boolean", "epoch string, batch long")


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("window_start", "window_end", "user").agg(*sums()).select(TABLES["metrics"].names)


def metrics(spark: SparkSession, root: str, lateness: str = LATENESS) -> DataFrame:
    """(user, minute) counts as a stream in append mode shows them: closed minutes only, without late rows."""
    newest = ledger(spark, root).agg(F.max("newest")).scalar()
    return _summed(_parts(spark, root).filter(~F.col("late") & (F.col("window_end") <= newest - F.expr(f"INTERVAL {lateness}"))))


def missed(spark: SparkSession, root: str) -> DataFrame:
    """Counts of late rows, by the minute they missed."""
    return _summed(_parts(spark, root).filter("late"))


def repaired(spark: SparkSession, root: str) -> DataFrame:
    """(user, minute) counts of all rows, open minutes and late rows too: what the batch layer counts from the archive."""
    return _summed(_parts(spark, root))


def by_day(events: DataFrame, rows: int) -> DataFrame:
    """``rows`` events with those of a day in few tasks: not a file of each day from every task."""
    part = F.pmod(F.xxhash64("event_time", *SOURCE, "user", "x", "y"), F.lit(rows // DAY_ROWS + 1))
    return events.repartition("event_date", part)


class Ingest:
    """Writes and commits micro-batches below ``root``. ``epoch`` names the checkpoint: a new one, whose batches count from 0
    again, needs a new name."""

    def __init__(self, root: str, epoch: str = "first", lateness: str = LATENESS, window_s: int = 60):
        self.root, self.epoch, self.lateness, self.window_s = root, epoch, lateness, window_s
        self.last: int | None = None
        self.newest = None

    def _resume(self, spark: SparkSession) -> None:
        """Where the ledger stands; read once, then kept."""
        seen = ledger(spark, self.root)
        row = seen.agg(F.max(F.when(F.col("epoch") == self.epoch, F.col("batch"))).alias("last"), F.unix_micros(F.max("newest")).alias("newest")).first()
        self.last, self.newest = -1 if row.last is None else row.last, row.newest

    def tables(self, decoded: DataFrame) -> dict[str, DataFrame]:
        """What a batch adds to each table."""
        rows = good(decoded)
        for name in (n for n in SOURCE if n not in rows.columns):
            rows = rows.withColumn(name, F.lit(None).cast("int" if name == SOURCE[0] else "long"))
        w = F.window("event_time", f"{self.window_s} seconds").alias("w")
        closed = F.timestamp_micros(F.lit(self.newest).cast("long")) - F.expr(f"INTERVAL {self.lateness}")
        late = F.coalesce(F.col("w.end") <= closed, F.lit(False)).alias("late")
        minutes = rows.groupBy(w, "user").agg(*event_count_exprs()).select(*flat(), "user", *COUNTS, late)
        bad = decoded.filter("bad")
        places = [F.col(n) if n in decoded.columns else F.lit(None).cast("long").alias(n) for n in SOURCE]
        return {
            "events": rows.select(*ARCHIVED.names, F.to_date("event_time").alias("event_date")),
            "quarantine": bad.select("raw", *[p.cast(t) for p, t in zip(places, ("int", "long"), strict=True)]),
            "minutes": minutes,
        }

    def write(self, name: str, df: DataFrame, batch: int) -> None:
        writer = df.write.mode("overwrite")
        writer = writer.partitionBy("event_date") if name == "events" else writer
        writer.parquet(f"{self.root}/{name}/epoch={self.epoch}/batch={batch}")

    def counted(self, decoded: DataFrame) -> Row:
        newest = F.max(F.when(~F.col("bad"), F.unix_micros("event_time")))
        return decoded.agg(F.count_if(~F.col("bad")).alias("rows"), F.count_if(F.col("bad")).alias("bad"), newest.alias("newest")).first()

    def commit(self, spark: SparkSession, batch: int, n: Row) -> None:
        late = spark.read.parquet(f"{self.root}/minutes/epoch={self.epoch}/batch={batch}").filter("late").count()
        if n.newest is not None:
            self.newest = n.newest if self.newest is None else max(self.newest, n.newest)
        at = None if self.newest is None else (EPOCH + dt.timedelta(microseconds=self.newest)).isoformat(timespec="microseconds")
        row = {"epoch": self.epoch, "batch": batch, "rows": n["rows"], "bad": n.bad, "late": late, "newest": at}
        create_once(spark, f"{self.root}/ledger/{self.epoch}-{batch:012d}.json", json.dumps(row))
        self.last = batch

    def __call__(self, decoded: DataFrame, batch: int) -> None:
        if self.last is None:
            self._resume(decoded.sparkSession)
        if batch <= self.last:
            decoded.write.format("noop").mode("overwrite").save()  # what repeats are known by still moves on with the batch
            return
        decoded.persist()  # parsed once for all tables
        try:
            n = self.counted(decoded)
            if n["rows"] + n.bad:  # batches without rows only move the watermark on
                for name, df in self.tables(decoded).items():
                    self.write(name, by_day(df, n["rows"]) if name == "events" else df, batch)
                self.commit(decoded.sparkSession, batch, n)
        finally:
            decoded.unpersist()


def start_ingest(
    lines: DataFrame, root: str, checkpoint: str, within: str | None = "1 hour", every: str | None = "30 seconds", sink: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Ingest a stream of lines (value; partition and offset where the source has them). ``within`` bounds the state that repeats are
    known by (None: they stay); ``every`` is a trigger interval, None takes what is there and stops."""
    decoded = decode(lines)
    writer = (once(decoded, within) if within else decoded).writeStream.foreachBatch(sink or Ingest(root)).option("checkpointLocation", checkpoint).queryName("ingest")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
