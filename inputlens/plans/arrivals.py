"""The given events as they would arrive: in rounds, with stragglers, repeats and lines that are none. What the live path makes of
them, and what incremental batch runs make of an archive that grows by those rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inputlens.plans.batch import run_batch
from inputlens.schema import ARCHIVED, EVENT, Params
from inputlens.sources import segments
from inputlens.sources.archive import make_folder, move_folder, scratch
from inputlens.streaming import ingest, speed

#: Rounds; of event_id modulo the second number, the first marks who comes a round late, again a round later, or with a broken line beside it.
ROUNDS, STRAGGLES, REPEATS, BREAKS = 3, (7, 20), (3, 10), (11, 50)
LINES = "value string, partition int, offset long"
FOREVER = "3650 days"


def marked(rule: tuple[int, int]) -> Column:
    return F.col("event_id") % rule[1] == rule[0]


def in_rounds(events: DataFrame) -> DataFrame:
    """Events with the round, from 0, that they first arrive in: thirds of the time, stragglers one later."""
    us = F.unix_micros("event_time")
    first, last = events.agg(F.min(us), F.max(us)).first()
    third = F.floor((us - F.lit(first or 0)) * ROUNDS / F.lit((last or 0) - (first or 0) + 1)).cast("int")
    return events.withColumn("round", F.least(F.lit(ROUNDS - 1), third + marked(STRAGGLES).cast("int")))


def lines_of(events: DataFrame, round: int) -> DataFrame:
    """A round's lines with their positions: its events, those of the round before that repeat, and broken lines."""
    wire = events.withColumn("ts", F.unix_micros("event_time") / F.lit(1e6))
    wire = wire.select("event_id", "round", F.to_json(F.struct("type", "key", "x", "y", "button", "pressed", "dx", "dy", "user", "ts")).alias("value"))
    sent = wire.filter((F.col("round") == round) | ((F.col("round") == round - 1) & marked(REPEATS)))
    broken = wire.filter((F.col("round") == round) & marked(BREAKS)).select(F.concat(F.lit("no event "), "event_id").alias("value"), F.lit(1).alias("partition"), F.col("event_id").alias("offset"))
    return sent.select("value", F.lit(0).alias("partition"), F.col("event_id").alias("offset")).unionByName(broken)


def ingested(spark: SparkSession, events: DataFrame) -> str:
    """Root of an ingest that has run once for each round, from its checkpoint."""
    root, rounds = scratch(spark, "ingest"), in_rounds(events)
    for k in range(ROUNDS):
        lines_of(rounds, k).write.mode("append").parquet(f"{root}/lines")
        stream = spark.readStream.schema(LINES).parquet(f"{root}/lines")
        ingest.start_ingest(stream, root, f"{root}/checkpoint", FOREVER, None).awaitTermination()
    return root


def grown(spark: SparkSession, events: DataFrame, params: Params, as_of: Column) -> str:
    """Root of a batch that has run incrementally after each round of an archive by day. The rounds' files are written at once, from
    one reading of the events, and a round arrives as its folder is moved into the archive."""
    root, rounds = scratch(spark, "grown"), in_rounds(events)
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in ARCHIVED if f.name not in events.columns}
    columns = [none.get(c, F.col(c)) for c in ARCHIVED.names if not c.startswith("source_")]
    rows = rounds.select(*columns, F.lit(0).alias("source_partition"), F.col("event_id").alias("source_offset"), "round", F.to_date("event_time").alias("event_date"))
    rows.hint("rebalance", "round", "event_date").write.partitionBy("round", "event_date").parquet(f"{root}/coming")
    make_folder(spark, f"{root}/events")
    for k in range(ROUNDS):
        move_folder(spark, f"{root}/coming/round={k}", f"{root}/events/round={k}")
        run_batch(spark, f"{root}/events", root, params, as_of=as_of, incremental=True)
    return root


def thinned(spark: SparkSession, events: DataFrame, min_gap_s: float) -> DataFrame:
    """Moves that the stateful stream keeps, when they arrive up to a day late, six days at a time."""
    root = scratch(spark, "thinned")
    late = F.pmod(F.xxhash64("event_id"), F.lit(86_000)) * 1_000_000
    arrival = F.floor((F.unix_micros("event_time") + late) / F.lit(6 * 86_400_000_000)).cast("int").alias("arrival")
    rows = events.filter("type = 'move'").select(*[F.col(c) if c in events.columns else (F.unix_micros("event_time") / F.lit(1e6)).alias("ts") for c in EVENT.names], "event_time", arrival)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    speed.rocksdb_state(spark)
    try:
        for r in [*rows.select("arrival").distinct().orderBy("arrival").collect(), None]:
            if r is None:  # a move ten days on lets the watermark pass all others
                last = rows.agg(F.max("event_time").alias("t")).filter("t IS NOT NULL")
                some = last.select(*[F.lit("flush" if c == "user" else "move" if c == "type" else None).cast(EVENT[c].dataType).alias(c) for c in EVENT.names], (F.col("t") + F.expr("INTERVAL 10 DAYS")).alias("event_time"))
            else:
                some = rows.filter(F.col("arrival") == r.arrival).drop("arrival")
            some.write.mode("append").parquet(f"{root}/moves")
            stream = spark.readStream.schema(some.schema).parquet(f"{root}/moves")
            speed.start_sink(speed.thin_moves_stream(stream, min_gap_s, "1 day", 40 * 86_400), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(rows.drop("arrival").schema).parquet(f"{root}/out").filter("user <> 'flush'")


def logged(spark: SparkSession, events: DataFrame) -> DataFrame:
    """The archive of an ingest that has followed a log in segments, which grew twice: four partitions, events in order of their ids."""
    root = scratch(spark, "log")
    half = (events.agg(F.max("event_id")).first()[0] or 0) / 2
    wire = events.withColumn("ts", F.unix_micros("event_time") / F.lit(1e6))
    for part in (F.col("event_id") <= half, F.col("event_id") > half):
        lines = wire.filter(part).select("event_id", F.to_json(F.struct("type", "key", "x", "y", "button", "pressed", "dx", "dy", "user", "ts")).alias("value"))
        segments.append(lines, f"{root}/log", F.col("event_id") % 4, [F.col("event_id")])
        stream = segments.log_stream(spark, f"{root}/log", "earliest", fail_on_loss=True)
        ingest.start_ingest(stream, root, f"{root}/checkpoint", FOREVER, None).awaitTermination()
    return ingest.archived(spark, root)
