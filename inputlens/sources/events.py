"""Event streams: Kafka in and out, JSON decoding with quarantine, column normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inputlens.functions.times import from_epoch
from inputlens.schema import EVENT, SOURCE


def kafka_stream(spark: SparkSession, servers: str, topic: str = "events.raw") -> DataFrame:
    """The topic from now on; data that Kafka has meanwhile dropped does not stop the stream."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "latest", "failOnDataLoss": "false"}
    return spark.readStream.format("kafka").options(**options).load()


def decode(lines: DataFrame, value: str = "value") -> DataFrame:
    """Event columns, event_time and ``bad`` of JSON lines (text or bytes) under the fixed schema.

    A source's own partition and offset, as Kafka's, are kept. A field of the wrong type becomes null alone. A line is bad if it is no JSON object with a type, a user and a
    usable time; nothing is lost, see ``good`` and ``quarantined``."""
    text = F.col(value).cast("string")
    places = [F.col(c).cast(t).alias(n) for c, n, t in zip(("partition", "offset"), SOURCE, ("int", "long"), strict=True)] if {"partition", "offset"} <= set(lines.columns) else []
    parsed = lines.select(text.alias("raw"), *places, F.from_json(text, EVENT).alias("e")).select("raw", "e.*", *[n for n in SOURCE if places])
    timed = with_event_time(parsed)
    return timed.withColumn("bad", F.col("type").isNull() | F.col("user").isNull() | F.col("event_time").isNull())


def good(decoded: DataFrame) -> DataFrame:
    return decoded.filter("NOT bad").drop("raw", "bad")


def quarantined(decoded: DataFrame) -> DataFrame:
    return decoded.filter("bad").select("raw")


def with_event_time(events: DataFrame) -> DataFrame:
    """Add event_time from epoch seconds unless it is there."""
    return events if "event_time" in events.columns else events.withColumn("event_time", from_epoch(F.col("ts")))


def normalised(events: DataFrame, schema: T.StructType = EVENT) -> DataFrame:
    """Columns of the schema in its order, missing ones null, rows without a time dropped."""
    empty = events.sparkSession.createDataFrame([], schema)
    rows = with_event_time(empty.unionByName(events, allowMissingColumns=True))
    return rows.select(*schema.names, "event_time").filter("event_time IS NOT NULL")


def as_json(rows: DataFrame) -> Column:
    """A row as JSON with ISO times in UTC; NaN, like null, becomes null (and stays as a field)."""
    clean = [F.nanvl(f.name, F.lit(None)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in rows.schema]
    options = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timeZone": "UTC", "ignoreNullFields": "false"}
    return F.to_json(F.struct(*clean), options)


def published(events: DataFrame) -> DataFrame:
    """key = user, value = JSON, as Kafka takes them."""
    return events.select(F.col("user").alias("key"), as_json(events).alias("value"))


def publish(events: DataFrame, servers: str, topic: str = "events.raw") -> None:
    published(events).write.format("kafka").options(**{"kafka.bootstrap.servers": servers, "topic": topic}).save()
