"""The driver's ``events`` table seen as input events (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def input_events(events: DataFrame, users: int = 3) -> DataFrame:
    """Canonical events of a table (event_id, ts without zone taken as UTC, user_id, event_type, props)."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = (
        F.when(F.col("event_type") == "view", "move").when(F.col("event_type") == "click", "click")
        .when(F.col("event_type") == "signup", F.when(k % 2 == 0, "scroll").otherwise("key_up")).otherwise("key_down")
    )
    special = {0: "Key.space", 1: " ", 2: "Key.backspace", 3: "Key.delete"}
    key = F.lit(None).cast("string")
    for digit, name in special.items():
        key = F.when(k % 10 == digit, name) if digit == 0 else key.when(k % 10 == digit, name)
    key = key.otherwise(F.char(97 + k % 26))
    pointed, keyed = F.col("type").isin("move", "click", "scroll"), F.col("type").isin("key_down", "key_up")
    at = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp")
    rows = events.select("event_id", F.concat(F.lit("user-"), F.col("user_id") % users).alias("user"), at.alias("event_time"), kind.alias("type"), k.alias("k"), "props")
    return rows.select(
        "event_id", "user", "event_time", "type",
        F.when(keyed, key).alias("key"),
        F.when(pointed, F.col("event_id") * 37 % 1928 - 100).alias("x"),
        F.when(pointed, F.col("event_id") * 53 % 1217 - 50).alias("y"),
        F.when(F.col("type") == "click", "Button.left").alias("button"),
        F.when(F.col("type") == "click", F.col("event_id") % 2 == 0).alias("pressed"),
        F.when(F.col("type") == "scroll", k % 5 - 2).cast("long").alias("dx"),
        F.when(F.col("type") == "scroll", k % 3 - 1).cast("long").alias("dy"),
    )
