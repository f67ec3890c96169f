"""Counts by minute and by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inputlens.functions.events import event_count_exprs, mouse_moves
from inputlens.functions.times import day_key

def flat() -> list[Column]:
    """Start and end of a window column w, as columns."""
    return [F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end")]



def minute_metrics(events: DataFrame, window_s: int = 60) -> DataFrame:
    """(user, window) counts, batch or streaming. Rows without a time fall out; a null user is a user."""
    w = F.window("event_time", f"{window_s} seconds").alias("w")
    return events.groupBy(w, "user").agg(*event_count_exprs()).select(*flat(), "user", "keystrokes", "words", "corrections", "clicks")


def day_minute_metrics(events: DataFrame, tz: str, window_s: int = 60) -> DataFrame:
    """(day, window, user) counts and mouse moves; a window lies in the day of its events in ``tz``."""
    w = F.window("event_time", f"{window_s} seconds").alias("w")
    counted = events.groupBy(day_key(F.col("event_time"), tz).alias("day"), w, "user").agg(*event_count_exprs(), mouse_moves())
    return counted.select("day", *flat(), "user", "keystrokes", "words", "corrections", "clicks", "mouse_moves")


def daily_totals(day_minutes: DataFrame) -> DataFrame:
    """Keystrokes and clicks of each day, over all users."""
    return day_minutes.groupBy("day").agg(F.sum("keystrokes").alias("keystrokes"), F.sum("clicks").alias("clicks"))
