"""Roll-ups of events that later runs build on, a slice at a time: minutes and hourly cells, windows with their session pieces, and
what a day adds to sessions and baselines.

A slice is the UTC day that an event's window starts in, so no window lies in two. All roll-ups add up: sessions are stitched from
pieces where the gap over a seam is short enough, baselines come from whole-number sums, and range heatmaps are whole hours plus
the events of the hour that the range begins in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inputlens.functions.events import CLICK, MOVE, cell, event_count_exprs, mouse_moves, sums
from inputlens.functions.times import bucket, bucket_start, local, moment
from inputlens.operators.heat import pointed
from inputlens.operators.sessions import islands
from inputlens.schema import COUNTS

HOUR_S = 3600


def sliced(events: DataFrame, window_s: int) -> DataFrame:
    """Events with their slice, a date."""
    days = F.floor(bucket(F.col("event_time"), window_s) * window_s / F.lit(86_400)).cast("int")
    return events.withColumn("slice", F.date_from_unix_date(days))


def rolled_up(events: DataFrame, tz: str, window_s: int, cell_size: int, gap_s: int) -> DataFrame:
    """Both roll-ups in one pass: ``kind`` minutes has counts of (day, window, user), ``kind`` cells those of (day, hour, cell, type,
    user); ``at`` is the start of the window or hour. Events need a time and a slice.

    With windows longer than the gap a window can hold several sessions: events then get their ``piece`` before they are counted."""
    us = F.unix_micros("event_time")
    piece = F.lit(None).cast("long")
    if gap_s < window_s:
        events = islands(events.withColumn("__us", us), F.col("__us"), F.col("__us"), gap_s * 1_000_000, [F.col("__us")], "__piece", ["slice", "user"])
        piece = F.col("__piece")
    at = lambda width: bucket_start(bucket(F.col("event_time"), width), width).alias("at")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    minute = F.struct(F.lit("minutes").alias("kind"), at(window_s), none("int", "cell_x"), none("int", "cell_y"), none("string", "pointer"), piece.alias("piece"))
    hour = F.struct(F.lit("cells").alias("kind"), at(HOUR_S), cell("x", cell_size).alias("cell_x"), cell("y", cell_size).alias("cell_y"), F.col("type").alias("pointer"), none("long", "piece"))
    both = F.explode(F.array(minute, F.when(F.col("type").isin(MOVE, CLICK), hour))).alias("to")
    rows = events.select("slice", local(F.col("event_time"), tz).cast("date").alias("day"), "user", "type", "key", us.alias("us"), both).filter("to IS NOT NULL")
    keys = ["to.kind", "slice", "day", "to.at", "user", "to.cell_x", "to.cell_y", "to.pointer", "to.piece"]
    counts = [*event_count_exprs(), mouse_moves(), F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us")]
    return rows.groupBy(*keys).agg(*counts).withColumn("day", F.col("day").cast("string"))


def windows_of(minutes: DataFrame, gap_s: int, window_s: int) -> DataFrame:
    """(slice, user, window) counts with ``piece``, the number of the session in the slice."""
    keys = ["slice", "user", "at", "piece"]
    whole = minutes.groupBy(*keys).agg(*sums(), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    if gap_s >= window_s:
        whole = islands(whole.drop("piece"), F.col("first_us"), F.col("last_us"), gap_s * 1_000_000, [F.col("first_us")], "piece", ["slice", "user"])
    end = F.timestamp_micros(F.unix_micros("at") + window_s * 1_000_000)
    return whole.select("slice", "user", "piece", F.col("at").alias("window_start"), end.alias("window_end"), *COUNTS, "first_us", "last_us")


def pieces_of(windows: DataFrame) -> DataFrame:
    """What each piece of a session adds: its span, and of its windows the number, the sums of counts and of their squares."""
    squares = [F.sum(F.col(c).cast("decimal(19,0)") * F.col(c).cast("decimal(19,0)")).cast("decimal(38,0)").alias(f"{c}_squares") for c in COUNTS]
    return windows.groupBy("slice", "user", "piece").agg(
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.min("window_start").alias("session_start"),
        F.max("window_end").alias("session_end"), F.count(F.lit(1)).alias("window_count"), *sums("_total"), *squares,
    )


def stitched(pieces: DataFrame, gap_s: int) -> DataFrame:
    """Pieces with the session_id, an ordinal by user, of the session that each is a part of."""
    return islands(pieces, F.col("first_us"), F.col("last_us"), gap_s * 1_000_000, [F.col("first_us")], "session_id")


def sessions_of(joined: DataFrame) -> DataFrame:
    """``sessions.session_summary`` from stitched pieces."""
    return joined.groupBy("session_id", "user").agg(
        F.min("first_us").alias("session_key"), F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end"),
        F.sum("window_count").cast("long").alias("window_count"), *sums("_total", "_total"),
    )


def numbered(windows: DataFrame, joined: DataFrame) -> DataFrame:
    """``sessions.per_window``: every window with its session_id."""
    ids = joined.select(F.col("slice").alias("__slice"), F.col("user").alias("__user"), F.col("piece").alias("__piece"), "session_id")
    same = (F.col("slice") == F.col("__slice")) & F.col("user").eqNullSafe(F.col("__user")) & (F.col("piece") == F.col("__piece"))
    return windows.join(ids, same).select("session_id", "window_start", "window_end", "user", *COUNTS, "first_us")


def merged_baseline(pieces: DataFrame, computed_at: Column) -> DataFrame:
    """``sessions.user_baseline`` from the sums of pieces. Sums are whole numbers, so merging loses nothing, and the variance is one
    division of exact ones."""
    exact = lambda c: F.sum(F.col(c).cast("decimal(28,0)")).cast("decimal(38,0)")
    n = F.col("n")
    summed = pieces.groupBy("user").agg(
        F.sum("window_count").cast("decimal(12,0)").alias("n"), *[exact(f"{c}_total").alias(f"{c}_1") for c in COUNTS], *[exact(f"{c}_squares").alias(f"{c}_2") for c in COUNTS],
    )
    stats = []
    for c in COUNTS:
        one = F.col(f"{c}_1").cast("decimal(18,0)")
        spread = n * F.col(f"{c}_2").cast("decimal(25,0)") - one * one
        stats += [(F.col(f"{c}_1").cast("double") / n.cast("double")).alias(f"{c}_mean")]
        stats += [F.when(n > 1, F.sqrt(spread.cast("double") / (n.cast("double") * (n.cast("double") - 1)))).alias(f"{c}_std")]
    return summed.select("user", *stats, computed_at.alias("computed_at"))


def day_minutes(minutes: DataFrame, window_s: int) -> DataFrame:
    """``counts.day_minute_metrics`` from the roll-up."""
    whole = minutes.groupBy("day", "at", "user").agg(*sums(), F.sum("mouse_moves").cast("long").alias("mouse_moves"))
    end = F.timestamp_micros(F.unix_micros("at") + window_s * 1_000_000)
    return whole.select("day", F.col("at").alias("window_start"), end.alias("window_end"), "user", *COUNTS, "mouse_moves")


def day_cells(cells: DataFrame) -> DataFrame:
    """``heat.heatmap_by_day`` from the roll-up."""
    return cells.groupBy("day", "cell_x", "cell_y", F.col("pointer").alias("type"), "user").agg(F.sum("n").alias("count"))


def range_edges(newest_us: int, ranges: dict[str, int]) -> dict[str, tuple[int, int]]:
    """Start of each range and of its first whole hour, in microseconds."""
    hour = HOUR_S * 1_000_000
    starts = {name: newest_us - hours * hour for name, hours in ranges.items()}
    return {name: (start, -(-start // hour) * hour) for name, start in starts.items()}


def range_cells(cells: DataFrame, events: DataFrame, newest_us: int, ranges: dict[str, int], size: int) -> DataFrame:
    """``heat.range_heatmaps`` from whole hours of the roll-up and, of ``events``, those between a range's start and its first whole
    hour."""
    edges = range_edges(newest_us, ranges)
    at, us = F.unix_micros("at"), F.unix_micros("event_time")
    whole = F.array(*[F.when(at >= first, F.lit(name)) for name, (_, first) in edges.items()])
    part = F.array(*[F.when((us >= start) & (us < first), F.lit(name)) for name, (start, first) in edges.items()])
    hours = cells.select(F.explode(whole).alias("range"), "cell_x", "cell_y", F.col("pointer").alias("type"), "user", "n")
    rest = pointed(events, size).select(F.explode(part).alias("range"), "cell_x", "cell_y", "type", "user", F.lit(1).cast("long").alias("n"))
    return hours.unionByName(rest).filter("range IS NOT NULL").groupBy("range", "cell_x", "cell_y", "type", "user").agg(F.sum("n").alias("count"))


def newest_of(pieces: DataFrame) -> int | None:
    """Time of the newest event, in microseconds."""
    return pieces.agg(F.max("last_us")).first()[0]


def at_us(us: int | None) -> Column:
    return moment(F.timestamp_micros(F.lit(us).cast("long")))
