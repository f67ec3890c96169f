"""Features of a (user, window) that tell a person from automation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inputlens.functions.events import CLICK, KEY_DOWN, MOVE, SCROLL

FEATURES = ["key_diversity", "ks_iei_cv", "move_iei_cv", "iei_cv", "step_mean", "step_cv", "mouse_fraction"]


def _cv(value: Column) -> Column:
    """Population deviation over mean; 0 where the mean isn't positive."""
    mean = F.avg(value)
    return F.when(mean > 0, F.stddev_pop(value) / mean).otherwise(0.0)


def _guarded(enough: Column, value: Column) -> Column:
    return F.when(enough, F.coalesce(value, F.lit(0.0))).otherwise(0.0)


def window_features(events: DataFrame, window_s: int = 60, min_events: int = 5) -> DataFrame:
    """One row for each (user, window) of at least ``min_events`` events; users must be known.

    Intervals are between neighbours in time within the window: of all events, of key presses, of moves. Steps are
    between neighbouring moves with a position. All windows share one exchange by (user, window)."""
    events = events.filter("event_time IS NOT NULL AND user IS NOT NULL")
    events = events.withColumns({
        "window_start": F.window("event_time", f"{window_s} seconds")["start"], "__us": F.unix_micros("event_time"),
    })
    keys = ["user", "window_start"]
    order = [F.col(c) for c in ("__us", "x", "y", "type", "key")]
    all_, same = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys, "type").orderBy(*order)
    placed = (F.col("type") == MOVE) & F.col("x").isNotNull() & F.col("y").isNotNull()
    before = F.last(F.when(placed, F.struct("x", "y")), ignorenulls=True).over(all_.rowsBetween(Window.unboundedPreceding, -1))
    rows = events.withColumns({
        "__gap": F.col("__us") - F.lag("__us").over(all_),
        "__type_gap": F.col("__us") - F.lag("__us").over(same),
        "__before": F.when(placed, before),
    })
    square = lambda c: F.pow(F.col(c) - F.col(f"__before.{c}"), F.lit(2.0))
    rows = rows.withColumn("__step", F.sqrt(square("x") + square("y")))
    down, move = F.col("type") == KEY_DOWN, F.col("type") == MOVE
    presses, moves, n = F.count_if(down), F.count_if(move), F.count(F.lit(1))
    enough_steps = F.count_if(placed) >= 2
    kinds = F.size(F.collect_set(F.when(down, F.col("key"))))  # keys of one window: few
    return rows.groupBy(*keys).agg(
        n.alias("n_events"),
        F.when(presses > 0, kinds / presses).otherwise(0.0).alias("key_diversity"),
        _guarded(presses >= 3, _cv(F.when(down, F.col("__type_gap")))).alias("ks_iei_cv"),
        _guarded(moves >= 3, _cv(F.when(move, F.col("__type_gap")))).alias("move_iei_cv"),
        _guarded(n >= 3, _cv(F.col("__gap"))).alias("iei_cv"),
        _guarded(enough_steps, F.avg("__step")).alias("step_mean"),
        _guarded(enough_steps, _cv(F.col("__step"))).alias("step_cv"),
        (F.count_if(F.col("type").isin(MOVE, CLICK, SCROLL)) / n).alias("mouse_fraction"),
    ).filter(F.col("n_events") >= min_events)
