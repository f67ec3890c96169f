"""Heatmaps of moves and clicks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inputlens.functions.events import CLICK, MOVE, cell
from inputlens.functions.times import day_key, moment

#: Screen size in pixels where none is recorded.
DISPLAY = (1728, 1117)


def pointed(events: DataFrame, size: int) -> DataFrame:
    """Moves and clicks with their cells; a null coordinate gives a null cell."""
    return events.filter(F.col("type").isin(MOVE, CLICK)).withColumns({"cell_x": cell("x", size), "cell_y": cell("y", size)})


def range_heatmaps(events: DataFrame, ranges: dict[str, int], size: int = 16, as_of: Column | None = None) -> DataFrame:
    """Counts by (range, cell, type, user) over the last hours of each range, in one pass.

    Ranges end at ``as_of``, by default the newest event of any user and type, and include their start. Every event is
    counted in all ranges that hold it."""
    newest = moment(as_of) if as_of is not None else events.agg(F.max("event_time")).scalar()
    longest = max(ranges.values())
    rows = pointed(events, size).filter(F.col("event_time") >= newest - F.make_interval(hours=F.lit(longest)))
    names = [F.when(F.col("event_time") >= newest - F.make_interval(hours=F.lit(h)), F.lit(name)) for name, h in ranges.items()]
    rows = rows.withColumn("range", F.explode(F.array_compact(F.array(*names))))
    return rows.groupBy("range", "cell_x", "cell_y", "type", "user").count()


def heatmap_by_day(events: DataFrame, tz: str, size: int = 16) -> DataFrame:
    rows = pointed(events.filter("event_time IS NOT NULL"), size)
    return rows.groupBy(day_key(F.col("event_time"), tz).alias("day"), "cell_x", "cell_y", "type", "user").count()


def known_display(spark: SparkSession, displays: DataFrame | None = None) -> DataFrame:
    """width and height of the first recorded display, or of the usual one: one row."""
    usual = spark.range(1).select(F.lit(DISPLAY[0]).alias("__w"), F.lit(DISPLAY[1]).alias("__h"))
    if displays is None:
        return usual.select(F.col("__w").alias("width"), F.col("__h").alias("height"))
    first = displays.agg(F.min(F.struct("width", "height")).alias("d")).select("d.width", "d.height")  # one row, of nulls if empty
    return first.join(usual, F.lit(True)).select(F.coalesce("width", "__w").alias("width"), F.coalesce("height", "__h").alias("height"))


def with_grid(display: DataFrame, size: int = 16) -> DataFrame:
    """Columns and rows of cells that cover the screen."""
    across = lambda c: F.ceil(F.col(c) / F.lit(size)).cast("int")
    return display.select(F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), across("width").alias("grid_w"), across("height").alias("grid_h"))


def clipped(heatmap: DataFrame, grid: DataFrame, panel: list[str]) -> DataFrame:
    """Cells on the screen (``grid``: one row from ``with_grid``) with ``intensity`` = ln(count+1)/ln(highest count of the
    panel + 1); the ``panel`` columns (day, user, type, ...) say which cells share a picture."""
    bounds = F.broadcast(grid.select("grid_w", "grid_h"))  # one row
    held = (F.col("cell_x") >= 0) & (F.col("cell_x") < F.col("grid_w")) & (F.col("cell_y") >= 0) & (F.col("cell_y") < F.col("grid_h"))
    inside = heatmap.join(bounds, held).drop("grid_w", "grid_h")
    highest = F.max("count").over(Window.partitionBy(*panel))
    return inside.withColumn("intensity", F.log1p("count") / F.log1p(highest))


def painted(cells: DataFrame) -> DataFrame:
    """In the order they are painted, so that the highest counts lie on top."""
    return cells.orderBy("count", "cell_x", "cell_y")
