"""Read queries over the result tables of a root folder. None of them computes from events."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inputlens.functions.times import gap_us, moment
from inputlens.operators import dashboard, heat, liveness as scoring, sessions
from inputlens.plans.batch import run_log
from inputlens.schema import TABLES
from inputlens.sources.archive import read_table


def live_metrics(spark: SparkSession, root: str) -> DataFrame:
    """All metrics that the speed layer has written; none before it has."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(TABLES["metrics"]).parquet(f"{root}/metrics")
    except AnalysisException:
        return spark.createDataFrame([], TABLES["metrics"])


def metrics(spark: SparkSession, root: str, as_of: Column, minutes: int = 60) -> DataFrame:
    return dashboard.recent(live_metrics(spark, root), as_of, minutes)


def newest_sessions(spark: SparkSession, root: str, limit: int = 2000) -> DataFrame:
    return sessions.newest_sessions(read_table(spark, root, "sessions"), limit)


def baseline(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "baseline")


def heatmap(spark: SparkSession, root: str, range: str) -> DataFrame:
    """An unknown range has no rows."""
    return read_table(spark, root, "heatmaps").filter(F.col("range") == range)


def day_metrics(spark: SparkSession, root: str, day: str, user: str) -> DataFrame:
    rows = read_table(spark, root, "day_minute_metrics").filter((F.col("day") == day) & (F.col("user") == user))
    return rows.orderBy("window_start")


def heatmap_day(spark: SparkSession, root: str, day: str, user: str) -> DataFrame:
    return read_table(spark, root, "heatmap_by_day").filter((F.col("day") == day) & (F.col("user") == user))


def display_grid(spark: SparkSession, displays: DataFrame | None = None, cell: int = 16) -> DataFrame:
    """width, height, grid_w, grid_h of the recorded display (the first row of ``displays``), or of the usual one."""
    return heat.with_grid(heat.known_display(spark, displays), cell)


def health(spark: SparkSession, root: str, as_of: Column) -> DataFrame:
    """One row: end of the newest of all live windows, its age in seconds and whether it is fresh; time, age, status and
    error of the last batch run, null before the first."""
    fresh = dashboard.freshness(live_metrics(spark, root), as_of)
    age = (gap_us(moment(as_of), F.col("as_of")) / 1_000_000).alias("batch_age_s")
    last = run_log(spark, root).limit(1).select(F.col("as_of").alias("batch_last_run"), age, F.col("status").alias("batch_status"), F.col("error").alias("batch_error"))
    return fresh.join(last, F.lit(True), "left")


def batch_status(spark: SparkSession, root: str) -> DataFrame:
    return run_log(spark, root).select("run", "as_of", "status", "error").limit(1)


def ml_metrics(spark: SparkSession, root: str) -> DataFrame:
    """The newest model report with available = true, or one row with false."""
    report = read_table(spark, root, "model_report")
    one = spark.range(1).select(F.lit(1).alias("__one"))
    return one.join(report.limit(1).withColumn("__held", F.lit(True)), F.lit(True), "left").select(F.col("__held").isNotNull().alias("available"), *report.columns)


def liveness(spark: SparkSession, root: str, user: str | None = None) -> DataFrame:
    return dashboard.of_user(read_table(spark, root, "liveness"), user)


def calendar(spark: SparkSession, root: str, as_of: Column, tz: str, user: str | None = None) -> DataFrame:
    ratings = dashboard.activity_ratings(dashboard.of_user(read_table(spark, root, "sessions"), user), tz)
    return dashboard.calendar(ratings, read_table(spark, root, "liveness"), as_of, tz)


def day_detail(spark: SparkSession, root: str, day: str, user: str, tz: str) -> dict[str, DataFrame]:
    """Timeline of 96 quarter-hours (half-open: the whole day and no more), its gauge, the sessions and the clipped
    heatmaps of a local day."""
    from inputlens.functions.times import end_of_day

    last = end_of_day(F.lit(day), tz) - F.expr("INTERVAL 1 MICROSECOND")
    timeline = dashboard.rebucket(day_metrics(spark, root, day, user), 96, 15, last)
    cells = heat.clipped(heatmap_day(spark, root, day, user), heat.with_grid(heat.known_display(spark)), ["type"])
    own = dashboard.of_user(read_table(spark, root, "sessions"), user)
    return {
        "timeline": timeline,
        "gauge": dashboard.activity_gauge(timeline, 15),
        "sessions": dashboard.day_sessions(own, day, tz),
        "heatmap": heat.painted(cells),
    }


def model(root: str) -> PipelineModel | None:
    return scoring.saved(f"{root}/model")
