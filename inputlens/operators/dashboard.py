"""Figures that a dashboard shows: timelines, gauges, totals of the day, ratings, calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inputlens.functions.events import is_active
from inputlens.functions.times import bucket, bucket_start, day_key, gap_us, local, midnight, moment, monday
from inputlens.schema import COUNTS

FIVE = (*COUNTS, "mouse_moves")
TIERS = ("not_active", "below_average", "standard", "productive")


def of_user(rows: DataFrame, user: str | None) -> DataFrame:
    """Rows of one user; all if none is named."""
    return rows if user is None else rows.filter(F.col("user") == user)


def recent(metrics: DataFrame, as_of: Column, minutes: int = 60) -> DataFrame:
    start = moment(as_of) - F.make_interval(mins=F.lit(minutes))
    return metrics.filter(F.col("window_start") >= start).orderBy("window_start", "user")


def rebucket(metrics: DataFrame, n: int, size_min: int, as_of: Column) -> DataFrame:
    """For every known user the ``n`` buckets of ``size_min`` minutes up to the one that holds ``as_of``: sums of five
    counts, zero and ``synthetic`` where nothing was recorded."""
    width = size_min * 60
    last = bucket(moment(as_of), width)
    rows = metrics.filter("user IS NOT NULL").withColumn("bucket", bucket(F.col("window_start"), width))
    held = [c if c in metrics.columns else F.lit(0).alias(c) for c in FIVE]
    rows = rows.select("user", "bucket", *held)
    inside = rows.filter(F.col("bucket").between(last - (n - 1), last))
    summed = inside.groupBy("user", "bucket").agg(*[F.sum(c).cast("long").alias(c) for c in FIVE])
    spine = rows.select("user").distinct().withColumn("bucket", F.explode(F.sequence(last - (n - 1), last)))
    filled = spine.join(summed.withColumn("__held", F.lit(True)), ["user", "bucket"], "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in FIVE]
    return filled.select("user", bucket_start(F.col("bucket"), width).alias("window_start"), *counts, F.col("__held").isNull().alias("synthetic"))


def activity_gauge(buckets: DataFrame, size_min: int) -> DataFrame:
    """Active buckets of each user, their share in percent, and active and idle minutes."""
    active = F.count_if(is_active())
    total = F.count(F.lit(1))
    return buckets.groupBy("user").agg(
        active.alias("active_buckets"), (active / total * 100).alias("active_pct"),
        (active * size_min).alias("active_minutes"), ((total - active) * size_min).alias("idle_minutes"),
    )


def started_today(sessions: DataFrame, as_of: Column, tz: str) -> DataFrame:
    return sessions.filter(F.col("session_start") >= midnight(moment(as_of), tz))


def today_totals(sessions: DataFrame, as_of: Column, tz: str) -> DataFrame:
    """Sums over each user's sessions that started today: counts, sessions, active minutes, the longest session."""
    totals = [F.sum(f"{c}_total").cast("long").alias(c) for c in COUNTS]
    return started_today(sessions, as_of, tz).groupBy("user").agg(
        *totals, F.count(F.lit(1)).alias("sessions"), F.sum("window_count").cast("long").alias("active_minutes"),
        F.max("window_count").alias("longest"),
    )


def per_minute(today: DataFrame, baseline: DataFrame) -> DataFrame:
    """Today's counts per active minute (rounded), the share of corrections in percent, and the user's baseline of
    both; null without active minutes, keystrokes or baseline."""
    rates = [F.when(F.col("active_minutes") > 0, F.floor(F.col(c) / F.col("active_minutes") + 0.5)).cast("long").alias(f"{c}_per_minute") for c in COUNTS]
    ratio = F.when(F.col("keystrokes") > 0, F.col("corrections") / F.col("keystrokes") * 100).alias("correction_pct")
    usual = F.when(F.col("keystrokes_mean") != 0, F.col("corrections_mean") / F.greatest("keystrokes_mean", F.lit(1.0)) * 100)
    joined = today.join(baseline.select("user", *[f"{c}_mean" for c in COUNTS]), "user", "left")
    return joined.select("user", *rates, ratio, *[f"{c}_mean" for c in COUNTS], usual.alias("baseline_correction_pct"))


def peak_keystrokes(metrics: DataFrame, as_of: Column, tz: str) -> DataFrame:
    """Each user's highest keystrokes in a window today; null instead of 0."""
    today = F.when(F.col("window_start") >= midnight(moment(as_of), tz), F.col("keystrokes"))
    return metrics.groupBy("user").agg(F.nullif(F.max(today), F.lit(0)).alias("peak"))


def activity_ratings(sessions: DataFrame, tz: str) -> DataFrame:
    """user, day, total_minutes, median, tier. A session belongs to the day it starts in; a day's total is held
    against the exact median of the user's days with activity."""
    days = sessions.filter("session_start IS NOT NULL").groupBy("user", day_key(F.col("session_start"), tz).alias("day"))
    days = days.agg(F.sum("window_count").cast("long").alias("total_minutes"))
    median = days.groupBy("user").agg(F.median(F.when(F.col("total_minutes") > 0, F.col("total_minutes"))).alias("median"))
    rated = days.join(median.withColumnRenamed("user", "__user"), F.col("user").eqNullSafe(F.col("__user"))).drop("__user")
    return rated.withColumn("tier", tier(F.col("total_minutes"), F.col("median")))


def tier(total: Column, median: Column) -> Column:
    ratio = total / median
    return (
        F.when((total <= 0) | median.isNull() | (median <= 0), TIERS[0])
        .when(ratio < 0.5, TIERS[1]).when(ratio <= 1.5, TIERS[2]).otherwise(TIERS[3])
    )


def calendar(ratings: DataFrame, liveness: DataFrame, as_of: Column, tz: str, weeks: int = 8) -> DataFrame:
    """Every day of the last ``weeks`` weeks, Monday to Sunday, for every rated user: tier, minutes, whether liveness
    flagged it, whether it is yet to come."""
    today = local(moment(as_of), tz).cast("date")
    first = F.date_sub(monday(today), 7 * (weeks - 1))
    dates = F.explode(F.sequence(first, F.date_add(first, 7 * weeks - 1)))
    spine = ratings.select("user").distinct().select("user", dates.alias("date"), today.alias("__today"))
    spine = spine.withColumn("day", F.date_format("date", "yyyy-MM-dd"))
    flags = liveness.filter("nonhuman").select("user", "day").distinct().withColumn("nonhuman", F.lit(True))
    # a null user has days too
    named = lambda t, n: t.withColumnsRenamed({"user": f"__user{n}", "day": f"__day{n}"})
    same = lambda n: (F.col("day") == F.col(f"__day{n}")) & F.col("user").eqNullSafe(F.col(f"__user{n}"))
    rated = named(ratings.select("user", "day", "total_minutes", "tier"), 1)
    cells = spine.join(rated, same(1), "left").join(named(flags, 2), same(2), "left")
    return cells.select(
        "user", "day", F.coalesce("tier", F.lit(TIERS[0])).alias("tier"), F.coalesce("total_minutes", F.lit(0)).cast("long").alias("total_minutes"),
        F.coalesce("nonhuman", F.lit(False)).alias("nonhuman"), (F.col("date") > F.col("__today")).alias("is_future"),
    )


def freshness(metrics: DataFrame, as_of: Column, max_age_s: int = 120) -> DataFrame:
    """Newest window end, its age in seconds and whether it is younger than ``max_age_s``; one row, nulls and false
    without metrics."""
    newest = metrics.agg(F.max("window_end").alias("newest"))
    age = gap_us(moment(as_of), F.col("newest")) / 1_000_000
    return newest.select("newest", age.alias("age_s"), F.coalesce(age < max_age_s, F.lit(False)).alias("fresh"))


def users(metrics: DataFrame) -> DataFrame:
    return metrics.filter("user IS NOT NULL AND user <> ''").select("user").distinct().orderBy("user")


def default_user(metrics: DataFrame, requested: str | None = None) -> DataFrame:
    """One row: the requested user if known, else the one with the newest window (first by name of several)."""
    newest = F.min_by("user", F.struct(-F.unix_micros("window_start"), F.col("user")))
    known = F.bool_or(F.col("user") == F.lit(requested))
    return metrics.filter("user IS NOT NULL").agg(F.when(known, F.lit(requested)).otherwise(newest).alias("user"))


def latest_mix(metrics: DataFrame) -> DataFrame:
    """Each user's share of clicks among clicks and keystrokes in the newest window; null if both are 0."""
    newest = metrics.groupBy("user").agg(F.max_by(F.struct("keystrokes", "clicks"), "window_start").alias("m"), F.max("window_start").alias("window_start"))
    both = F.col("m.keystrokes") + F.col("m.clicks")
    return newest.select("user", "window_start", F.try_divide("m.clicks", F.nullif(both, F.lit(0))).alias("click_share"))


def z_scores(metrics: DataFrame, baseline: DataFrame) -> DataFrame:
    """Every window's counts in standard deviations from the user's mean; null where the deviation is null or 0. Windows without a
    user have no rows."""
    joined = metrics.join(baseline.drop("computed_at"), "user")
    z = [((F.col(c) - F.col(f"{c}_mean")) / F.nullif(f"{c}_std", F.lit(0.0))).alias(f"{c}_z") for c in COUNTS]
    return joined.select("user", "window_start", *z)


def day_sessions(sessions: DataFrame, day: str, tz: str) -> DataFrame:
    """Sessions that started on a local day, newest first."""
    return sessions.filter(day_key(F.col("session_start"), tz) == day).orderBy(F.desc("session_start"), "user", "session_id")
