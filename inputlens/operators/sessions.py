"""Sessions: gaps and islands, summaries, baselines, the current sitting, and move thinning.

A session goes on while the gap to the event before is at most ``gap_s``. With windows no longer than the gap, all
events of a (user, window) lie in one session, so events are first reduced to windows (with their first and last
event) and only windows are sorted by user: a busy user brings at most 1,440 rows a day to a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inputlens.functions.events import event_count_exprs, is_active, sums
from inputlens.functions.times import gap_us, midnight, moment
from inputlens.operators.counts import flat
from inputlens.schema import COUNTS

KEPT = ["window_start", "window_end", "user", *COUNTS]


def islands(rows: DataFrame, first: Column, last: Column, gap_us: int, order: list[Column], name: str, by: list[str] | None = None) -> DataFrame:
    """Number each user's runs of rows (or those of ``by``) from 1; a run ends where ``first`` is more than ``gap_us`` after the
    previous row's ``last`` (both in microseconds)."""
    by_user = Window.partitionBy(*(by or ["user"])).orderBy(*order)
    before = F.lag(last).over(by_user)
    starts = F.when(before.isNull() | (first - before > gap_us), 1).otherwise(0)
    running = by_user.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("__starts", starts).withColumn(name, F.sum("__starts").over(running)).drop("__starts")


def per_window(events: DataFrame, gap_s: int = 300, window_s: int = 60) -> DataFrame:
    """session_id with the counts of every (session, window, user). Rows without a time are left out first."""
    events = events.filter("event_time IS NOT NULL")
    w = F.window("event_time", f"{window_s} seconds").alias("w")
    us = F.unix_micros("event_time")
    if gap_s >= window_s:
        windows = events.groupBy(w, "user").agg(*event_count_exprs(), F.min(us).alias("__first"), F.max(us).alias("__last"))
        windows = windows.select(*flat(), "user", *COUNTS, "__first", "__last")
        numbered = islands(windows, F.col("__first"), F.col("__last"), gap_s * 1_000_000, [F.col("__first")], "session_id")
        return numbered.select("session_id", *KEPT, F.col("__first").alias("first_us"))
    # a window can hold several sessions: number events, then count
    numbered = islands(events.withColumn("__us", us), F.col("__us"), F.col("__us"), gap_s * 1_000_000, [F.col("__us")], "session_id")
    counted = numbered.groupBy("session_id", w, "user").agg(*event_count_exprs(), F.min("__us").alias("first_us"))
    return counted.select("session_id", *flat(), "user", *COUNTS, "first_us")


def session_summary(windows: DataFrame) -> DataFrame:
    """One row for each (session, user). session_id is an ordinal and moves when late events join sessions;
    session_key, the first event's microsecond, does not."""
    return windows.groupBy("session_id", "user").agg(
        F.min("first_us").alias("session_key"), F.min("window_start").alias("session_start"), F.max("window_end").alias("session_end"),
        F.count(F.lit(1)).alias("window_count"), *sums("_total"),
    )


def user_baseline(windows: DataFrame, computed_at: Column | None = None) -> DataFrame:
    """Mean and sample deviation of each count over a user's windows with events (one window: no deviation)."""
    stats = [f(c).alias(f"{c}_{n}") for c in COUNTS for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return windows.groupBy("user").agg(*stats).withColumn("computed_at", F.current_timestamp() if computed_at is None else computed_at)


def newest_sessions(sessions: DataFrame, limit: int = 2000) -> DataFrame:
    return sessions.orderBy(F.desc("session_start"), "user", "session_id").limit(limit)


def current_sitting(metrics: DataFrame, as_of: Column, gap_s: int = 300) -> DataFrame:
    """user, run_start and minutes of each user's newest run of active windows whose starts are at most ``gap_s``
    apart; users whose newest active window started longer ago have none."""
    at = F.unix_micros("window_start")
    runs = islands(metrics.filter(is_active()), at, at, gap_s * 1_000_000, [F.col("window_start")], "__run")
    spans = runs.groupBy("user", "__run").agg(F.min("window_start").alias("run_start"), F.max("window_start").alias("run_end"))
    newest = spans.groupBy("user").agg(F.max_by(F.struct("run_start", "run_end"), "__run").alias("r")).select("user", "r.*")
    live = newest.filter(gap_us(moment(as_of), F.col("run_end")) <= gap_s * 1_000_000)
    return live.select("user", "run_start", (gap_us(moment(as_of), F.col("run_start")) / 60_000_000).alias("minutes"))


def live_session(sessions: DataFrame, metrics: DataFrame, as_of: Column, tz: str, gap_s: int = 300, fresh_s: int = 120, match_s: int = 90) -> DataFrame:
    """(user, session_id): today's newest session of a user, if the user's metrics are fresh and the session starts
    less than ``match_s`` from the current sitting's start."""
    as_of = moment(as_of)
    order = Window.partitionBy("user").orderBy(F.desc("session_start"), F.desc("session_id"))
    today = sessions.filter(F.col("session_start") >= midnight(as_of, tz)).withColumn("__n", F.row_number().over(order)).filter("__n = 1")
    fresh = metrics.groupBy("user").agg(F.max("window_end").alias("__end")).filter(gap_us(as_of, F.col("__end")) < fresh_s * 1_000_000)
    matched = today.join(current_sitting(metrics, as_of, gap_s), "user").join(fresh, "user")
    return matched.filter(F.abs(gap_us(F.col("session_start"), F.col("run_start"))) < match_s * 1_000_000).select("user", "session_id", "session_start", "run_start")


def thin_moves(events: DataFrame, min_gap_s: float = 0.02) -> DataFrame:
    """Drop a user's move that comes less than ``min_gap_s`` after the last move kept; other events stay.

    Exact and parallel: time is cut into slots, far longer than the gap. Which moves of a slot are kept depends on the
    slots before only through the first one kept, which is among the times of the slot's first gap or the next one after.
    So each slot is summed up by the last time kept for every such beginning, the sums are chained by user, and
    each slot is thinned from its beginning. A task holds the distinct times of one slot of one user, or one user's sums.
    Moves without a time stay; of moves at one time the first by position is kept. A gap of 0 (to the microsecond) keeps all."""
    gap = round(min_gap_s * 1_000_000)
    if gap <= 0:
        return events
    slot_us = max(3_600_000_000, 100 * gap)
    moves = events.filter((F.col("type") == "move") & F.col("event_time").isNotNull()).withColumn("__us", F.unix_micros("event_time"))
    who = F.coalesce(F.concat(F.lit("u"), "user"), F.lit("n")).alias("__who")  # a null user is a user too
    times = moves.select(who, F.floor(F.col("__us") / F.lit(slot_us)).cast("long").alias("__slot"), "__us").distinct()

    def sums(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        us = np.sort(pdf["__us"].to_numpy())
        begins = us[: int(np.searchsorted(us, key[1] * slot_us + gap)) + 1]
        after, last = np.searchsorted(us, us + gap), np.arange(len(us))
        for i in range(len(us) - 1, -1, -1):
            if after[i] < len(us):
                last[i] = last[after[i]]
        return pd.DataFrame({"__who": key[0], "__slot": key[1], "__begin": begins, "__last": us[last[: len(begins)]]})

    def chain(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kept, out = None, []
        for slot, rows in pdf.sort_values(["__slot", "__begin"]).groupby("__slot"):
            begins = rows["__begin"].to_numpy()
            at = 0 if kept is None else int(np.searchsorted(begins, kept + gap))
            if at < len(begins):
                out.append((key[0], slot, begins[at]))
                kept = rows["__last"].iat[at]
        return pd.DataFrame(out, columns=["__who", "__slot", "__begin"])

    def thin(rows: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        us, kept = np.sort(rows["__us"].to_numpy()), []
        at = int(np.searchsorted(us, begin["__begin"].iat[0])) if len(begin) else len(us)
        while at < len(us):
            kept.append(us[at])
            at = int(np.searchsorted(us, us[at] + gap))
        return pd.DataFrame({"__who": rows["__who"].iat[0] if len(rows) else None, "__us": kept}).astype({"__us": "int64"})

    keys = ["__who", "__slot"]
    begins = times.groupBy(keys).applyInPandas(sums, "__who string, __slot long, __begin long, __last long")
    begins = begins.groupBy("__who").applyInPandas(chain, "__who string, __slot long, __begin long")
    keep = times.groupBy(keys).cogroup(begins.groupBy(keys)).applyInPandas(thin, "__who string, __us long")
    first = Window.partitionBy("__who", "__us").orderBy("x", "y")
    ordered = moves.withColumn("__who", who).withColumn("__first", F.row_number().over(first)).filter("__first = 1").drop("__first")
    kept = ordered.join(keep, ["__who", "__us"], "left_semi").drop("__us", "__who")
    return events.filter((F.col("type") != "move") | F.col("type").isNull() | F.col("event_time").isNull()).unionByName(kept)
