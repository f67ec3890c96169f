"""Event operators on literal rows: one test for each rule of the semantics contract."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from inputlens.functions import times
from inputlens.functions.events import redacted_key
from inputlens.operators import counts, dashboard, features, heat, liveness, sessions
from inputlens.schema import Params

EVENT = "type string, key string, x long, y long, user string, t double"


def events(spark, rows):
    """Rows (type, t) or (type, t, key/x, y), of user u; times in seconds."""
    made = []
    for r in rows:
        kind, t, *more = r
        key = more[0] if kind.startswith("key") and more else None
        x, y = (more + [None, None])[:2] if not kind.startswith("key") else (None, None)
        made.append((kind, key, x, y, "u", None if t is None else float(t)))
    df = spark.createDataFrame(made, EVENT)
    return df.withColumn("event_time", times.from_epoch(F.col("t"))).drop("t")


def seconds(ts):
    return ts.replace(tzinfo=dt.UTC).timestamp() if ts.tzinfo is None else ts.timestamp()


def test_counts(spark):
    e = events(spark, [("key_down", 1, "a"), ("key_down", 2, " "), ("key_down", 3, "Key.space"), ("key_down", 4, "Key.delete"), ("key_up", 5, "a"), ("click", 6), ("click", 7), ("move", 8, 1, 1)])
    r = counts.minute_metrics(e).collect()
    assert [(x.keystrokes, x.words, x.corrections, x.clicks) for x in r] == [(4, 2, 1, 2)]


@pytest.mark.parametrize("window_s", [60, 600])
def test_session_edges(spark, window_s):
    e = events(spark, [("click", t) for t in (0, 300, 600.000001, 900, 1200.5)] + [("click", None)])
    w = sessions.per_window(e, 300, window_s)  # a window beyond the gap takes the path by event
    got = sessions.session_summary(w).orderBy("session_id").collect()
    assert [(r.session_id, r.clicks_total) for r in got] == [(1, 2), (2, 2), (3, 1)]
    assert [r.session_key for r in got] == [0, 600_000_001, 1_200_500_000]


def test_both_session_paths_agree(spark):
    e = spark.range(3000).select(
        F.lit("click").alias("type"), F.lit(None).cast("string").alias("key"), F.concat(F.lit("u"), F.col("id") % 3).alias("user"),
        F.timestamp_micros(F.pmod(F.xxhash64("id"), F.lit(10**11))).alias("event_time"),
    )
    fast = sessions.per_window(e, 300, 60)
    us = F.unix_micros("event_time")
    slow = sessions.islands(e, us, us, 300_000_000, [us], "session_id")
    slow = slow.groupBy("session_id", F.window("event_time", "60 seconds")["start"].alias("window_start"), "user").count()
    a = fast.select("session_id", "window_start", "user", F.col("clicks").alias("count"))
    assert a.exceptAll(slow).count() == 0 == slow.exceptAll(a).count()


def test_tied_times_are_one_session(spark):
    assert sessions.session_summary(sessions.per_window(events(spark, [("click", 0), ("move", 0, 1, 1)]))).count() == 1


def test_baseline_of_one_window(spark):
    r = sessions.user_baseline(sessions.per_window(events(spark, [("click", 0), ("click", 1)]))).first()
    assert r.clicks_mean == 2 and r.clicks_std is None and r.computed_at is not None


def test_cells_truncate_toward_zero(spark):
    e = events(spark, [("move", i, x, 0) for i, x in enumerate([-17, -15, 15, 16, None])])
    got = {r.cell_x: r["count"] for r in heat.heatmap_by_day(e, "UTC").collect()}
    assert got == {-1: 1, 0: 2, 1: 1, None: 1}


def test_range_heatmaps_include_the_edge(spark):
    e = events(spark, [("move", 0, 1, 1), ("move", 3600, 1, 1), ("key_down", 7200, "a")])
    got = {r["range"]: r["count"] for r in heat.range_heatmaps(e, Params().ranges).collect()}
    assert got == {"1h": 1, "6h": 2, "1d": 2, "3d": 2, "1w": 2}
    assert heat.range_heatmaps(e.limit(0), Params().ranges).count() == 0


def test_clip_and_intensity(spark):
    h = spark.createDataFrame([(0, 0, "move", 3), (107, 69, "move", 1), (108, 0, "move", 9), (-1, 0, "move", 9)], "cell_x int, cell_y int, type string, count long")
    got = {r.cell_x: r.intensity for r in heat.clipped(h, heat.with_grid(heat.known_display(spark)), ["type"]).collect()}
    assert got == {0: 1.0, 107: pytest.approx(0.5)}


def test_features_of_regular_clicks(spark):
    r = features.window_features(events(spark, [("click", t, 5, 5) for t in range(60)])).first()
    assert (r.n_events, r.iei_cv, r.mouse_fraction, r.key_diversity, r.step_mean) == (60, 0.0, 1.0, 0.0, 0.0)


def test_features_need_events_and_steps(spark):
    assert features.window_features(events(spark, [("click", t) for t in range(4)])).count() == 0
    r = features.window_features(events(spark, [("move", 0, 0, 0), ("move", 1, None, None), ("move", 2, 3, 4), ("key_down", 3, "a"), ("key_down", 4, "a")])).first()
    assert (r.step_mean, r.step_cv, r.key_diversity, r.ks_iei_cv) == (5.0, 0.0, 0.5, 0.0)


def test_day_flags(spark):
    at = dt.datetime(2024, 1, 1, 12)
    rows = [("u", at, 0.8), ("u", at, 0.79), ("u", at, 0.95), ("v", at, 0.95), ("v", at, 0.79)]
    got = {r.user: (r.score, r.nonhuman) for r in liveness.score_days(spark.createDataFrame(rows, "user string, window_start timestamp, probability double"), "UTC").collect()}
    assert got == {"u": (0.95, True), "v": (0.95, False)}


def test_ratings(spark):
    day = lambda d, n: (1, "u", dt.datetime(2024, 1, d, 12), n)
    s = spark.createDataFrame([day(1, 10), day(2, 20), day(3, 50), day(3, 10), day(4, 5), day(5, 0)], "session_id long, user string, session_start timestamp, window_count long")
    got = {r.day[-2:]: r.tier for r in dashboard.activity_ratings(s.filter("day(session_start) <= 3"), "UTC").collect()}
    assert got == {"01": "standard", "02": "standard", "03": "productive"}
    got = {r.day[-2:]: r.tier for r in dashboard.activity_ratings(s, "UTC").collect()}
    assert got["04"] == "below_average" and got["05"] == "not_active"


def metric(spark, rows):
    made = [("u", dt.datetime.fromtimestamp(t, dt.UTC), dt.datetime.fromtimestamp(t + 60, dt.UTC), k, 0, 0, c) for t, k, c in rows]
    return spark.createDataFrame(made, "user string, window_start timestamp, window_end timestamp, keystrokes long, words long, corrections long, clicks long")


def test_rebucket_fills_with_zero(spark):
    m = metric(spark, [(600, 3, 0), (300, 1, 0), (0, 9, 9)])
    got = dashboard.rebucket(m, 2, 5, F.timestamp_seconds(F.lit(899))).orderBy("window_start").collect()
    assert [(seconds(r.window_start), r.keystrokes, r.synthetic) for r in got] == [(300, 1, False), (600, 3, False)]
    got = dashboard.rebucket(m, 3, 5, F.timestamp_seconds(F.lit(1500))).orderBy("window_start").collect()
    assert [(r.keystrokes, r.synthetic) for r in got] == [(0, True)] * 3
    gauge = dashboard.activity_gauge(dashboard.rebucket(m, 3, 5, F.timestamp_seconds(F.lit(899))), 5).first()
    assert (gauge.active_buckets, gauge.active_minutes, gauge.idle_minutes) == (3, 15, 0)


def test_sitting_breaks_at_the_gap(spark):
    m = metric(spark, [(0, 1, 0), (300, 1, 0), (660, 1, 0), (480, 0, 0)])
    r = sessions.current_sitting(m, F.timestamp_seconds(F.lit(720))).first()
    assert seconds(r.run_start) == 660 and r.minutes == 1.0
    assert sessions.current_sitting(m, F.timestamp_seconds(F.lit(961))).count() == 0


def test_thin_moves_across_slots(spark):
    """A gap of 100 s has slots of 10,000 s; moves never pause, so that every slot depends on the one before."""
    rng = random.Random(6)
    ts = sorted({round(rng.uniform(0, 60_000), 3) for _ in range(6000)})
    e = events(spark, [("move", t, 1, 1) for t in ts])
    want, last = [], None
    for t in ts:
        if last is None or round((t - last) * 1e6) >= 100_000_000:
            want.append(t)
            last = t
    got = sorted(r.t for r in sessions.thin_moves(e, 100).select((F.unix_micros("event_time") / 1e6).alias("t")).collect())
    assert got == pytest.approx(want, abs=1e-6)


def test_thin_moves_equals_the_greedy_loop(spark):
    e = spark.range(2000).select(
        F.when(F.col("id") % 10 == 0, "click").otherwise("move").alias("type"), F.concat(F.lit("u"), F.col("id") % 2).alias("user"),
        F.col("id").alias("x"), F.col("id").alias("y"), F.timestamp_micros(F.pmod(F.xxhash64("id"), F.lit(20_000_000))).alias("event_time"),
    )
    got = sorted((r.user, r.event_time, r.x) for r in sessions.thin_moves(e).filter("type = 'move'").collect())
    want, last = [], {}
    for r in sorted(e.filter("type = 'move'").collect(), key=lambda r: (r.event_time, r.x)):
        if r.user not in last or r.event_time - last[r.user] >= dt.timedelta(milliseconds=20):
            want.append((r.user, r.event_time, r.x))
            last[r.user] = r.event_time
    assert got == sorted(want)
    assert sessions.thin_moves(e).filter("type = 'click'").count() == 200


def test_days_follow_the_zone_and_its_clock_changes(spark):
    t = F.lit("2024-03-31T00:30:00Z").cast("timestamp")
    row = spark.range(1).select(
        times.day_key(F.lit("2024-01-01T23:30:00Z").cast("timestamp"), "Europe/Istanbul").alias("a"),
        (F.unix_micros(times.end_of_day(F.lit("2024-03-31"), "Europe/Berlin")) - F.unix_micros(times.midnight(t, "Europe/Berlin"))).alias("b"),
        F.unix_micros(times.parse_iso(F.lit("2024-01-01T00:00:00"))).alias("c"), F.unix_micros(times.parse_iso(F.lit("2024-01-01T03:00:00+03:00"))).alias("d"),
        times.parse_iso(F.lit("soon")).alias("e"), times.from_epoch(F.lit(float("nan"))).alias("f"), times.from_epoch(F.lit(1e300)).alias("g"),
        times.duration_minutes(F.timestamp_seconds(F.lit(0)), F.timestamp_seconds(F.lit(10)), F.lit(False), F.timestamp_seconds(F.lit(0))).alias("h"),
        times.duration_minutes(F.timestamp_seconds(F.lit(0)), F.timestamp_seconds(F.lit(10)), F.lit(True), F.timestamp_seconds(F.lit(179))).alias("i"),
        times.staleness(F.timestamp_seconds(F.lit(0)), F.timestamp_seconds(F.lit(1900)))[0].alias("j"),
    ).first()
    assert row.a == "2024-01-02" and row.b == 23 * 3600 * 10**6 and row.c == row.d == 1704067200 * 10**6
    assert row.e is row.f is row.g is None and (row.h, row.i, row.j) == (1, 2, 32)


def test_calendar(spark):
    ratings = spark.createDataFrame([("u", "2024-01-30", 7, "standard")], "user string, day string, total_minutes long, tier string")
    flags = spark.createDataFrame([("u", "2024-01-29", True), ("u", "2024-01-30", False)], "user string, day string, nonhuman boolean")
    got = {r.day: r for r in dashboard.calendar(ratings, flags, F.lit("2024-01-30T12:00:00Z").cast("timestamp"), "UTC").collect()}
    assert len(got) == 56 and min(got) == "2023-12-11" and max(got) == "2024-02-04"
    nobody = ratings.withColumn("user", F.lit(None).cast("string"))
    late = F.lit("2024-01-30T12:00:00Z").cast("timestamp")
    of_null = {r.day: r for r in dashboard.calendar(nobody, flags.withColumn("user", F.lit(None).cast("string")), late, "UTC").collect()}
    assert of_null["2024-01-30"].tier == "standard" and of_null["2024-01-29"].nonhuman and len(of_null) == 56
    assert got["2024-01-30"].tier == "standard" and not got["2024-01-30"].is_future and got["2024-01-31"].is_future and got["2024-01-29"].nonhuman


def test_small_reads(spark):
    m = metric(spark, [(0, 3, 1), (60, 0, 0)])
    as_of = F.timestamp_seconds(F.lit(200))
    assert dashboard.latest_mix(m).first().click_share is None
    assert dashboard.latest_mix(m.filter("keystrokes > 0")).first().click_share == 0.25
    assert dashboard.freshness(m, as_of).first().fresh and not dashboard.freshness(m.limit(0), as_of).first().fresh
    assert dashboard.default_user(m, "nobody").first().user == "u" and dashboard.default_user(m.limit(0)).first().user is None
    assert dashboard.peak_keystrokes(m, as_of, "UTC").first().peak == 3
    assert [r.user for r in dashboard.users(m).collect()] == ["u"]
    assert dashboard.of_user(m, None).count() == 2 and dashboard.of_user(m, "x").count() == 0


def test_redaction_keeps_counts(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (" ",), ("Key.space",), (None,)], "key string")
    got = [r.k for r in df.select(redacted_key("key", "s").alias("k")).collect()]
    assert got[0] == got[1] != got[2] and got[3:] == [" ", "Key.space", None] and "a" not in got


def test_training_and_report(spark, tmp_path):
    from inputlens.sources.automation import automation_events

    robots = features.window_features(automation_events(spark, 2, 20))
    people = features.window_features(
        spark.range(4000).select(
            F.when(F.col("id") % 3 == 0, "move").otherwise("key_down").alias("type"), F.char(97 + F.pmod(F.xxhash64("id"), F.lit(26))).alias("key"),
            F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1500)).alias("x"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(900)).alias("y"), F.lit("p").alias("user"),
            F.timestamp_micros(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(4 * 10**9))).alias("event_time"),
        )
    )
    labeled = liveness.labeled_dataset(people, robots, spark.createDataFrame([("demo", None)], "user string, day string"), "UTC").persist()
    report = liveness.evaluate(labeled, trees=10, depth=6).first()
    assert report.roc_auc > 0.9 and report.n_train + report.n_test == labeled.count() and len(report.importances) == 7
    model = liveness.train(labeled, trees=10, depth=6)
    assert liveness.score_windows(people, model).filter("probability >= 0.5").count() <= 0.2 * people.count()
    assert liveness.score_windows(people, None).count() == 0
    with pytest.raises(liveness.TooFewRows):
        liveness.train(labeled.limit(5))
    liveness.save(model, f"file://{tmp_path}/model")
    again = liveness.score_windows(people, liveness.load(f"file://{tmp_path}/model"))
    assert again.exceptAll(liveness.score_windows(people, model)).count() == 0
    top = liveness.suspicious(liveness.score_windows(robots, model), 3).collect()
    assert len(top) == 3 and top[0].probability >= top[2].probability
    ranked = [r.importance for r in liveness.ranked_importances(spark, model).collect()]
    assert ranked == sorted(ranked, reverse=True) and len(ranked) == 7
    fitted, held = liveness.split(labeled)
    assert fitted.count() + held.count() == labeled.count()
