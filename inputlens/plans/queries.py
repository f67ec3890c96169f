"""The registered queries: every operator over the driver's ``events``, as input events (see FIXTURES.md).

P0 is a gap of 300 s with windows of 60 s, P1 both of 3600 s. "As of" is the newest event's time. Times come out in
UTC without a zone.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from inputlens.functions.events import redacted_key
from inputlens.functions.times import duration_minutes, parse_iso, staleness
from inputlens.operators import counts, dashboard, features, heat, liveness, sessions
from inputlens.plans import arrivals, reads
from inputlens.plans.batch import run_batch, run_liveness
from inputlens.schema import ARCHIVED, SOURCE, Params
from inputlens.sources.archive import read_archive, scratch
from inputlens.sources.automation import automation_events
from inputlens.sources.canonical import input_events
from inputlens.sources.events import as_json, decode, good, normalised
from inputlens.streaming import ingest, speed

P0, P1 = {"gap_s": 300, "window_s": 60}, {"gap_s": 3600, "window_s": 3600}
DAY, USER, TZ = "2024-01-15", "user-1", "UTC"
SALT = "pepper"


def utc(df: DataFrame) -> DataFrame:
    """Timestamps as UTC wall-clock times."""
    plain = {f.name: F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(f.name).cast("timestamp_ntz")) for f in df.schema if isinstance(f.dataType, T.TimestampType)}
    return df.select([plain.get(c, F.col(c)).alias(c) for c in df.columns])


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select([F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema])


class Tables:
    """What the queries start from, over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.events = input_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
        self.as_of: Column = self.events.agg(F.max("event_time")).scalar()

    def minutes(self, window_s: int = 60) -> DataFrame:
        return counts.minute_metrics(self.events, window_s)

    def days(self) -> DataFrame:
        return counts.day_minute_metrics(self.events, TZ)

    def windows(self, p: dict) -> DataFrame:
        return sessions.per_window(self.events, **p)

    def sessions(self, p: dict) -> DataFrame:
        return sessions.session_summary(self.windows(p))

    def baseline(self, p: dict) -> DataFrame:
        return sessions.user_baseline(self.windows(p))

    @functools.cached_property
    def _features(self) -> DataFrame:
        """Written once: forest, split and scores read them many times, and events are read once."""
        made, path = features.window_features(self.events, P1["window_s"]), scratch(self.spark, "features")
        made.write.parquet(path)
        return self.spark.read.schema(made.schema).parquet(path)

    def features(self) -> DataFrame:
        return self._features

    def lines(self) -> DataFrame:
        """Events as they travel: JSON with epoch seconds."""
        wire = self.events.withColumn("ts", F.unix_micros("event_time") / F.lit(1e6))
        columns = ["type", "key", "x", "y", "button", "pressed", "dx", "dy", "user", "ts"]
        return wire.select(F.to_json(F.struct(*columns)).alias("value"))

    def labelled(self) -> DataFrame:
        """Features of all events and of automation in proportion: a session of each kind for 20 windows."""
        human = self.features()
        n = max(1, math.ceil(human.count() / 20))
        automated = features.window_features(automation_events(self.spark, n), P1["window_s"])
        exclude = self.spark.createDataFrame([("user-0", DAY), ("demo", None)], "user string, day string")
        made, path = liveness.labeled_dataset(human, automated, exclude, TZ), scratch(self.spark, "labelled")
        made.write.parquet(path)
        return self.spark.read.schema(made.schema).parquet(path)

    def scored(self) -> DataFrame:
        model = liveness.train(self.labelled())
        return liveness.score_windows(self.features(), model)


def _with(f: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: utc(f(Tables(spark, sf_dir)))


def _range_heatmaps(t: Tables) -> DataFrame:
    return heat.range_heatmaps(t.events, Params().ranges)


def _clip(t: Tables) -> DataFrame:
    panel = ["day", "user", "type"]
    return rounded(heat.clipped(heat.heatmap_by_day(t.events, TZ), heat.with_grid(heat.known_display(t.spark)), panel))


def _small_display(t: Tables) -> DataFrame:
    """Heatmaps on a recorded display, smaller than the usual one."""
    grid = reads.display_grid(t.spark, t.spark.createDataFrame([(1001, 700)], "width int, height int"))
    return rounded(heat.clipped(heat.heatmap_by_day(t.events, TZ), grid, ["day", "user", "type"]))


def _recent(t: Tables) -> DataFrame:
    return dashboard.recent(t.minutes(), t.as_of, 24 * 60)


def _one_day(df: DataFrame) -> DataFrame:
    return df.filter((F.col("day") == DAY) & (F.col("user") == USER))


def _day_sessions(t: Tables) -> DataFrame:
    own = dashboard.day_sessions(t.sessions(P0), DAY, TZ)
    minutes = duration_minutes(F.col("session_start"), F.col("session_end"), F.lit(False), t.as_of)
    return own.select("session_id", "user", "session_start", "session_end", minutes.alias("minutes"))


def _buckets(t: Tables) -> DataFrame:
    return dashboard.rebucket(t.days(), 84, 120, t.as_of)


def _today(t: Tables) -> DataFrame:
    return dashboard.today_totals(t.sessions(P0), t.as_of, TZ)


def _calendar(t: Tables) -> DataFrame:
    ratings = dashboard.activity_ratings(t.sessions(P1), TZ)
    return dashboard.calendar(ratings, _day_flags(t), t.as_of, TZ)


def _day_flags(t: Tables) -> DataFrame:
    """Flags over a fixed score that SQL can express; those over the model's scores are ``m10_day_flags``."""
    scored = t.minutes(3600).select("user", "window_start", ((F.col("keystrokes") * 7 + F.col("clicks") * 3) % 10 / 10).alias("probability"))
    return liveness.score_days(scored, TZ)


def _decoded(t: Tables) -> DataFrame:
    return normalised(good(decode(t.lines()))).drop("ts")


def _redacted(t: Tables) -> DataFrame:
    return t.events.select("event_id", "type", redacted_key("key", SALT).alias("key"))


def _split(t: Tables) -> DataFrame:
    fitted, held = liveness.split(t.labelled())
    rows = fitted.withColumn("part", F.lit("train")).unionByName(held.withColumn("part", F.lit("test")))
    return rows.select("label", "user", "window_start", "part")


def _stream(t: Tables, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a streaming query over the events as JSON files until all is read; a last line, a day on, closes what is
    open and stays open itself."""
    root = scratch(t.spark, "stream")
    flush = t.events.agg((F.max(F.unix_micros("event_time")) / F.lit(1e6) + 86_400).alias("ts"))
    flush = flush.select(F.to_json(F.struct(F.lit("move").alias("type"), F.lit("flush").alias("user"), "ts")).alias("value"))
    t.lines().unionByName(flush).write.text(f"{root}/lines")
    live = make(speed.decoded_events(t.spark.readStream.schema("value string").text(f"{root}/lines")))
    query = speed.start_sink(live, f"{root}/out", f"{root}/checkpoint")
    query.awaitTermination()
    return t.spark.read.schema(live.schema).parquet(f"{root}/out")


def _report(t: Tables) -> DataFrame:
    return liveness.evaluate(t.labelled()).withColumn("importances", F.to_json("importances"))


def _importance(t: Tables) -> DataFrame:
    return liveness.ranked_importances(t.spark, liveness.train(t.labelled()))


def _live(t: Tables) -> DataFrame:
    return sessions.live_session(t.sessions(P1), t.minutes(3600), t.as_of, TZ, gap_s=3600, fresh_s=7200)


def _live_minutes(t: Tables) -> DataFrame:
    """Lengths of the sessions as if every one were still live."""
    minutes = duration_minutes(F.col("session_start"), F.col("session_end"), F.lit(True), t.as_of)
    return t.sessions(P0).select("session_id", "user", minutes.alias("minutes"))


def _iso(t: Tables) -> DataFrame:
    """Times written with Z, with an offset and without either, and texts that are none, read back."""
    wall = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("event_time").cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss")
    form = F.col("event_id") % 4
    text = F.when(form == 0, F.concat(wall, F.lit("Z"))).when(form == 1, F.concat(wall, F.lit("+02:00"))).when(form == 2, wall).otherwise(F.lit("soon"))
    return t.events.select("event_id", parse_iso(text).alias("event_time"))


def _staleness(t: Tables) -> DataFrame:
    ages = t.minutes().groupBy("user").agg(F.max("window_end").alias("newest")).select("user", "newest", *[c.alias(n) for c, n in zip(staleness(F.col("newest"), t.as_of), ("minutes", "pending"), strict=True)])
    return ages


def _balance(t: Tables) -> DataFrame:
    """Class balance, where keystrokes in the window decide the label."""
    rows = t.features().withColumn("label", (F.col("key_diversity") > 0.5).cast("double"))
    return liveness.class_balance(rows)


def _metrics(t: Tables) -> DataFrame:
    """Accuracy, precision, recall and F1 of a fixed prediction."""
    rows = t.features().select((F.col("key_diversity") > 0.5).cast("int").alias("label"), (F.col("mouse_fraction") < 0.5).cast("int").alias("prediction"))
    return rounded(liveness.metrics(rows))


def _human_rows(t: Tables) -> DataFrame:
    """The human rows of the labelled union: what the exclusions leave."""
    return rounded(t.labelled().filter("label = 0"))


def _human_counts(t: Tables) -> DataFrame:
    return t.labelled().filter("label = 0").groupBy("label", "user").count()


_ROOTS: dict[tuple[str, str], str] = {}


def _root(t: Tables, sf_dir: str) -> str:
    """A root of result tables that the batch run has made of the events' archive, and the speed layer's metrics: once for
    each session and folder."""
    key = (t.spark.sparkContext.applicationId, sf_dir)
    if key not in _ROOTS:
        root = scratch(t.spark, "root")
        archived = [F.col(f.name) if f.name in t.events.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in ARCHIVED]
        archived[ARCHIVED.names.index("event_time")] = F.col("event_time").cast("timestamp")
        placed = dict(zip(ARCHIVED.names, archived, strict=True)) | {"source_partition": F.lit(0).alias("source_partition"), "source_offset": F.col("event_id").alias("source_offset")}
        rows = t.events.select(*placed.values(), F.to_date("event_time").alias("event_date"))
        twice = rows.unionByName(rows.filter("source_offset % 10 = 0"))  # as after a failed batch of the sink
        twice.write.partitionBy("event_date").parquet(f"{root}/events")
        t.minutes().write.parquet(f"{root}/metrics")
        run_batch(t.spark, f"{root}/events", root, as_of=t.as_of)
        _ROOTS[key] = root
    return _ROOTS[key]


def _read(f: Callable[[Tables, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Tables(spark, sf_dir)
        return utc(f(t, _root(t, sf_dir)))

    return query


def _scored_root(t: Tables, root: str) -> str:
    """A root of its own where the job that follows a batch has run, on windows of an hour: once for each archive."""
    key = (t.spark.sparkContext.applicationId, root)
    if key not in _ROOTS:
        own = scratch(t.spark, "liveness")
        run_liveness(t.spark, f"{root}/events", own, Params(gap_s=3600, window_s=3600), sessions_per_kind=max(1, math.ceil(t.features().count() / 20)))
        _ROOTS[key] = own
    return _ROOTS[key]


def _flags(t: Tables, root: str) -> DataFrame:
    return reads.liveness(t.spark, _scored_root(t, root))


def _flagged_days(t: Tables, root: str) -> DataFrame:
    """Which days have a flag, and whether its score is a probability: what SQL can say of a model's flags."""
    return _flags(t, root).select("user", "day", F.col("score").between(0, 1).alias("scored"))


def _model_report(t: Tables, root: str) -> DataFrame:
    return reads.ml_metrics(t.spark, _scored_root(t, root)).select("available", "n_human", (F.col("n_train") + F.col("n_test") - F.col("n_automation")).alias("n_split"))


def _archive_sink(t: Tables) -> DataFrame:
    """Metrics and archive as the speed layer writes them, both from one stream; what the archive then holds."""
    root = scratch(t.spark, "speed")
    t.lines().write.text(f"{root}/lines")
    for query in speed.start_speed_layer(t.spark.readStream.schema("value string").text(f"{root}/lines"), root, None, None):
        query.awaitTermination()
    events, _ = read_archive(t.spark, f"{root}/events", guard=True)
    return events.select([c for c in ARCHIVED.names if c not in (*SOURCE, "ts")])


def _split_share(t: Tables) -> DataFrame:
    """Human rows of both parts, and whether about a quarter is held out."""
    rows = _split(t).filter("label = 0").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("part") == "test").cast("double")).alias("held"))
    return rows.select("label", "n", F.col("held").between(0.2, 0.3).alias("a_quarter"))


def _json_counts(t: Tables) -> DataFrame:
    rows = t.features().select("user", "n_events", "window_start")
    return rows.select("user", "window_start", as_json(rows.select("user", "n_events")).alias("record"))


def _once(name: str, make: Callable[[Tables], str]) -> Callable[[Tables, str], str]:
    """A root that is made once for each session and folder."""

    def root(t: Tables, sf_dir: str) -> str:
        key = (t.spark.sparkContext.applicationId, f"{name} {sf_dir}")
        if key not in _ROOTS:
            _ROOTS[key] = make(t)
        return _ROOTS[key]

    return root


_ingest_root = _once("ingest", lambda t: arrivals.ingested(t.spark, t.events))
_grown_root = _once("grown", lambda t: arrivals.grown(t.spark, t.events, Params(), t.as_of))


def _arrived(f: Callable[[Tables, str], DataFrame], root: Callable[[Tables, str], str]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Tables(spark, sf_dir)
        return utc(f(t, root(t, sf_dir)))

    return query


def _ledger(rows: DataFrame) -> DataFrame:
    """The ledger in order of batches, numbered without those that held nothing."""
    order = Window.orderBy("batch")  # a row for each batch
    return rows.select((F.row_number().over(order) - 1).cast("long").alias("batch"), "rows", "bad", "late", "newest")


#: What the once-only ingest makes of events that arrive in rounds, and incremental batch runs of an archive that grows by them.
ARRIVALS = {
    "r3_ingest_archive": (_ingest_root, lambda t, root: ingest.archived(t.spark, root).select([c for c in ARCHIVED.names if c not in (SOURCE[0], "ts")])),
    "r3_ingest_quarantine": (_ingest_root, lambda t, root: ingest.refused(t.spark, root)),
    "r4_live_metrics": (_ingest_root, lambda t, root: ingest.metrics(t.spark, root)),
    "r4_missed": (_ingest_root, lambda t, root: ingest.missed(t.spark, root)),
    "r4_repaired": (_ingest_root, lambda t, root: ingest.repaired(t.spark, root)),
    "r5_ledger": (_ingest_root, lambda t, root: _ledger(ingest.ledger(t.spark, root))),
    "a3_incremental": (_grown_root, lambda t, root: reads.read_table(t.spark, root, "per_window")),
    "a4_incremental": (_grown_root, lambda t, root: reads.read_table(t.spark, root, "sessions")),
    "a5_merged": (_grown_root, lambda t, root: rounded(reads.baseline(t.spark, root).drop("computed_at"))),
    "a6_from_hours": (_grown_root, lambda t, root: reads.read_table(t.spark, root, "heatmaps")),
    "a7_incremental": (_grown_root, lambda t, root: reads.read_table(t.spark, root, "day_minute_metrics")),
    "a8_incremental": (_grown_root, lambda t, root: reads.read_table(t.spark, root, "heatmap_by_day")),
}


def _detail(part: str) -> Callable[[Tables, str], DataFrame]:
    return lambda t, root: rounded(reads.day_detail(t.spark, root, DAY, USER, TZ)[part])


READS = {
    "read_metrics": lambda t, root: reads.metrics(t.spark, root, t.as_of, 24 * 60),
    "read_sessions": lambda t, root: reads.newest_sessions(t.spark, root),
    "read_baseline": lambda t, root: rounded(reads.baseline(t.spark, root)),
    "read_heatmap_1d": lambda t, root: reads.heatmap(t.spark, root, "1d"),
    "read_heatmap_unknown": lambda t, root: reads.heatmap(t.spark, root, "2h"),
    "read_day_metrics": lambda t, root: reads.day_metrics(t.spark, root, DAY, USER),
    "read_heatmap_day": lambda t, root: reads.heatmap_day(t.spark, root, DAY, USER),
    "read_per_window": lambda t, root: reads.read_table(t.spark, root, "per_window"),
    "read_display_grid": lambda t, root: reads.display_grid(t.spark),
    "read_health": lambda t, root: rounded(reads.health(t.spark, root, t.as_of + F.expr("INTERVAL 90 SECONDS"))),
    "read_batch_status": lambda t, root: reads.batch_status(t.spark, root),
    "read_ml_metrics_none": lambda t, root: reads.ml_metrics(t.spark, root).select("available", "accuracy", "n_train"),
    "read_liveness_none": lambda t, root: reads.liveness(t.spark, root, USER),
    "read_calendar": lambda t, root: reads.calendar(t.spark, root, t.as_of, TZ),
    "read_day_timeline": _detail("timeline"),
    "read_day_gauge": _detail("gauge"),
    "read_day_sessions": _detail("sessions"),
    "read_day_heatmap": _detail("heatmap"),
    "k4_liveness_job": lambda t, root: rounded(_flags(t, root)),
    "k4_flagged_days": _flagged_days,
    "k6_model_report": _model_report,
}

QUERIES = {
    "a2_minute_metrics": _with(lambda t: t.minutes()),
    "a3_per_window": _with(lambda t: t.windows(P0).drop("first_us")),
    "a3_per_window_p1": _with(lambda t: t.windows(P1).drop("first_us")),
    "a4_sessions": _with(lambda t: t.sessions(P0)),
    "a4_sessions_p1": _with(lambda t: t.sessions(P1)),
    "a5_baseline": _with(lambda t: rounded(t.baseline(P0).drop("computed_at"))),
    "a6_range_heatmaps": _with(_range_heatmaps),
    "a7_day_minute": _with(lambda t: t.days()),
    "a8_heatmap_day": _with(lambda t: heat.heatmap_by_day(t.events, TZ)),
    "a10_features_p1": _with(lambda t: rounded(t.features())),
    "a14_day_flags": _with(lambda t: rounded(_day_flags(t))),
    "a15_class_balance": _with(_balance),
    "a16_metrics": _with(_metrics),
    "a17_rebucket": _with(_buckets),
    "a18_gauge": _with(lambda t: rounded(dashboard.activity_gauge(_buckets(t), 120))),
    "a19_today": _with(lambda t: _today(t).drop("longest")),
    "a20_per_minute": _with(lambda t: rounded(dashboard.per_minute(_today(t), t.baseline(P0)))),
    "a21_longest": _with(lambda t: _today(t).select("user", "longest")),
    "a22_peak": _with(lambda t: dashboard.peak_keystrokes(t.minutes(), t.as_of, TZ)),
    "a23_ratings": _with(lambda t: rounded(dashboard.activity_ratings(t.sessions(P1), TZ))),
    "a24_freshness": _with(lambda t: rounded(dashboard.freshness(t.minutes(), t.as_of))),
    "a25_users": _with(lambda t: dashboard.users(t.minutes())),
    "a27_daily_totals": _with(lambda t: counts.daily_totals(t.days())),
    "c6_one_user": _with(lambda t: dashboard.of_user(t.minutes(), USER)),
    "c10_redact": _with(_redacted),
    "c11_clip_intensity": _with(_clip),
    "c14_thin_moves": _with(lambda t: sessions.thin_moves(t.events, 3600).select("event_id", "user", "event_time", "type")),
    "c14_stream": _with(lambda t: arrivals.thinned(t.spark, t.events, 3600).select("user", "event_time", "x", "y")),
    "f8_parse_iso": _with(_iso),
    "f11_live_minutes": _with(_live_minutes),
    "f14_staleness": _with(_staleness),
    "j2_calendar": _with(_calendar),
    "j4_display": _with(_small_display),
    "j5_zscore": _with(lambda t: rounded(dashboard.z_scores(t.minutes(3600), t.baseline(P1)))),
    "k2_archive_sink": _with(_archive_sink),
    "k7_json_counts": _with(_json_counts),
    "k7_json_export": _with(lambda t: t.features().select("user", "window_start", as_json(t.features()).alias("record"))),
    "m5_split": _with(_split),
    "m5_split_share": _with(_split_share),
    "m8_report": _with(_report),
    "m9_scores": _with(lambda t: t.scored()),
    "m10_day_flags": _with(lambda t: rounded(liveness.score_days(t.scored(), TZ))),
    "q_day_metrics": _with(lambda t: _one_day(t.days()).orderBy("window_start")),
    "q_heatmap_day": _with(lambda t: _one_day(heat.heatmap_by_day(t.events, TZ))),
    "q_recent_metrics": _with(_recent),
    "r2_stream_metrics": _with(lambda t: _stream(t, speed.live_metrics)),
    "r10_stream_sessions": _with(lambda t: _stream(t, speed.live_sessions)),
    "s1_log_stream": _with(lambda t: arrivals.logged(t.spark, t.events).select("type", "user", "event_time", *SOURCE)),
    "s2_decode": _with(_decoded),
    "s8_automation_events": _with(lambda t: automation_events(t.spark, max(1, math.ceil(t.features().count() / 20)))),
    "t1_newest_sessions": _with(lambda t: sessions.newest_sessions(t.sessions(P0))),
    "t4_suspicious": _with(lambda t: liveness.suspicious(t.scored())),
    "t5_importance": _with(_importance),
    "t6_day_sessions": _with(_day_sessions),
    "t7_default_user": _with(lambda t: dashboard.default_user(t.minutes())),
    "t9_latest_mix": _with(lambda t: rounded(dashboard.latest_mix(t.minutes()))),
    "t8_paint_order": _with(lambda t: heat.painted(_one_day(heat.heatmap_by_day(t.events, TZ)))),
    "u1_human_counts": _with(_human_counts),
    "u1_human_rows": _with(_human_rows),
    "u1_labelled": _with(lambda t: rounded(t.labelled())),
    "w6_sitting": _with(lambda t: rounded(sessions.current_sitting(t.minutes(3600), t.as_of, 3600))),
    "w7_live": _with(_live),
} | {name: _read(f) for name, f in READS.items()} | {name: _arrived(f, root) for name, (root, f) in ARRIVALS.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to sessions, newest first."""
    return QUERIES["t1_newest_sessions"](spark, sf_dir)


