"""Decoding, streams, archive, the batch run and the reads on its tables."""

import datetime as dt
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from inputlens.operators import sessions
from inputlens.plans import arrivals, batch, reads
from inputlens.schema import EVENT, Params
from inputlens.sources import archive
from inputlens.sources.automation import ANCHOR, AWAKE_KEYS, CADENCE, DISTANCES, PATTERNS, TYPER_KEYS, automation_events
from inputlens.sources.events import as_json, decode, good, normalised, published, quarantined
from inputlens.streaming import speed

DIRTY = [
    "garbage", "", '{"type":"move","x":12.5,"user":"u","ts":1}', '{"type":"move","x":"12","user":"u","ts":1}',
    '{"type":"move","user":"u","ts":NaN}', '{"type":"move","user":"u","ts":1e300}', '{"type":"move","ts":2}',
    '{"type":"click","x":1,"y":2,"button":"Button.left","pressed":true,"user":"u","ts":1716300002.5}',
]


def line(t, kind="click", user="u"):
    return json.dumps({"type": kind, "user": user, "ts": t, "x": 1, "y": 1})


def test_decode_quarantines(spark):
    d = decode(spark.createDataFrame([(x,) for x in DIRTY], "value string"))
    assert sorted(r.raw for r in quarantined(d).collect()) == sorted(DIRTY[i] for i in (0, 1, 4, 5, 6))
    rows = good(d).collect()
    assert len(rows) == 3 and [r.x for r in rows if r.type == "move"] == [None, None]
    assert normalised(spark.createDataFrame([("u", 1.0), ("u", None)], "user string, ts double")).columns == [*EVENT.names, "event_time"]


def test_published_rows_decode_again(spark):
    d = good(decode(spark.createDataFrame([(DIRTY[-1],)], "value string"))).drop("event_time")
    row = published(d).first()
    assert row.key == "u" and json.loads(row.value)["pressed"] is True
    nan = spark.createDataFrame([(float("nan"), None)], "a double, b string")
    assert json.loads(nan.select(as_json(nan)).first()[0]) == {"a": None, "b": None}


def test_late_rows_and_resume(spark, tmp_path):
    """Files arrive one after another; a row is late only when its minute has closed, and only for the metrics."""
    src, root = tmp_path / "in", f"file://{tmp_path}/out"
    src.mkdir()
    for i, ts in enumerate([(0.5, 30, 61), (65, 3, 70), (10, 200)]):
        (src / f"{i}.txt").write_text("\n".join(line(t) for t in ts) + "\ngarbage\n")
        stream = spark.readStream.schema("value string").text(f"file://{src}")
        for q in speed.start_speed_layer(stream, root, None, None):
            q.awaitTermination()
    got = {r.window_start.timestamp(): r.clicks for r in spark.read.parquet(f"{root}/metrics").collect()}
    assert got == {0.0: 3, 60.0: 3}
    assert spark.read.parquet(f"{root}/events").count() == 8


def test_live_sessions_equal_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    ts = [0, 30, 300, 601, 900, 5000]
    (src / "a.txt").write_text("\n".join(line(t) for t in [*ts, 90_000]))
    live = speed.live_sessions(speed.decoded_events(spark.readStream.schema("value string").text(f"file://{src}")))
    speed.start_sink(live, f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    got = sorted((r.session_key, r.window_count, r.clicks) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    e = good(decode(spark.createDataFrame([(line(t),) for t in ts], "value string")))
    want = sorted((r.session_key, r.window_count, r.clicks_total) for r in sessions.session_summary(sessions.per_window(e)).collect())
    assert got == want and len(got) == 3


def test_stream_thinning_spans_batches(spark, tmp_path):
    src, old = tmp_path / "in", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    src.mkdir()
    speed.rocksdb_state(spark)
    try:
        for i, ts in enumerate([(1.0, 1.01, 1.02), (1.03, 1.045, 1.2), (100.0,)]):  # the last lets the watermark pass the others
            (src / f"{i}.txt").write_text("\n".join(line(t, "move") for t in ts))
            events = speed.decoded_events(spark.readStream.schema("value string").text(f"file://{src}"))
            speed.start_sink(speed.thin_moves_stream(events), f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    kept = sorted(r.ts for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    assert kept == [1.0, 1.02, 1.045, 1.2]


def test_supervision_stops_the_rest_and_logs_progress(spark, tmp_path):
    log = speed.ProgressLog()
    spark.streams.addListener(log)
    rate = spark.readStream.format("rate").option("rowsPerSecond", 50).load()
    bad = rate.select(F.raise_error(F.lit("broken")).cast("string").alias("x"))
    fine = rate.writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/a").start()
    broken = bad.writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/b").start()
    with pytest.raises(Exception, match="broken"):
        speed.supervise(spark, [fine, broken])
    assert not fine.isActive and not broken.isActive
    spark.streams.removeListener(log)
    assert log.table(spark).columns[:2] == ["query", "batch"]


def test_archive_guard_and_duplicates(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    e = good(decode(spark.createDataFrame([(line(t),) for t in (1, 2, 3)], "value string")))
    e.coalesce(1).write.parquet(path)
    e.coalesce(1).write.mode("append").parquet(path)
    e.withColumn("x", F.col("x").cast("double")).coalesce(1).write.mode("append").parquet(path)
    (tmp_path / "archive" / "broken.parquet").write_bytes(b"no parquet")
    events, skipped = archive.read_archive(spark, path, guard=True)
    assert skipped == 2 and events.count() == 6 and archive.deduplicated(events).count() == 3


def test_batch_run_and_reads(spark, tmp_path):
    source, root = f"file://{tmp_path}/archive", f"file://{tmp_path}/tables"
    as_of = F.timestamp_seconds(F.lit(4000))
    assert reads.newest_sessions(spark, root).count() == 0 and reads.batch_status(spark, root).count() == 0
    assert reads.ml_metrics(spark, root).first().available is False and reads.model(root) is None
    e = good(decode(spark.createDataFrame([(line(t),) for t in (1, 70, 80, 3000)] + [(line(3001, "move"),)], "value string")))
    e.write.parquet(source)
    log = batch.run_batch(spark, source, root, Params()).first()
    assert log.status == "ok" and log.error is None
    assert [r.clicks_total for r in reads.newest_sessions(spark, root).collect()] == [1, 3]
    assert reads.heatmap(spark, root, "1h").agg(F.sum("count")).first()[0] == 5 and reads.heatmap(spark, root, "2h").count() == 0
    assert reads.baseline(spark, root).first().clicks_mean == pytest.approx(4 / 3)
    assert reads.day_metrics(spark, root, "1970-01-01", "u").count() == 3 and reads.heatmap_day(spark, root, "1970-01-01", "u").count() == 2
    detail = reads.day_detail(spark, root, "1970-01-01", "u", "UTC")
    assert detail["timeline"].count() == 96 and detail["gauge"].first().active_buckets == 2 and detail["sessions"].count() == 2
    assert detail["timeline"].agg(F.min("window_start")).first()[0] == dt.datetime.fromtimestamp(0)
    assert reads.calendar(spark, root, as_of, "UTC").count() == 56
    # a second run takes over at once; the first version stays for its readers
    e.filter("ts < 100").write.mode("overwrite").parquet(source)
    batch.run_batch(spark, source, root)
    assert batch.run_log(spark, root).count() == 2
    assert reads.newest_sessions(spark, root).count() == 1 and reads.batch_status(spark, root).count() == 1
    health = reads.health(spark, root, as_of).first()
    assert health.batch_status == "ok" and not health.fresh and health.batch_age_s == pytest.approx(4000 - 80) and health.batch_error is None
    with pytest.raises(AnalysisException):
        batch.run_batch(spark, f"file://{tmp_path}/nowhere", root, guard=False)
    assert batch.run_log(spark, root).filter("status = 'failed'").count() == 1
    assert reads.display_grid(spark).first().grid_w == 108 and reads.liveness(spark, root, "u").count() == 0


def test_a_failing_table_changes_nothing(spark, tmp_path, monkeypatch):
    """The fourth table of the second run fails: all tables stay those of the first."""
    source, root = f"file://{tmp_path}/archive", f"file://{tmp_path}/tables"
    e = good(decode(spark.createDataFrame([(line(t),) for t in (1, 70, 80, 3000)], "value string")))
    e.write.parquet(source)
    batch.run_batch(spark, source, root)
    names = RESULTS
    rows = lambda: {n: sorted(map(str, archive.read_table(spark, root, n).collect())) for n in names}
    before, real = rows(), batch.write_version

    def broken(df, root, name, partition=None):
        if name == "day_minute_metrics":
            raise RuntimeError("disk full")
        return real(df, root, name, partition)

    e.filter("ts > 100").write.mode("overwrite").parquet(source)
    monkeypatch.setattr(batch, "write_version", broken)
    with pytest.raises(RuntimeError, match="disk full"):
        batch.run_batch(spark, source, root)
    assert rows() == before and reads.batch_status(spark, root).first().error == "disk full"
    monkeypatch.setattr(batch, "write_version", real)
    batch.run_batch(spark, source, root)
    assert all(r != before[n] for n, r in rows().items())


RESULTS = ["per_window", "sessions", "baseline", "day_minute_metrics", "heatmap_by_day", "heatmaps"]


def results(spark, root):
    near = lambda v: round(v, 9) if isinstance(v, float) else v
    return {n: sorted(str([near(v) for v in r]) for r in archive.read_table(spark, root, n).collect()) for n in RESULTS}


@pytest.fixture
def slices_read(monkeypatch):
    """Spans of the archive that runs have read events of."""
    seen, real = [], batch.read_spans

    def spied(spark, index, spans):
        seen.append(spans)
        return real(spark, index, spans)

    monkeypatch.setattr(batch, "read_spans", spied)
    return seen


def some_events(spark, ts, user="u"):
    kinds = ["move", "click", "key_down", "scroll", "move"]
    rows = [(json.dumps({"type": kinds[(t * 7 + len(user)) % 5], "user": None if user == "none" else user, "ts": t, "x": t % 900, "y": t * 3 % 700, "key": " " if t % 4 else "a"}),) for t in ts]
    return decode(spark.createDataFrame(rows, "value string")).withColumn("bad", F.col("event_time").isNull()).filter("NOT bad").drop("raw", "bad")


DAY_S = 86_400


@pytest.mark.parametrize("params", [Params(), Params(gap_s=100, window_s=3600, tz="Asia/Kolkata"), Params(gap_s=4000, window_s=420, tz="America/New_York")])
def test_incremental_runs_equal_whole_ones(spark, tmp_path, slices_read, params):
    """Days that gain, lose or change events at an equal number, that vanish, and sessions over midnight."""
    source, root, whole = (f"file://{tmp_path}/{x}" for x in ("archive", "tables", "whole"))
    folder = lambda name: f"{source}/{name}"
    over_midnight = [*range(DAY_S - 500, DAY_S + 500, 37), *range(2 * DAY_S - 40, 2 * DAY_S + 40, 3)]
    some_events(spark, over_midnight).unionByName(some_events(spark, range(1000, 1400, 11), "v")).write.parquet(folder("a"))
    some_events(spark, [*range(5 * DAY_S, 5 * DAY_S + 900, 70)], "none").write.parquet(folder("b"))
    some_events(spark, [*range(9 * DAY_S, 9 * DAY_S + 4000, 100)]).write.parquet(folder("c"))

    def check(days):
        slices_read.clear()
        batch.run_batch(spark, source, root, params, incremental=True)
        read = [(a // 1_000_000 // DAY_S, -(-b // 1_000_000 // DAY_S)) for a, b in slices_read[0]] if len(slices_read) > 1 else None
        batch.run_batch(spark, source, whole, params)
        assert results(spark, root) == results(spark, whole)
        assert read is None if days is None else {d for a, b in read for d in range(a, b)} <= days

    check(None)  # the first run is a whole one
    check(set())  # nothing has changed
    some_events(spark, [*range(5 * DAY_S + 300, 5 * DAY_S + 1200, 90)], "v").write.parquet(folder("late"))
    check({4, 5, 6})
    some_events(spark, [t + 3 for t in range(9 * DAY_S, 9 * DAY_S + 4000, 100)]).write.mode("overwrite").parquet(folder("c"))  # as many as before
    check({8, 9, 10})
    archive.delete(spark, folder("b"), folder("late"))  # the day is gone
    check({4, 5, 6})
    archive.delete(spark, folder("a"))  # the first days are gone, ordinals move
    check({-1, 0, 1, 2, 3})


def test_other_parameters_make_a_whole_run(spark, tmp_path):
    source, root, whole = (f"file://{tmp_path}/{x}" for x in ("archive", "tables", "whole"))
    some_events(spark, range(0, 200_000, 977)).write.parquet(source)
    batch.run_batch(spark, source, root, Params(tz="UTC"))
    other = Params(tz="Asia/Kolkata", cell=32)
    batch.run_batch(spark, source, root, other, incremental=True)
    batch.run_batch(spark, source, whole, other)
    assert results(spark, root) == results(spark, whole)


def test_tables_equal_the_operators(spark, tmp_path):
    """From roll-ups as from events, in a zone of half hours and with windows longer than the gap too."""
    from inputlens.operators import counts, heat

    events = some_events(spark, range(0, 300_000, 331)).unionByName(some_events(spark, range(7, 200_000, 4001), "none"))
    events.write.parquet(f"file://{tmp_path}/archive")
    for i, p in enumerate([Params(), Params(gap_s=60, window_s=3600, tz="Asia/Kolkata"), Params(gap_s=5000, window_s=3600, tz="Asia/Kolkata")]):
        root = f"file://{tmp_path}/{i}"
        batch.run_batch(spark, f"file://{tmp_path}/archive", root, p, guard=i != 1)
        windows = sessions.per_window(events, p.gap_s, p.window_s)
        newest = events.agg(F.max("event_time")).scalar()
        want = {
            "per_window": windows.drop("first_us"), "sessions": sessions.session_summary(windows), "baseline": sessions.user_baseline(windows, newest),
            "day_minute_metrics": counts.day_minute_metrics(events, p.tz, p.window_s), "heatmap_by_day": heat.heatmap_by_day(events, p.tz, p.cell),
            "heatmaps": heat.range_heatmaps(events, p.ranges, p.cell),
        }
        near = lambda v: round(v, 9) if isinstance(v, float) else v
        for name, rows in results(spark, root).items():
            columns = archive.TABLES[name].names
            assert rows == sorted(str([near(v) for v in r]) for r in want[name].select(columns).collect()), name


def test_ranges_read_events_of_one_hour_each(spark, tmp_path, slices_read):
    source, root = f"file://{tmp_path}/archive", f"file://{tmp_path}/tables"
    some_events(spark, range(0, 700_000, 777)).write.parquet(source)
    batch.run_batch(spark, source, root)
    (spans,) = slices_read
    assert len(spans) == len(Params().ranges) and all(0 < b - a <= 3_600_000_000 for a, b in spans)


def test_index_spans_files(spark, tmp_path):
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    try:
        some_events(spark, [100, 200]).coalesce(1).write.parquet(f"file://{tmp_path}/micros")
    finally:
        spark.conf.unset("spark.sql.parquet.outputTimestampType")
    some_events(spark, [300, 400]).coalesce(1).write.parquet(f"file://{tmp_path}/ts")
    some_events(spark, [500]).withColumn("ts", F.lit(None).cast("double")).coalesce(1).write.parquet(f"file://{tmp_path}/dated/event_date=1970-01-01")
    some_events(spark, [600]).withColumn("ts", F.lit(None).cast("double")).coalesce(1).write.parquet(f"file://{tmp_path}/none")
    found = {n: archive.file_index(spark, f"file://{tmp_path}/{n}").first() for n in ("micros", "ts", "dated", "none")}
    for n, a, b in (("micros", 100, 200), ("ts", 300, 400)):
        assert abs(found[n].first_us - a * 1_000_000) <= 2 and abs(found[n].last_us - b * 1_000_000) <= 2
    assert found["dated"].first_us < 0 < found["dated"].last_us < 3 * DAY_S * 1_000_000 and found["none"].first_us is None
    index = archive.file_index(spark, f"file://{tmp_path}/ts")
    assert archive.overlapping(index, [(0, 300_000_000 - 5)]).count() == 0 and archive.read_spans(spark, index, [(0, 350_000_000)]).count() == 1


def test_two_publishers(spark, tmp_path):
    """Of one table the second is told; of two tables both are seen; a run overtaken by another is made again."""
    root, source = f"file://{tmp_path}/t", f"file://{tmp_path}/archive"
    rows = spark.createDataFrame([("u", "1970-01-01", True, 0.5)], archive.TABLES["liveness"])
    mine = archive.write_version(rows, root, "liveness")
    assert archive.publish(spark, root, {"liveness": mine}, 0) == 1
    with pytest.raises(archive.Stale):
        archive.publish(spark, root, {"liveness": archive.write_version(rows, root, "liveness")}, 0)
    assert archive.publish(spark, root, {"sessions": "v-x"}, 0) == 2 and archive.current(spark, root) == (2, {"liveness": mine, "sessions": "v-x"})
    some_events(spark, range(0, 1000, 50)).write.parquet(source)
    real, raced = batch.publish, []

    def overtaken(spark, root, versions, base=None):
        if not raced:
            nothing = spark.createDataFrame([], archive.TABLES["sessions"])
            raced.append(real(spark, root, {"sessions": archive.write_version(nothing, root, "sessions")}))
        return real(spark, root, versions, base)

    batch.publish = overtaken
    try:
        batch.run_batch(spark, source, f"file://{tmp_path}/raced")
    finally:
        batch.publish = real
    assert archive.current(spark, f"file://{tmp_path}/raced")[0] == 2 and archive.read_table(spark, f"file://{tmp_path}/raced", "sessions").count() == 1


def test_vacuum_keeps_what_newer_runs_name(spark, tmp_path):
    source, root = f"file://{tmp_path}/archive", f"file://{tmp_path}/tables"
    for day in range(4):
        some_events(spark, range(day * DAY_S + 3600, day * DAY_S + 4100, 50)).write.mode("append").parquet(source)
        batch.run_batch(spark, source, root, incremental=True)
    before = results(spark, root)
    assert archive.vacuum(spark, root, keep=1) > 0 and archive.numbered_files(spark, f"{root}/_runs") == [4]
    assert results(spark, root) == before and len(list((tmp_path / "tables" / "sessions").iterdir())) == 1
    assert len(list((tmp_path / "tables" / "rollups").iterdir())) == 4  # a version for each day, all still named
    batch.run_batch(spark, source, root, incremental=True)
    assert results(spark, root) == before


def test_liveness_job(spark, tmp_path):
    """Enough people's windows give flags, a report and a model; too few give none, and the calendar reads the flags."""
    source, root, few = (f"file://{tmp_path}/{x}" for x in ("archive", "tables", "few"))
    ts = [m * 60 + s + (s * s * 7 % 5) for m in range(60) for s in (0, 3, 11, 19, 40, 52)]
    kinds = ["move", "click", "key_down", "move", "key_down", "click"]
    lines = [(line(t, kinds[(i * i) % 6]),) for i, t in enumerate(ts)]
    good(decode(spark.createDataFrame(lines, "value string"))).write.parquet(source)
    assert batch.run_liveness(spark, source, few, trees=3, depth=3, sessions_per_kind=0).count() == 0
    assert archive.read_table(spark, few, "model_report").count() == 0 and reads.model(few) is None
    batch.run_liveness(spark, source, root, trees=5, depth=4, sessions_per_kind=1)
    flags = reads.liveness(spark, root).collect()
    assert [(r.user, r.day) for r in flags] == [("u", "1970-01-01")] and 0 <= flags[0].score <= 1
    report = reads.ml_metrics(spark, root).first()
    assert report.available and report.n_human == 60 and report.n_automation > 30 and report.accuracy > 0.8
    assert reads.model(root) is not None
    again = batch.run_liveness(spark, source, root, retrain=False)
    assert [tuple(r) for r in again.collect()] == [tuple(r) for r in flags]


def test_equal_events_at_two_offsets_stay_two(spark, tmp_path):
    lines = spark.createDataFrame([(line(1), 0, 5), (line(1), 0, 6), (line(1), 0, 6), (line(2), 1, 5)], "value string, partition int, offset long")
    e = good(decode(lines))
    assert archive.deduplicated(e, columns=["type", "ts"]).columns == ["type", "ts"] and archive.deduplicated(e).count() == 3
    assert archive.deduplicated(e.withColumn("source_offset", F.lit(None).cast("long"))).count() == 2  # by content
    e.write.parquet(f"file://{tmp_path}/a")
    events, _ = batch.archived_events(spark, f"file://{tmp_path}/a")
    assert events.count() == 3 and "ts" not in events.columns


def test_compaction(spark, tmp_path):
    e = good(decode(spark.createDataFrame([(line(t),) for t in range(40)], "value string"))).repartition(8)
    e.write.parquet(f"file://{tmp_path}/many")
    archive.compact(spark, f"file://{tmp_path}/many", f"file://{tmp_path}/few")
    files = list((tmp_path / "few").rglob("*.parquet"))
    assert len(files) == 1 and archive.read_archive(spark, f"file://{tmp_path}/few")[0].count() == 40


def test_automation_is_repeatable(spark):
    a = automation_events(spark, 1, 5)
    assert sorted(map(str, a.collect())) == sorted(map(str, automation_events(spark, 1, 5).collect()))
    by = {r.kind: r["count"] for r in a.groupBy("kind").count().collect()}
    assert set(by) == set(CADENCE) and by["typer"] > by["clicker"] > by["keep_awake"]
    assert a.filter("type = 'key_down' AND key IS NULL").count() == 0
    assert a.agg(F.max("ts") - F.min("ts")).first()[0] < 4 * 14_400


def test_automation_shares_and_patterns(spark):
    rows = automation_events(spark, 8, 60).orderBy("session", "ts").collect()
    off = sum(r.kind != r.acted for r in rows) / len(rows)
    assert 0.075 < off < 0.085 and {(r.kind, r.acted) for r in rows} == {(a, b) for a in CADENCE for b in CADENCE}
    assert all(r.pressed is True and r.button == "Button.left" for r in rows if r.type == "click")
    assert {r.key for r in rows if r.acted == "typer"} == set(TYPER_KEYS)
    seen = set()
    for s in {r.session for r in rows}:
        at, walked, keys = ANCHOR, [], set()
        for r in (r for r in rows if r.session == s):
            if r.acted == "jiggler":
                walked.append((r.x - at[0], r.y - at[1]))
                at = (r.x, r.y)
            elif r.acted == "clicker":
                assert (r.x, r.y) == at
            elif r.acted == "keep_awake":
                keys.add(r.key)
        assert len(keys) <= 1 and keys <= set(AWAKE_KEYS)
        fits = [(n, d) for n, p in PATTERNS.items() for d in DISTANCES if walked and walked == [(x * d, y * d) for x, y in (p * len(walked))[: len(walked)]]]
        assert fits or not walked
        seen |= {n for n, _ in fits}
    assert seen == set(PATTERNS)


def test_growing_archive_reads_the_events_twice(spark, monkeypatch):
    """Events are read for their span and to be written, not again for each round that arrives; a run sees the rounds up to its own."""
    rows = [(i, "u", dt.datetime(2024, 1, 1 + i // 10, 1, i % 10)) for i in range(60)]
    events = spark.createDataFrame(rows, "event_id long, user string, event_time timestamp").coalesce(1)
    seen, found = spark.sparkContext.accumulator(0), []

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    monkeypatch.setattr(arrivals, "run_batch", lambda spark, path, *_, **__: found.append({r.source_offset for r in archive.read_archive(spark, path)[0].collect()}))
    arrivals.grown(spark, events.mapInArrow(counted, events.schema), Params(), F.lit(None))
    rounds = {r.event_id: r.round for r in arrivals.in_rounds(events).collect()}
    assert found == [{i for i, k in rounds.items() if k <= last} for last in range(arrivals.ROUNDS)]
    assert seen.value == 2 * len(rows)
