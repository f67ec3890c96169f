"""Once-only ingest and the stateful stream: crashes, repeats, late rows, shuffled arrival."""

import json
import random
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from inputlens.operators import counts, sessions
from inputlens.sources import archive
from inputlens.sources.events import decode, good
from inputlens.streaming import ingest, speed

LINES = "value string, partition int, offset long"


def line(t, kind="click", user="u", x=1):
    return json.dumps({"type": kind, "user": user, "ts": t, "x": x, "y": 1})


class Source:
    """A stream that grows by batches of (line, offset)."""

    def __init__(self, spark, folder):
        self.spark, self.path = spark, f"file://{folder}/lines"
        self.sent = 0

    def add(self, lines, offsets=None):
        offsets = offsets or range(self.sent, self.sent + len(lines))
        self.sent = max(self.sent, max(offsets) + 1)
        self.spark.createDataFrame([(v, 0, o) for v, o in zip(lines, offsets, strict=True)], LINES).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(LINES).parquet(self.path)


def ingested(source, folder, sink=None, within="1 hour"):
    ingest.start_ingest(source.stream(), f"file://{folder}/root", f"file://{folder}/checkpoint", within, None, sink or ingest.Ingest(f"file://{folder}/root")).awaitTermination()


def test_one_parse_three_tables(spark, tmp_path):
    source, root = Source(spark, tmp_path), f"file://{tmp_path}/root"
    assert ingest.archived(spark, root).count() == 0 and ingest.metrics(spark, root).count() == 0 and ingest.refused(spark, root).count() == 0
    source.add([line(1), "garbage", line(70, "key_down"), '{"type":"move","ts":2}'])
    ingested(source, tmp_path)
    source.add([line(130), line(5, "key_down"), line(71), ""])
    ingested(source, tmp_path)
    events = ingest.archived(spark, root)
    assert sorted(r.ts for r in events.collect()) == [1, 5, 70, 71, 130] and events.columns == archive.ARCHIVED.names
    assert sorted((r.raw, r.source_offset) for r in ingest.refused(spark, root).collect()) == [("", 7), ("garbage", 1), ('{"type":"move","ts":2}', 3)]
    show = lambda df: sorted((r.window_start.timestamp(), r.keystrokes, r.clicks) for r in df.collect())
    # the row of second 5 came when its minute had closed
    assert show(ingest.metrics(spark, root)) == [(0, 0, 1), (60, 1, 1)]
    assert show(ingest.missed(spark, root)) == [(0, 1, 0)]
    assert show(ingest.repaired(spark, root)) == show(counts.minute_metrics(events))
    assert [(r["rows"], r.bad, r.late) for r in ingest.ledger(spark, root).orderBy("batch").collect()] == [(2, 2, 0), (3, 1, 1)]


def test_a_day_has_one_file_of_a_batch(spark, tmp_path):
    source, root = Source(spark, tmp_path), f"file://{tmp_path}/root"
    source.add([line(86_400 * (k % 3) + k + 1) for k in range(60)])
    ingested(source, tmp_path)
    files = ingest.archived(spark, root).inputFiles()
    assert ingest.archived(spark, root).count() == 60
    assert sorted(f.split("event_date=")[1][:10] for f in files) == ["1970-01-01", "1970-01-02", "1970-01-03"]


@pytest.mark.parametrize("place", ["quarantine", "minutes", "commit", "after"])
def test_a_crash_anywhere_loses_nothing_and_repeats_nothing(spark, tmp_path, place):
    source, root = Source(spark, tmp_path), f"file://{tmp_path}/root"
    source.add([line(1), "bad one"])
    ingested(source, tmp_path)
    source.add([line(61), line(62), "bad two"])

    class Crashing(ingest.Ingest):
        def write(self, name, df, batch):
            if name == place:
                raise RuntimeError("killed")
            super().write(name, df, batch)

        def commit(self, spark, batch, n):
            if place == "commit":
                raise RuntimeError("killed")
            super().commit(spark, batch, n)
            if place == "after":
                raise RuntimeError("killed")

    with pytest.raises(StreamingQueryException, match="killed"):
        ingested(source, tmp_path, Crashing(root))
    seen = (ingest.archived(spark, root).count(), ingest.refused(spark, root).count(), ingest.repaired(spark, root).agg(F.sum("clicks")).first()[0])
    assert seen == ((3, 2, 3) if place == "after" else (1, 1, 1))  # whole batches or nothing
    ingested(source, tmp_path)
    source.add([line(63)])
    ingested(source, tmp_path)
    assert sorted(r.ts for r in ingest.archived(spark, root).collect()) == [1, 61, 62, 63]
    assert ingest.refused(spark, root).count() == 2 and ingest.repaired(spark, root).agg(F.sum("clicks")).first()[0] == 4


def test_repeats_are_ingested_once_and_late_ones_counted(spark, tmp_path):
    log = speed.ProgressLog()
    spark.streams.addListener(log)
    source, root = Source(spark, tmp_path), f"file://{tmp_path}/root"
    source.add([line(1000), line(1000), line(1001)])
    ingested(source, tmp_path, within="10 minutes")
    source.add([line(1000), line(1001), line(5000), "bad", "bad"], [0, 2, 3, 4, 4])  # two again, two lines of one place
    ingested(source, tmp_path, within="10 minutes")
    source.add([line(100)], [9])  # more than ten minutes behind
    ingested(source, tmp_path, within="10 minutes")
    assert sorted(r.ts for r in ingest.archived(spark, root).collect()) == [1000, 1000, 1001, 5000]
    assert ingest.refused(spark, root).count() == 1
    for _ in range(50):
        if sum(r.dropped_late for r in log.table(spark).collect()):
            break
        time.sleep(0.1)
    assert sum(r.dropped_late for r in log.table(spark).collect()) == 1
    spark.streams.removeListener(log)


def test_lines_without_positions_repeat_by_content(spark, tmp_path):
    lines = spark.createDataFrame([(line(1),), (line(1),), (line(2),)], "value string")
    lines.write.parquet(f"file://{tmp_path}/lines")
    stream = spark.readStream.schema("value string").parquet(f"file://{tmp_path}/lines")
    ingest.start_ingest(stream, f"file://{tmp_path}/root", f"file://{tmp_path}/cp", "1 hour", None, ingest.Ingest(f"file://{tmp_path}/root")).awaitTermination()
    rows = ingest.archived(spark, f"file://{tmp_path}/root").collect()
    assert sorted(r.ts for r in rows) == [1, 2] and rows[0].source_offset is None


def test_a_new_checkpoint_is_a_new_epoch(spark, tmp_path):
    source, root = Source(spark, tmp_path), f"file://{tmp_path}/root"
    source.add([line(1)])
    ingested(source, tmp_path)
    source.add([line(2)])
    ingest.start_ingest(source.stream(), root, f"file://{tmp_path}/other", None, None, ingest.Ingest(root, "second")).awaitTermination()
    assert sorted(r.ts for r in ingest.archived(spark, root).collect()) == [1, 1, 2]  # read again from the start, as asked


def test_one_of_two_writers_creates_a_file(spark, tmp_path):
    path = f"file://{tmp_path}/ledger/1.json"
    assert archive.create_once(spark, path, "a") and not archive.create_once(spark, path, "b")
    assert (tmp_path / "ledger" / "1.json").read_text() == "a"


@pytest.mark.parametrize("gap", [0.02, 0.5, 7.0])
def test_stream_thinning_equals_batch_under_shuffled_arrival(spark, tmp_path, gap):
    rng = random.Random(1)
    times = [(round(rng.uniform(0, 60), 3), u) for u in ("a", "b") for _ in range(150)]
    times += [times[0], times[1]]  # repeated moves
    waits = sorted(((t + rng.uniform(0, 4), t, u) for t, u in times))  # up to 4 s late
    events = lambda rows: spark.createDataFrame([(line(t, "move", u),) for _, t, u in rows], "value string")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    speed.rocksdb_state(spark)
    try:
        path = f"file://{tmp_path}/lines"
        for k in range(0, len(waits), 76):
            more = waits[k : k + 76] if k + 76 < len(waits) else [*waits[k:], (0, 1000.0, "flush")]
            events(more).coalesce(1).write.mode("append").parquet(path)
            moves = speed.decoded_events(spark.readStream.schema("value string").parquet(path))
            speed.start_sink(speed.thin_moves_stream(moves, gap), f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = sorted((r.user, r.ts) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    table = good(decode(events(waits)))
    assert got == sorted((r.user, r.ts) for r in sessions.thin_moves(table, gap).collect())


def test_no_gap_keeps_all_moves(spark):
    rows = spark.createDataFrame([(line(t, "move"),) for t in (1, 1, 2)], "value string")
    assert sessions.thin_moves(good(decode(rows)), 0).count() == 3 and sessions.thin_moves(good(decode(rows)), 1e-9).count() == 3


def test_progress_outlives_the_listener(spark, tmp_path):
    source, root = Source(spark, tmp_path), f"file://{tmp_path}/root"
    assert speed.progress(spark, root).count() == 0
    for k in range(2):
        log = speed.ProgressTable(spark, root, every=1000)
        spark.streams.addListener(log)
        source.add([line(100 * k + 1), line(100 * k + 2)])
        ingested(source, tmp_path)
        for _ in range(100):
            if speed.progress(spark, root).agg(F.sum("input_rows")).first()[0] == 2 * (k + 1):
                break
            time.sleep(0.1)
        spark.streams.removeListener(log)
    rows = speed.progress(spark, root).filter("input_rows > 0").collect()
    assert sorted(r.input_rows for r in rows) == [2, 2] and {r.query for r in rows} == {"ingest"} and len({r.batch for r in rows}) == 2
    assert all(r.at.year > 2000 and r.dropped_late == 0 for r in rows)
