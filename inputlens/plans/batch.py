"""The batch run: archive to roll-ups by slice to result tables, all switched to their new versions at once, and the scores of days."""

from __future__ import annotations

import dataclasses
import datetime as dt
import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inputlens.operators import features, liveness, rollup
from inputlens.schema import ROLLUPS, TABLES, Params
from inputlens.sources.archive import (
    Stale, create_once, current, deduplicated, delete, file_index, fine_files, make_folder, numbered_files, publish, read_archive, read_spans, read_table,
    subfolders, write_version,
)
from inputlens.sources.automation import automation_events

#: How the run log writes times: to the microsecond.
MOMENT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
NEEDED = ["type", "key", "x", "y", "user", "event_time"]


def archived_events(spark: SparkSession, archive: str, guard: bool = True, dedup_keys: list[str] | None = None) -> tuple[DataFrame, int]:
    """The columns in use of every event with a time, once each, and the number of skipped files."""
    events, skipped = read_archive(spark, archive, guard)
    return deduplicated(events, dedup_keys, NEEDED).filter("event_time IS NOT NULL"), skipped


def _spans(slices: list[str], window_s: int) -> list[tuple[int, int]]:
    """Times whose events lie in the slices, neighbours joined, in microseconds: an event's window starts in its slice."""
    out: list[tuple[int, int]] = []
    for s in sorted(slices):
        start = round(dt.datetime.fromisoformat(s).replace(tzinfo=dt.timezone.utc).timestamp())
        first, last = (-(-edge // window_s) * window_s for edge in (start, start + 86_400))
        joined = out and out[-1][1] == first * 1_000_000
        out[-1:] = [(out[-1][0], last * 1_000_000)] if joined else [*out[-1:], (first * 1_000_000, last * 1_000_000)]
    return out


def changed_slices(now: DataFrame, then: DataFrame, window_s: int) -> list[str] | None:
    """Slices that files hold which came, went or were written anew between two indexes; None if such a file may hold any."""
    same = ["path", "bytes", "modified", "ok"]
    moved = now.join(then, same, "left_anti").select(INDEXED).unionByName(then.join(now, same, "left_anti").select(INDEXED)).filter("ok")
    unknown, first, last = moved.agg(F.count_if(F.col("first_us").isNull()), F.min("first_us"), F.max("last_us")).first()
    if unknown:
        return None
    if first is None:
        return []
    day = lambda us: F.floor((F.col(us) - window_s * 1_000_000 * (us == "first_us")) / F.lit(86_400_000_000)).cast("int")
    days = moved.select(F.explode(F.sequence(day("first_us"), day("last_us"))).alias("d")).distinct()
    return sorted(r[0] for r in days.select(F.date_format(F.date_from_unix_date("d"), "yyyy-MM-dd")).collect())  # a row for each day


INDEXED = ["path", "bytes", "modified", "ok", "first_us", "last_us"]


class Sliced:
    """Roll-ups by slice: of each slice the version that the newest run has of it."""

    def __init__(self, spark: SparkSession, root: str, versions: dict[str, str]):
        self.spark, self.root, self.versions = spark, root, versions

    def read(self, kind: str) -> DataFrame:
        """All rows of one kind of roll-up; folders of versions that a newer one has replaced are not looked into."""
        schema = ROLLUPS[kind]
        paths = [f"{self.root}/rollups/version={v}/kind={kind}/slice={s}" for s, v in sorted(self.versions.items())]
        if not paths:
            return self.spark.createDataFrame([], schema)
        folders = T.StructType([*schema.fields, T.StructField("version", T.StringType()), T.StructField("kind", T.StringType())])
        return self.spark.read.schema(folders).option("basePath", f"{self.root}/rollups").parquet(*paths).select(schema.names)


def write_rollups(events: DataFrame, root: str, version: str, params: Params) -> dict[str, str]:
    """Roll-ups of the events, in a version of their own; the slices that it has."""
    spark, at = events.sparkSession, f"{root}/rollups/version={version}"
    both = rollup.rolled_up(rollup.sliced(events, params.window_s), params.tz, params.window_s, params.cell, params.gap_s)
    both.hint("rebalance", "kind", "slice").write.partitionBy("kind", "slice").parquet(at)
    slices = subfolders(spark, f"{at}/kind=minutes", "slice")
    for s in slices:  # a day without moves and clicks has no cells
        make_folder(spark, f"{at}/kind=cells/slice={s}")
    held = Sliced(spark, root, dict.fromkeys(slices, version))
    for kind, make in (("windows", lambda: rollup.windows_of(held.read("minutes"), params.gap_s, params.window_s)), ("pieces", lambda: rollup.pieces_of(held.read("windows")))):
        if slices:
            make().hint("rebalance", "slice").write.partitionBy("slice").parquet(f"{at}/kind={kind}")
    return held.versions


def tables(held: Sliced, edge_events: DataFrame, params: Params, newest_us: int, computed_at: Column) -> dict[str, tuple[DataFrame, str | None]]:
    """Result tables of a run, with the column that partitions each. Events are needed only for the hours that ranges begin in."""
    pieces = rollup.stitched(held.read("pieces"), params.gap_s)
    cells = held.read("cells")
    return {
        "per_window": (rollup.numbered(held.read("windows"), pieces).drop("first_us"), None),
        "sessions": (rollup.sessions_of(pieces), None),
        "baseline": (rollup.merged_baseline(held.read("pieces"), computed_at), None),
        "day_minute_metrics": (rollup.day_minutes(held.read("minutes"), params.window_s), "day"),
        "heatmap_by_day": (rollup.day_cells(cells), "day"),
        "heatmaps": (rollup.range_cells(cells, edge_events, newest_us, params.ranges, params.cell), "range"),
    }


def run_batch(
    spark: SparkSession, archive: str, root: str, params: Params | None = None, guard: bool = True, dedup_keys: list[str] | None = None,
    as_of: Column | None = None, incremental: bool = False, unique: bool = False,
) -> DataFrame:
    """Bring all result tables up to the archive; returns the run's log row, which is also appended.

    Events are told apart (unless they are ``unique``, as the once-only ingest leaves them) and reduced to roll-ups by slice in one pass;
    all tables come from those, and are written at the same time. They are then published by one file: a run that fails at any
    table leaves all as they were, and logs its error; one that another run overtook is made again. ``as_of`` is the time that the run
    is logged under (that of the newest event, if none is given).

    With ``incremental`` the index of files (kept with each run) says which files came, went or changed since the newest run, and
    only slices that those may hold are read again; slices without events any more are dropped. Sessions are stitched over the
    seams. Other parameters than the newest run's, a run without index or a changed file whose times are unknown make it a whole run."""
    params = params or Params()
    run_id, status, error, skipped = uuid.uuid4().hex, "ok", None, 0
    try:
        while True:
            try:
                at, skipped = _run(spark, archive, root, params, guard, dedup_keys, as_of, incremental, unique)
                break
            except Stale:
                continue
    except Exception as e:
        status, error, at = "failed", str(e)[:2000], F.lit(None).cast("timestamp") if as_of is None else as_of
        raise
    finally:
        log = _logged(spark, root, run_id, at, status, error, skipped)
    return log


def _run(spark, archive, root, params, guard, dedup_keys, as_of, incremental, unique) -> tuple[Column, int]:
    base, before = current(spark, root)
    settings = json.dumps([dataclasses.asdict(params), dedup_keys, unique, archive], sort_keys=True)
    written: dict[str, str] = {}
    rolled: dict[str, str] = {}
    version = f"v-{uuid.uuid4().hex}"
    skipped, slices, kept, index = 0, None, {}, None
    sound = lambda df: df if unique else deduplicated(df, dedup_keys, NEEDED)
    try:
        if guard:
            known = read_table(spark, root, "files") if "files" in before else None
            written["files"] = write_version(file_index(spark, archive, known), root, "files")
            index = spark.read.schema(TABLES["files"]).parquet(f"{root}/files/{written['files']}")
            timed = not dedup_keys or bool({"event_time", "ts"} & set(dedup_keys))  # repeats lie in one slice
            if incremental and timed and known is not None and before.get("params") == settings:
                slices = changed_slices(index, known, params.window_s)
        if slices is None:
            events, skipped = fine_files(spark, index) if guard else read_archive(spark, archive)
        else:
            kept = {r.slice: r.version for r in read_table(spark, root, "slices").collect() if r.slice not in set(slices)}  # a row for each day
            events, skipped = read_spans(spark, index, _spans(slices, params.window_s)), index.filter("NOT ok").count()
        if slices is None or slices:
            rolled = write_rollups(sound(events).select(*NEEDED).filter("event_time IS NOT NULL"), root, version, params)
        held = Sliced(spark, root, kept | rolled)
        newest = rollup.newest_of(held.read("pieces"))
        at = rollup.at_us(newest) if as_of is None else as_of
        edges = rollup.range_edges(newest or 0, params.ranges).values()
        spans = [(start, first) for start, first in edges if start < first]
        edge = read_spans(spark, index, spans) if guard else read_archive(spark, archive)[0]
        made = tables(held, sound(edge).select(*NEEDED), params, newest or 0, at)
        made["slices"] = (spark.createDataFrame(sorted((kept | rolled).items()), TABLES["slices"]).coalesce(1), None)
        with ThreadPoolExecutor(len(made)) as pool:
            jobs = {name: pool.submit(write_version, df, root, name, partition) for name, (df, partition) in made.items()}
        written |= {name: job.result() for name, job in jobs.items() if not job.exception()}
        for job in jobs.values():
            job.result()
        publish(spark, root, written | {"params": settings}, base)
        return at, skipped
    except Exception:
        delete(spark, *(f"{root}/{name}/{version}" for name, version in written.items()), f"{root}/rollups/version={version}")
        raise


def _logged(spark: SparkSession, root: str, run_id: str, at: Column, status: str, error: str | None, skipped: int) -> DataFrame:
    """Append a row to the run log; rows are numbered, so that their order needs no clock."""
    moment = spark.range(1).select(at.cast("timestamp").alias("at")).select(F.date_format(F.col("at"), MOMENT)).first()[0]
    while True:
        number = (numbered_files(spark, f"{root}/run_log") or [0])[-1] + 1
        row = {"run": number, "run_id": run_id, "as_of": moment, "status": status, "error": error, "skipped_files": skipped}
        if create_once(spark, f"{root}/run_log/{number:09d}.json", json.dumps(row)):
            return run_log(spark, root).filter(F.col("run") == number)


def run_liveness(
    spark: SparkSession, archive: str, root: str, params: Params | None = None, exclude: DataFrame | None = None, trees: int = 300, depth: int = 15,
    sessions_per_kind: int = 4, retrain: bool = True, guard: bool = True,
) -> DataFrame:
    """Score every window of the archive, flag days, and publish ``liveness`` and, if a model is fitted, ``model_report``,
    together; meant to follow each batch. Returns the flags.

    The model is fitted on people's windows (without ``exclude``) and on automated ones, and saved below ``root``; with
    ``retrain=False`` the saved one is used if there is one. With too few windows to fit on, and none saved, there are
    no flags and no report."""
    params = params or Params()
    events, _ = archived_events(spark, archive, guard)
    human = features.window_features(events, params.window_s, params.min_events).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model, versions = None if retrain else liveness.saved(f"{root}/model"), {}
        if model is None:
            automated = features.window_features(automation_events(spark, sessions_per_kind), params.window_s, params.min_events)
            labelled = liveness.labeled_dataset(human, automated, exclude, params.tz)
            try:
                report = liveness.evaluate(labelled, trees, depth)
                model = liveness.train(labelled, trees, depth)
            except liveness.TooFewRows:
                model = liveness.saved(f"{root}/model")
            else:
                liveness.save(model, f"{root}/model")
                versions["model_report"] = write_version(report, root, "model_report")
        flags = liveness.score_days(liveness.score_windows(human, model), params.tz, params.threshold, params.min_windows)
        versions["liveness"] = write_version(flags, root, "liveness")
        publish(spark, root, versions)
    finally:
        human.unpersist()
    return read_table(spark, root, "liveness")


def run_log(spark: SparkSession, root: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(TABLES["run_log"]).option("timestampFormat", MOMENT).json(f"{root}/run_log").orderBy(F.desc("run"))
    except AnalysisException:
        return spark.createDataFrame([], TABLES["run_log"])
