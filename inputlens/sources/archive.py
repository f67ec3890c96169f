"""The event archive and result tables on disk.

Result tables are versions in folders of their own, and a file of ``_runs`` names the version of every table: a run
writes all its versions first and then that one file, so that readers see all its tables or none. Files are numbered, and created
once; no clock takes part.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inputlens.schema import ARCHIVED, SOURCE, TABLES

POSITIONS = ("x", "y", "dx", "dy")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the one that driver and executors share. Unset, a session in one process gets a folder of
    its own; a cluster must name one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/inputlens-{name}-{uuid.uuid4().hex}"


_ONE = threading.Lock()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file if there is none of that name, and say whether it was written. It becomes visible whole, by a rename.

    Of several writers of one driver exactly one succeeds; of several drivers too where the store's rename replaces nothing (HDFS). On
    a local disk two drivers in the same instant could both."""
    target, store = _folder(spark, path)
    with _ONE:
        if store.exists(target):
            return False
        draft = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{uuid.uuid4().hex}")  # readers pass over such names
        out = store.create(draft, False)
        out.write(bytearray(text, "utf-8"))
        out.close()
        done = store.rename(draft, target)
    if not done:
        store.delete(draft, False)
    return done


INDEX = "path string, bytes long, modified timestamp, ok boolean, first_us long, last_us long"


def file_index(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """A row for each part file below ``path``: ok if it can be read and its positions are integers, and the span of its event times.

    Tasks read the footers, and only them, through Arrow's file systems; the contents stay where they are. Footers of files that
    ``known`` has with the same size and time are not read again. Spans come from the footer's statistics of event_time, of ts, or
    from a day's folder (a day to either side, as its zone is not known); they are null, and may be anywhere, without any of them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    files = files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    same = ["path", "bytes", "modified"]

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        for pdf in batches:
            rows = []
            for name in pdf["path"]:
                store, at = fs.FileSystem.from_uri(name)
                span = (None, None)
                try:
                    with store.open_input_file(at) as file:
                        footer = pq.read_metadata(file)
                    schema = footer.schema.to_arrow_schema()
                    ok = all(c in schema.names and pa.types.is_integer(schema.field(c).type) for c in POSITIONS)
                    span = _span(footer, name)
                except (pa.ArrowInvalid, OSError):
                    ok = False
                rows.append((ok, *span))
            yield pdf.assign(**{c: pd.Series([r[i] for r in rows], dtype=t) for i, (c, t) in enumerate((("ok", bool), ("first_us", "Int64"), ("last_us", "Int64")))})

    if known is None:
        return files.mapInPandas(judge, INDEX)
    read = files.join(known.select(same), same, "left_anti").mapInPandas(judge, INDEX)
    return known.join(files, same, "left_semi").select(read.columns).unionByName(read)


def _span(footer, name: str) -> tuple[int | None, int | None]:
    """First and last event time of a file in microseconds, from its footer or its folder."""
    if not footer.num_rows:
        return 0, 0
    # times of 96 bits, Spark's own way of writing them unless told otherwise, come without statistics
    names = [footer.schema.column(i).path if footer.schema.column(i).physical_type != "INT96" else None for i in range(footer.num_columns)]
    for column, us in (("event_time", lambda v: round(v.timestamp() * 1e6)), ("ts", lambda v: round(v * 1e6))):
        if column in names:
            found = [footer.row_group(g).column(names.index(column)).statistics for g in range(footer.num_row_groups)]
            # rows without ts may still have a time
            if found and all(s is not None and s.has_min_max and (column == "event_time" or s.null_count == 0) for s in found):
                try:
                    return min(us(_zoned(s.min)) for s in found) - 1, max(us(_zoned(s.max)) for s in found) + 1
                except (OverflowError, ValueError):
                    break
    day = re.search(r"/event_date=(\d{4}-\d{2}-\d{2})/", name)
    if not day:
        return None, None
    start = dt.datetime.fromisoformat(day[1]).replace(tzinfo=dt.timezone.utc).timestamp()
    return round((start - 86_400) * 1e6), round((start + 2 * 86_400) * 1e6)


def _zoned(value):
    return value.replace(tzinfo=dt.timezone.utc) if isinstance(value, dt.datetime) and value.tzinfo is None else value


def _parts(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema(ARCHIVED).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(*paths)


def fine_files(spark: SparkSession, index: DataFrame) -> tuple[DataFrame, int]:
    """Events of all files that are ok, and the number of others. The driver gets a row for each folder of sound files, and the names of
    sound files only in folders that hold others."""
    foldered = index.withColumn("folder", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    folders = foldered.groupBy("folder").agg(F.count_if(~F.col("ok")).alias("bad")).collect()
    skipped = sum(r.bad for r in folders)
    paths = [f"{r.folder}/*.parquet" for r in folders if not r.bad]
    mixed = [r.folder for r in folders if r.bad]
    if mixed:
        paths += [r.path for r in foldered.filter(F.col("ok") & F.col("folder").isin(mixed)).select("path").collect()]
    return (_parts(spark, *paths) if paths else spark.createDataFrame([], ARCHIVED)), skipped


def read_archive(spark: SparkSession, path: str, guard: bool = False) -> tuple[DataFrame, int]:
    """Archived events and the number of skipped files; with ``guard`` only conforming files are read.

    The directory is listed as plain Parquet, past any sink commit log, so that a reset checkpoint hides nothing;
    ``deduplicated`` takes care of parts that a failed batch left."""
    return fine_files(spark, file_index(spark, path)) if guard else (_parts(spark, path), 0)


def overlapping(index: DataFrame, spans: list[tuple[int, int]]) -> DataFrame:
    """Sound files that may hold events of any of the spans (half-open, in microseconds)."""
    near = F.lit(False)
    for start, end in spans:
        near = near | ((F.col("first_us") < end) & (F.col("last_us") >= start))
    return index.filter(F.col("ok") & F.coalesce(near, F.lit(True)))


def read_spans(spark: SparkSession, index: DataFrame, spans: list[tuple[int, int]]) -> DataFrame:
    """Events of the spans, from the files that may hold them: no other is opened."""
    paths = [r.path for r in overlapping(index, spans).select("path").collect()]
    events = _parts(spark, *paths) if paths else spark.createDataFrame([], ARCHIVED)
    inside = F.lit(False)
    for start, end in spans:
        at = [F.timestamp_micros(F.lit(t).cast("long")) for t in (start, end)]
        inside = inside | ((F.col("event_time") >= at[0]) & (F.col("event_time") < at[1]))
    return events.filter(inside)


def deduplicated(events: DataFrame, keys: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """One row for each event, with ``columns`` (all): by source position where a row has one, so that two equal events
    stay two, else by content; or by ``keys``. What is neither wanted nor needed to tell rows apart is not shuffled."""
    columns = columns or events.columns
    if keys:
        return events.select(*{*columns, *keys}).dropDuplicates(keys).select(columns)
    content = [c for c in ARCHIVED.names if c in events.columns and c not in SOURCE]
    if not set(SOURCE) <= set(events.columns):
        return events.dropDuplicates(content).select(columns)
    # a position's rows are one event, so all columns may be keys: no sort, as keeping a first row of texts would take
    unplaced = F.when(F.col(SOURCE[1]).isNull(), F.struct(content))
    return events.select(*{*columns, *SOURCE}, unplaced.alias("__content")).distinct().select(columns)


class Stale(RuntimeError):
    """What a run was made from is no longer the newest; it has to be made anew."""


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def numbered_files(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the files ``<number>.json`` of a folder, rising."""
    at, store = _folder(spark, path)
    names = [f.getPath().getName() for f in store.listStatus(at)] if store.exists(at) else []
    return sorted(int(n.removesuffix(".json")) for n in names if re.fullmatch(r"\d+\.json", n))


def _text(spark: SparkSession, path: str) -> str:
    at, store = _folder(spark, path)
    file = store.open(at)
    try:
        return bytes(file.readAllBytes()).decode()
    finally:
        file.close()


def versions_of(spark: SparkSession, root: str, run: int) -> dict[str, str]:
    return json.loads(_text(spark, f"{root}/_runs/{run:09d}.json")) if run else {}


def current(spark: SparkSession, root: str) -> tuple[int, dict[str, str]]:
    """Number of the newest published run and the version of every table; (0, {}) before the first."""
    run = (numbered_files(spark, f"{root}/_runs") or [0])[-1]
    return run, versions_of(spark, root, run)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Published version of a result table; an empty one of the right schema before the first."""
    version = current(spark, root)[1].get(name)
    if not version:
        return spark.createDataFrame([], TABLES[name])
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}/{version}")


def write_version(df: DataFrame, root: str, name: str, partition: str | None = None) -> str:
    """Write a version of a table that nobody reads before it is published."""
    version = f"v-{uuid.uuid4().hex}"
    rows = df.select(TABLES[name].names)
    writer = rows.write.partitionBy(partition) if partition else rows.write
    writer.parquet(f"{root}/{name}/{version}")
    return version


def publish(spark: SparkSession, root: str, versions: dict[str, str], base: int | None = None) -> int:
    """Point at new versions of some tables, all at once; other tables stay as they are. Returns the run's number.

    Runs are files of consecutive numbers, and a file is created once: of two publishers one takes a number, the other adds its
    tables to what that one published. ``base`` is the run that the new versions were made from: if one of their tables has been
    published since, nothing is and ``Stale`` is raised."""
    while True:
        run, newest = current(spark, root)
        if base is not None and base != run:
            then = versions_of(spark, root, base)
            if any(newest.get(name) != then.get(name) for name in versions):
                raise Stale(f"run {run} has replaced what this one was made from, run {base}")
        if create_once(spark, f"{root}/_runs/{run + 1:09d}.json", json.dumps(newest | versions)):
            return run + 1


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        at, store = _folder(spark, path)
        store.delete(at, True)


def subfolders(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of a partition column, by the folders there are."""
    at, store = _folder(spark, path)
    names = [f.getPath().getName() for f in store.listStatus(at)] if store.exists(at) else []
    return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{column}="))


def make_folder(spark: SparkSession, path: str) -> None:
    at, store = _folder(spark, path)
    store.mkdirs(at)


def move_folder(spark: SparkSession, path: str, to: str) -> None:
    """Move a folder, if there is one."""
    at, store = _folder(spark, path)
    if store.exists(at) and not store.rename(at, spark._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"{path} could not be moved to {to}")


def vacuum(spark: SparkSession, root: str, keep: int = 3) -> int:
    """Delete the versions of tables that only runs before the newest ``keep`` name, and those runs; returns how many versions.

    What no run names, as a version that is being written, stays."""
    runs = numbered_files(spark, f"{root}/_runs")
    gone, kept = runs[:-keep] if keep > 0 else [], runs[-keep:] if keep > 0 else runs
    held = set().union(*(folders(spark, root, versions_of(spark, root, r)) for r in kept))
    old = set().union(*(folders(spark, root, versions_of(spark, root, r)) for r in gone)) - held
    delete(spark, *(f"{root}/{f}" for f in sorted(old)), *(f"{root}/_runs/{r:09d}.json" for r in gone))
    return len(old)


def folders(spark: SparkSession, root: str, versions: dict[str, str]) -> set[str]:
    """Folders below ``root`` that a run's tables lie in: its versions, and those that its slices name."""
    found = {f"{name}/{version}" for name, version in versions.items() if name in TABLES}
    if "slices" in versions:
        named = spark.read.schema(TABLES["slices"]).parquet(f"{root}/slices/{versions['slices']}").select("version").distinct()
        found |= {f"rollups/version={r.version}" for r in named.collect()}
    return found


def compact(spark: SparkSession, path: str, to: str, rows_per_file: int = 5_000_000) -> None:
    """Rewrite an archive's many small files as few larger ones, by day."""
    events, _ = read_archive(spark, path)
    dated = events.withColumn("event_date", F.to_date("event_time"))
    rebalanced = dated.hint("rebalance", "event_date")
    rebalanced.write.option("maxRecordsPerFile", rows_per_file).partitionBy("event_date").parquet(to)
