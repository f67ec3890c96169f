"""A partitioned log in segment files, as a source and a sink: what the live path needs of a broker, where there is none.

A partition is a folder, a segment a file of lines named by its first offset and the number of its lines; offsets of a partition follow
one another. Readers list names and open only segments that hold offsets they want. Retention may delete old segments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "value string, partition int, offset long"
#: Lines of a segment that is written, and of a batch that is read.
SEGMENT_LINES, BATCH_LINES = 100_000, 10_000


def _name(root: str, partition: int, first: int, n: int) -> str:
    return f"{root}/partition={partition}/{first:020d}-{n}.lines"


def segments(root: str) -> dict[int, list[tuple[int, int, str]]]:
    """First offset, offset after the last, and path of every segment, by partition and in order."""
    store, at = fs.FileSystem.from_uri(root)
    found: dict[int, list[tuple[int, int, str]]] = {}
    for info in store.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True)):
        m = re.search(r"partition=(\d+)/(\d{20})-(\d+)\.lines$", info.path)
        if m:
            p, first, n = map(int, m.groups())
            found.setdefault(p, []).append((first, first + n, _name(root, p, first, n)))
    return {p: sorted(s) for p, s in found.items()}


class LostOffsets(RuntimeError):
    """Offsets that a stream has yet to read are gone."""


@dataclass
class Piece(InputPartition):
    path: str
    partition: int
    first: int
    start: int
    end: int


class SegmentStream(DataSourceStreamReader):
    """Options: ``path``; ``startingOffsets`` earliest or latest (a checkpoint goes before it); ``failOnDataLoss`` true or false, whether
    offsets that retention has taken stop the stream or are passed over."""

    def __init__(self, options):  # keys in any case
        self.root = options["path"].rstrip("/")
        self.start = options.get("startingOffsets", "latest")
        self.strict = options.get("failOnDataLoss", "true").lower() != "false"
        if self.start not in ("earliest", "latest"):
            raise ValueError("startingOffsets is earliest or latest")

    def initialOffset(self) -> dict:
        return {str(p): s[0][0] if self.start == "earliest" else s[-1][1] for p, s in segments(self.root).items()}

    def latestOffset(self) -> dict:
        return {str(p): s[-1][1] for p, s in segments(self.root).items()}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out, held = [], segments(self.root)
        for p, to in sorted((int(p), to) for p, to in end.items()):
            at = start.get(str(p), 0)  # a partition that is new since
            for first, last, path in held.get(p, []):
                if last <= at or first >= to:
                    continue
                if first > at and self.strict and str(p) in start:
                    raise LostOffsets(f"partition {p} begins at {first}, {at} was to be read")
                out.append(Piece(path, p, first, max(at, first), min(last, to)))
                at = min(last, to)
            if at < to and self.strict and str(p) in start:
                raise LostOffsets(f"partition {p} ends at {at}, {to} was announced")
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(partition.path)
        lines: list[str] = []
        done = partition.start

        def batch() -> pa.RecordBatch:
            n = len(lines)
            return pa.record_batch([pa.array(lines, pa.string()), pa.array([partition.partition] * n, pa.int32()), pa.array(range(done, done + n), pa.int64())], names=["value", "partition", "offset"])

        with store.open_input_stream(at) as file:
            for offset, line in enumerate(_lines(file), partition.first):
                if offset >= partition.end:
                    break
                if offset >= partition.start:
                    lines.append(line)
                if len(lines) >= BATCH_LINES:
                    yield batch()
                    done, lines = done + len(lines), []
        if lines:
            yield batch()


def _lines(file) -> Iterator[str]:
    rest = b""
    while chunk := file.read(1 << 20):
        *whole, rest = (rest + chunk).split(b"\n")
        yield from (line.decode() for line in whole)
    if rest:
        yield rest.decode()


class SegmentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "segments"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> SegmentStream:
        return SegmentStream(self.options)


def log_stream(spark: SparkSession, path: str, starting: str = "latest", fail_on_loss: bool = False) -> DataFrame:
    """value, partition and offset of a log's lines, from now on unless told otherwise; ``decode`` takes it as it is."""
    spark.dataSource.register(SegmentSource)
    return spark.readStream.format("segments").options(path=path, startingOffsets=starting, failOnDataLoss=str(fail_on_loss).lower()).load()


def append(lines: DataFrame, root: str, partition: Column, order: list[Column]) -> int:
    """Add ``value`` of every row to the log, in ``order`` within its partition (a whole number from 0); returns the number of lines.

    A partition has one writer at a time, a task of this job. A task that runs again writes the same names with the same lines, if
    ``order`` leaves no ties; lines must not hold line breaks. The log's ends are read once, a number for each partition."""
    ends = {p: s[-1][1] for p, s in segments(root).items()}
    dealt = lines.select("value", partition.cast("int").alias("partition"), *[c.alias(f"__o{i}") for i, c in enumerate(order)])
    dealt = dealt.repartition("partition").sortWithinPartitions("partition", *[f"__o{i}" for i in range(len(order))]).select("value", "partition")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[str]] = {}
        at = dict(ends)

        def flush(p: int) -> pd.DataFrame:
            text = held.pop(p)
            first = at.get(p, 0)
            path = _name(root, p, first, len(text))
            store, place = fs.FileSystem.from_uri(path)
            store.create_dir(place.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(place) as out:
                out.write("".join(f"{t}\n" for t in text).encode())
            at[p] = first + len(text)
            return pd.DataFrame({"n": [len(text)]})

        for pdf in batches:
            for p, rows in pdf.groupby("partition", sort=False):
                held.setdefault(int(p), []).extend(rows["value"])
                if len(held[int(p)]) >= SEGMENT_LINES:
                    yield flush(int(p))
        for p in list(held):
            yield flush(p)

    return dealt.mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
