"""Schemas and parameters of the event model."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

#: One input action as it travels: JSON on the wire, the same columns in the archive.
EVENT = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("x", T.LongType()),
    T.StructField("y", T.LongType()),
    T.StructField("button", T.StringType()),
    T.StructField("pressed", T.BooleanType()),
    T.StructField("dx", T.LongType()),
    T.StructField("dy", T.LongType()),
    T.StructField("user", T.StringType()),
    T.StructField("ts", T.DoubleType()),
])

#: Where a row came from: partition and offset of the source.
SOURCE = ("source_partition", "source_offset")

#: The archive adds the event time and, where the source has positions, those (and, on disk, a partition column event_date).
ARCHIVED = T.StructType([
    *EVENT.fields, T.StructField("event_time", T.TimestampType()), T.StructField(SOURCE[0], T.IntegerType()), T.StructField(SOURCE[1], T.LongType()),
])

COUNTS = ("keystrokes", "words", "corrections", "clicks")


_KINDS = {"BIGINT": T.LongType(), "INT": T.IntegerType(), "STRING": T.StringType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType(), "TIMESTAMP": T.TimestampType(), "DECIMAL": T.DecimalType(38, 0)}


def _table(columns: str, *more: T.StructField) -> T.StructType:
    """Schema of "name KIND, ..."; needs no session."""
    return T.StructType([*(T.StructField(n, _KINDS[k]) for n, k in map(str.split, columns.split(", "))), *more])


_FOUR = ", ".join(f"{c} BIGINT" for c in COUNTS)
_WINDOW = "window_start TIMESTAMP, window_end TIMESTAMP, user STRING"

#: Derived tables, for readers that find none yet.
TABLES = {
    "metrics": _table(f"{_WINDOW}, {_FOUR}"),
    "per_window": _table(f"session_id BIGINT, {_WINDOW}, {_FOUR}"),
    "sessions": _table(
        "session_id BIGINT, user STRING, session_key BIGINT, session_start TIMESTAMP, session_end TIMESTAMP, window_count BIGINT, "
        + ", ".join(f"{c}_total BIGINT" for c in COUNTS)
    ),
    "baseline": _table("user STRING, " + ", ".join(f"{c}_mean DOUBLE, {c}_std DOUBLE" for c in COUNTS) + ", computed_at TIMESTAMP"),
    "day_minute_metrics": _table(f"{_WINDOW}, {_FOUR}, mouse_moves BIGINT, day STRING"),
    "heatmap_by_day": _table("cell_x INT, cell_y INT, type STRING, user STRING, count BIGINT, day STRING"),
    "heatmaps": _table("cell_x INT, cell_y INT, type STRING, user STRING, count BIGINT, range STRING"),
    "slices": _table("slice STRING, version STRING"),
    "files": _table("path STRING, bytes BIGINT, modified TIMESTAMP, ok BOOLEAN, first_us BIGINT, last_us BIGINT"),
    "liveness": _table("user STRING, day STRING, nonhuman BOOLEAN, score DOUBLE"),
    "model_report": _table(
        "accuracy DOUBLE, precision DOUBLE, recall DOUBLE, f1 DOUBLE, roc_auc DOUBLE, n_train BIGINT, n_test BIGINT, n_human BIGINT, "
        "n_automation BIGINT",
        T.StructField("importances", T.ArrayType(_table("feature STRING, importance DOUBLE"))),
    ),
    "run_log": _table("run BIGINT, run_id STRING, as_of TIMESTAMP, status STRING, error STRING, skipped_files BIGINT"),
}


#: Roll-ups that a batch run keeps by slice.
ROLLUPS = {
    "minutes": _table(f"slice STRING, day STRING, at TIMESTAMP, user STRING, piece BIGINT, {_FOUR}, mouse_moves BIGINT, first_us BIGINT, last_us BIGINT"),
    "cells": _table("slice STRING, day STRING, at TIMESTAMP, cell_x INT, cell_y INT, pointer STRING, user STRING, n BIGINT"),
    "windows": _table(f"slice STRING, user STRING, piece BIGINT, window_start TIMESTAMP, window_end TIMESTAMP, {_FOUR}, first_us BIGINT, last_us BIGINT"),
    "pieces": _table(
        "slice STRING, user STRING, piece BIGINT, first_us BIGINT, last_us BIGINT, session_start TIMESTAMP, session_end TIMESTAMP, window_count BIGINT, "
        + ", ".join([*(f"{c}_total BIGINT" for c in COUNTS), *(f"{c}_squares DECIMAL" for c in COUNTS)])
    ),
}


@dataclass(frozen=True)
class Params:
    """Parameters of a batch run; all times of day are in ``tz``."""

    gap_s: int = 300
    window_s: int = 60
    cell: int = 16
    tz: str = "UTC"
    ranges: dict[str, int] = field(default_factory=lambda: {"1h": 1, "6h": 6, "1d": 24, "3d": 72, "1w": 168})
    min_events: int = 5
    threshold: float = 0.8
    min_windows: int = 2
