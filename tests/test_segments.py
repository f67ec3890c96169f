"""The log in segments: offsets kept, resume, new partitions, lost segments."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from inputlens.sources import segments
from inputlens.streaming import speed


def add(spark, root, values, parts=2):
    lines = spark.createDataFrame([(v,) for v in values], "value string")
    return segments.append(lines, root, F.substring("value", 2, 9).cast("int") % parts, [F.substring("value", 2, 9).cast("int")])


def read(spark, root, folder, starting="earliest", fail=True):
    speed.start_sink(segments.log_stream(spark, root, starting, fail), f"file://{folder}/out", f"file://{folder}/cp").awaitTermination()
    return sorted((r.partition, r.offset, r.value) for r in spark.read.parquet(f"file://{folder}/out").collect())


def test_offsets_and_resume(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/log"
    monkeypatch.setattr(segments, "SEGMENT_LINES", 3)
    assert add(spark, root, [f"v{i}" for i in range(10)]) == 10
    first = [(i % 2, i // 2, f"v{i}") for i in range(10)]
    assert read(spark, root, tmp_path) == sorted(first)
    assert add(spark, root, [f"v{i}" for i in range(10, 15)]) == 5 and add(spark, root, []) == 0
    more = [(i % 2, i // 2, f"v{i}") for i in range(15)]
    assert read(spark, root, tmp_path) == sorted(more)  # nothing twice
    assert add(spark, root, ["v2", "v5"], parts=3) == 2  # a partition that was not there
    assert read(spark, root, tmp_path)[-1] == (2, 1, "v5")


def test_latest_starts_at_the_end(spark, tmp_path):
    root = f"file://{tmp_path}/log"
    add(spark, root, ["v0", "v1"])
    assert read(spark, root, tmp_path, "latest") == []
    add(spark, root, ["v2"])
    assert read(spark, root, tmp_path, "latest") == [(0, 1, "v2")]


def test_lost_segments(spark, tmp_path):
    """What retention takes before it was read stops a strict stream; another goes on with what there is."""
    root = f"file://{tmp_path}/log"
    for k in range(3):
        add(spark, root, [f"v{2 * k}"], 1)
        if k == 0:
            (tmp_path / "a").mkdir()
            (tmp_path / "b").mkdir()
            assert read(spark, root, tmp_path / "a") == read(spark, root, tmp_path / "b") == [(0, 0, "v0")]
    gone = sorted((tmp_path / "log" / "partition=0").glob("*.lines"))[:2]
    for f in gone:
        f.unlink()
    with pytest.raises(StreamingQueryException, match="begins at 2, 1 was to be read"):
        read(spark, root, tmp_path / "a")
    assert read(spark, root, tmp_path / "b", fail=False) == [(0, 0, "v0"), (0, 2, "v4")]
