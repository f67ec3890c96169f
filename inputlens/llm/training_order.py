"""Training-order materialisation: a keyed Feistel permutation gives every sequence its global slot; range partitions
of the slots write shards of fixed-stride records.

Documents are tokenized once and cut into sequences, which are numbered densely: by task, and within a task in order. A
Feistel network over the smallest even number of bits that holds all numbers, walked along its cycle until it falls
inside, permutes them under a key: its output is the slot. Shard s holds slots s * records ... (s + 1) * records - 1 in
order, and a record has one size, so a slot's place is arithmetic: readers seek, and list nothing.

Shards are written in waves, a share of all slots each, so that at any time only a wave's sequences are in shuffle files.
Files are written through Arrow's file systems (local, HDFS, object stores) under a name of the attempt's own, then
renamed: a task that is run again replaces its shard.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inputlens.llm.common import discard, fast_encoding, mix, ranks, written

#: Tokens of a record, bytes of a shard at most, waves, rounds of the network, most tasks of a reader.
LENGTH, SHARD_BYTES, WAVES, ROUNDS, READERS = 512, 16 << 20, 4, 6, 100_000
#: A record: document (8 bytes, signed), piece (4; the highest bit marks a null document), tokens (4), then LENGTH ids
#: of 2 bytes, zeros beyond the tokens.
HEAD = np.dtype([("doc_id", "<i8"), ("piece", "<u4"), ("length", "<u4")])
UNNAMED = 1 << 31

RECORDS = "slot long, shard int, place long, doc_id long, piece int, length int, ids binary"


def record_bytes(length: int = LENGTH) -> int:
    return HEAD.itemsize + 2 * length


class Feistel:
    """Keyed permutation of 0..size-1."""

    def __init__(self, size: int, key: int, rounds: int = ROUNDS):
        self.size = max(1, size)
        self.half = max(1, -(-(self.size - 1).bit_length() // 2))
        self.mask = np.uint64((1 << self.half) - 1)
        rng = np.random.default_rng(key)
        self.keys = rng.integers(0, 1 << 63, rounds, dtype=np.uint64)

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in self.keys:
            left, right = right, left ^ (mix(right + k) & self.mask)
        return (left << np.uint64(self.half)) | right

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Cycle-walking: apply the network until the value is inside again."""
        x = self._once(np.asarray(x, dtype=np.uint64))
        outside = np.flatnonzero(x >= self.size)
        while len(outside):
            x[outside] = self._once(x[outside])
            outside = outside[x[outside] >= self.size]
        return x


def sequences(docs: DataFrame, ranks_path: str, length: int) -> DataFrame:
    """task, n, payload (head and ids) of every sequence of ``docs`` (doc_id, text), n counting from 0 in each task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = fast_encoding(ranks_path)
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                payloads = []
                for doc_id, text in zip(batch.column(0).slice(a, 500).to_pylist(), batch.column(1).slice(a, 500), strict=True):
                    tokens = encoding.encode_to_numpy(text.as_py() or "", disallowed_special=()).astype("<u2")
                    for k in range(max(1, -(-len(tokens) // length))):
                        part = tokens[k * length : (k + 1) * length]
                        head = np.array([(doc_id or 0, k if doc_id is not None else k | UNNAMED, len(part))], dtype=HEAD)
                        payloads.append(head.tobytes() + part.tobytes())
                m = len(payloads)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, task, np.int32)), pa.array(np.arange(n, n + m)), pa.array(payloads, pa.binary())], names=["task", "n", "payload"])
                n += m

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "task int, n long, payload binary")


def write_shards(docs: DataFrame, path: str, ranks_path: str, key: int, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> None:
    """Write the token sequences of ``docs`` (doc_id, text) below ``path``, a new folder, in training order.

    Null text is empty; a text without tokens has one sequence of length 0; null ids stay null. Every row is a document of
    its own, also rows that repeat. The same rows in the same files and splits under the same key give the same shards. An
    empty table gives no shard. A vocabulary of more than 65,536 ids is refused."""
    if max(ranks(ranks_path).values()) >= 1 << 16:
        raise ValueError("ids of more than 16 bits don't fit a record")
    made = sequences(docs, ranks_path, length)
    made = _compressed(made, "sequences")
    counts = made.groupBy("task").agg(F.count(F.lit(1)).alias("held"))  # a row for each task that tokenized
    total = counts.agg(F.sum("held")).first()[0] or 0
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(counts.select("task", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start")), "starts")
    permute, records = Feistel(total, key), max(1, shard_bytes // record_bytes(length))
    shards = -(-total // records)

    @F.arrow_udf("long")
    def slot_of(numbers: pa.Array) -> pa.Array:
        return pa.array(permute(numbers.to_numpy(zero_copy_only=False)).astype(np.int64))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        stride, shard, out, temporary, done = record_bytes(length), -1, None, "", []

        def close() -> None:
            if out is not None:
                out.close()
                store.move(temporary, f"{root}/{shard_name(shard)}")
                done.append(shard)

        for batch in batches:
            slots, payloads = batch.column(0).to_numpy(), batch.column(1)
            for slot, payload in zip(slots.tolist(), payloads, strict=True):
                if slot // records != shard:
                    close()
                    shard = slot // records
                    temporary = f"{root}/.{shard_name(shard)}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(temporary)
                out.write(payload.as_py().ljust(stride, b"\0"))
        close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], names=["shard"])

    numbered = made.join(F.broadcast(starts), "task").withColumn("slot", slot_of(F.col("start") + F.col("n")))
    for wave in range(min(WAVES, shards)):
        first, last = shards * wave // min(WAVES, shards), shards * (wave + 1) // min(WAVES, shards)
        some = numbered.filter(F.col("slot").between(first * records, last * records - 1)).select("slot", "payload")
        dealt = some.repartitionById(last - first, (F.col("slot") / records).cast("int") - first).sortWithinPartitions("slot")
        if written(dealt.mapInArrow(write, "shard long"), "shards").count() != last - first:
            raise RuntimeError("a shard was not written")
    discard(made, starts)
    spark = docs.sparkSession
    about = json.dumps({"sequences": total, "records": records, "length": length})
    spark.range(1).select(F.lit(about).alias("value")).coalesce(1).write.text(f"{path}/about")


def _compressed(df: DataFrame, name: str) -> DataFrame:
    spark, codec = df.sparkSession, "spark.sql.parquet.compression.codec"
    usual = spark.conf.get(codec)
    spark.conf.set(codec, "zstd")
    try:
        return written(df, name)
    finally:
        spark.conf.set(codec, usual)


def shard_name(shard: int) -> str:
    return f"shard-{shard:09d}.bin"


def read_shards(spark: SparkSession, path: str, first_slot: int = 0) -> DataFrame:
    """Records from ``first_slot`` on: slot, shard, place (in the shard), doc_id, piece, length, ids (packed).

    A slot's shard and place are arithmetic: shards before ``first_slot`` are not opened, and its own is entered in the
    middle. A run that stopped after slot s resumes with ``first_slot=s+1``; beyond the last slot there are no rows. A
    folder that ``write_shards`` has not finished has no description and raises."""
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    records, length, total = about["records"], about["length"], about["sequences"]
    shards, stride = -(-total // records), record_bytes(length)
    numbers = spark.range(max(0, first_slot) // records, max(shards, max(0, first_slot) // records), 1, max(1, min(READERS, shards - max(0, first_slot) // records)))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                at, end = max(first_slot, shard * records), min(total, (shard + 1) * records)
                with store.open_input_file(f"{root}/{shard_name(shard)}") as file:
                    file.seek((at - shard * records) * stride)
                    while at < end:
                        n = min(2000, end - at)
                        some = np.frombuffer(file.read(n * stride), np.uint8).reshape(n, stride)
                        head = some[:, : HEAD.itemsize].copy().view(HEAD)[:, 0]
                        held = head["length"].tolist()
                        rows = [r[HEAD.itemsize : HEAD.itemsize + 2 * m].tobytes() for r, m in zip(some, held, strict=True)]
                        slots, unnamed = np.arange(at, at + n), (head["piece"] & UNNAMED) > 0
                        columns = [
                            pa.array(slots), pa.array(np.full(n, shard, np.int32)), pa.array(slots - shard * records), pa.array(head["doc_id"], mask=unnamed),
                            pa.array((head["piece"] & (UNNAMED - 1)).astype(np.int32)), pa.array(head["length"].astype(np.int32)), pa.array(rows, pa.binary()),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in RECORDS.split(", ")])
                        at += n

    return numbers.mapInArrow(parse, RECORDS)


def with_crc(records: DataFrame) -> DataFrame:
    """Replace the ids of a record by the crc32 of their bytes."""
    return records.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def crc_of(ids: list[int]) -> int:
    """What ``with_crc`` gives for a list of ids."""
    return zlib.crc32(np.array(ids, dtype="<u2").tobytes())
