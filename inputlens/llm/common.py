"""Helpers shared by the training-data operators: tables that cut lineage, word hashing, tokenizers."""

from __future__ import annotations

import functools
import json
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that end a word: space and the controls from tab to carriage return.
SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])
#: Word pattern of the contracts, for regular-expression users.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text hashed at once (some 20 times as much memory); a longer single document is hashed alone.
CHUNK_BYTES = 1 << 19
#: Rows of an Arrow batch in place of Spark's default: texts are longer than most rows.
BATCH_ROWS = 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Unset, a session in one process gets a folder
    of its own; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def tuned(spark: SparkSession) -> SparkSession:
    """Smaller Arrow batches, unless the session has a size of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))
    return spark


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back, so lost executors lose no work.

    Nothing needs the job's shuffle files afterwards: a collection of the driver's garbage, once a second at most, lets Spark
    remove them."""
    global _collected
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inputlens-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if time.monotonic() - _collected > 1:
        spark._jvm.System.gc()
        _collected = time.monotonic()
    return spark.read.schema(df.schema).parquet(path)


_collected = 0.0


def discard(*tables: DataFrame) -> None:
    """Delete the files of written tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/inputlens-" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: A key with more than 1/HOT of all rows, and more than HOT_ROWS, is hot: fewer than HOT keys can be.
HOT, HOT_ROWS = 2000, 1000


def with_keys(rows: DataFrame, counted: DataFrame, keys: list[str], times: str) -> DataFrame:
    """The ``rows`` whose keys ``counted`` has (a left semi join, keys not null). ``counted`` holds in ``times`` how many
    rows a key has; hot keys, of which there are fewer than HOT, are broadcast, so that no task gets all rows of one."""
    total = rows.count()
    hot = (F.col(times) * HOT > total) & (F.col(times) > HOT_ROWS)
    few = F.broadcast(counted.filter(hot).select(keys))
    rest = rows.join(few, keys, "left_anti").join(counted.filter(~hot).select(keys), keys, "left_semi")
    return rows.join(few, keys, "left_semi").unionByName(rest)


def hot_keys(rows: DataFrame, keys: list[str], most: int | None = None) -> list:
    """Keys (not null) that hold more than 1/``most`` (HOT) of ``rows``, and more than HOT_ROWS: fewer than ``most``."""
    most = most or HOT
    counted = rows.groupBy(keys).count().filter(F.col("count") > HOT_ROWS).filter(F.col("count") * most > rows.agg(F.count(F.lit(1))).scalar())
    return counted.select(keys).collect()


def matched(rows: DataFrame, values: DataFrame, keys: list[str], how: str = "inner", most: int | None = None, hot: list | None = None) -> DataFrame:
    """``rows`` joined with ``values`` (inner, left or left_semi; keys not null, of one name). Hot keys of ``rows`` (found
    here, or given) meet their values in a broadcast of just those, so that no task gets all rows of one. ``rows`` is read
    several times: pass a written table."""
    hot = hot_keys(rows, keys, most) if hot is None else hot
    if not hot:
        return rows.join(values, keys, how)
    few = F.broadcast(rows.sparkSession.createDataFrame(hot, rows.select(keys).schema))
    rest = rows.join(few, keys, "left_anti").join(values, keys, how)
    return rows.join(few, keys, "left_semi").join(F.broadcast(values.join(few, keys, "left_semi")), keys, how).unionByName(rest)


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids fall in no bucket (null)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def row_key(text: str = "text", doc_id: str = "doc_id") -> Column:
    """Key of a row: its id and a hash of id and text. Rows that repeat share it, and all that follows from it."""
    return F.struct(F.coalesce(F.col(doc_id).cast("long"), F.lit(-1)).alias("id"), F.xxhash64(F.col(doc_id).isNull(), doc_id, text).alias("hash"))


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, label (0, 1) and text of every labelled document, by the rules of ``labelled_sample``. Texts meet their labels before those
    of one id meet: where Spark broadcasts the labels, only labelled texts are shuffled, and else all are, once."""
    labels = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    texts = docs.select("doc_id", "text").join(labels, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return texts.select(F.col("doc_id").cast("long"), "label", "text")


def labelled_sample(docs: DataFrame, labels: DataFrame, of_each: int) -> tuple[DataFrame, dict[int, int]]:
    """A bounded sample for fitting: of each label (0, 1) about ``of_each`` documents, those whose hashed id falls
    under a share; rows (doc_id, place, label, text), and the number of labelled documents by label.

    ``labels`` has doc_id and label; only ids that ``docs`` has count, an id with several labels counts with the highest,
    null labels don't count; of several texts of an id the first by order is taken. The chosen ids, at most some
    2 * of_each, are broadcast; texts are whole."""
    labels = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    labels = labels.join(docs.select("doc_id"), "doc_id", "left_semi")
    sizes = {r[0]: r[1] for r in labels.groupBy("label").count().collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("label") == 1, of_each / max(1, sizes.get(1, 0))).otherwise(of_each / max(1, sizes.get(0, 0)))
    chosen = labels.withColumn("place", place).filter(F.col("place") < share)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "place", "label").agg(F.min("text").alias("text"))
    return rows.select(F.col("doc_id").cast("long"), "place", "label", "text"), sizes


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (three xor-shift-multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _byte_table(seed: int, lower: bool) -> np.ndarray:
    table = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if lower:
        table[65:91] = table[97:123]
    return table


@functools.cache
def _is_separator() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(SEPARATORS)] = True
    return table


class _Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            grow = max(n, CHUNK_BYTES + 1)
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(grow, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_POWERS = {seed: _Powers(0x9E3779B97F4A7C15 + 2 * seed * 0x632BE59BD9B4E019 & ((1 << 64) - 1) | 1) for seed in (1, 2)}


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int, lower: bool) -> np.ndarray:
    """A 64-bit hash of each byte span, equal for equal bytes wherever they stand; ``lower`` folds A-Z."""
    up, down = _POWERS[seed](len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_byte_table(seed, lower)[data] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """Words of several documents: ``bounds[i]:bounds[i+1]`` are document i's words, with byte spans and hashes."""

    __slots__ = ("bounds", "ends", "hashes", "starts", "text")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, seeds: tuple[int, ...], lower: bool):
        gap = _is_separator()[data]
        inside = np.empty(len(data) + 1, dtype=bool)
        inside[:-1], inside[-1] = ~gap, False
        edge = offsets[1:-1]
        first = np.empty(len(data) + 1, dtype=bool)
        first[0], first[1:] = inside[0], inside[1:] & ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cut = edge[(edge > 0) & (edge < len(data))]  # a document's end is a word's end
        first[cut] |= inside[cut]
        last[cut - 1] |= inside[cut - 1]
        self.text = data
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.hashes = [span_hashes(data, self.starts, self.ends, seed, lower) for seed in seeds]


def hashed_words(column, seeds: tuple[int, ...] = (1,), lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """Cut an Arrow string column in runs of whole rows of about CHUNK_BYTES and hash the words of each run.

    Yields (first row, one past the last row, words). Null counts as empty.
    """
    import pyarrow as pa

    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1)
        yield at, to, Words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], seeds, lower)
        at = to


_SPANS = _Powers(0xD6E8FEB86659FD93)


def joined_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run ``starts[i]:ends[i]`` of ``hashes``, equal for equal runs wherever they stand."""
    up, down = _SPANS(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every ``k`` consecutive values; entry i covers i..i+k-1 (length n-k+1)."""
    starts = np.arange(max(0, len(hashes) - k + 1))
    return joined_hashes(hashes, starts, starts + k)


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a ``.tiktoken`` file."""
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def fast_encoding(path: str):
    """The vocabulary of a ``.tiktoken`` file as a tiktoken encoding without special tokens."""
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@functools.cache
def json_encoding(path: str):
    """The byte-level BPE of a ``tokenizers`` JSON file as a tiktoken encoding, several times faster.

    Added tokens keep their meaning: where a text holds one, it is that id, and the text on either side is encoded by
    itself. ``encode_to_numpy(text, allowed_special="all")`` gives the ids of ``Tokenizer.encode`` without special tokens
    added. A file with other features than these is refused."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    model, added = made["model"], made["added_tokens"]
    plain = made["normalizer"] is None and made["pre_tokenizer"]["type"] == "ByteLevel" and not made["pre_tokenizer"]["add_prefix_space"]
    if model["type"] != "BPE" or not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError(f"{path} is no plain byte-level BPE")
    # the byte-level alphabet: printable characters stand for their bytes, others follow from 256 on
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"]: t["id"] for t in added}
    vocabulary = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
    order = [model["vocab"][m] for m in merges]
    if order != sorted(order):
        raise ValueError(f"{path} merges in another order than its ids")
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary, special_tokens=special)
