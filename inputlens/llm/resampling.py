"""Importance resampling toward a target text: hashed word runs, log-ratio weights, a Gumbel draw.

A feature is a run of 1 to 3 words, its bucket the CRC-32 of its bytes modulo ``BUCKETS``. CRC is linear, so the state after a run
follows from the state before its last word, that word's own state and its length: no run is ever spelled out. The vocabulary has
a head and a tail. Words and pairs that hold more than a share of all occurrences, so that there are few of them whatever the
corpus, are counted exactly and broadcast with their states; words and pairs outside the head are hashed as they come.
Both give the same states, so totals and weights are exact.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inputlens.llm.common import written

#: Buckets of features; longest run of words.
BUCKETS, RUN = 10_000, 3
#: Head: words and pairs with more than 1/HEAD of all occurrences of words, fewer than HEAD and 2 * HEAD.
HEAD = 20_000
#: Slots of the head's pairs (a power of 2); a pair that finds its slot taken by a more frequent one is hashed as it comes.
SLOTS = 1 << 18
#: Bytes of text taken at once; a longer word is taken whole.
CHUNK_BYTES = 1 << 20
#: Different words counted in a task before they go out.
COUNTED = 500_000

#: Bytes of words: digits and letters, and all of non-ASCII characters; A-Z count as a-z.
_WORD_BYTES = bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_CLEAN = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _WORD_BYTES else 0x20 for b in range(256))


@functools.cache
def _shifts(length: int) -> np.ndarray:
    """Four tables of 256: a CRC state, byte by byte, after ``length`` more zero bytes (without the final inversion)."""
    basis = [zlib.crc32(bytes(length), (1 << bit) ^ 0xFFFFFFFF) ^ zlib.crc32(bytes(length), 0xFFFFFFFF) for bit in range(32)]
    values, bits = np.arange(256, dtype=np.uint32), np.array(basis, dtype=np.uint32)
    out = np.zeros((4, 256), dtype=np.uint32)
    for k in range(4):
        for bit in range(8):
            out[k] ^= np.where(values >> np.uint32(bit) & np.uint32(1), bits[8 * k + bit], np.uint32(0))
    return out


#: Lengths whose shifts are kept as one table; longer ones are looked up one by one.
SHORT = 64


@functools.cache
def _short() -> np.ndarray:
    return np.stack([_shifts(n) for n in range(SHORT)])


def extended(state: np.ndarray, tail: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of a text followed by another, from both CRCs and the length of the other."""
    b = [state >> np.uint32(8 * k) & np.uint32(0xFF) for k in range(4)]
    near = np.minimum(length, SHORT - 1)
    table = _short()
    out = tail ^ table[near, 0, b[0]] ^ table[near, 1, b[1]] ^ table[near, 2, b[2]] ^ table[near, 3, b[3]]
    for i in np.flatnonzero(length >= SHORT):
        t = _shifts(int(length[i])) if length[i] < 4096 else _shifts.__wrapped__(int(length[i]))
        out[i] = tail[i] ^ t[0, b[0][i]] ^ t[1, b[1][i]] ^ t[2, b[2][i]] ^ t[3, b[3][i]]
    return out


class Head:
    """States of the frequent words and pairs. ``words`` are in falling order of frequency, ``pairs`` are pairs of them."""

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]]):
        self.number = {w: i for i, w in enumerate(words)}
        self.state = np.array([zlib.crc32(w) for w in words], dtype=np.uint32)
        self.spaced = np.array([zlib.crc32(b" " + w) for w in words], dtype=np.uint32)
        self.length = np.array([len(w) + 1 for w in words], dtype=np.int64)
        self.keys, self.pair = np.full(SLOTS, -1, dtype=np.int64), np.zeros(SLOTS, dtype=np.uint32)
        for a, b in reversed(pairs):  # the most frequent last
            key = np.array([self.number[a] * HEAD + self.number[b]])
            slot = _slot(key)
            self.keys[slot], self.pair[slot] = key, zlib.crc32(a + b" " + b)

    def of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number in the head (-1: none), state, state behind a space, and length with the space of each word."""
        n = len(words)
        found = np.fromiter(map(self.number.get, words, (-1 for _ in words)), np.int64, n)
        tail = np.flatnonzero(found < 0)
        at = np.maximum(found, 0)
        if len(self.state):
            state, spaced, length = self.state[at], self.spaced[at], self.length[at]
        else:
            state, spaced, length = np.zeros(n, np.uint32), np.zeros(n, np.uint32), np.zeros(n, np.int64)
        few = [words[i] for i in tail.tolist()]
        state[tail] = np.fromiter(map(zlib.crc32, few), np.uint32, len(few))
        spaced[tail] = np.fromiter((zlib.crc32(w, 0xE96CCF45) for w in few), np.uint32, len(few))  # the CRC of a space
        length[tail] = np.fromiter(map(len, few), np.int64, len(few)) + 1
        return found, state, spaced, length

    def of_pairs(self, found: np.ndarray, state: np.ndarray, spaced: np.ndarray, length: np.ndarray) -> np.ndarray:
        """State of every two words that follow one another."""
        key = np.where((found[:-1] >= 0) & (found[1:] >= 0), found[:-1] * HEAD + found[1:], -2)
        slot = _slot(key)
        out = self.pair[slot]
        rest = np.flatnonzero(self.keys[slot] != key)
        out[rest] = extended(state[rest], spaced[rest + 1], length[rest + 1])
        return out


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 18)).astype(np.int64)


def chunks(text: str | None) -> Iterator[list[bytes]]:
    """Words of a text, some at a time, lower-cased, as UTF-8."""
    raw = (text or "").encode()
    if len(raw) <= CHUNK_BYTES:
        yield raw.translate(_CLEAN).split()
        return
    at = 0
    while at < len(raw):
        piece = raw[at : at + CHUNK_BYTES].translate(_CLEAN)
        end = at + CHUNK_BYTES
        while end < len(raw) and piece.rfind(b" ", 1) < 0:  # one word so far
            piece += raw[end : end + CHUNK_BYTES].translate(_CLEAN)
            end += CHUNK_BYTES
        cut = len(piece) if end >= len(raw) else piece.rfind(b" ", 1)
        yield piece[:cut].split()
        at += cut


def buckets(text: str | None, head: Head) -> Iterator[tuple[int, np.ndarray]]:
    """Number of words, and buckets of all features that end in them, chunk by chunk; two words are carried over."""
    kept: list[bytes] = []
    for words in chunks(text):
        new = len(words)
        if not new:
            continue
        words = kept + words
        old = len(kept)
        found, state, spaced, length = head.of_words(words)
        pairs = head.of_pairs(found, state, spaced, length)
        triples = extended(pairs[:-1], spaced[2:], length[2:]) if len(words) > 2 else pairs[:0]
        # a pair ends one word after it begins, a triple two
        every = np.concatenate([state[old:], pairs[max(0, old - 1) :], triples[max(0, old - 2) :]])
        yield new, every % np.uint32(BUCKETS)
        kept = words[-(RUN - 1) :]


def _counted(texts: DataFrame, known: set[bytes] | None) -> DataFrame:
    """word and n; or, where the frequent words are ``known``, word, next and n of two of them that follow one another. Counted in
    tasks first."""
    kinds = "word binary, n long" if known is None else "word binary, next binary, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                last = None
                for words in chunks(text.as_py()):
                    if known is None:
                        held.update(words)
                    else:
                        words = words if last is None else [last, *words]
                        held.update(p for p in zip(words, words[1:]) if p[0] in known and p[1] in known)
                        last = words[-1] if words else last
                    if len(held) > COUNTED:
                        yield _batch(held, known)
                        held.clear()
        yield _batch(held, known)

    return texts.mapInArrow(count, kinds)


def _batch(held: Counter, known: set[bytes] | None) -> pa.RecordBatch:
    counts = pa.array(held.values(), pa.int64())
    if known is None:
        return pa.record_batch([pa.array(held.keys(), pa.binary()), counts], names=["word", "n"])
    sides = [pa.array([p[k] for p in held], pa.binary()) for k in (0, 1)]
    return pa.record_batch([*sides, counts], names=["word", "next", "n"])


def head_of(texts: DataFrame, share: int = HEAD) -> Head:
    """The frequent words and pairs of a text column, counted over all rows.

    A word or pair with more than 1/``share`` of all words' occurrences is frequent: fewer than ``share`` can be, of either kind.
    A frequent pair's words are frequent, so only pairs of those are counted."""
    counted = written(_counted(texts, None).groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = counted.agg(F.sum("n")).first()[0] or 0
    words = [bytes(r.word) for r in counted.filter(F.col("n") * share > total).orderBy(F.desc("n"), "word").collect()]
    pairs = _counted(texts, set(words)).groupBy("word", "next").agg(F.sum("n").alias("n")).filter(F.col("n") * share > total)
    found = [(bytes(r.word), bytes(r.next)) for r in pairs.orderBy(F.desc("n"), "word", "next").collect()]
    return Head(words, found)


def totals(texts: DataFrame, head: Head) -> np.ndarray:
    """Features of a text column by bucket: a task sends one row for each bucket at most."""
    shared = texts.sparkSession.sparkContext.broadcast(head)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, of in buckets(text.as_py(), shared.value):
                    held += np.bincount(of, minlength=BUCKETS)
        some = np.flatnonzero(held)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(held[some], pa.int64())], names=["bucket", "n"])

    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


@dataclass
class Model:
    """Gain of each bucket, with the head that finds buckets."""

    head: Head
    gains: np.ndarray


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) by bucket: s and S features of the raw corpus, t and T of the target."""
    whole, wanted = float(raw.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * whole / ((float(s) + 1) * wanted))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def fit(docs: DataFrame, target: DataFrame) -> Model:
    """Exact totals over all ``text`` of both tables, through one head."""
    head = head_of(docs.select("text"))
    return Model(head, gains(totals(docs.select("text"), head), totals(target.select("text"), head)))


def weigh(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_words, n_features and weight (sum of gains) of every row; null text has no words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            rows = []
            for text in batch.column(1):
                n = features = weight = 0
                for new, of in buckets(text.as_py(), m.head):
                    n, features, weight = n + new, features + len(of), weight + int(m.gains[of].sum())
                rows.append((n, features, weight))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")


def draw(weighed: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """Add score and rank: without replacement, ``percent`` of the rows with ``least_words`` words and an id, by weight plus a Gumbel
    number (both in thousandths) that ``seed`` and doc_id fix. Ties go to the smaller doc_id; rows that tie in both, being
    the same, in any order. Rows without an id have no score and take no part.

    Scores are counted in at most 2**14 ranges, and only rows from the last drawn one's range on are sorted, by range."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = written(weighed.withColumn("score", F.col("weight") + gumbel), "scored")
    able = F.coalesce((F.col("n_words") >= least_words) & F.col("score").isNotNull(), F.lit(False))
    n, low, high = scored.filter(able).agg(F.count(F.lit(1)), F.min("score"), F.max("score")).first()
    wanted = percent * n // 100
    out = [F.col(c) for c in ("doc_id", "n_features", "weight", "score")]
    none = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return scored.select(*out, none)
    width = max(1, (high - low + 1) // (1 << 14) + 1)
    ranges = scored.filter(able).groupBy(F.floor((F.col("score") - low) / width).cast("long").alias("r")).count().orderBy(F.desc("r")).collect()
    seen = 0
    for r in ranges:
        seen += r["count"]
        if seen >= wanted:
            break
    first = low + r.r * width
    top = able & (F.col("score") >= first)
    # a task holds a range of the order; its rows are numbered, and ranges by the rows before them
    order = [F.desc("score"), F.asc("doc_id")]
    placed = scored.filter(top).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = written(placed.select(*out, F.shiftright("__at", 33).alias("__part"), F.col("__at").bitwiseAND((1 << 33) - 1).alias("__n")), "drawn")
    parts = placed.groupBy("__part").count()  # a row for each task
    before = parts.withColumn("__before", F.sum("count").over(Window.orderBy("__part")) - F.col("count")).select("__part", "__before")
    ranked = placed.join(F.broadcast(before), "__part").withColumn("rank", F.col("__before") + F.col("__n") + 1)
    drawn = ranked.select(*out, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))
    return drawn.unionByName(scored.filter(~top).select(*out, none))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with n_features, weight, score and rank, toward ``target`` (text).

    Null or empty text has no features and weighs 0; an empty table gives an empty one; an empty target leaves all gains to the
    smoothing. Other columns are not read; rows that repeat stay as often as they are, and count as often."""
    return draw(weigh(docs, fit(docs, target)), percent, least_words, seed)
