"""Substring dedup: remove words covered by word windows that occur more than once.

A window is WINDOW consecutive words of one document. Windows are classed by their anchor, the word sequence of
ANCHOR words inside them whose hash is smallest (leftmost of equals): equal windows have equal anchors at equal
places, so an anchor occurs at least as often as any of its windows. First pass: every partition counts its anchors
in a count-min sketch; the merged sketch overestimates them. Second pass: windows whose anchor is estimated to occur
once cannot repeat and stay behind; all others are grouped exactly, by 128 bits of hash of their words. None is lost.

Nothing is broadcast but keys that hold so large a share of the rows that few can (see ``common.with_keys``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inputlens.llm import sketch
from inputlens.llm.common import SEPARATORS, Words, discard, hashed_words, joined_hashes, rolling, row_key, with_keys, written

WINDOW, ANCHOR = 35, 8
#: Bytes of text to an anchor, roughly (sizes the sketch; only its speed depends on it); runs that a task gathers before
#: it sends them off by block.
BYTES_PER_ANCHOR, GATHERED = 60, 500_000


def windows(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window in the documents: its first word, its document, and the word where its anchor starts."""
    k = min(ANCHOR, window)
    n = len(words.starts)
    none = np.zeros(0, dtype=np.int64)
    if n < window:
        return none, none, none
    grams = rolling(words.hashes[0], k)
    span = window - k + 1
    shift = np.uint64(int(n).bit_length())
    # order by the hash's high bits, then by place: equal content gives equal choices, leftmost first
    order = (grams >> shift << shift) | np.arange(len(grams), dtype=np.uint64)
    padded = np.full(-(-len(order) // span) * span, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(order)] = order
    blocks = padded.reshape(-1, span)
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - window + 1)
    least = np.minimum(suffix[starts], prefix[starts + span - 1])
    doc = np.searchsorted(words.bounds, starts, side="right") - 1
    inside = starts + window <= words.bounds[doc + 1]
    anchor = (least & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
    return starts[inside], doc[inside], anchor[inside]


class Runs:
    """Neighbouring windows with one anchor: first windows, how many, documents and the anchor's hash of each run."""

    def __init__(self, words: Words, window: int):
        starts, doc, anchor = windows(words, window)
        edges = np.flatnonzero(np.diff(anchor, prepend=-1))
        k = min(ANCHOR, window)
        self.words, self.window = words, window
        self.first, self.doc = starts[edges], doc[edges]
        self.n = np.diff(np.append(edges, len(starts)))
        self.anchor = joined_hashes(words.hashes[0], anchor[edges], anchor[edges] + k)

    @property
    def at(self) -> np.ndarray:
        """First window in its document."""
        return (self.first - self.words.bounds[self.doc]).astype(np.int32)

    def contents(self) -> np.ndarray:
        """A hash of all words of a run, independent of its anchor's."""
        return joined_hashes(self.words.hashes[1], self.first, self.first + self.n - 1 + self.window)


RUN = "anchor long, one long, id long, hash long, at int, n int, met boolean"


def packed_runs(rows: DataFrame, window: int, blocks: int) -> DataFrame:
    """All runs of ``rows`` (text, id, hash), packed by the sketch block of their anchor: arrays as bytes, so that
    a run takes little more than its 20 bytes, and its row's id and hash stand once for each block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[tuple] = []
        held = 0

        def send() -> pa.RecordBatch:
            nonlocal gathered, held
            anchor, one, row, at, n, ids, hashes = (np.concatenate(c) for c in zip(*gathered, strict=True))
            gathered, held = [], 0
            block = sketch.block_of(anchor, blocks)
            order = np.argsort(block, kind="stable")
            edges = np.flatnonzero(np.diff(block[order], prepend=-1))
            out: list[list] = [[] for _ in range(8)]
            for some in np.split(order, edges[1:]):
                own, place = np.unique(row[some], return_inverse=True)
                values = [anchor[some], one[some], place.astype("<i4"), at[some], n[some], ids[own], hashes[own]]
                for column, value in zip(out, [int(block[some[0]]), *[v.tobytes() for v in values]], strict=True):
                    column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *[pa.array(c, pa.binary()) for c in out[1:]]], names=["block", *PACKED])

        for batch in batches:
            ids, hashes = (batch.column(c).to_numpy() for c in (1, 2))
            for first, last, words in hashed_words(batch.column(0), (1, 2)):
                runs = Runs(words, window)
                base = sum(len(g[5]) for g in gathered)
                gathered.append((runs.anchor, runs.contents(), base + runs.doc, runs.at, runs.n.astype(np.int32), ids[first:last], hashes[first:last]))
                held += len(runs.n)
                if held >= GATHERED:
                    yield send()
        if gathered and held:
            yield send()

    kinds = ", ".join(f"{c} binary" for c in PACKED)
    return rows.select("text", "id", "hash").mapInArrow(pack, f"block int, {kinds}")


PACKED = ["anchor", "one", "row", "at", "n", "id", "hash"]
_KINDS = dict(zip(PACKED, ["<u8", "<u8", "<i4", "<i4", "<i4", "<i8", "<i8"], strict=True))


def _suspects(bits: np.ndarray, packed: pd.DataFrame) -> pd.DataFrame:
    """The runs whose anchor is estimated to occur twice; ``met`` are those that meet an equal one right here."""
    parts = []
    for values in packed[PACKED].itertuples(index=False):
        a = {c: np.frombuffer(v, _KINDS[c]) for c, v in zip(PACKED, values, strict=True)}
        some = np.flatnonzero(sketch.often(bits, a["anchor"]))
        row = a["row"][some]
        parts.append((a["anchor"][some].view("<i8"), a["one"][some].view("<i8"), a["id"][row], a["hash"][row], a["at"][some], a["n"][some]))
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, "i8")] * 6
    runs = pd.DataFrame(dict(zip(("anchor", "one", "id", "hash", "at", "n"), columns, strict=True)))
    return runs.assign(met=runs.duplicated(["anchor", "one"], keep=False).to_numpy(dtype=bool))


def repeated_windows(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """id, hash, at, n: runs of n windows from the at-th word of a row on that each start more than once anywhere.

    ``rows`` has columns text, id and hash, which name a row. Every start counts, also of rows that repeat. Runs of
    neighbouring windows with one anchor are grouped by their whole words first: copies of a run repeat as a whole.
    Only where an anchor has several different runs are windows compared one by one, once for each different run."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = size // BYTES_PER_ANCHOR

    def anchors(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, words in hashed_words(batch.column(0)):
            yield Runs(words, window).anchor

    counted = sketch.build(rows.select("text"), anchors, expected)
    runs = written(sketch.ask(packed_runs(rows, window, sketch.blocks_for(expected)), counted, _suspects, RUN), "runs")
    contents = runs.groupBy("anchor", "one").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("id", "hash", "at", "n")).alias("some"))
    contents = written(contents, "contents")
    # most copies have met in a block; only what is alone in its lot is looked up, of a key one row a lot at most
    alone = runs.filter("NOT met").join(contents.filter("times > 1"), ["anchor", "one"], "left_semi")
    whole = written(runs.filter("met").unionByName(alone).select("id", "hash", "at", "n"), "whole")
    # anchors with several different runs: one of each, to be compared by window
    several = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    compared = with_keys(contents, several, ["anchor"], "times").groupBy("some.id", "some.hash").agg(F.collect_list(F.struct("some.at", "some.n")).alias("runs"))
    asked = rows.join(compared, ["id", "hash"]).dropDuplicates(["id", "hash"]).select("text", "id", "hash", "runs.at", "runs.n")

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(c) for c in (3, 4)]
            for first, last, words in hashed_words(batch.column(0), (1, 2)):
                at, n = (c.slice(first, last - first).flatten().to_numpy() for c in lists)
                held = np.diff(lists[0].slice(first, last - first).offsets.to_numpy())
                doc = np.repeat(np.repeat(np.arange(last - first), held), n)
                place = np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())
                starts = words.bounds[doc] + place
                one, two = (joined_hashes(h, starts, starts + window).view(np.int64) for h in words.hashes)
                where = pa.array(first + doc)
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), batch.column(1).take(where), batch.column(2).take(where), pa.array(place.astype(np.int32))], names=["one", "two", "id", "hash", "at"])

    found = written(asked.mapInArrow(single, "one long, two long, id long, hash long, at int"), "windows")
    twice = written(found.groupBy("one", "two").agg(F.count(F.lit(1)).alias("times")).filter("times > 1"), "twice")
    again = with_keys(found, twice, ["one", "two"], "times").select("id", "hash", "at", F.lit(1).alias("n"))
    marks = whole.unionByName(again).groupBy("id", "hash").agg(F.collect_set(F.struct("at", "n")).alias("runs"))
    marks = written(marks, "marks")
    discard(counted, runs, contents, whole, found, twice)
    return marks


def dedup(docs: DataFrame, window: int = WINDOW, keep_text: bool = False, name: str = "dedup") -> DataFrame:
    """``docs`` (doc_id, text and any others) with a struct called ``name``, in place of a column of that name: n_words, n_removed, kept_sha256 (hex, of the kept
    words joined by one space) and, on request, kept_text: the text itself if nothing is removed, else those words
    so joined.

    Words are runs of bytes other than space and tab to carriage return; null text has none. A word goes if any
    window over it starts anywhere else too, in the same or another row; windows are judged on the input. Rows that
    repeat are documents of their own, so all their windows repeat. Texts shorter than a window stay whole."""
    key = row_key()
    marks = repeated_windows(docs.select("text", key["id"].alias("id"), key["hash"].alias("hash")), window)
    marks = marks.select(F.col("id").alias("__il_id"), F.col("hash").alias("__il_hash"), F.col("runs").alias("__il_at"))
    keyed = docs.withColumns({"__il_id": key["id"], "__il_hash": key["hash"]})
    joined = keyed.join(marks, ["__il_id", "__il_hash"], "left")
    kind = "n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text

    @F.pandas_udf(kind)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, places in batches:
            rows = [_cut(t, p, window) for t, p in zip(texts, places, strict=True)]
            frame = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256", "kept_text"])
            yield frame if keep_text else frame.drop(columns="kept_text")

    return joined.withColumn("__il_cut", cut("text", "__il_at")).select(*[F.col(c) for c in docs.columns if c != name], F.col("__il_cut").alias(name))


def _cut(text: str | None, places: list | None, window: int) -> tuple[int, int, str, str | None]:
    words = (text or "").encode().split()  # at exactly the bytes of SEPARATORS
    n = len(words)
    kept = words
    if places is not None and len(places):
        at, runs = (np.array([p[c] for p in places]) for c in ("at", "n"))
        change = np.zeros(n + 1, dtype=np.int32)
        np.add.at(change, at, 1)
        np.add.at(change, at + runs - 1 + window, -1)
        kept = [w for w, c in zip(words, np.cumsum(change[:n]).tolist(), strict=True) if not c]
    joined = b" ".join(kept)
    return n, n - len(kept), hashlib.sha256(joined).hexdigest(), text if len(kept) == n else joined.decode()


assert bytes(b for b in range(256) if not bytes([b]).split()) == bytes(sorted(SEPARATORS))
