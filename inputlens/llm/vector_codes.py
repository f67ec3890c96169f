"""Vector code compression: parts of a vector become the numbers of codebook entries (product quantisation), by slicing bitmasks.

The nearest entry is found exactly. In every dimension the entries' coordinates are sorted, and each place in that order has the
bitmask of the entries before it; a range of coordinates is then the difference of two masks, and the ranges' masks of all
dimensions, ANDed word by word, leave the entries in a box around the part. The first box has a radius that a few parts of the
block suggest: if its best entry is no farther than the radius, none outside can be nearer or as near. Otherwise the box grows, to
the distance of that entry (then it holds all that are as near), or twofold if it was empty.

All arithmetic is on whole numbers. Codebooks are trained by rounds of assignment, each one Spark job whose tasks send one sum for
each entry at most.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inputlens.llm.common import matched, written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Parts searched at once; parts of a block that suggest the first radius.
BLOCK, TRIED = 1024, 16
#: Groups in which the tasks' sums are added up (a group gets some entries' sums of every task).
SUMMED = 128


def whole(x: float) -> int:
    """floor(SCALE * x), exact for any finite number."""
    n, d = float(x).as_integer_ratio()
    return n * SCALE // d


class Slices:
    """The entries of one part's codebook, as masks by place in the order of each dimension."""

    def __init__(self, entries: list[list[int]]):
        self.entries, self.n, self.width = entries, len(entries), len(entries[0])
        #: Components up to this size keep squared distances inside 64 bits.
        self.safe = math.isqrt((1 << 62) // self.width) // 2
        self.small = all(abs(x) <= self.safe for e in entries for x in e)
        self.orders = [sorted(range(self.n), key=lambda i, k=k: (entries[i][k], i)) for k in range(self.width)]
        self.sorted = [[entries[i][k] for i in order] for k, order in enumerate(self.orders)]
        if self.small:
            self.matrix = np.array(entries, dtype=np.int64)
            self.coordinates = np.array(self.sorted, dtype=np.int64)
            bits = np.zeros((self.width, self.n + 1, -(-self.n // 64) * 64), dtype=np.uint8)
            for k, order in enumerate(self.orders):
                bits[k, np.arange(1, self.n + 1), order] = 1
            # each place holds the mask of all entries before it
            self.masks = np.packbits(np.bitwise_or.accumulate(bits, axis=1), axis=2, bitorder="little").view("<u8")

    def inside(self, parts: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """For each part and entry, whether the entry lies in the box of that radius around the part."""
        held = np.full((len(parts), self.masks.shape[2]), ~np.uint64(0), dtype=np.uint64)
        for k in range(self.width):
            low = np.searchsorted(self.coordinates[k], parts[:, k] - radius, side="left")
            high = np.searchsorted(self.coordinates[k], parts[:, k] + radius, side="right")
            held &= self.masks[k, high] & ~self.masks[k, low]
        return np.unpackbits(held.view(np.uint8), axis=1, bitorder="little", count=self.n).view(bool)

    def distances(self, parts: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        apart = parts[rows] - self.matrix[columns]
        return np.einsum("ij,ij->i", apart, apart)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry nearest to each part (the lowest of several) and its squared distance. All components are ``safe``."""
        entry, error = np.zeros(len(parts), dtype=np.int64), np.zeros(len(parts), dtype=np.int64)
        for at in range(0, len(parts), BLOCK):
            block = parts[at : at + BLOCK]
            found = self._nearest(block)
            entry[at : at + BLOCK], error[at : at + BLOCK] = found
        return entry, error

    def _nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        entry, error = np.full(len(parts), -1, dtype=np.int64), np.zeros(len(parts), dtype=np.int64)
        # the radius of a cube that holds the nearest entry in the largest dimension, typical for a few parts
        tried = parts[:: max(1, len(parts) // TRIED)]
        typical = int(np.median(np.abs(tried[:, None, :] - self.matrix).max(2).min(1)))
        open_, radius = np.arange(len(parts)), np.full(len(parts), max(1, typical), dtype=np.int64)
        while len(open_):
            held = self.inside(parts[open_], radius[open_])
            rows, columns = np.nonzero(held)
            apart = self.distances(parts[open_], rows, columns)
            some = np.flatnonzero(held.any(1))
            starts = np.searchsorted(rows, some)
            least = np.minimum.reduceat(apart, starts) if len(some) else apart
            best = np.flatnonzero(apart == np.repeat(least, np.diff(np.append(starts, len(rows)))))
            first = best[np.searchsorted(rows[best], some)]
            who = open_[some]
            entry[who], error[who] = columns[first], least
            sure = least < (radius[who] + 1) ** 2
            # a box out to that distance holds all entries as near
            radius[who] = np.floor(np.sqrt(least.astype(np.float64))).astype(np.int64) + 1
            empty = np.setdiff1d(open_, who)
            radius[empty] *= 2
            open_ = np.concatenate([who[~sure], empty])
        return entry, error

    def nearest_of(self, part: list[int]) -> tuple[int, int]:
        """The same for one part of any size, with whole numbers of any length."""
        radius = 1
        while True:
            held = (1 << self.n) - 1
            for k, x in enumerate(part):
                a, b = bisect_left(self.sorted[k], x - radius), bisect_right(self.sorted[k], x + radius)
                held &= sum(1 << i for i in self.orders[k][a:b])
            apart = [(sum((x - y) ** 2 for x, y in zip(part, self.entries[i], strict=True)), i) for i in range(self.n) if held >> i & 1]
            if apart and min(apart)[0] <= radius * radius:
                return min(apart)[1], min(apart)[0]
            radius = math.isqrt(min(apart)[0]) + 1 if apart else 4 * radius


def assigned(column: pa.Array, codebooks: list[Slices]) -> tuple[np.ndarray, list[np.ndarray], dict[int, list[list[int]]], np.ndarray]:
    """Entry of each vector and part (-1 where numbers are too long, see the third), parts as whole numbers, the long ones row by
    row, and squared distances summed over parts (0 for those)."""
    n, width = len(column), codebooks[0].width
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, width * len(codebooks))
    limit = min(c.safe for c in codebooks) / SCALE
    short = (np.abs(flat) < limit).all(1) & all(c.small for c in codebooks)
    numbers = np.floor(np.where(short[:, None], flat, 0.0) * SCALE).astype(np.int64)
    parts = [numbers[:, k * width : (k + 1) * width] for k in range(len(codebooks))]
    entries, error, rows = np.full((n, len(codebooks)), -1, dtype=np.int64), np.zeros(n, dtype=np.int64), np.flatnonzero(short)
    for k, c in enumerate(codebooks):
        entries[rows, k], apart = c.nearest(parts[k][rows])
        error[rows] += apart
    long = {}
    for i in np.flatnonzero(~short).tolist():
        values = [whole(x) for x in flat[i].tolist()]
        long[i] = [values[k * width : (k + 1) * width] for k in range(len(codebooks))]
    return entries, parts, long, error


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector has only finite components."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return vectors.filter(F.col("embedding").isNotNull() & finite)


def trained(vectors: DataFrame, seeds: list[list[list[int]]], rounds: int) -> list[list[list[int]]]:
    """Codebooks (by part and entry) after ``rounds`` of assigning every part and averaging, from ``seeds``."""
    books = seeds
    for _ in range(rounds):
        shared = vectors.sparkSession.sparkContext.broadcast([Slices(b) for b in books])

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            codebooks = shared.value
            held = [np.zeros((c.n, c.width), dtype=object) for c in codebooks]
            counts = [np.zeros(c.n, dtype=np.int64) for c in codebooks]
            for batch in batches:
                entries, parts, long, _ = assigned(batch.column(0), codebooks)
                for k, c in enumerate(codebooks):
                    short = entries[:, k] >= 0
                    some = np.zeros((c.n, c.width), dtype=np.int64)
                    np.add.at(some, entries[short, k], parts[k][short])
                    held[k] += some
                    counts[k] += np.bincount(entries[short, k], minlength=c.n)
                    for values in long.values():
                        i = c.nearest_of(values[k])[0]
                        held[k][i] += np.array(values[k], dtype=object)
                        counts[k][i] += 1
            rows = [(k, i, int(counts[k][i]), ",".join(map(str, held[k][i]))) for k in range(len(codebooks)) for i in np.flatnonzero(counts[k]).tolist()]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.string())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["part", "entry", "n", "sums"])

        def average(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            out = []
            for at, rows in pdf.groupby(["part", "entry"]):
                n = int(rows["n"].sum())
                total = [sum(column) for column in zip(*(map(int, s.split(",")) for s in rows["sums"]), strict=True)]
                out.append((*at, ",".join(str(t // n) for t in total)))
            return pd.DataFrame(out, columns=["part", "entry", "mean"])

        found = vectors.select("embedding").mapInArrow(sums, "part int, entry int, n long, sums string")
        few = F.pmod(F.xxhash64("part", "entry"), F.lit(SUMMED))
        means = found.groupBy(few).applyInPandas(average, "part int, entry int, mean string").collect()  # one row for each entry
        books = [[list(e) for e in b] for b in books]
        for r in means:
            books[r.part][r.entry] = list(map(int, r.mean.split(",")))
    return books


def coded(vectors: DataFrame, books: list[list[list[int]]]) -> DataFrame:
    """Add code and error to (vec_id, label, embedding); an error of more than 64 bits is null."""
    shared = vectors.sparkSession.sparkContext.broadcast([Slices(b) for b in books])

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebooks = shared.value
        for batch in batches:
            entries, _, long, error = assigned(batch.column(2), codebooks)
            errors = error.tolist()
            for i, values in long.items():
                found = [c.nearest_of(v) for c, v in zip(codebooks, values, strict=True)]
                entries[i] = [e for e, _ in found]
                total = sum(e for _, e in found)
                errors[i] = total if total < 1 << 63 else None
            code = ["".join(f"{e:02x}" for e in row) for row in entries.tolist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.select(F.col("vec_id").cast("long"), "label", "embedding").mapInArrow(codes, f"vec_id long, label {kind}, code string, error long")


def with_label_error(rows: DataFrame) -> DataFrame:
    """Add label_error, the sum of ``error`` over rows of equal label (null if it passes 64 bits, or one of them does). Labels
    that many rows share are joined apart."""
    keyed = written(rows.withColumns({"__null": F.col("label").isNull(), "__label": F.coalesce(F.col("label").cast("string"), F.lit(""))}), "coded")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    summed = keyed.groupBy("__null", "__label").agg(F.when(F.count_if(F.col("error").isNull()) == 0, total.try_cast("long")).alias("label_error"))
    return matched(keyed, summed, ["__null", "__label"]).drop("__null", "__label")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every usable row of (vec_id, label, embedding).

    Codebooks start from the vectors of the ``entries`` smallest ids (of an id's several vectors, the smaller come first; null ids
    are coded, but start nothing). Rows without a vector, with null, infinite or missing numbers, or of another length than the first
    starting vector's (which divides by ``parts``) are left out. Rows that repeat are coded alike, and count as often as they are. An
    empty table gives an empty one, as does one without ids; fewer rows than ``entries`` make smaller codebooks."""
    if entries > ENTRIES:
        raise ValueError(f"a code has two hex digits, so at most {ENTRIES} entries")
    kept = usable(vectors.select("vec_id", "label", "embedding")).filter((F.size("embedding") > 0) & (F.size("embedding") % parts == 0))
    first = kept.filter("vec_id IS NOT NULL").orderBy("vec_id", "embedding").limit(entries).collect()  # at most 256 rows
    size = len(first[0].embedding) if first else 0
    kept = kept.filter(F.size("embedding") == size)
    width = size // parts
    starts = [[whole(x) for x in r.embedding] for r in first if len(r.embedding) == size]
    seeds = [[s[k * width : (k + 1) * width] for s in starts] for k in range(parts)]
    books = trained(kept, seeds, rounds) if first else []
    spelled = ",".join(str(x) for b in books for e in b for x in e)
    if not first:
        kind = vectors.schema["label"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id long, label {kind}, code string, error long, label_error long, codebooks_sha256 string")
    return with_label_error(coded(kept, books)).withColumn("codebooks_sha256", F.lit(hashlib.sha256(spelled.encode()).hexdigest()))
