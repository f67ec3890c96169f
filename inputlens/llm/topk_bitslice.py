"""Exact top-k inner products over a bit-sliced index.

Components are quantised to integers. Rows are dealt into blocks; in a block every attribute is a stack of
bitmaps, slice j holding bit j of (component - smallest component). The index is a table of its own, a row for each
block, built once. A query's score is a sum of slices shifted by the set bits of its own components (complemented slices
where it is negative), added for all rows at once by bitmap arithmetic: carry-save adders of three bitmaps, weight by
weight. The sum is again a stack of slices; walking it from the most significant slice down narrows the rows to those
certainly in the top k and those tied with the k-th, of which the smallest ids are taken.

A task holds some queries and takes one index block after another, keeping the best k of each query, so that partial
results are k rows for each query and task, not for each query and block.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inputlens.llm.common import written

#: Rows of a block, queries of a task, blocks that a task takes at most (about; all dealt at random).
ROWS, QUERIES, BLOCKS = 16_384, 2048, 16
#: Vectors with quantised components at or beyond this size meet in smaller blocks of their own, as their stacks are
#: higher; so many times smaller.
WIDE, WIDE_SHARE = 1 << 28, 16


def finite(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding; drops null ids and null vectors, and vectors with null or non-finite components."""
    fine = F.forall("embedding", lambda e: e.isNotNull() & (F.abs(e.cast("double")) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long"), "embedding").filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def quantised(column: pd.Series, dims: int, scale: int) -> np.ndarray:
    """Integer components floor(scale * x), a row for each vector; Python's integers where 64 bits may not do."""
    raw = np.zeros((len(column), dims))
    for i, v in enumerate(column):
        raw[i, : len(v)] = v
    with np.errstate(over="ignore"):
        x = np.floor(scale * raw)
    if np.abs(x).max(initial=0) < 1 << 62:
        return x.astype(np.int64)
    out = np.empty(x.shape, dtype=object)
    out.flat = [int(e) if math.isfinite(e) else int(r) * scale for e, r in zip(x.flat, raw.flat, strict=True)]
    return out


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans, a multiple of 64 long, as 64-bit words."""
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def sliced(ids: np.ndarray, values: np.ndarray) -> dict:
    """A block of the index; rows must be in id order."""
    n, dims = values.shape
    low = values.min(0)
    shifted = values - low
    bits = max(1, int(shifted.max(initial=0)).bit_length())
    words = -(-n // 64)
    slices = np.zeros((dims, bits, words), dtype=np.uint64)
    for j in range(bits):
        plane = np.zeros((dims, words * 64), dtype=bool)
        plane[:, :n] = ((shifted >> j) & 1).T.astype(bool)
        slices[:, j] = packed(plane)
    # smallest components as text: they may pass 64 bits
    return {"ids": ids.astype("<i8").tobytes(), "low": json.dumps([int(x) for x in low]), "bits": bits, "slices": slices.tobytes()}


class Index:
    """A block of the index, ready for queries."""

    def __init__(self, ids: bytes, low: str, bits: int, slices: bytes):
        self.ids, self.low, self.bits = np.frombuffer(ids, "<i8"), json.loads(low), int(bits)
        self.dims = len(self.low)
        mask = np.zeros((1, -(-len(self.ids) // 64) * 64), dtype=bool)
        mask[0, : len(self.ids)] = True
        self.rows = packed(mask)[0]
        direct = np.frombuffer(slices, np.uint64).reshape(self.dims * self.bits, -1)
        self.slices = np.concatenate([direct, ~direct & self.rows])

    def sums(self, query: list[int]) -> list[np.ndarray]:
        """Slices of the inner products, less ``constant`` of the query; least significant first."""
        by_weight: dict[int, list[np.ndarray]] = {}
        size, negative = [abs(q) for q in query], np.array([q < 0 for q in query], dtype=np.int64)
        for k in range(max(size, default=0).bit_length()):
            dims = np.array([d for d, x in enumerate(size) if x >> k & 1], dtype=np.int64)
            first = (dims + negative[dims] * self.dims) * self.bits
            for j in range(self.bits):
                by_weight.setdefault(j + k, []).append(first + j)
        out: list[np.ndarray] = []
        carried: dict[int, list[np.ndarray]] = {}
        w, last = 0, max(by_weight, default=-1)
        while w <= last or w in carried:
            parts = carried.pop(w, [])
            if w in by_weight:
                parts.append(self.slices[np.concatenate(by_weight[w])])
            stack = np.concatenate(parts) if parts else np.zeros((0, len(self.rows)), dtype=np.uint64)
            while len(stack) > 1:
                t = len(stack) // 3
                if t:
                    a, b, c = stack[:t], stack[t : 2 * t], stack[2 * t : 3 * t]
                    half = a ^ b
                    carried.setdefault(w + 1, []).append((a & b) | (half & c))
                    stack = np.concatenate([half ^ c, stack[3 * t :]])
                else:
                    carried.setdefault(w + 1, []).append(stack[:1] & stack[1:])
                    stack = stack[:1] ^ stack[1:]
            out.append(stack[0] if len(stack) else np.zeros(len(self.rows), dtype=np.uint64))
            w += 1
        return out

    def constant(self, query: list[int]) -> int:
        """What a score is more than its sum of slices: the smallest components' share, and a complement's all-ones."""
        return sum(q * low + (q * ((1 << self.bits) - 1) if q < 0 else 0) for q, low in zip(query, self.low, strict=True))

    def top(self, query: list[int], own: int, k: int) -> list[tuple[int, int]]:
        """Scores and ids of the k best rows whose id isn't ``own``, ties to smaller ids; in no order."""
        tied = self.rows.copy()
        for at in range(*np.searchsorted(self.ids, [own, own + 1]).tolist()):
            tied[at >> 6] &= ~np.uint64(1 << (at & 63))
        sure = np.zeros_like(tied)
        count = lambda m: int(np.bitwise_count(m).sum())
        sums = self.sums(query)
        if count(tied) > k:
            for s in reversed(sums):
                both = tied & s
                n = count(sure | both)
                if n > k:
                    tied = both
                else:
                    sure |= both
                    tied &= ~s
                    if n == k:
                        tied[:] = 0
                        break
        else:
            sure, tied = tied, sure
        numbers = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
        best = numbers(sure)
        best = np.concatenate([best, numbers(tied)[: k - len(best)]]) if len(best) < k else best
        more, words, shift = self.constant(query), best >> 6, (best & 63).astype(np.uint64)
        bits = np.stack([(s[words] >> shift) & np.uint64(1) for s in sums], axis=1) if sums else np.zeros((len(best), 0), dtype=np.uint64)
        return [(more + sum(1 << w for w in np.flatnonzero(row).tolist()), int(self.ids[r])) for r, row in zip(best, bits, strict=True)]


def index(rows: DataFrame, dims: int, scale: int, usual: int, wide: int) -> DataFrame:
    """The index of rows (vec_id, embedding, wide): a written table with one row for each of the blocks."""
    number = F.monotonically_increasing_id()
    dealt = lambda m: F.pmod(F.xxhash64(number), F.lit(m)).cast("int")
    blocks = rows.withColumn("block", F.when(F.col("wide"), usual + dealt(max(1, wide))).otherwise(dealt(usual))).drop("wide")

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        made = sliced(pdf["vec_id"].to_numpy(), quantised(pdf["embedding"], dims, scale))
        return pd.DataFrame([{"block": key[0], **made}])

    return written(blocks.groupBy("block").applyInPandas(build, "block int, ids binary, low string, bits int, slices binary"), "slices")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for every query row the k rows of highest integer inner product, without
    rows of its own id; ties to smaller vec_id. ``vectors`` has vec_id and embedding; a shorter vector's missing
    components count as 0. All finite vectors take part; ranks are exact at any size, and a score is null where it
    passes the 64 bits of its column. Rows that repeat take part as often as they are. Empty input gives no rows."""
    size = F.coalesce(F.array_max(F.transform("embedding", lambda e: F.abs(e.cast("double")))), F.lit(0.0))
    rows = finite(vectors).withColumn("wide", size >= float(WIDE // scale))
    n, large, nq, dims, most = rows.agg(F.count(F.lit(1)), F.count_if("wide"), F.count_if(is_query), F.max(F.size("embedding")), F.max(size)).first()
    usual, query_blocks = max(1, math.ceil((n - large) / ROWS)), max(1, math.ceil(nq / QUERIES))
    wide = math.ceil(large / max(1, ROWS // WIDE_SHARE))
    dims = max(1, dims or 1)
    bound = dims * ((int(most or 0) + 1) * scale + 1) ** 2  # of every score's size
    places = bound.bit_length() // 8 + 1 if bound >= 1 << 63 else 0  # bytes that order the scores beyond 64 bits
    indexed = index(rows, dims, scale, usual, wide)
    # tasks: at most BLOCKS blocks each, fewer while there are cores without any
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    lots = max(math.ceil((usual + wide) / BLOCKS), min(usual + wide, math.ceil(2 * cores / query_blocks)))
    spread = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = indexed.withColumns({"lot": F.pmod("block", F.lit(lots)), "query_block": spread(query_blocks)})
    asked = rows.drop("wide").filter(is_query).withColumn("query_row", F.monotonically_increasing_id())
    asked = asked.withColumns({"query_block": F.pmod(F.xxhash64("query_row"), F.lit(query_blocks)).cast("int"), "lot": spread(lots)})

    def search(blocks: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        best: dict[int, list[tuple[int, int]]] = {}
        values = quantised(queries["embedding"], dims, scale).tolist() if len(queries) else []
        for block in blocks.sort_values("block").itertuples():
            index = Index(block.ids, block.low, block.bits, block.slices)
            for row, own, q in zip(queries["query_row"].tolist(), queries["vec_id"].tolist(), values, strict=True):
                found = best.get(row, []) + index.top(q, own, k)
                best[row] = sorted(found, key=lambda x: (-x[0], x[1]))[:k]
        names = dict(zip(queries["query_row"].tolist(), queries["vec_id"].tolist(), strict=True))
        flat = [(row, names[row], i, s) for row, found in best.items() for s, i in found]
        out = pd.DataFrame(flat, columns=["query_row", "query_id", "vec_id", "score"])
        if not places:
            return out.astype("int64")
        exact = out["score"].tolist()
        out["score"] = pd.Series([x if -(1 << 63) <= x < 1 << 63 else None for x in exact], dtype=object)
        out["place"] = [(x + (1 << (8 * places - 1))).to_bytes(places, "big") for x in exact]
        return out

    keys = ["lot", "query_block"]
    kinds = "query_row long, query_id long, vec_id long, score long" + (", place binary" if places else "")
    partial = left.groupBy(keys).cogroup(asked.groupBy(keys)).applyInPandas(search, kinds)
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("place" if places else "score"), "vec_id")
    ranked = partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
