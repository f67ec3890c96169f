"""Count-min sketches over all rows in blocks of cells: built by partition, merged by block, looked up by block.

A sketch answers "was this key counted at least twice?" with no false no. The number of blocks follows the number of
keys, so that the share of false answers is the same at every size; no block, and no part that grows with the data, goes
to the driver or to all executors. Who asks sends keys to the block's task. A block that is asked very often, as by very
frequent keys, is dealt into lots, each with a copy of the block's bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inputlens.llm.common import mix, written

#: Expected keys of a block, cells of each of its two hash rows (a power of two), counted keys of a lot at most (about).
BLOCK_KEYS, CELLS, LOT_KEYS = 1 << 18, 1 << 20, 1 << 20


def blocks_for(keys: int) -> int:
    return max(1, -(-keys // BLOCK_KEYS))


def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    return ((mix(keys) >> np.uint64(36)) % np.uint64(blocks)).astype(np.int64)


def cells_of(keys: np.ndarray, cells: int) -> list[np.ndarray]:
    """Cells in the block, one of each hash row of ``cells`` cells."""
    x = mix(keys ^ np.uint64(0x5851F42D4C957F2D))
    mask = np.uint64(cells - 1)
    return [(x & mask).astype(np.int64), ((x >> np.uint64(32)) & mask).astype(np.int64) + cells]


def often(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether keys of a block may have been counted twice; ``bits`` are its cells'."""
    out = np.ones(len(keys), dtype=bool)
    for at in cells_of(keys, 4 * len(bits)):
        out &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
    return out


def build(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], expected: int) -> DataFrame:
    """block, bits and lots of the sketch of the keys (64-bit arrays) that ``keys_of`` makes of the Arrow batches of
    ``rows``, as a written table. ``expected`` keys choose the number of blocks: see ``blocks_for``.

    A partition sends its touched cells, block by block, with a bit for those it counted twice itself, and how often
    it counted in the block; a block is summed in one task. Blocks that no key is in are missing."""
    blocks = blocks_for(expected)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        pending, waiting = [], 0
        held = np.zeros(blocks, dtype=np.int64)

        def fold() -> None:
            nonlocal once, twice, pending, waiting
            at, n = np.unique(np.concatenate([once, twice, twice, *pending]), return_counts=True)
            once, twice, pending, waiting = at[n == 1], at[n > 1], [], 0

        for batch in batches:
            for keys in keys_of(batch):
                block = block_of(keys, blocks)
                held += np.bincount(block, minlength=blocks)
                pending += [block * (2 * CELLS) + at for at in cells_of(keys, CELLS)]
                waiting += 2 * len(keys)
            if waiting > 1_000_000:
                fold()
        fold()
        both = np.concatenate([once, twice])
        flag = np.concatenate([np.zeros(len(once), dtype=np.uint32), np.full(len(twice), 1 << 31, dtype=np.uint32)])
        order = np.argsort(both, kind="stable")
        both, flag = both[order], flag[order]
        block = both // (2 * CELLS)
        edges = np.flatnonzero(np.diff(block, prepend=-1))
        parts = np.split((both % (2 * CELLS)).astype(np.uint32) | flag, edges[1:]) if len(both) else []
        for a in range(0, len(parts), 256):
            own = block[edges[a : a + 256]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.astype(np.int32)), pa.array(held[own]), pa.array([zlib.compress(p.tobytes(), 1) for p in parts[a : a + 256]], pa.binary())],
                names=["block", "held", "payload"],
            )

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        count = np.zeros(2 * CELLS, dtype=np.uint8)
        for payload in pdf["payload"]:
            p = np.frombuffer(zlib.decompress(payload), dtype=np.uint32)
            at = p & np.uint32((1 << 31) - 1)
            count[at] = np.minimum(2, count[at] + 1 + (p >> np.uint32(31)).astype(np.uint8))
        lots = -(-int(pdf["held"].sum()) // LOT_KEYS)
        return pd.DataFrame({"block": [key[0]], "bits": [np.packbits(count > 1, bitorder="little").tobytes()], "lots": [lots]})

    parts = rows.mapInArrow(partial, "block int, held long, payload binary")
    return written(parts.groupBy("block").applyInPandas(merge, "block int, bits binary, lots int"), "sketch")


def ask(questions: DataFrame, sketch: DataFrame, answer: Callable[[np.ndarray, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``answer(bits, rows)`` for the rows of ``questions`` (block and any others), lot by lot of every block.

    Which blocks have several lots is known from a short table, one row at most for every LOT_KEYS counted keys;
    Spark broadcasts it where its size allows."""
    crowded = written(sketch.filter("lots > 1").select("block", "lots"), "crowded")
    dealt = questions.join(crowded, "block", "left")
    dealt = dealt.withColumn("lot", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("lots", F.lit(1))).cast("int")).drop("lots")
    bits = sketch.select("block", "bits", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"))

    def meet(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return answer(np.zeros(2 * CELLS // 8, dtype=np.uint8), rows.iloc[:0])
        return answer(np.frombuffer(own["bits"].iat[0], dtype=np.uint8), rows)

    keys = ["block", "lot"]
    return dealt.groupBy(keys).cogroup(bits.groupBy(keys)).applyInPandas(meet, schema)
