"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary that resolves a whole pre-token which is itself a
token. Tier two, for the others, merges bytes: a heap of candidate pairs over a doubly linked list of parts,
always taking the lowest rank, leftmost first. Results of either tier are kept in a bounded memo per worker.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from inputlens.llm.common import ranks

#: Encoded pre-tokens kept per Python worker, and the longest that is kept.
MEMO_SIZE, MEMO_CHARS = 800_000, 48


class PerfectHash:
    """Minimal perfect hash of byte strings: level by level, keys alone in their cell are placed there.

    ``find(key)`` gives the key's number from 0 to n-1, or -1 for a string that isn't a key (keys are kept
    and compared, so strangers never match).
    """

    def __init__(self, keys: list[bytes], gamma: float = 1.5):
        self.levels: list[tuple[list[int], int]] = []
        self.keys: list[bytes] = []
        left = sorted(set(keys))
        while left:
            seed, width = len(self.levels), max(1, int(gamma * len(left)))
            cells = np.fromiter((xxhash.xxh3_64_intdigest(k, seed) % width for k in left), np.int64, len(left))
            alone = np.bincount(cells, minlength=width)[cells] == 1
            table = np.full(width, -1, dtype=np.int64)
            table[cells[alone]] = len(self.keys) + np.arange(alone.sum())
            self.keys += [k for k, a in zip(left, alone, strict=True) if a]
            self.levels.append((table.tolist(), width))
            left = [k for k, a in zip(left, alone, strict=True) if not a]

    def find(self, key: bytes) -> int:
        for seed, (table, width) in enumerate(self.levels):
            at = table[xxhash.xxh3_64_intdigest(key, seed) % width]
            if at >= 0:
                return at if self.keys[at] == key else -1
        return -1


class Codec(dict):
    """Encoder and decoder of one vocabulary; as a dict, the bounded memo from pre-token to packed ids."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        vocabulary = ranks(path)
        self.split = regex.compile(pattern).findall
        self.whole = PerfectHash(list(vocabulary))
        self.ids = [vocabulary[k] for k in self.whole.keys]
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = token
        self.single = [vocabulary[bytes([b])] for b in range(256)]
        #: follow[a][b]: the token that a and b make together
        self.follow: list[dict[int, int]] = [{} for _ in self.bytes_of]
        for token, i in vocabulary.items():
            for cut in range(1, len(token)):
                a, b = vocabulary.get(token[:cut]), vocabulary.get(token[cut:])
                if a is not None and b is not None:
                    self.follow[a][b] = i

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that isn't a token: lowest-ranked adjacent pair first, leftmost on ties."""
        follow = self.follow
        part = list(map(self.single.__getitem__, piece))
        n = len(part)
        shift = n.bit_length()
        mask = (1 << shift) - 1
        # a heap entry is rank and position in one integer, ordered as the pair
        heap = [r << shift | i for i, r in enumerate([follow[a].get(b) for a, b in zip(part, part[1:])]) if r is not None]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heappop(heap)
            i, r = top & mask, top >> shift
            j, left = after[i], part[i]
            if left < 0 or j >= n or follow[left].get(part[j]) != r:
                continue
            part[i], part[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                new = follow[r].get(part[k])
                if new is not None:
                    heappush(heap, new << shift | i)
            h = before[i]
            if h >= 0:
                new = follow[part[h]].get(r)
                if new is not None:
                    heappush(heap, new << shift | h)
        return [p for p in part if p >= 0]

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        at = self.whole.find(raw)
        ids = (self.ids[at],) if at >= 0 else self.merged(raw)
        packed = pack(f"<{len(ids)}I", *ids)
        if len(piece) <= MEMO_CHARS:
            self[piece] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self) > MEMO_SIZE:
            self.clear()
        return b"".join(map(self.__getitem__, self.split(text or "")))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


@functools.cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(text: Column, path: str, pattern: str) -> Column:
    """Array of token ids of a text column; null text is empty, an empty text has no ids."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path, pattern)
        for texts in batches:
            yield pd.Series([np.frombuffer(c.encode(t), dtype="<i4") for t in texts])

    return ids(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """Bytes of an array of token ids; a null array is null. Any id order decodes, valid UTF-8 or not."""

    @F.pandas_udf("binary")
    def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path, pattern)
        for arrays in batches:
            yield pd.Series([None if a is None else c.decode(np.asarray(a, dtype="<u4").tobytes()) for a in arrays])

    return raw(ids)


def digest(text: Column, path: str, pattern: str) -> Column:
    """Struct (n_tokens, ids_sha256, decoded_sha256): the ids are made, hashed, decoded and hashed again in one
    pass, so that neither ids nor bytes leave the worker. Null text counts as empty."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(path, pattern)
        for texts in batches:
            rows = []
            for t in texts:
                packed = c.encode(t)
                rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(c.decode(packed)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return both(text)
