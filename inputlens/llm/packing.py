"""Best-fit packing of documents into fixed-size sequences by a grouping genetic algorithm.

Documents are tokenized and cut where they exceed a sequence; whole sequences need no packing. The shorter
pieces are dealt at random into groups of bounded size. Every group is evolved by several islands, each one
Spark task: an individual is a list of bins, its fitness the number of bins and then the squares of their fills. Two
parents are drawn by tournament; crossover injects whole well-filled bins of one into the other, drops the bins that
now hold an item twice, exchanges items of loose bins for displaced ones that fill them better, and puts the rest back
by best fit. Mutation empties some bins. Between epochs each island's elite migrates to the next island through
a shuffle. A group that reaches the lower bound on bins is done.

A group starts from the better of best fit and exact fill, which completes the largest item with up to three others to an
exactly full bin where it can. A group with more bins than the lower bound evolves: all its bins with room, dealt into
nests of bounded size, each with islands of its own; a few full bins join them where there is little else. The lower bound is
Martello and Toth's, so that a group whose large items can't share bins is known to be done. Bins that end exactly full are
kept at the first level; the items of all others meet once more in new groups, so that waste does not add up by group.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inputlens.llm.common import json_encoding, written

CAPACITY = 1024
#: Items of a group; items of a nest (about); islands, epochs between migrations, individuals of an island, children of
#: an epoch, size of a tournament.
GROUP_ITEMS, LOOSE_ITEMS, ISLANDS, EPOCHS, POPULATION, CHILDREN, TOURNAMENT = 32_768, 600, 2, 3, 24, 120, 3
#: Share of bins that are injected in a crossover, by falling fill; share of children that mutate; share of their bins emptied.
INJECTED, MUTANTS, EMPTIED = 0.4, 0.3, 0.06

PIECES = "row_id long, doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of every row of ``docs`` (doc_id, text): the ids of ``vocabulary`` (a ``tokenizers`` JSON file, whose
    added tokens are recognised in texts), then ``end_id``; only what is longer than ``capacity`` is cut, the remainder
    first. Null text is empty, so every row has at least one piece; null ids stay null. ``row_id`` numbers pieces; rows
    that repeat give pieces that repeat, each with its own number."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = json_encoding(vocabulary)
        number = TaskContext.get().partitionId() << 36
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encoding.encode_to_numpy(text.as_py() or "", allowed_special="all").astype("<u4", copy=False), end)
                n = -(-len(ids) // capacity)
                edges = [0, *range(len(ids) - (n - 1) * capacity, len(ids) + 1, capacity)]
                for k in range(n):
                    a, b = edges[k], edges[k + 1]
                    out.append((number, doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                    number += 1
            yield _batch(out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(cut, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in PIECES.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


class Bins:
    """One individual: items by bin, with the bins of each remaining room for best fit."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.items: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.rooms = 0  # bit r: some bin has room r

    def add(self, items: list[int]) -> None:
        self.items.append(items)
        self.room.append(self.capacity - sum(self.sizes[i] for i in items))
        self._offer(len(self.items) - 1)

    def _offer(self, b: int) -> None:
        r = self.room[b]
        self.by_room[r].append(b)
        self.rooms |= 1 << r

    def fit(self, order: list[int]) -> Bins:
        """Put each item in the fullest bin that holds it, else in a new one."""
        for i in order:
            s = self.sizes[i]
            fitting = self.rooms >> s
            if not fitting:
                self.add([i])
                continue
            r = s + (fitting & -fitting).bit_length() - 1
            b = self.by_room[r].pop()
            if not self.by_room[r]:
                self.rooms &= ~(1 << r)
            self.items[b].append(i)
            self.room[b] = r - s
            self._offer(b)
        return self

    def fill_exactly(self) -> Bins:
        """Put all items in bins: the largest left, and up to three others that fill its bin exactly, largest first. Where
        none do, the largest that fits joins it, and so on."""
        capacity, whole = self.capacity, (1 << self.capacity + 1) - 1
        left: list[list[int]] = [[] for _ in range(capacity + 1)]
        for i in range(len(self.sizes) - 1, -1, -1):
            left[self.sizes[i]].append(i)
        sizes = mirror = 0  # bit s: an item of size s is left; bit capacity - s, the same
        for s in range(capacity + 1):
            if left[s]:
                sizes, mirror = sizes | 1 << s, mirror | 1 << capacity - s

        def take(s: int) -> int:
            nonlocal sizes, mirror
            i = left[s].pop()
            if not left[s]:
                sizes, mirror = sizes & ~(1 << s), mirror & ~(1 << capacity - s)
            return i

        def pair(room: int) -> tuple[int, int] | None:
            """Two sizes that are left and sum up to ``room``, the first as large as can be."""
            both = sizes & (mirror >> capacity - room) & ((1 << room) - 1)
            while both:
                a = both.bit_length() - 1
                if 2 * a < room:
                    return None
                if 2 * a > room or len(left[a]) > 1:
                    return a, room - a
                both ^= 1 << a
            return None

        while sizes:
            items = [take(sizes.bit_length() - 1)]
            room = capacity - self.sizes[items[0]]
            while room and (fitting := sizes & (whole >> capacity - room)):
                largest = fitting.bit_length() - 1
                found = (room,) if largest == room else pair(room)
                while not found and fitting:
                    a = fitting.bit_length() - 1
                    if 3 * a < room:
                        break
                    i = take(a)
                    rest = pair(room - a)
                    left[a].append(i)
                    sizes, mirror = sizes | 1 << a, mirror | 1 << capacity - a
                    found = rest and (a, *rest)
                    fitting ^= 1 << a
                for a in found or (largest,):
                    items.append(take(a))
                    room -= a
            self.add(items)
        return self

    def score(self) -> tuple[int, int]:
        """Fewer bins first, then the larger sum of squared fills."""
        return len(self.items), -sum((self.capacity - r) ** 2 for r in self.room)

    def assigned(self) -> np.ndarray:
        out = np.empty(len(self.sizes), dtype=np.int64)
        for b, items in enumerate(self.items):
            out[items] = b
        return out


def least_bins(sizes: list[int], capacity: int) -> int:
    """Martello and Toth's lower bound on bins: for each size k, items that k does not fit beside have bins of their own,
    larger ones than half have one each, and those from k to half a bin fill what room these leave, then further bins."""
    held = np.bincount(np.asarray(sizes, dtype=np.int64), minlength=capacity + 1)
    count, total = (np.concatenate([[0], np.cumsum(v)]) for v in (held, held * np.arange(capacity + 1)))
    k, half = np.arange(capacity // 2 + 1), capacity // 2 + 1
    alone = count[-1] - count[capacity - k + 1]
    shared = count[capacity - k + 1] - count[half]
    room = shared * capacity - (total[capacity - k + 1] - total[half])
    return int((alone + shared + np.maximum(0, -((room - (total[half] - total[k])) // capacity))).max(initial=0))


def from_assignment(sizes: list[int], capacity: int, bin_of: np.ndarray) -> Bins:
    made = Bins(sizes, capacity)
    order = np.argsort(bin_of, kind="stable")
    for items in np.split(order, np.flatnonzero(np.diff(bin_of[order])) + 1):
        made.add(items.tolist())
    return made


def replace(bins: list[list[int]], free: list[int], sizes: list[int], capacity: int) -> tuple[list[list[int]], list[int]]:
    """Exchange up to two items of a bin for one or two free ones that fill it better, bin by bin, loosest first: large
    items come to rest and smaller ones, easier to place, become free."""
    free = sorted(free, key=lambda i: -sizes[i])
    for b in sorted(range(len(bins)), key=lambda b: sum(sizes[i] for i in bins[b])):
        items = bins[b]
        room = capacity - sum(sizes[i] for i in items)
        if not room or not free:
            continue
        outs = [(), *((i,) for i in items), *itertools.combinations(items[:12], 2)]
        size = np.array([sum(sizes[i] for i in o) for o in outs])
        by_size = np.array([sizes[i] for i in free])  # falling
        most = room + size
        # one free item for each way: the largest that fits
        first = np.searchsorted(-by_size, -most)
        gain = np.where(first < len(free), by_size[np.minimum(first, len(free) - 1)], 0) - size
        # two: each free item with the largest later one that fits beside it; not in place of a single one
        rest = most[:, None] - by_size
        second = np.maximum(np.searchsorted(-by_size, -rest.ravel()).reshape(rest.shape), np.arange(1, len(free) + 1))
        fits = (rest > 0) & (second < len(free)) & (np.array([len(o) for o in outs]) != 1)[:, None]
        total = np.where(fits, by_size + by_size[np.minimum(second, len(free) - 1)], 0) - size[:, None]
        total[total > room] = 0
        at = total.argmax(1)
        double = total[np.arange(len(outs)), at]
        best, k = None, int(np.maximum(gain, double).argmax())
        if max(gain[k], double[k]) > 0:
            best = (outs[k], (int(first[k]),) if gain[k] >= double[k] else (int(at[k]), int(second[k, at[k]])))
        if best:
            out, taken = best
            bins[b] = [i for i in items if i not in out] + [free[t] for t in taken]
            free = sorted([f for t, f in enumerate(free) if t not in taken] + list(out), key=lambda i: -sizes[i])
    return bins, free


def filled(bins: list[list[int]], free: list[int], sizes: list[int], capacity: int) -> Bins:
    """An individual of ``bins`` and of ``free`` items, put in by exchange and then by best fit, largest first."""
    bins, free = replace(bins, free, sizes, capacity)
    made = Bins(sizes, capacity)
    for x in bins:
        made.add(x)
    return made.fit(sorted(free, key=lambda i: -sizes[i]))


def crossover(a: Bins, b: Bins, rng: np.random.Generator) -> Bins:
    """Inject whole bins of b, fuller ones likelier, into a; bins of a that share an item with them are dissolved and
    their other items displaced."""
    order = np.argsort(b.room, kind="stable")
    weight = np.linspace(1.0, 0.05, len(order))
    take = max(1, round(INJECTED * len(order)))
    chosen = rng.choice(order, min(take, len(order)), replace=False, p=weight / weight.sum())
    injected = [list(b.items[x]) for x in chosen]
    taken = {i for x in injected for i in x}
    kept = [list(x) for x in a.items if taken.isdisjoint(x)]
    displaced = [i for x in a.items if not taken.isdisjoint(x) for i in x if i not in taken]
    return filled(injected + kept, displaced, a.sizes, a.capacity)


def mutated(a: Bins, rng: np.random.Generator) -> Bins:
    """Empty the least filled bin and a few others, and place their items anew."""
    n = len(a.items)
    gone = {int(np.argmax(a.room)), *rng.choice(n, max(1, round(EMPTIED * n))).tolist()}
    free = [i for x in gone for i in a.items[x]]
    return filled([list(x) for k, x in enumerate(a.items) if k not in gone], free, a.sizes, a.capacity)


def evolve(sizes: list[int], capacity: int, seed: tuple[int, ...], given: list[np.ndarray]) -> list[Bins]:
    """One epoch of an island, best individual first; ends early at the lower bound on bins.

    ``given`` are assignments to start from; best fit in falling order and in noisy orders fill up the population."""
    least = least_bins(sizes, capacity)
    rng = np.random.default_rng(seed)
    population = [from_assignment(sizes, capacity, g) for g in given] or [Bins(sizes, capacity).fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]))]
    while len(population) < POPULATION and min(len(p.items) for p in population) > least:
        noisy = np.array(sizes) * rng.uniform(0.7, 1.3, len(sizes))
        population.append(Bins(sizes, capacity).fit(np.argsort(-noisy).tolist()))
    population.sort(key=Bins.score)
    for _ in range(CHILDREN):
        if len(population[0].items) <= least:
            break
        a, b = (population[min(rng.integers(0, len(population), TOURNAMENT))] for _ in range(2))
        child = mutated(a, rng) if rng.random() < MUTANTS else crossover(a, b, rng)
        if child.score() < population[-1].score() and all(child.score() != p.score() for p in population):
            population[-1] = child
            population.sort(key=Bins.score)
    return population


def nests_of(made: Bins) -> np.ndarray:
    """The nest of each bin, -1 for those that stay as they are. All bins with room evolve, and full ones where that leaves a nest
    with fewer than about LOOSE_ITEMS items; none where the lower bound is reached. Neighbours by room go to different nests."""
    nest = np.full(len(made.items), -1, dtype=np.int64)
    if len(made.items) > least_bins(made.sizes, made.capacity):
        order = np.argsort(-np.array(made.room), kind="stable")
        items = np.cumsum([len(made.items[b]) for b in order])
        n = max(int(np.count_nonzero(made.room)), int(np.searchsorted(items, LOOSE_ITEMS)) + 1)
        evolving = order[:n]
        nest[evolving] = np.arange(len(evolving)) % max(1, int(items[len(evolving) - 1]) // LOOSE_ITEMS)
    return nest


def _pack(items: DataFrame, level: int, capacity: int) -> DataFrame:
    """Items with columns bin, room and offset; ``bin`` is unique within ``level``."""
    groups = max(1, math.ceil(items.count() / GROUP_ITEMS))
    columns = items.columns
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema)

    def best_fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id").reset_index(drop=True)
        sizes = pdf["length"].tolist()
        made = min(Bins(sizes, capacity).fit(sorted(range(len(sizes)), key=lambda i: -sizes[i])), Bins(sizes, capacity).fill_exactly(), key=Bins.score)
        pdf["__bin"] = made.assigned()
        pdf["__nest"] = nests_of(made)[pdf["__bin"]]
        return pdf

    def island(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        group, nest, own, epoch = int(key[0]), int(key[1]), int(key[2]), int(pdf["__epoch"].iloc[0])
        pdf = pdf.sort_values(["row_id", "__from"], kind="stable")
        home = pdf[pdf["__from"] == own].reset_index(drop=True)
        given = [p["__bin"].to_numpy() for _, p in pdf.groupby("__from")]
        best = evolve(home["length"].tolist(), capacity, (level, group, nest, own, epoch), given)[0]
        home["__bin"] = best.assigned()
        home["__bins"] = len(best.items)
        home["__epoch"] = epoch + 1
        return home

    fitted = items.withColumn("__group", F.pmod(F.xxhash64("row_id", F.lit(level)), F.lit(groups)))
    fitted = fitted.groupBy("__group").applyInPandas(best_fit, f"{kinds}, __group long, __bin long, __nest long")
    fitted = written(fitted, "fitted")
    state = "row_id long, length long, __group long, __nest long, __island int, __from int, __epoch int, __bin long, __bins long"
    own = ["__group", "__nest", "__island"]
    loose = fitted.filter("__nest >= 0")
    islands = F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("__island")
    evolved = loose.select("row_id", "length", "__group", "__nest", islands, "__bin")
    evolved = evolved.withColumns({"__from": F.col("__island"), "__epoch": F.lit(0), "__bins": F.lit(0).cast("long")})
    # few rows, much work: an own number of tasks, which Spark does not join by their bytes
    evolved = evolved.repartition(groups * ISLANDS, *own).groupBy(own).applyInPandas(island, state)
    for _ in range(EPOCHS - 1):
        # an elite stays and moves on to the next island
        to = F.explode(F.array_distinct(F.array(F.col("__island"), (F.col("__island") + 1) % ISLANDS)))
        moved = evolved.withColumn("__from", F.col("__island")).withColumn("__island", to)
        evolved = moved.repartition(groups * ISLANDS, *own).groupBy(own).applyInPandas(island, state)
    evolved = evolved.select("row_id", "__island", "__bin", "__bins")

    def winner(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__bins", "__island"], kind="stable").drop_duplicates("row_id")
        # a nest's best island comes first in all its rows: every item of the nest has its place there
        pdf = pdf.assign(__bin=pd.factorize(pd.Series(zip(pdf["__nest"], pdf["__bin"], strict=True)))[0])
        rows = pdf.sort_values(["__bin", "row_id"])
        ends = rows.groupby("__bin")["length"].cumsum()
        rows["offset"] = ends - rows["length"]
        rows["room"] = capacity - rows.groupby("__bin")["length"].transform("sum")
        rows["bin"] = (int(key[0]) << 20) + rows["__bin"]
        return rows[[*columns, "bin", "room", "offset"]]

    firm = fitted.filter("__nest < 0").withColumns({"__island": F.lit(0), "__bins": F.lit(0).cast("long")})
    return firm.unionByName(loose.drop("__bin").join(evolved, "row_id")).groupBy("__group").applyInPandas(winner, f"{kinds}, bin long, room long, offset long")


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Place pieces (row_id, unique; length; any other columns) in sequences of ``capacity`` tokens.

    Adds sequence_id and offset. Sequences never exceed the capacity and have no gaps; which items share one is
    repeatable, ties by row_id. An empty table gives an empty one. ``made`` is read several times: pass a written table."""
    whole = made.filter(F.col("length") == capacity)
    first = written(_pack(made.filter(F.col("length") < capacity), 1, capacity), "packed")
    again = _pack(first.filter("room > 0").drop("bin", "room", "offset"), 2, capacity)
    number = lambda level: F.col("bin") * 4 + level
    return (
        whole.withColumns({"sequence_id": F.col("row_id") * 4, "offset": F.lit(0).cast("long")})
        .unionByName(first.filter("room = 0").withColumn("sequence_id", number(1)).drop("bin", "room"))
        .unionByName(again.withColumn("sequence_id", number(2)).drop("bin", "room"))
    )


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    made = written(pieces(docs, vocabulary, end_id, capacity), "pieces")
    return pack(made, capacity).drop("row_id")
