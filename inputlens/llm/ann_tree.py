"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The upper tree is fitted on a bounded sample and has a bounded number of leaves. Every row is indexed: it descends to
a leaf, and the rows of a leaf, or of a part of it where it holds many, are split further by a tree of their own, in the
task that holds them. So leaves stay small at any number of rows, while what all executors share does not grow.

A query walks the upper tree through a priority queue, the open node whose centre has the largest inner product with it
first, until it has visited as many leaves as calibration asks for. In the trees below it opens nodes whose centre's
product, divided by the query's length, reaches a level that calibration sets too, and goes on to the next best of them while
they hold fewer rows than a result has. Calibration compares with exact
neighbours, over all rows, of a bounded sample of queries, and widens visits and level until their recall is reached.

Neighbouring leaves are searched together, a query bringing the list of those it visits, so that a query has one short
result for each group and not for each leaf.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inputlens.llm.common import matched, written

#: Rows that the upper tree is fitted on at most (about), children of a node, rows of a leaf aimed at (in all trees),
#: leaves of the upper tree at most.
SAMPLE_ROWS, BRANCHES, LEAF_ROWS, UPPER_LEAVES = 65_536, 8, 16, 4096
#: Queries of the calibration at most (about), recall that it must reach, rows of a searched block at most (about).
CALIBRATION_QUERIES, RECALL, BLOCK_ROWS = 200, 0.94, 8192
ROUNDS = 8
#: Queries whose way through the upper tree is found at once.
WALKED = 256


@dataclass
class Tree:
    """Nodes in order of creation: centre, children (empty for a leaf), and a leaf's number."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: list[int]

    @property
    def leaves(self) -> int:
        return sum(i >= 0 for i in self.leaf)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: at every node to the nearest child centre."""
        out = np.zeros(len(x), dtype=np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
                continue
            c = self.centres[kids]
            near = (x[rows] @ c.T - 0.5 * (c**2).sum(1)).argmax(1)
            todo += [(kid, rows[near == i]) for i, kid in enumerate(kids) if (near == i).any()]
        return out

    def level(self, query: np.ndarray) -> np.ndarray:
        """For each leaf the highest level that opens it: the least product of the query's direction with a centre on
        the way."""
        near = self.centres @ unit(query)
        out, todo = np.zeros(self.leaves), [(0, math.inf)]
        while todo:
            node, level = todo.pop()
            if not self.children[node]:
                out[self.leaf[node]] = level
            todo += [(kid, min(level, near[kid])) for kid in self.children[node]]
        return out

    def order(self, queries: np.ndarray) -> np.ndarray:
        """Leaves in best-bin-first order, a row for each query. A leaf's turn comes when the worst node on its way is the best open one,
        so leaves go by that node's product; those behind the same node by their own."""
        out = np.empty((len(queries), self.leaves), dtype=np.int32)
        at = np.empty(self.leaves, dtype=np.int64)
        for node, leaf in enumerate(self.leaf):
            if leaf >= 0:
                at[leaf] = node
        for a in range(0, len(queries), WALKED):
            near = self.centres @ queries[a : a + WALKED].T
            worst = near.copy()
            worst[0] = np.inf
            for node, kids in enumerate(self.children):  # a node comes before its children
                if kids:
                    worst[kids] = np.minimum(worst[node], near[kids])
            for i in range(near.shape[1]):
                out[a + i] = np.lexsort((-near[at, i], -worst[at, i]))
        return out

    def opened(self, query: np.ndarray, level: float) -> list[int]:
        """Leaves that best-bin-first search visits until the best open node is below the level; the first one always."""
        near = (self.centres @ unit(query)).tolist()
        queue, out = [(-math.inf, 0)], []
        while queue and (-queue[0][0] >= level or not out):
            _, node = heappop(queue)
            if not self.children[node]:
                out.append(self.leaf[node])
            for kid in self.children[node]:
                heappush(queue, (-near[kid], kid))
        return out


def unit(query: np.ndarray) -> np.ndarray:
    return query / np.linalg.norm(query)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of Lloyd's iterations; fewer than ``k`` if rows coincide."""
    centres = np.unique(x[rng.choice(len(x), min(k, len(x)), replace=False)], axis=0)
    for _ in range(ROUNDS):
        near = (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        centres = np.stack([x[near == i].mean(0) for i in range(len(centres)) if (near == i).any()])
    return centres


def grow(x: np.ndarray, leaves: int, seed: int = 11) -> Tree:
    """Split the largest leaf until there are ``leaves``, or none can be split."""
    rng = np.random.default_rng(seed)
    centres, children, rows = [x.mean(0)], [[]], [np.arange(len(x))]
    open_leaves, n = [(-len(x), 0)], 1
    while open_leaves and n < leaves:
        _, node = heappop(open_leaves)
        own = x[rows[node]]
        if len(own) < 2:
            continue
        found = k_means(own, min(BRANCHES, leaves - n + 1), rng)
        if len(found) < 2:
            continue
        near = (own @ found.T - 0.5 * (found**2).sum(1)).argmax(1)
        for i, c in enumerate(found):
            centres.append(c)
            children.append([])
            rows.append(rows[node][near == i])
            children[node].append(len(centres) - 1)
            heappush(open_leaves, (-len(rows[-1]), len(centres) - 1))
        n += len(found) - 1
    numbers = iter(range(n))
    return Tree(np.array(centres), children, [next(numbers) if not kids else -1 for kids in children])


def grouped(sizes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Group of each leaf, neighbours together up to ``rows`` rows, and the number of blocks of each leaf's group:
    a leaf of more rows is a group by itself, of several blocks."""
    group, blocks, held, g = np.zeros(len(sizes), dtype=np.int64), np.ones(len(sizes), dtype=np.int64), 0, 0
    for leaf, size in enumerate(sizes.tolist()):
        if held and held + size > rows:
            g, held = g + 1, 0
        group[leaf], blocks[leaf] = g, max(1, -(-size // rows))
        held += size
    return group, blocks


class Lower:
    """The trees below the upper leaves of a block's rows."""

    def __init__(self, x: np.ndarray, leaf: np.ndarray):
        self.trees = []
        for own in np.unique(leaf).tolist():
            rows = np.flatnonzero(leaf == own)
            tree = grow(x[rows], max(1, len(rows) // LEAF_ROWS)) if len(rows) > 2 * LEAF_ROWS else None
            lower = tree.assign(x[rows]) if tree else np.zeros(len(rows), dtype=np.int32)
            self.trees.append((own, rows, tree, lower))
        self.leaf, self.flat = leaf, all(tree is None for _, _, tree, _ in self.trees)

    def visited(self, query: np.ndarray, leaves: set[int] | None, level: float, others: np.ndarray, k: int) -> np.ndarray:
        """Rows below the given upper leaves (all) in lower leaves that the level opens; and, while fewer than ``k`` of them are
        ``others`` (a flag for each row of the block), in the next best lower leaves of all those trees, through one queue."""
        if self.flat:  # no tree to open: all rows of the leaves
            return np.arange(len(self.leaf)) if leaves is None else np.flatnonzero(np.isin(self.leaf, list(leaves)))
        out, queue, held = [], [], 0
        for own, rows, tree, lower in self.trees:
            if leaves is not None and own not in leaves:
                continue
            open_ = [] if tree is None else tree.opened(query, level)
            some = rows if tree is None else rows[np.isin(lower, open_)]
            out.append(some)
            held += int(others[some].sum())
            if tree is not None:
                queue.append((tree, rows, lower, set(open_)))
        if held < k and queue:
            left = [(-near, t, leaf) for t, (tree, _, _, open_) in enumerate(queue) for leaf, near in enumerate(tree.level(query).tolist()) if leaf not in open_]
            heapify(left)
            while left and held < k:
                _, t, leaf = heappop(left)
                _, rows, lower, _ = queue[t]
                out.append(rows[lower == leaf])
                held += int(others[out[-1]].sum())
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)

    def levels(self, query: np.ndarray, n: int) -> np.ndarray:
        """For each of the block's rows the level at which the query opens its lower leaf."""
        out = np.full(n, np.inf)
        for _, rows, tree, lower in self.trees:
            if tree is not None:
                out[rows] = tree.level(query)[lower]
        return out


def matrix(column: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def exact_scores(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products added from the first component to the last, alike wherever a row stands."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * query[d]
    return out


def nearest(ids: np.ndarray, x: np.ndarray, norms: np.ndarray, query: np.ndarray, rough: np.ndarray, own: int, k: int, here: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and exact scores of the k nearest, ties to smaller ids; ``rough`` are the products in any order of adding,
    ``norms`` the rows' lengths, ``here`` the rows in question (all)."""
    other = np.flatnonzero(ids != own) if here is None else here[ids[here] != own]
    if len(other) > k:
        # a sum of d products is wrong by less than d * eps * |x| * |query|, whatever the order
        slack = 2 * (x.shape[1] + 2) * np.finfo(float).eps * norms[other] * np.linalg.norm(query)
        least = np.partition(rough[other] - slack, len(other) - k)[len(other) - k]
        other = other[rough[other] + slack >= least]
    scores = exact_scores(x[other], query)
    best = np.lexsort((ids[other], -scores))[:k]
    return other[best], scores[best]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding as doubles, without null ids and without vectors that are null, zero or hold null or
    non-finite components."""
    fine = F.forall("embedding", lambda e: e.isNotNull() & (F.abs(e.cast("double")) < float("inf"))) & F.exists("embedding", lambda e: e != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def share(n: int, most: int) -> Column:
    """True for about ``most`` of ``n`` rows, by the hash of their id."""
    return F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 30)) < min(1 << 30, math.ceil(most / max(1, n) * (1 << 30)))


def search(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score, rows_scored: for every query row the k rows found with the largest inner product,
    without rows of its own id; ties to smaller vec_id. All rows if fewer than k. ``rows_scored`` is the number of rows
    compared with the query in the block where a row was found. A shorter vector's missing components
    count as 0; rows that repeat take part as often as they are; empty input gives no rows."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double, rows_scored long"
    rows = usable(vectors)
    n, nq, dims = rows.agg(F.count(F.lit(1)), F.count_if(is_query), F.max(F.size("embedding"))).first()
    if not nq:
        return spark.createDataFrame([], schema)
    sample = rows.filter(share(n, SAMPLE_ROWS)).toPandas().sort_values("vec_id")
    leaves = max(1, min(UPPER_LEAVES, n // LEAF_ROWS))
    tree = grow(matrix(sample["embedding"], dims), leaves) if len(sample) else Tree(np.zeros((1, dims)), [[]], [0])
    shared = spark.sparkContext.broadcast(tree)

    def descend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(leaf=shared.value.assign(matrix(pdf["embedding"], dims)))

    indexed = written(rows.mapInPandas(descend, "vec_id long, embedding array<double>, leaf int"), "tree")
    sizes = np.zeros(tree.leaves, dtype=np.int64)
    for leaf, size in indexed.groupBy("leaf").count().collect():  # at most UPPER_LEAVES rows
        sizes[leaf] = size
    group, blocks = grouped(sizes, BLOCK_ROWS)
    of_leaf = lambda values: F.element_at(F.lit(values.tolist()), F.col("leaf") + 1).cast("long")
    number = F.monotonically_increasing_id()
    dealt = indexed.withColumns({"group": of_leaf(group), "block": F.pmod(F.xxhash64(number), of_leaf(blocks))})
    dealt = written(dealt, "dealt")
    visits, level = calibrate(dealt, is_query, nq, tree, dims, k, recall)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            queries = matrix(pdf["embedding"], dims)
            for row, own, copies, v, turn in zip(pdf["query_row"], pdf["vec_id"], pdf["copies"], queries, shared.value.order(queries), strict=True):
                enough = int(np.searchsorted(np.cumsum(sizes[turn]), k + copies)) + 1
                near = turn[: max(visits, enough)]
                near = near[np.argsort(group[near], kind="stable")]
                for leaves in np.split(near, np.flatnonzero(np.diff(group[near])) + 1):
                    out += [(row, own, v, leaves, group[leaves[0]], b) for b in range(blocks[leaves[0]])]
            yield pd.DataFrame(out, columns=["query_row", "query_id", "query", "leaves", "group", "block"])

    # rows of a query's own id are no candidates, so that many more are needed
    asked = dealt.filter(is_query)
    copies = asked.groupBy("vec_id").agg(F.count(F.lit(1)).alias("copies"))
    asked = matched(asked, copies, ["vec_id"]).select(number.alias("query_row"), "vec_id", "embedding", "copies")
    asked = asked.mapInPandas(walk, "query_row long, query_id long, query array<double>, leaves array<int>, group long, block long")

    def scan(block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(block) and len(queries):
            block = block.sort_values("vec_id", kind="stable")
            ids, x, q = block["vec_id"].to_numpy(), matrix(block["embedding"], dims), matrix(queries["query"], dims)
            lower, norms = Lower(x, block["leaf"].to_numpy()), np.linalg.norm(x, axis=1)
            for i, (row, own, leaves) in enumerate(zip(queries["query_row"], queries["query_id"], queries["leaves"], strict=True)):
                here = lower.visited(q[i], set(leaves.tolist()), level, ids != own, k)
                if i % WALKED == 0:
                    products = x @ q[i : i + WALKED].T
                rough = products[:, i % WALKED]
                best, scores = nearest(ids, x, norms, q[i], rough, own, k, here)
                found.append((np.full(len(best), row), np.full(len(best), own), ids[best], scores, np.full(len(best), len(here))))
        parts = [np.concatenate(c) for c in zip(*found, strict=True)] or [np.zeros(0, t) for t in ("i8", "i8", "i8", "f8", "i8")]
        return pd.DataFrame(dict(zip(("query_row", "query_id", "vec_id", "score", "rows_scored"), parts, strict=True)))

    keys = ["group", "block"]
    partial = dealt.groupBy(keys).cogroup(asked.groupBy(keys)).applyInPandas(scan, "query_row long, query_id long, vec_id long, score double, rows_scored long")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    ranked = partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", "rows_scored")


def calibrate(dealt: DataFrame, is_query: Column, nq: int, tree: Tree, dims: int, k: int, recall: float) -> tuple[int, float]:
    """Fewest visits of upper leaves, and then the highest level below them, at which the sampled queries find their
    exact neighbours, among all rows, to ``recall``. Either may lose half of what recall leaves.

    A neighbour is found if its upper leaf is visited and its lower leaf opened."""
    sample = dealt.filter(is_query & share(nq, CALIBRATION_QUERIES)).select("vec_id", "embedding").toPandas()
    if not len(sample):
        return tree.leaves, -math.inf
    queries, own = matrix(sample["embedding"], dims), sample["vec_id"].to_numpy()

    def best(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        ids, x, leaf = pdf["vec_id"].to_numpy(), matrix(pdf["embedding"], dims), pdf["leaf"].to_numpy()
        lower, norms, found = Lower(x, leaf), np.linalg.norm(x, axis=1), []
        for i, q in enumerate(queries):
            at, scores = nearest(ids, x, norms, q, x @ q, own[i], k)
            found.append(pd.DataFrame({"i": i, "vec_id": ids[at], "score": scores, "leaf": leaf[at], "level": lower.levels(q, len(x))[at]}))
        return pd.concat(found)

    order = Window.partitionBy("i").orderBy(F.desc("score"), "vec_id")
    true = dealt.groupBy("group", "block").applyInPandas(best, "i int, vec_id long, score double, leaf int, level double")
    true = true.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("i", "leaf", "level").toPandas()
    if not len(true):
        return tree.leaves, -math.inf
    place = np.zeros((len(queries), tree.leaves), dtype=np.int64)
    np.put_along_axis(place, tree.order(queries).astype(np.int64), np.arange(tree.leaves)[None, :], axis=1)
    needed = place[true["i"].to_numpy(), true["leaf"].to_numpy()] + 1
    level = true["level"].to_numpy()
    split = np.isfinite(level).any()  # without lower trees the visits alone decide
    visits = int(np.sort(needed)[math.ceil(((1 + recall) / 2 if split else recall) * len(needed)) - 1])
    if not split:
        return visits, -math.inf
    within = np.sort(level[needed <= visits])[::-1]
    return visits, float(within[min(len(within), math.ceil(recall * len(needed))) - 1])
