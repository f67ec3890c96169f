"""Exact n-gram Jaccard self-join: which documents share at least THRESHOLD percent of their word shingles.

Two sets that similar share one of their few rarest shingles (prefix filtering under any one order of all shingles;
ours puts shingles that a count over all documents shows as frequent last). Documents with equal sets are one node.
Nodes that share such a shingle meet in a tile: a shingle and a band of sizes, since similar sets have similar
sizes. In a tile, hashed parity bitmaps of the sets bound every overlap from above by bit counts; what passes is
settled by exact intersection of the sorted sets.

Crowded shingles, as large groups of near copies make, never become all pairs: first every node of a shingle is held
against one pivot; the links that this finds are closed into components; then only pairs from different components
are still open, and only shingles with several components make tiles, split into blocks.

Which shingles two nodes share is found by a join on exact shingle hashes; nothing whose size follows the data is
broadcast. Keys that hold a large share of a table (a common shingle, a pivot, a hub of links, a set that very many
documents have) meet their partners in a broadcast of those few alone (``common.matched``).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inputlens.llm.common import discard, hashed_words, hot_keys, matched, mix, rolling, row_key, with_keys, written

#: Words of a shingle and the similarity, in percent.
SHINGLE, THRESHOLD = 5, 80
#: Cells that count how frequent shingles are, and of a block of them: shingles with more than a cell's even share of all
#: occurrences are told apart, at any size of the input; bits of a bitmap at least and at most; rows of a tile's block, and
#: of a task's tiles (about).
FREQUENCY_CELLS, FREQUENCY_BLOCK, LEAST_BITS, MOST_BITS, BLOCK_ROWS, TASK_ROWS = 1 << 23, 1 << 18, 64, 1 << 15, 1024, 40_000
#: A key whose sets are broadcast has more than one in so many of the pairs: sets are long.
FEW_SETS = 20


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text: of every ``k`` words, A-Z lowered; of all words if fewer; empty
    without words."""
    for at, to, words in hashed_words(column, (1,), lower=True):
        grams = rolling(words.hashes[0], k)
        for i in range(to - at):
            a, b = words.bounds[i], words.bounds[i + 1]
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                yield rolling(words.hashes[0][a:b], int(b - a)) + np.uint64(b - a)
            else:
                yield grams[:0]


def node_of(s: np.ndarray) -> int:
    """Digest of a set, as a signed 64-bit number."""
    return int(np.array(xxhash.xxh3_64_intdigest(s.tobytes(), len(s)), dtype=np.uint64).view(np.int64))


def prefix(s: np.ndarray, levels: np.ndarray, threshold: int) -> np.ndarray:
    """The rarest shingles of a set, as many as every similar set must share one of."""
    n = len(s)
    take = n - -(-threshold * n // 100) + 1 if n else 0
    order = np.lexsort((s, levels[s & np.uint64(len(levels) - 1)]))
    return s[order[:take]]


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parity of the number of elements hashed to each bit; twice as many bits as elements, as a power of two."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(s) - 1).bit_length()))
    counts = np.bincount((mix(s) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little")


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of fewer bits (bytes ``size``, a power of two less): parities of its parts, added."""
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def possible(total: np.ndarray, apart: np.ndarray, threshold: int) -> np.ndarray:
    """Whether sets with sizes adding to ``total`` can be similar if their bitmaps differ in ``apart`` bits: each
    such bit is an element of one set only, so |A and B| <= (total - apart) / 2."""
    return (total - apart) // 2 * (100 + threshold) >= threshold * total


def similar(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    """Exact, by intersection of the sorted arrays."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= threshold * (len(a) + len(b) - both)


def profile(docs: DataFrame, k: int) -> DataFrame:
    """One pass over the texts: for each row its id, hash, set size, node and bitmap; and from each partition the
    counts of shingles by cell, as blocks (block, payload). Cells counted once in a partition are left out: the
    counts only order shingles, and any order is right."""
    names = ["doc_id", "row_hash", "n", "node", "bits", "block", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(FREQUENCY_CELLS, dtype=np.uint32)
        for batch in batches:
            sizes, nodes, bits = [], [], []
            for s in shingle_sets(batch.column(1), k):
                sizes.append(len(s))
                nodes.append(node_of(s))
                bits.append(bitmap(s).tobytes() if len(s) else b"")
                at = (s & np.uint64(FREQUENCY_CELLS - 1)).astype(np.int64)
                counts[at] += 1  # elements are distinct; two in one cell count once
            n = len(sizes)
            columns = [batch.column(0), batch.column(2), sizes, nodes, bits, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)
        for block in range(FREQUENCY_CELLS // FREQUENCY_BLOCK):
            part = counts[block * FREQUENCY_BLOCK : (block + 1) * FREQUENCY_BLOCK]
            at = np.flatnonzero(part > 1)
            if len(at):
                payload = zlib.compress(np.stack([at.astype(np.uint32), part[at].astype(np.uint32)]).tobytes(), 1)
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in kinds[:5]], pa.array([block], pa.int32()), pa.array([payload])], names=names)

    rows = docs.select(F.col("doc_id").cast("long"), "text", row_key()["hash"].alias("row_hash"))
    return written(rows.mapInArrow(scan, "doc_id long, row_hash long, n int, node long, bits binary, block int, payload binary"), "profile")


def frequency_levels(profiled: DataFrame) -> np.ndarray:
    """Half powers of two of the shingle counts by cell, over all documents: a byte a cell, FREQUENCY_CELLS bytes."""

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.ones(FREQUENCY_BLOCK)
        for payload in pdf["payload"]:
            at, n = np.frombuffer(zlib.decompress(payload), dtype=np.uint32).reshape(2, -1)
            total[at] += n
        levels = np.floor(2 * np.log2(total)).astype(np.uint8)
        return pd.DataFrame({"block": [key[0]], "payload": [zlib.compress(levels.tobytes(), 1)]})

    parts = profiled.filter("block IS NOT NULL").select("block", "payload").groupBy("block").applyInPandas(add, "block int, payload binary")
    levels = np.zeros(FREQUENCY_CELLS, dtype=np.uint8)
    for block, payload in parts.collect():
        levels[block * FREQUENCY_BLOCK : (block + 1) * FREQUENCY_BLOCK] = np.frombuffer(zlib.decompress(bytes(payload)), dtype=np.uint8)
    return levels


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, label for every node of ``edges`` (a, b): labels are equal exactly within a connected component.

    Every round a node takes the smallest label around it and then that label's own label, until none changes;
    labels and edges are written tables, and only labels move."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-labels")
    hubs = hot_keys(both, ["b"])
    while True:
        around = matched(both, labels.withColumnRenamed("node", "b"), ["b"], hot=hubs).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        new = labels.join(around, "node").select("node", F.least("label", "near").alias("near"), F.col("label").alias("old"))
        new = written(new, f"{name}-near")
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        after = matched(new, jump, ["near"], "left").select("node", F.least("near", "far").alias("label"), "old")
        after = written(after, f"{name}-labels")
        changed = after.filter("label <> old").limit(1).count()
        discard(new, labels)
        labels = after.select("node", "label")
        if not changed:
            discard(both)
            return labels


def sets_of(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node and elements of the sets of ``nodes`` (node, doc_id, row_hash: a row that has the set), as a written table.
    Only texts of those rows are hashed again."""
    keyed = docs.select("text", row_key().alias("key")).select("text", "key.id", "key.hash")
    wanted = nodes.select(F.coalesce("doc_id", F.lit(-1)).alias("id"), F.col("row_hash").alias("hash"), "node")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                sets = [s.tobytes() for s in shingle_sets(part.column(0), k)]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(sets, pa.binary())], names=["node", "elements"])

    rows = keyed.join(wanted, ["id", "hash"]).dropDuplicates(["node"]).select("text", "node")
    return written(rows.mapInArrow(scan, "node long, elements binary"), "sets")


def bounded(pairs: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """Those of the pairs (a, b) whose bitmaps allow the similarity; ``nodes`` has node, n, bits. Many pairs may have
    one a."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col("bits").alias("x"))
    right = nodes.select(F.col("node").alias("b"), "n", F.col("bits").alias("y"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = np.zeros(batch.num_rows, dtype=np.int64)
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint8) for v in (x, y))
                size = min(len(x), len(y))
                apart[i] = np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()
            total = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(possible(total, apart, threshold)))

    rows = matched(pairs, left, ["a"], most=FEW_SETS).join(right, "b").select("a", "b", "m", "n", "x", "y")
    return rows.mapInArrow(bound, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Those of the pairs (a, b), a written table, whose ``sets`` are similar, as a written table. Many pairs may have
    one a."""
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), threshold) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = matched(pairs, left, ["a"], most=FEW_SETS).join(right, "b").select("a", "b", "x", "y")
    return written(joined.mapInArrow(settle, "a long, b long"), "links")


def tile_pairs(rows: DataFrame, bitmaps: DataFrame, threshold: int) -> DataFrame:
    """Candidate pairs (a, b) among rows (token, node, label, n): same token, different labels, sizes and
    bitmaps that allow the similarity.

    A node stands in the tile of its size band, and in that of the next band for the larger sets there. A tile
    of more than BLOCK_ROWS rows is dealt into blocks; every pair of blocks is an item of work, and items are
    gathered into tasks of about TASK_ROWS rows."""
    width = math.log(100 / threshold) or 1.0
    band = F.floor(F.log(F.col("n").cast("double")) / width).cast("int")
    placed = rows.withColumns({"band": F.explode(F.array(band, band + 1)), "own": band})
    placed = placed.withColumn("lower", F.col("band") > F.col("own")).drop("own")
    sizes = placed.groupBy("token", "band").agg(F.count(F.lit(1)).alias("held"), F.min("lower").alias("all_lower"), F.min("label").alias("l"), F.max("label").alias("m"))
    sizes = sizes.filter((F.col("l") != F.col("m")) & ~F.col("all_lower")).select("token", "band", F.ceil(F.col("held") / BLOCK_ROWS).cast("int").alias("blocks"))
    tiles = matched(written(placed, "placed"), sizes, ["token", "band"])
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # a row of block s works with all blocks: pair (min, max) of s and each other block
    tiles = tiles.withColumn("mine", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    tiles = tiles.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")})
    tiles = written(tiles.select("token", "band", "i", "j", "mine", "lower", "node", "label", "n"), "tiles")
    tasks = max(1, math.ceil(tiles.count() / TASK_ROWS))

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["token", "band", "i", "j"], kind="stable")
        cut = np.flatnonzero((np.diff(pdf[["token", "band", "i", "j"]].to_numpy(), axis=0) != 0).any(1)) + 1
        raw = pdf["bits"].to_numpy()
        node, label, size = (pdf[c].to_numpy() for c in ("node", "label", "n"))
        lower, mine, i, j = (pdf[c].to_numpy() for c in ("lower", "mine", "i", "j"))
        edges = [0, *cut.tolist(), len(pdf)]
        out = []
        for a, b in zip(edges, edges[1:], strict=False):
            width = min(map(len, raw[a:b]), default=0)
            bits = np.stack([folded(np.frombuffer(v, np.uint8), width) for v in raw[a:b]]).view(np.uint64)
            for r in range(a, b):
                # a row meets those after it in its block pair; in a pair of two blocks only the other block's
                t = np.arange(r + 1, b)
                if not len(t):
                    break
                ok = (label[t] != label[r]) & ~(lower[t] & lower[r])
                if i[r] != j[r]:
                    ok &= mine[t] != mine[r]
                t = t[ok]
                small, large = np.minimum(size[t], size[r]), np.maximum(size[t], size[r])
                t = t[100 * small >= threshold * large]
                if len(t):
                    apart = np.bitwise_count(bits[t - a] ^ bits[r - a]).sum(1).astype(np.int64)
                    t = t[possible(size[t].astype(np.int64) + size[r], apart, threshold)]
                    out.append(np.stack([np.minimum(node[t], node[r]), np.maximum(node[t], node[r])], 1))
        pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), dtype=np.int64)
        return pd.DataFrame(pairs, columns=["a", "b"])

    bucket = F.pmod(F.xxhash64("token", "band", "i", "j"), F.lit(tasks))
    return tiles.join(bitmaps, "node").groupBy(bucket.alias("task")).applyInPandas(meet, "a long, b long").distinct()


def _repeated(rows: DataFrame) -> DataFrame:
    """token and times of the tokens that have more than one of the rows."""
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")


def links(docs: DataFrame, profiled: DataFrame, k: int, threshold: int) -> DataFrame:
    """node, label of the nodes that a link of similarity joins to another node; equal labels are connected."""
    levels = docs.sparkSession.sparkContext.broadcast(frequency_levels(profiled))

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                tokens, nodes, sizes = [], [], []
                for s in shingle_sets(batch.column(0).slice(a, 500), k):
                    p = prefix(s, levels.value, threshold)
                    tokens.append(p.view(np.int64))
                    nodes.append(np.full(len(p), node_of(s), dtype=np.int64))
                    sizes.append(np.full(len(p), len(s), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (tokens, nodes, sizes)], names=["token", "node", "n"])

    every = written(docs.select("text").mapInArrow(postings, "token long, node long, n int"), "postings")
    # first shingles that stand twice at all, then, with equal sets as one, those that two sets share: counts alone are
    # half as wide in the shuffle as what would tell both at once
    twice = written(_repeated(every), "twice")
    some = written(with_keys(every, twice, ["token"], "times").dropDuplicates(["token", "node"]), "some")
    discard(every, twice)
    shared = written(_repeated(some), "tokens")
    rows = written(with_keys(some, shared, ["token"], "times"), "shared")
    discard(some, shared)
    # a shingle's pivot is its node with the largest share of rare shingles that others have too: in a group of
    # edited copies that is the text they come from, which is nearer to each than they are to each other
    taken = F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1
    shares = rows.groupBy("node").agg((F.count(F.lit(1)) / F.first(taken)).alias("share"))
    central = F.max_by(F.struct(F.col("node").alias("pivot"), F.col("n").alias("pivot_n")), F.struct("share", -F.col("node")))
    pivots = written(rows.join(shares, "node").groupBy("token").agg(central.alias("p")).select("token", "p.*"), "pivots")
    held = matched(rows, pivots, ["token"])
    fits = 100 * F.least("n", "pivot_n") >= threshold * F.greatest("n", "pivot_n")
    pairs = held.filter(fits & (F.col("node") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    nodes = profiled.filter("n > 0").join(rows.select("node").distinct(), "node", "left_semi")
    row = F.min(F.struct("doc_id", "row_hash"))
    nodes = nodes.groupBy("node").agg(row.alias("row"), F.first("n").alias("n"), F.first("bits").alias("bits")).select("node", "row.*", "n", "bits")
    nodes = written(nodes, "nodes")
    sets = sets_of(docs, nodes, k)
    first = verified(written(bounded(written(pairs, "held"), nodes, threshold), "pairs"), sets, threshold)
    labels = components(first, "first")
    # open pairs: of a shingle whose nodes are in several components
    open_rows = rows.select("token", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_rows = written(open_rows, "open")
    # neighbouring shingles of a shared passage have the same nodes: one shingle of each set of nodes is enough
    mixed = open_rows.groupBy("token").agg(
        F.min("label").alias("l"), F.max("label").alias("m"), F.count(F.lit(1)).alias("held"), F.min("node").alias("u"),
        F.max("node").alias("v"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64("node", F.lit(1)).bitwiseAND(0x7FFFFFFF)).alias("s"),
    )
    tokens = mixed.filter("l <> m").groupBy("held", "u", "v", "x", "s").agg(F.min("token").alias("token"), F.first("held").alias("times"))
    tokens = written(tokens.select("token", "times"), "open-tokens")
    some = with_keys(open_rows, tokens, ["token"], "times").join(nodes.select("node", "n"), "node")
    pairs = tile_pairs(some, nodes.select("node", "bits"), threshold)
    second = verified(written(pairs, "pairs"), sets, threshold)
    labels = components(first.unionByName(second), "all")
    discard(rows, pivots, nodes, sets, first, second, open_rows, tokens)
    return labels


def labelled_rows(docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """doc_id, row_hash, n, node and label of every row of ``docs``: rows with words are linked exactly when their
    labels are equal, whatever their ids; rows without words have no label."""
    profiled = profile(docs, k)
    labels = links(docs, profiled, k, threshold)
    rows = written(profiled.filter("block IS NULL").select("doc_id", "row_hash", "n", "node"), "rows")
    discard(profiled)
    linked = matched(rows.filter("n > 0"), labels, ["node"], "left").withColumn("label", F.coalesce("label", "node"))
    alone = rows.filter("n = 0").withColumn("label", F.lit(None).cast("long"))
    columns = ["doc_id", "row_hash", "n", "node", "label"]
    return written(linked.select(columns).unionByName(alone.select(columns)), "labelled")


def similar_groups(docs: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, row_hash, n_shingles and component_id for every row of ``docs`` (doc_id, text).

    n_shingles is the size of the row's set; component_id the smallest id reachable by links, itself included. Rows
    without words (or null) have an empty set and no links; rows that repeat have equal sets, which link; null ids
    never name a component unless all ids in it are null. Sets are identified by their size and a 64-bit digest.
    An empty table gives none; texts count whole, at any length."""
    rows = labelled_rows(docs, k, threshold)
    names = written(rows.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("component_id")), "names")
    linked = matched(rows.filter("n > 0"), names, ["label"])
    alone = rows.filter("n = 0").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "row_hash", F.col("n").cast("long").alias("n_shingles"), "component_id"]
    return linked.select(columns).unionByName(alone.select(columns))


def one_of_each(docs: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` (doc_id, text and any others) with one row of each group: that of the smallest id, a null one last.
    Groups are told apart by their links, not by an id, which may be null or occur with several texts. Rows without
    words stay; of rows that repeat (id and text) one stays."""
    rows = labelled_rows(docs, k, threshold)
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(-1)).alias("id"), F.col("row_hash").alias("hash"))
    named = rows.filter("n > 0").groupBy("label").agg(F.min(key).alias("k")).select("k")
    kept = named.unionByName(rows.filter("n = 0").select(key.alias("k")).distinct())
    kept = kept.select(F.col("k.id").alias("__il_id"), F.col("k.hash").alias("__il_hash"))
    keyed = docs.withColumn("__il_row", row_key()).withColumns({"__il_id": F.col("__il_row.id"), "__il_hash": F.col("__il_row.hash")})
    return keyed.join(kept, ["__il_id", "__il_hash"], "left_semi").dropDuplicates(["__il_id", "__il_hash"]).select(docs.columns)
