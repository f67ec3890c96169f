"""Vector operators: exact top-k by bit slices, approximate neighbours by tree."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from inputlens.llm import ann_tree, topk_bitslice

SCHEMA = "vec_id long, embedding array<float>, rank string, score int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], SCHEMA)


def sample(n, dims=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims)).astype("f4")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[n // 2 : n // 2 + n // 5] = x[0]  # one very common vector
    return [(i, [float(e) for e in v]) for i, v in enumerate(x)]


ODD = [
    (9001, None), (None, [0.5] * 16), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] * 16),
    (9005, [float("inf")] + [0.0] * 15), (9006, []), (9000, [0.25] * 16), (9000, [0.25] * 16), (9007, [0.5, 0.5]),
]


def brute(rows, step, k, score):
    out = set()
    for own, q in rows:
        if own % step == 0:
            best = sorted((-score(q, v), i) for i, v in rows if i != own)[:k]
            out |= {(own, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def padded(v):
    return list(v) + [0.0] * (16 - len(v))


@pytest.mark.parametrize("rows,queries", [(16_384, 2048), (70, 3)])
def test_top_k_is_exact(spark, monkeypatch, rows, queries):
    monkeypatch.setattr(topk_bitslice, "ROWS", rows)
    monkeypatch.setattr(topk_bitslice, "QUERIES", queries)
    data = sample(400) + ODD
    fine = [(i, [math.floor(256 * e) for e in padded(v)]) for i, v in data if i is not None and v is not None and all(e is not None and math.isfinite(e) for e in v)]
    got = topk_bitslice.top_k(vectors(spark, data), F.col("vec_id") % 50 == 0).collect()
    assert {tuple(r) for r in got} == brute(fine, 50, 5, lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)))


def test_top_k_with_few_rows(spark):
    data = [(0, [1.0, -2.0]), (1, [1.0, 0.5]), (2, [-3.0, 0.0])]
    got = {tuple(r) for r in topk_bitslice.top_k(vectors(spark, data), F.col("vec_id") == 0).collect()}
    assert got == {(0, 1, 1, 256 * 256 - 512 * 128), (0, 2, 2, -768 * 256)}
    assert topk_bitslice.top_k(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("large", [2.0**20, 3.0e38])
def test_top_k_keeps_large_components(spark, monkeypatch, large):
    monkeypatch.setattr(topk_bitslice, "ROWS", 70)
    data = sample(200) + [(1000, [large] * 16), (1050, [-large] + [0.5] * 15), (1001, [0.0] * 15 + [large]), (1002, [-large] * 16)]
    vecs = vectors(spark, data)
    whole = [(i, [math.floor(256 * e) for e in v]) for i, v in ((r.vec_id, r.embedding) for r in vecs.collect())]
    want = brute(whole, 50, 5, lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)))
    got = topk_bitslice.top_k(vecs, F.col("vec_id") % 50 == 0).collect()
    assert {tuple(r) for r in got} == {(q, r, i, s if abs(s) < 2**63 else None) for q, r, i, s in want}


def test_top_k_sums_of_many_dimensions(spark):
    v = [(i, [(2.0**20 - 1 - i)] * 200) for i in range(9)]
    got = topk_bitslice.top_k(vectors(spark, v), F.col("vec_id") == 0).collect()
    scores = {i: sum(int(256 * a) * int(256 * b) for a, b in zip(v[0][1], x, strict=True)) for i, x in v}
    assert {tuple(r) for r in got} == {(0, i, i, scores[i] if scores[i] < 2**63 else None) for i in range(1, 6)}


@pytest.mark.parametrize("upper,recall", [(4096, 0.94), (4096, 1.0), (4, 0.94), (4, 1.0)])
def test_tree_search(spark, monkeypatch, upper, recall):
    """With trees below the upper leaves and without; calibrated on all queries, recall 1 leaves no neighbour out."""
    if upper == 4:
        monkeypatch.setattr(ann_tree, "UPPER_LEAVES", 4)
        monkeypatch.setattr(ann_tree, "BLOCK_ROWS", 150)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # groups meet in partitions of their own
    data = sample(900) + ODD
    fine = [(i, padded(v)) for i, v in data if i is not None and v and all(e is not None and math.isfinite(e) for e in v) and any(v)]
    got = ann_tree.search(vectors(spark, data), F.col("vec_id") % 20 == 0, k=20, recall=recall).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by = dict(fine)
    want = brute(fine, 20, 20, lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)))
    truth, found = {(q, i) for q, _, i, _ in want}, {(r.query_id, r.vec_id) for r in got}
    assert len(truth & found) >= (1.0 if recall == 1 else 0.9) * len(truth)
    per = {}
    for r in got:
        per.setdefault(r.query_id, []).append(r)
        assert r.vec_id != r.query_id
        assert r.score == pytest.approx(sum(x * y for x, y in zip(by[r.query_id], by[r.vec_id], strict=True)), abs=1e-12)
    for rows in per.values():
        ranked = sorted(rows, key=lambda r: r["rank"])
        assert [(-r.score, r.vec_id) for r in ranked] == sorted((-r.score, r.vec_id) for r in rows)
    assert {q for q, *_ in want} == set(per) and all(len(v) == 20 for q, v in per.items() if q != 9000)


def test_tree_search_small(spark):
    got = ann_tree.search(vectors(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [1.0, 1.0])]), F.col("vec_id") == 0, k=20).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2, 1.0), (2, 1, 0.5)]
    assert ann_tree.search(vectors(spark, []), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("upper", [4096, 16])
def test_tree_prunes_clusters(spark, monkeypatch, upper):
    """Vectors around 60 centres: nine of ten neighbours found with far fewer than half of all rows scored."""
    monkeypatch.setattr(ann_tree, "UPPER_LEAVES", upper)
    monkeypatch.setattr(ann_tree, "BLOCK_ROWS", 500)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 16))
    x = centres[rng.integers(0, 60, 3000)] + 0.3 * rng.standard_normal((3000, 16))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("f4").astype(float)
    got = ann_tree.search(vectors(spark, [(i, [float(e) for e in v]) for i, v in enumerate(x)]), F.col("vec_id") % 20 == 0).collect()
    scores = x @ x.T
    np.fill_diagonal(scores, -9)
    truth = {(q, i) for q in range(0, 3000, 20) for i in np.argsort(-scores[q], kind="stable")[:20].tolist()}
    assert len(truth & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(truth)
    scored = {}
    for r in got:
        scored.setdefault(r.query_id, set()).add(r.rows_scored)
    assert np.mean([max(v) for v in scored.values()]) < 0.2 * 3000


def test_tree_search_of_wide_norms(spark):
    """Products of long, nearly orthogonal vectors lose digits: the exact order must not depend on them."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 64)) * 1e9
    q = x[0] / np.linalg.norm(x[0])
    x[1:] -= np.outer(x[1:] @ q, q) - np.outer(rng.standard_normal(399) * 1e-6, q)
    data = spark.createDataFrame([(i, [float(e) for e in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann_tree.search(data, F.col("vec_id") == 0, k=20, recall=1.0).collect()
    exact = ann_tree.exact_scores(x, x[0])
    want = sorted((-exact[i], i) for i in range(1, 400))[:20]
    assert sorted((-r.score, r.vec_id) for r in got) == want


@pytest.mark.parametrize("leaves", [8, 4096])
def test_tree_search_never_returns_too_few(spark, monkeypatch, leaves):
    """Queries away from all centres, opposite to them, of tiny and huge length, and ids that many rows share."""
    monkeypatch.setattr(ann_tree, "UPPER_LEAVES", leaves)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(5000, 8)) + 6
    rows = [(i * 20 + 1, v.tolist()) for i, v in enumerate(x)]
    odd = [-x[0], -50 * x[1], 1e-9 * x[2], 1e9 * x[3], np.eye(8)[0] * 1e4, -np.eye(8)[1], rng.normal(size=8)]
    queries = [(20 * (i + 1) * 1000, v.tolist()) for i, v in enumerate(odd)]
    queries += [(20, x[5].tolist())] * 40  # one id, more rows than a result has
    table = spark.createDataFrame(rows + queries, "vec_id long, embedding array<double>")
    got = ann_tree.search(table, F.col("vec_id") % 20 == 0, k=20).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {q: 20 * (40 if q == 20 else 1) for q, _ in queries}


def test_upper_leaves_come_best_bin_first():
    """The order found for many queries at once is that of a search by a queue of open nodes, one query at a time."""
    from heapq import heappop, heappush

    rng = np.random.default_rng(4)
    tree = ann_tree.grow(rng.normal(size=(600, 8)), 40)
    queries = rng.normal(size=(ann_tree.WALKED + 9, 8))
    for q, turn in zip(queries, tree.order(queries)):
        near, queue, worst, seen = tree.centres @ q, [(0.0, 0)], np.inf, []
        while queue:
            p, node = heappop(queue)
            worst = min(worst, -p) if node else np.inf
            if not tree.children[node]:
                seen.append((worst, tree.leaf[node]))
            for kid in tree.children[node]:
                heappush(queue, (-near[kid], kid))
        # leaves found while the worst node so far is the same one may come in any order
        place = {leaf: i for i, leaf in enumerate(turn.tolist())}
        assert sorted(place) == list(range(tree.leaves))
        groups = [[place[leaf] for w, leaf in seen if w == level] for level in sorted({w for w, _ in seen}, reverse=True)]
        assert all(max(a) < min(b) for a, b in zip(groups, groups[1:]))
