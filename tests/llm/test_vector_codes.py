import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from inputlens.llm import vector_codes
from inputlens.llm.vector_codes import Slices


def by_hand(rows, entries=256, rounds=4, parts=4):
    kept = [(i, lab, v) for i, lab, v in rows if v is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    whole = [[math.floor(1024 * x) if abs(x) < 1e300 else int(x) * 1024 for x in v] for _, _, v in kept]
    w = len(kept[0][2]) // parts
    order = sorted((r[0], r[2], k) for k, r in enumerate(kept) if r[0] is not None)[:entries]
    books = [[whole[k][p * w : (p + 1) * w] for _, _, k in order] for p in range(parts)]

    def near(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v[p * w : (p + 1) * w], e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for v in whole:
                groups[near(p, v)[1]].append(v[p * w : (p + 1) * w])
            books[p] = [[sum(c) // len(groups[i]) for c in zip(*groups[i], strict=True)] if i in groups else e for i, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, sums = [], defaultdict(int)
    for (i, lab, _), v in zip(kept, whole, strict=True):
        found = [near(p, v) for p in range(parts)]
        error = sum(d for d, _ in found)
        sums[lab] += error
        out.append([i, lab, "".join(f"{e:02x}" for _, e in found), error])
    short = lambda x: x if x < 1 << 63 else None
    broken = {lab for _, lab, _, e in out if e >= 1 << 63}
    return sorted(repr((i, c, short(e), None if lab in broken else short(sums[lab]), sha)) for i, lab, c, e in out)


def run(spark, rows, entries=256):
    table = spark.createDataFrame([(i, lab, v, "x") for i, lab, v in rows], "vec_id long, label int, embedding array<double>, code string").repartition(3)
    got = vector_codes.compress(table, entries=entries).drop("label").collect()
    return sorted(repr((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256)) for r in got)


def vectors(n, width, seed=0, scale=1.0):
    return (np.random.default_rng(seed).normal(size=(n, width)) * scale).tolist()


def test_as_by_hand(spark):
    rows = [(i * 3 % 101 + 10, i % 4 if i % 5 else None, v) for i, v in enumerate(vectors(300, 8))]
    rows += [rows[0]] * 20 + [(None, 1, [0.5] * 8), (5, None, None), (6, 1, [None] * 8), (7, 2, [math.inf] * 8), (8, 2, [math.nan] * 8)]
    assert run(spark, rows, entries=16) == by_hand(rows, 16)


def test_fewer_rows_than_entries_and_unused_entries(spark):
    rows = [(i, 0, [float(i // 3)] * 4) for i in range(9)]
    assert run(spark, rows) == by_hand(rows)


def test_numbers_of_any_size(spark):
    rows = [(i, i % 2, v) for i, v in enumerate(vectors(12, 4) + vectors(6, 4, 1, 1e12) + vectors(3, 4, 2, 1e200) + [[1.7e308, -1.7e308, 5e-324, 0.0]])]
    assert run(spark, rows, entries=5) == by_hand(rows, 5)


def test_other_lengths_and_empty_tables(spark):
    rows = [(1, 0, [1.0] * 4), (2, 0, [2.0] * 4), (3, 0, [1.0] * 8), (4, 0, [1.0] * 3), (5, 0, [])]
    assert run(spark, rows) == by_hand(rows[:2])
    table = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert vector_codes.compress(table).count() == 0


@pytest.mark.parametrize("spread", [1, 5, 300])
def test_slices_find_the_nearest(spread):
    rng = np.random.default_rng(spread)
    for n, width in ((1, 1), (7, 2), (64, 3), (65, 16), (256, 4)):
        entries, parts = rng.integers(-spread, spread + 1, (n, width)), rng.integers(-2 * spread, 2 * spread + 1, (500, width))
        slices = Slices(entries.tolist())
        apart = ((parts[:, None, :] - entries) ** 2).sum(2)
        entry, error = slices.nearest(parts)
        assert (entry == apart.argmin(1)).all() and (error == apart.min(1)).all()
        assert all(slices.nearest_of(p) == (e, d) for p, e, d in zip(parts[:50].tolist(), entry[:50].tolist(), error[:50].tolist(), strict=True))


def test_masks_hold_the_box():
    rng = np.random.default_rng(1)
    entries, parts = rng.integers(-50, 50, (130, 3)), rng.integers(-60, 60, (40, 3))
    held = Slices(entries.tolist()).inside(parts, np.full(40, 20))
    assert (held == (np.abs(parts[:, None, :] - entries) <= 20).all(2)).all()
