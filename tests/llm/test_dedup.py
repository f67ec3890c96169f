"""Substring dedup against a brute-force version."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from inputlens.llm import common, sketch, substring_dedup
from inputlens.llm.common import WORD

SCHEMA = "doc_id long, text string, n_words int, dedup string"


def brute(rows, window):
    split = [re.findall(WORD, t or "") for _, t in rows]
    counts = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc_id, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return Counter(out)


def corpus(seed, window):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["é", "Ünï", "a.b,c"]
    passage = [rng.choice(words) for _ in range(window + 15)]
    rows = []
    for i in range(120):
        text = [rng.choice(words) for _ in range(rng.randint(0, 120))]
        if i % 3 == 0:
            at = rng.randint(0, len(text))
            text[at:at] = passage[: rng.randint(window - 3, len(passage))]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(text)))
    rows += [(200, None), (201, ""), (202, "x " * 300), (203, " \n "), (7, rows[7][1]), (204, rows[9][1]), (None, rows[10][1]), (205, "short one")]
    return rows


@pytest.mark.parametrize("window", [35, 10, 5])
@pytest.mark.parametrize("blind", [False, True])
def test_equals_brute_force(spark, monkeypatch, window, blind):
    if blind:  # a sketch so crowded that it lets almost all windows pass
        monkeypatch.setattr(sketch, "CELLS", 256)
        monkeypatch.setattr(sketch, "BLOCK_KEYS", 300)
        monkeypatch.setattr(sketch, "LOT_KEYS", 100)
        monkeypatch.setattr(substring_dedup, "GATHERED", 200)
        monkeypatch.setattr(common, "HOT", 300)
        monkeypatch.setattr(common, "HOT_ROWS", 1)
    rows = corpus(window, window)
    docs = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], SCHEMA).repartition(5)
    made = substring_dedup.dedup(docs, window, keep_text=True)
    assert made.columns == ["doc_id", "text", "n_words", "dedup"]
    got = made.collect()
    assert Counter((r.doc_id, r.dedup.n_words, r.dedup.n_removed, r.dedup.kept_sha256) for r in got) == brute(rows, window)
    for r in got:
        assert r.dedup.kept_text == r.text if not r.dedup.n_removed else hashlib.sha256(r.dedup.kept_text.encode()).hexdigest() == r.dedup.kept_sha256


def test_few_single_keys_pass_at_any_size():
    """A block's share of false answers, as keys of 30 GB and of 100 TB of text would be dealt to it."""
    for keys in (5 * 10**8, 16 * 10**11):
        blocks = sketch.blocks_for(keys)
        own = np.random.default_rng(1).integers(0, 1 << 63, int(keys / blocks), dtype=np.uint64)
        count = np.zeros(2 * sketch.CELLS, dtype=np.int64)
        for at in sketch.cells_of(own, sketch.CELLS):
            count += np.bincount(at, minlength=len(count))
        assert sketch.often(np.packbits(count > 1, bitorder="little"), own).mean() < 0.1
        some = sketch.block_of(own, blocks)
        assert some.min() >= 0 and some.max() < blocks


def test_copies_are_known_where_they_meet(spark):
    """A passage that every document holds is not looked up: of its runs none is alone."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, i, f"u{i} " * 3 + passage + f" v{i}" * 3) for i in range(400)]
    made = spark.createDataFrame(rows, "id long, hash long, text string").repartition(4)
    every = np.full(2 * sketch.CELLS // 8, 255, dtype=np.uint8)
    runs = pd.concat([substring_dedup._suspects(every, p.toPandas()) for p in [substring_dedup.packed_runs(made, 35, 1)]])
    assert runs["met"].dtype == bool and runs["met"].sum() >= 400
    times = runs.groupby(["anchor", "one"])["id"].transform("size")
    assert (runs["met"] == (times > 1)).all()


def test_empty_table(spark):
    assert substring_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_text_is_whole(spark):
    words = [f"u{i}" for i in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[59_900:]))]
    got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.dedup.n_words, r.dedup.n_removed) for r in got} == {(1, 60_000, 100), (2, 100, 100)}
