"""N-gram Jaccard join against a brute-force version."""

import random
import re

import pytest

from inputlens.llm import common, ngram_join
from inputlens.llm.common import WORD

SCHEMA = "doc_id long, text string, node string, n int"


def shingles(text, k=5):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, threshold=80):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= threshold * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 40, 90, 200]))]
        for _ in range(rng.randint(1, 8)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.3:
                text += passage
            if rng.random() < 0.3:
                text = text[: max(1, int(len(text) * rng.choice([0.8, 0.85, 0.9])))]
            rows.append((len(rows), " ".join(text).upper() if rng.random() < 0.2 else " ".join(text)))
    # a chain whose ends are far apart
    chain = [rng.choice(words) for _ in range(200)]
    for i in range(8):
        rows.append((len(rows), " ".join(chain[i * 10 : i * 10 + 130])))
    rows += [(900, None), (901, ""), (902, " \t"), (903, "one two"), (904, "ONE two"), (905, "one two three"), (5, rows[5][1]), (None, rows[6][1]), (906, "É é É é É é")]
    return rows


@pytest.mark.parametrize("seed,block", [(1, 1024), (2, 4)])
def test_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
    if block == 4:  # and many keys are hot
        monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA).repartition(3)
    got = ngram_join.similar_groups(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_empty_and_wordless_tables(spark):
    assert ngram_join.similar_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    got = ngram_join.similar_groups(spark.createDataFrame([(1, None, "", 0), (2, "", "", 0)], SCHEMA)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 0, 1), (2, 0, 2)]


def test_one_of_each_tells_groups_apart_without_ids(spark):
    rng = random.Random(5)
    text = lambda: " ".join(f"w{rng.randrange(9000)}" for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    near = f"{a} more"
    rows = [(None, a), (None, near), (None, b), (None, c), (7, d), (7, e), (-1, f"{d} more"), (None, f"{e} more"), (None, None), (None, "")]
    got = ngram_join.one_of_each(spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA).repartition(3)).collect()
    texts = [r.text for r in got]
    assert len(texts) == len(set(texts)) == 7 and set(texts) - {a, near} == {b, c, f"{d} more", e, None, ""}
    assert {r.doc_id for r in got if r.text == e} == {7}  # a null id comes last
