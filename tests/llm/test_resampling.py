import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from inputlens.llm import resampling

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or "").encode())
    return len(words), Counter(zlib.crc32(b" ".join(words[i : i + k])) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1))


TEXTS = [None, "", "!?", "One", "one TWO", "a b a b a b", "x-y_z 12 é日 " + "q" * 200, "w " * 3000, " lead and trail ", "\x00nul\x7fdel", "Ää ÄÄ", "l" * 70 + " " + "m" * 5000 + " n"]


@pytest.mark.parametrize("size", [1 << 20, 64, 3])
@pytest.mark.parametrize("known", [0, 2, 50])
def test_buckets_are_those_of_spelled_features(monkeypatch, size, known):
    monkeypatch.setattr(resampling, "CHUNK_BYTES", size)
    words, pairs = Counter(), Counter()
    for t in TEXTS:
        w = WORD.findall((t or "").lower().encode())
        words.update(w)
        pairs.update(zip(w, w[1:]))
    frequent = [w for w, _ in words.most_common(known)]
    head = resampling.Head(frequent, [p for p, _ in pairs.most_common(known) if set(p) <= set(frequent)])
    for text in TEXTS:
        found = list(resampling.buckets(text, head))
        n, expected = features(text)
        assert sum(k for k, _ in found) == n
        assert sum((Counter(b.tolist()) for _, b in found), Counter()) == expected


def brute(docs, target, percent=5, least=20):
    raw, wanted = Counter(), Counter()
    for _, text in docs:
        raw.update(features(text)[1])
    for text in target:
        wanted.update(features(text)[1])
    s, t = sum(raw.values()), sum(wanted.values())
    rows = []
    for doc_id, text in docs:
        n, own = features(text)
        weight = sum(c * math.floor(1000 * math.log((wanted[k] + 1) * (s + 10_000) / ((raw[k] + 1) * (t + 10_000)))) for k, c in own.items())
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, sum(own.values()), weight, score, None, n])
    able = sorted((r for r in rows if r[5] >= least and r[3] is not None), key=lambda r: (-r[3], r[0]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return Counter(tuple(r[:5]) for r in rows)


def corpus():
    docs = [(i, " ".join(f"w{(i * 7 + j * j) % (5 + i % 40)}" for j in range(i % 60))) for i in range(300)]
    copies = [(1000 + i, "the same long text " * 10) for i in range(100)]
    return docs + copies + [(50, docs[50][1])] * 3 + [(None, "no id " * 30), (None, None), (7000, None), (7001, ""), (-5, "W1 w2 " * 5000)]


@pytest.mark.parametrize("percent", [0, 5, 100])
def test_resample_as_by_hand(spark, monkeypatch, percent):
    monkeypatch.setattr(resampling, "COUNTED", 50)
    docs, target = corpus(), ["w1 w2 w3 w4", None, "the same text", ""]
    table = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, rank string").repartition(3)
    got = resampling.resample(table, spark.createDataFrame([(t,) for t in target], "text string"), percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == brute(docs, target, percent)


def test_equal_scores_are_drawn_by_id(spark):
    weighed = spark.createDataFrame([(i, 30, 10, 5) for i in range(40)], "doc_id long, n_words long, n_features long, weight long")
    rows = resampling.draw(weighed.unionByName(weighed), 50).collect()
    drawn = sorted((r for r in rows if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, 41))
    assert [(-r.score, r.doc_id) for r in drawn] == sorted((-r.score, r.doc_id) for r in rows)[:40]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert resampling.resample(none, some).count() == 0
    assert Counter(map(tuple, resampling.resample(some, none, 100).collect())) == brute([(1, "a b " * 20)], [], 100)


def test_head_has_what_is_frequent(spark):
    docs = spark.createDataFrame([("the cat the dog " * 50 + f"rare{i} once{i}",) for i in range(50)], "text string")
    head = resampling.head_of(docs, share=20)
    assert set(head.number) == {b"the", b"cat", b"dog"}
    assert (head.keys >= 0).sum() == 4  # the cat, cat the, the dog, dog the
