"""Language, toxicity and quality on made-up labelled texts: held-out accuracy and odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from inputlens.llm import lang_id, quality_knn, toxicity
from inputlens.llm.common import labelled_sample, labelled_texts

SYLLABLES = {"aa": ["th", "er", "in", "on", "an"], "bb": ["sch", "ung", "ei", "keit", "be"], "cc": ["ción", "que", "ado", "mi", "es"]}
BAD = ["vilx", "vilxen", "gronk", "gronkish"]


def words(rng, lang, n):
    return ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def corpus(n=900):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        w = words(rng, lang, rng.randint(15, 80))
        toxic, good = rng.random() < 0.3, rng.random() < 0.7
        if toxic:
            for _ in range(rng.randint(2, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        if not good:
            w = [x + "***" for x in w] if rng.random() < 0.5 else [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w), lang, int(toxic), int(good)))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string, lang string, toxic int, score int").persist()


ODD = [(5000, None), (5001, ""), (5002, " 12 ... "), (5003, "ther " * 30_000), (None, "ther in"), (5004, "th"), (5004, "th")]


def odd(spark):
    return spark.createDataFrame([(i, t, "clash", 3) for i, t in ODD], "doc_id long, text string, lang string, score int")


def sizes_by_hand(model, text):
    """Encoded sizes with nothing but zstandard: language -> mean bytes that the words add to a passage."""
    words = " ".join(re.findall(r"[^\W\d_]+", text.lower())).encode()
    out = {}
    for lang, raw in model.dictionaries.items():
        added = []
        for r in raw:
            content = zstandard.ZstdCompressionDict(r, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            size = lambda x, d=content: len(zstandard.ZstdCompressor(level=lang_id.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress(x))
            added += [size(p + words) - size(p) for p in model.passages[lang]]
        out[lang] = sum(added) / len(added)
    return out


def test_language(spark, docs):
    model = lang_id.fit(docs.filter("doc_id % 3 <> 0").unionByName(odd(spark).select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit(0).alias("toxic"), "score")))
    assert sorted(model.dictionaries) == sorted(SYLLABLES)
    got = docs.filter("doc_id % 3 = 0").select("lang", "text", lang_id.predict(F.col("text"), model).alias("p")).collect()
    assert sum(r.lang == r.p.lang for r in got) >= 0.98 * len(got)
    assert all(0 <= r.p.score <= 1 for r in got) and sum(r.p.rejected for r in got) <= 2
    strange = odd(spark).select("doc_id", "text", lang_id.predict(F.col("text"), model).alias("p")).collect()
    for r in strange:
        if r.doc_id in (5000, 5001, 5002):
            assert r.p.lang == "und" and r.p.rejected and r.p.score == 0
        else:
            assert r.p.lang in model.dictionaries
    for r in [*got[:60], *strange[3:]]:
        sizes = sizes_by_hand(model, r.text)
        assert r.p.lang == min(sorted(sizes), key=sizes.get)
        best, second = sorted(sizes.values())[:2]
        assert r.p.rejected == ((second - best) / max(best, 1.0) <= model.narrow)
    assert lang_id.fit(docs.limit(0)).dictionaries == {}
    assert {r.p.lang for r in docs.limit(3).select(lang_id.predict(F.col("text"), lang_id.Model({})).alias("p")).collect()} == {"und"}


def test_narrow_margin_is_rejected():
    same = [b"abc def ghi " * 200]
    assert lang_id.Classifier(lang_id.Model({"x": same, "y": same}, {"x": [b"ab "], "y": [b"ab "]}))("abc def ghi and more of it")[2]


def test_rejection_is_calibrated_on_what_is_left(monkeypatch):
    """Texts half of one language and half of another are close calls; the margin learnt rejects most of them."""
    monkeypatch.setattr(lang_id, "DICT_BYTES", 3000)
    monkeypatch.setattr(lang_id, "SOURCE_BYTES", 1000)
    monkeypatch.setattr(lang_id, "COST", 0.05)
    rng = random.Random(8)
    clear = [(lang, " ".join(words(rng, lang, 60))) for _ in range(150) for lang in ("aa", "bb")]
    mixed = [(rng.choice(("aa", "bb")), " ".join(words(rng, "aa", 30) + words(rng, "bb", 30))) for _ in range(60)]
    rows = clear[:200] + mixed[:40] + clear[200:]
    model = lang_id.learned(rows)
    classify = lang_id.Classifier(model)
    assert model.narrow > 0
    kept = [not classify(t)[2] for _, t in clear]
    assert sum(kept) >= 0.9 * len(kept) and any(classify(t)[2] for _, t in mixed[40:])


def kneser_ney(rows, d):
    """The models of both classes by their formulas, a probability at a time."""
    ds = toxicity.SHARED_DISCOUNT
    one = [Counter(), Counter()]
    two = [Counter(), Counter()]
    before = {}
    for w, y in rows:
        one[y].update(set(w))
        two[y].update(set(zip(w, w[1:])))
        for a, b in zip(w, w[1:]):
            before.setdefault(b, set()).add(a)
    vocabulary = {x for w, _ in rows for x in w}
    kinds = sum(map(len, before.values()))

    def shared(w):
        return max(len(before.get(w, ())) - ds, 0) / kinds + max(ds * len(before), 1.0) / kinds / len(vocabulary)

    def single(y, w):
        return (max(one[y][w] - d, 0) + sum(min(n, d) for n in one[y].values()) * shared(w)) / sum(one[y].values())

    def ratio(h, w):
        if max(one[0][w], one[1][w]) <= d:
            return 0.0
        if max(two[0][h, w], two[1][h, w]) <= d:
            return math.log(single(1, w) / single(0, w))
        after = [sum(n for (a, _), n in two[y].items() if a == h) for y in (0, 1)]
        back = sum(min(n, d) for y in (0, 1) for (a, _), n in two[y].items() if a == h) / sum(after)
        p = [max(two[y][h, w] - d, 0) / max(1, after[y]) + back * single(y, w) for y in (0, 1)]
        return math.log(p[1] / p[0])

    return ratio


@pytest.mark.parametrize("discount", [1.0, 4.0])
def test_toxicity_equals_the_formulas(discount):
    rng = random.Random(2)
    rows = [([rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))] + ["you", "fool"] * (y and rng.random() < 0.7), y) for y in [0, 1] * 40]
    sample = toxicity.Sample(rows)
    tables = toxicity.Counts(sample, np.arange(len(rows))).tables(discount)
    ratios, ratio = toxicity.named(sample, tables), kneser_ney(rows, discount)
    assert ratios.pair and ratios.single
    direct = [toxicity.differences(w, ratios) for w, _ in rows]
    assert np.allclose(toxicity.compared(sample, np.arange(len(rows)), tables), direct, atol=1e-9)
    for w, _ in [*rows, (["you", "fool", "never", "seen", "a"], 0)]:
        want = [ratio(h, x) for h, x in zip(["", *w], w)]
        assert ratios.of(w) == pytest.approx(want, abs=1e-9)
        r = np.array(want)
        best = max(r[i : i + toxicity.PASSAGE].mean() for i in range(max(1, len(r) - toxicity.PASSAGE + 1)))
        assert toxicity.differences(w, ratios) == pytest.approx([1.0, r.mean(), best], abs=1e-9)


def test_quality_equals_a_direct_vote(spark, docs):
    """Cosines and votes a text at a time; equal texts have equal scores wherever they stand."""
    model = quality_knn.fit(docs.filter("doc_id % 3 <> 1"), docs.select("doc_id", F.col("score").alias("label")))
    texts = [r.text for r in docs.limit(200).collect()] + [None, "", "ther in"]
    column = pa.array(texts * 4)
    got = quality_knn.score(model, column)
    assert all(np.array_equal(got[: len(texts)], got[i * len(texts) : (i + 1) * len(texts)]) for i in range(4))
    for t, s in zip(texts, got):
        z = (quality_knn.weighted(quality_knn.counts(pa.array([t], pa.string())), model.idf) @ model.axes)[0]
        if not np.linalg.norm(z):
            assert s == model.prior
            continue
        c = [float(np.round(np.dot(z / np.linalg.norm(z), v), 6)) for v in model.vectors]
        last = sorted(c, reverse=True)[quality_knn.NEIGHBOURS - 1]
        votes = [(np.exp(quality_knn.SHARPNESS * x), y) for x, y in zip(c, model.labels) if x >= last]
        assert s == pytest.approx(sum(w * y for w, y in votes) / sum(w for w, _ in votes), abs=2e-3)


def test_held_out_labels_are_not_counted(spark, docs):
    labels = docs.select("doc_id", F.col("toxic").alias("label"))
    some = docs.filter("doc_id % 3 = 0")
    rows, sizes = labelled_sample(some, labels, 10_000)
    want = Counter(r.label for r in labels.filter("doc_id % 3 = 0").collect())
    assert sizes == dict(want) and rows.count() == some.count()


@pytest.mark.parametrize("module,label,limit", [(toxicity, "toxic", 0.7), (quality_knn, "score", 0.3)])
def test_scores(spark, docs, module, label, limit):
    labels = docs.select("doc_id", F.col(label).alias("label"))
    extra = spark.createDataFrame([(None, 1), (5, None), (99_999, 1)], "doc_id long, label int")
    model = module.fit(docs.filter("doc_id % 3 <> 1").unionByName(docs.filter("doc_id = 2")), labels.unionByName(extra))
    got = docs.filter("doc_id % 3 = 1").select(F.col(label).alias("y"), module.predict(F.col("text"), model).alias("p")).collect()
    assert sum((r.p >= limit) == r.y for r in got) >= 0.95 * len(got)
    strange = odd(spark).select(module.predict(F.col("text"), model).alias("p")).collect()
    assert len(strange) == len(ODD) and all(0 <= r.p <= 1 for r in strange)
    assert docs.limit(0).select(module.predict(F.col("text"), model)).count() == 0
    nothing = module.fit(docs, labels.limit(0))
    assert {r.p for r in docs.limit(5).select(module.predict(F.col("text"), nothing).alias("p")).collect()} == {0.5}
    one = module.fit(docs, labels.filter("label = 1"))
    assert all(0 <= r.p <= 1 for r in docs.limit(5).select(module.predict(F.col("text"), one).alias("p")).collect())


def test_quality_learns_from_the_whole_sample(spark):
    n = 2 * quality_knn.SAMPLE_DOCS
    made = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("ther "), F.col("id").cast("string")).alias("text"), (F.col("id") % 2).cast("int").alias("label"))
    model = quality_knn.fit(made, made.select("doc_id", "label"))
    assert 5700 < len(model.labels) < 6300 and len(model.labels) == len(model.vectors)
    assert 0.45 < model.labels.mean() < 0.55


def test_toxicity_keeps_all_unlike_documents():
    """At the full sample's size nothing goes by chance, and near copies count once."""
    rng = np.random.default_rng(2)
    docs = [([f"w{i}" for i in rng.integers(0, 3000, 60)], int(i % 2)) for i in range(8000)]
    assert len(toxicity.Sample(docs).different()) == 8000
    near = [(w[:30] + ["other"] + w[31:], y) for w, y in docs[:50]]  # similarity about 0.93
    assert toxicity.Sample(docs[:500] + near + docs[:50] + [([], 0), ([], 1)]).different().tolist() == [*range(500), 600, 601]


def test_numbers_that_are_no_letters_have_no_language():
    assert [lang_id.canonical(t) for t in ("½ ²", "Ⅷ ٣ 12", "_ !", None)] == [b""] * 4 and lang_id.canonical("Aé1b²ñ") == "aé b ñ".encode()


def test_toxicity_counts_every_labelled_document(spark):
    """Gathered counts give the models that all documents on one machine give, with a part left out or none."""
    rng = random.Random(9)
    rows = [(i, " ".join([rng.choice("abcdefgh") + "word" for _ in range(rng.randint(0, 12))] + ["you", "fool"] * (y and rng.random() < 0.7)), y) for i, y in enumerate([0, 1] * 60)]
    made = spark.createDataFrame([(y, i % toxicity.PARTS, t) for i, t, y in rows], "label int, part int, text string")
    gathered = toxicity.Gathered(made, 1.0)
    sample = toxicity.Sample((toxicity.words_of(t), y) for _, t, y in rows)
    for out in (None, 0, 2):
        some = np.array([i for i, *_ in rows if i % toxicity.PARTS != out])
        for discount in (1.0, 4.0, 9.0):
            got, want = gathered.ratios(out, discount), toxicity.named(sample, toxicity.Counts(sample, some).tables(discount))
            assert got.single == pytest.approx(want.single) and got.pair == pytest.approx(want.pair) and want.single
        ratios = [gathered.ratios(out, d) for d in (1.0, 4.0, 9.0)]
        several = toxicity.Several(gathered, ratios)
        for text in [*(t for _, t, _ in rows), "aword bwordless foolish you fool youthfool", ""]:
            assert np.allclose(several.of(toxicity.words_of(text)), [r.of(toxicity.words_of(text)) for r in ratios])


def test_toxicity_reads_beyond_the_former_sample(spark):
    """A word that is toxic in a few of many documents is learnt: 12,000 ordinary ones were more than the sample held."""
    rng = np.random.default_rng(6)
    text = [" ".join(f"w{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in rng.integers(0, 600, 12)) for _ in range(12_600)]
    rows = [(i, t + " gronk gronk" * (i >= 12_000), int(i >= 12_000)) for i, t in enumerate(text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(4).persist()
    every = toxicity.unlike(docs.select("doc_id", "label", "text"))
    assert every.count() == 12_600
    sizes = toxicity.Gathered(every.withColumn("part", F.lit(0)), 1.0)
    assert dict(zip(sizes.words.tolist(), sizes.counts[toxicity.WORD][1, 0].tolist()))["gronk"] == 600
    total = sum(len(set(t.split())) for _, t, y in rows if not y)  # numbers of documents by word, digits aside
    assert sizes.totals[toxicity.WORD][0, 0] == total


def test_toxic_words_are_known_by_their_beginnings(spark):
    """Toxic words that never occur twice, but for how they begin."""
    rng = random.Random(5)
    rows = []
    for i in range(900):
        w, toxic = words(rng, "aa", rng.randint(20, 60)), rng.random() < 0.3
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), "zorbak" + "".join(rng.choice("abcdefgh") for _ in range(9)))
        rows.append((i, " ".join(w), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int").persist()
    model = toxicity.fit(docs.filter("doc_id % 3 <> 1"), docs.select("doc_id", "label"))
    got = docs.filter("doc_id % 3 = 1").select("label", toxicity.predict(F.col("text"), model).alias("p")).collect()
    assert sum((r.p >= 0.7) == r.label for r in got) >= 0.93 * len(got)


def test_toxicity_counts_near_copies_once(spark):
    rng = np.random.default_rng(3)
    docs = [" ".join(f"w{i}" for i in rng.integers(0, 3000, 200)) for _ in range(300)]
    rows = docs + docs[:100] + [d.replace(" ", " extra ", 1) for d in docs[100:200]] + ["", None]
    made = spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(rows)], "doc_id long, label int, text string")
    assert 302 <= toxicity.unlike(made).count() <= 312


def test_toxicity_shuffles_labelled_texts_alone(spark):
    """Texts without a label, and all texts once near copies are known, stay where they are; the rows are those of the rules."""
    rows = [(i % 90, f"text {i % 90} of {i // 90}" if i % 7 else None) for i in range(180)] + [(None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 120, 3)] + [(3, 0), (None, 1), (7, None)], "doc_id long, label int")
    made = labelled_texts(docs, F.broadcast(labels.filter("doc_id IS NOT NULL")))
    want = {i: (i % 2, min((t for d, t in rows if d == i and t is not None), default=None)) for i in range(0, 90, 3)}
    assert {r.doc_id: (r.label, r.text) for r in made.collect()} == want
    aggregate, join = (made._jdf.queryExecution().optimizedPlan().toString().find(n) for n in ("min(text", "Join Inner"))
    assert 0 <= aggregate < join  # the join is below
    plan = toxicity.unlike(made)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftAnti" in plan and "LeftSemi" not in plan


def test_reader_gives_the_ratios_of_every_text(monkeypatch):
    """Words numbered and remembered, pairs of a word that only begins one, and more words than are remembered."""
    monkeypatch.setattr(toxicity, "REMEMBERED", 3)
    ratios = toxicity.Ratios({"one": 0.5, "two": -1.0}, {("one", "two"): 2.0, ("three", "two"): 3.0, ("one", "three"): 4.0}, {"fool": 0.7, "fooli": 0.9})
    read = toxicity.Reader(ratios)
    for text in ("one two three two foolish fools nothing one two", "", "two", "three one three two foo fool"):
        assert read.of(text.split()).tolist() == ratios.of(text.split()).tolist()


def test_words_are_the_runs_of_letters(monkeypatch):
    """Every character between letters, by the pattern; texts of letters and ASCII alone take no pattern, which is slow."""
    texts = [f"a{c}bA{c} {c} 1{c}_" for c in map(chr, range(0x110000))] + ["", None]
    found = [toxicity.words_of(t) for t in texts]
    assert found == [re.findall(r"[^\W\d_]+", (t or "").lower()) for t in texts]
    monkeypatch.setattr(toxicity, "_LETTERS", None)
    assert toxicity.words_of("It's 1_000 TIMES\x1e\tmás: Straße!\n") == ["it", "s", "times", "más", "straße"]


def test_pairs_are_the_same_however_often_tasks_send(spark, monkeypatch):
    """Counts of pairs do not depend on how much a task gathers, and documents without words or of one word have none."""
    rng = random.Random(8)
    rows = [(i % 2, i % 3, " ".join(rng.choice("abcdefgh") + "word" for _ in range(rng.randint(0, 9)))) for i in range(150)] + [(0, 0, None), (1, 1, "aword")]
    made = spark.createDataFrame(rows, "label int, part int, text string").coalesce(2)
    known = ["aword", "bword", "cword"]
    want = {tuple(r) for r in toxicity.counted_pairs(made, known, 1.0).collect()}
    pairs = Counter((y * toxicity.PARTS + k, p) for y, k, t in rows for w in [(t or "").split()] for p in set(zip(w, w[1:])))
    after = Counter()
    for (slot, (a, _)), n in pairs.items():
        if a in known:
            after[known.index(a), slot] += n
    assert {(code, i): n for kind, code, *slots in want for i, n in enumerate(slots) if kind == toxicity.AFTER and n} == after
    for name, size in (("GATHERED_PAIRS", 5), ("GATHERED", 3)):
        monkeypatch.setattr(toxicity, name, size)
        assert {tuple(r) for r in toxicity.counted_pairs(made, known, 1.0).collect()} == want
