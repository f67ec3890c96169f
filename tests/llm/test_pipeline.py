"""The pipeline, stage by stage, against brute-force versions on a small corpus."""

import random
import re
from collections import Counter

import public_tokenizers as P
from test_classifiers import corpus, words
from test_dedup import brute as brute_windows
from test_join import brute as brute_groups

import corpus_pipeline
from inputlens.llm import lang_id
from inputlens.llm.common import WORD, crc_bucket
from pyspark.sql import functions as F
from tokenizers import Tokenizer


def made(spark, folder):
    rng = random.Random(9)
    rows = [(i, t, lang, "src", len(t), q) for i, t, lang, _, q in corpus(300)]
    for i in range(20):  # near copies and a shared passage
        t = rows[i * 5][1].split(" ")
        rows.append((1000 + i, " ".join([*t[:40], "th", *t[40:]]), rows[i * 5][2], "src", 0, None))
    passage = " ".join(words(rng, "aa", 50))
    for i in range(6):
        t = f"{' '.join(words(rng, 'aa', 60))} {passage} {' '.join(words(rng, 'aa', 60))}"
        rows.append((2000 + i, t, "aa", "src", len(t), None))
    rows += [(3000, None, "aa", "src", 0, 1), (3001, "12 34 !!", "bb", "src", 8, 0), (3002, rows[3][1], "aa", "src", 1, None), (3, rows[3][1], rows[3][2], "src", rows[3][4], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality int")
    df.drop("quality").repartition(3).write.parquet(f"{folder}/documents.parquet")
    df.filter("quality IS NOT NULL").select("doc_id", "quality", F.lit(0).alias("toxic")).write.parquet(f"{folder}/labels.parquet")
    return f"file://{folder}"


def test_stages(spark, tmp_path):
    sf = made(spark, tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = docs.collect()
        out = stage(spark, docs, sf)
        out.write.parquet(f"{sf}/out{k}")
        after = spark.read.parquet(f"{sf}/out{k}")
        got = after.collect()
        if name != "sequences":
            assert after.columns == columns
        if name == "language":
            judge = lang_id.Classifier(lang_id.fit(docs.filter(crc_bucket(F.col("doc_id"), 5) != 0)))
            assert Counter(got) == Counter(r for r in rows if not judge(r.text)[2])
            assert {3000, 3001} & {r.doc_id for r in got} == set()
        elif name == "quality":
            assert 0.5 * len(rows) < len(got) < 0.9 * len(rows)
            junk = [r for r in rows if re.search(r"\*\*\*|!!", r.text)]
            assert len(set(got) & set(junk)) <= 2 and len(set(rows) - set(junk) - set(got)) <= 2
        elif name == "near_duplicates":
            named = {c for _, _, c in brute_groups([(r.doc_id, r.text) for r in rows])}
            assert Counter(r.doc_id for r in got) == Counter(named)
        elif name == "passages":
            want = {w[0]: w for w in brute_windows([(r.doc_id, r.text) for r in rows], 35)}
            assert len(got) == len(rows) and sum(w[2] for w in want.values()) >= 50
            for r in got:
                assert len(re.findall(WORD, r.text)) == want[r.doc_id][1] - want[r.doc_id][2]
        else:
            tokens = Counter()
            for r in got:
                tokens[r.doc_id] += r.length
            e = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
            assert tokens == Counter({r.doc_id: len(e.encode(r.text, add_special_tokens=False).ids) + 1 for r in rows})
        docs, before = after, got
    assert corpus_pipeline.run(spark, sf).count() == len(before)


def test_empty_documents(spark, tmp_path):
    made(spark, tmp_path)
    sf = f"file://{tmp_path}/none"
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet").limit(0)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet(f"file://{tmp_path}/labels.parquet").write.parquet(f"{sf}/labels.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_clashing_columns_and_long_texts(spark, tmp_path):
    """Columns that are called as the operators' own stay what they are, in every stage."""
    sf = made(spark, tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    long = " ".join(words(random.Random(1), "aa", 30_000))
    more = spark.createDataFrame([(7000, long, "aa", "src", len(long)), (7001, long, "aa", "src", len(long))], docs.schema)
    names = ["dedup", "score", "rejected", "label", "node", "n", "id", "hash", "runs", "row_hash", "piece", "kept_text"]
    docs = docs.unionByName(more).withColumns({c: F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")) for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        got = docs.collect()
        assert got and all(r[c] == f"{c}-{r.doc_id}" for r in got for c in names), name
        assert [7000, 7001][: 2 if name in ("language", "quality") else 1] == sorted(r.doc_id for r in got if r.doc_id in (7000, 7001))
    assert corpus_pipeline.sequences(spark, docs, sf).count() >= docs.count()
