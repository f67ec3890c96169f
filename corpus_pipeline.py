"""A training corpus from ``documents``: language, quality, near duplicates, repeated passages, packed sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it left; between stages the
rows are Parquet. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inputlens.llm import lang_id, ngram_join, packing, quality_knn, substring_dedup
from inputlens.llm.common import crc_bucket, tuned, written

#: Documents whose quality score is below this go.
LEAST_QUALITY = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters (null and empty ones too) and those whose language is a close call. Learns from the
    rows whose id is in no held-out fold; rows without an id teach nothing. Equal texts have one fate."""
    tuned(spark)
    model = lang_id.fit(docs.filter(crc_bucket(F.col("doc_id"), 5) != 0))
    judged = docs.withColumn("__il_lang", lang_id.predict(F.col("text"), model))
    return judged.filter(~F.col("__il_lang.rejected")).select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts whose labelled neighbours are of low quality. A text without words, or null, has the share of good
    documents among the labelled ones as its score; without labels every score is 0.5, and all stay."""
    labels = tuned(spark).read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality_knn.fit(docs.filter(crc_bucket(F.col("doc_id"), 5) != 0), labels)
    judged = docs.withColumn("__il_quality", quality_knn.predict(F.col("text"), model))
    return judged.filter(F.col("__il_quality") >= LEAST_QUALITY).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of similar ones: that of the smallest id, a null one last. Texts without words,
    null ones too, are similar to nothing and stay; of rows that repeat one stays."""
    tuned(spark)
    return ngram_join.one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages that occur more than once; a text left empty stays as a document without words. A text that
    loses nothing is as it was, null too; of others the words are joined by one space, and n_chars is counted anew."""
    tuned(spark)
    done = substring_dedup.dedup(docs, keep_text=True, name="__il_passages")
    text, lost = F.col("__il_passages.kept_text"), F.col("__il_passages.n_removed") > 0
    new = {"text": text, "n_chars": F.when(lost, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {"text": text}
    return done.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 tokens, one row for each piece of a document. A null text is empty and
    has one piece, its end; an empty table has none. Columns of ``docs`` other than doc_id and text are left behind."""
    tuned(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("passages", passages),
    ("sequences", sequences),
]

#: SQL can express neither the classifiers nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tuned(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
