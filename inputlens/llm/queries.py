"""The queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inputlens.llm import ann_tree, bpe, lang_id, ngram_join, packing, quality_knn, resampling, substring_dedup, topk_bitslice, toxicity, training_order, vector_codes, word_bpe
from inputlens.llm.common import crc_bucket, shared_dir, tuned


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def labels_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col(name).alias("label"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every text once all repeated windows of 35 words are removed."""
    done = substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "dedup.n_words", "dedup.n_removed", "dedup.kept_sha256")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from texts and languages outside the held-out fold; predict every text."""
    docs = table(spark, sf_dir, "documents")
    fold = crc_bucket(F.col("doc_id"), 5)
    model = lang_id.fit(docs.filter(fold != 0))
    found = docs.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), lang_id.predict(F.col("text"), model).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn ``labels.toxic`` outside the held-out fold; score every text."""
    docs = table(spark, sf_dir, "documents")
    fold = crc_bucket(F.col("doc_id"), 3)
    model = toxicity.fit(docs.filter(fold != 1), labels_of(spark, sf_dir, "toxic"))
    found = docs.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), toxicity.predict(F.col("text"), model).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn ``labels.quality`` outside the held-out fold; score every text."""
    docs = table(spark, sf_dir, "documents")
    fold = crc_bucket(F.col("doc_id"), 5)
    model = quality_knn.fit(docs.filter(fold != 0), labels_of(spark, sf_dir, "quality"))
    found = docs.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), quality_knn.predict(F.col("text"), model).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 5 integer inner products of every vector whose id is divisible by 50."""
    return topk_bitslice.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    return ann_tree.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' token sequences as shards in training order; one row for each record read back."""
    path = f"{shared_dir(spark)}/inputlens-shards-{uuid.uuid4().hex}"
    training_order.write_shards(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), key=20_240_229)
    return training_order.with_crc(training_order.read_shards(spark, path))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens; id 2 ends a document."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text; rows that repeat stay as often as they are."""
    docs = table(spark, sf_dir, "documents")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = docs.select("doc_id", bpe.digest(F.col("text"), path, public_tokenizers.PATTERN).alias("d"))
    return coded.select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that links of 80 percent of their five-word shingles join."""
    return ngram_join.similar_groups(table(spark, sf_dir, "documents")).drop("row_hash")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors: 4 parts of 256 entries, trained for 4 rounds."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).drop("label")


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text; rows that repeat stay as often as they are."""
    coded = table(spark, sf_dir, "documents").select("doc_id", word_bpe.digest(F.col("text"), public_tokenizers.path("word_bpe_49k.json")).alias("d"))
    return coded.select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draw one in twenty of all documents toward the benchmark's texts."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_language": op2_language,
    "op3_toxicity": op3_toxicity,
    "op4_topk": op4_topk,
    "op5_training_order": op5_training_order,
    "op6_quality": op6_quality,
    "op7_packing": op7_packing,
    "op8_nearest": op8_nearest,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_ngram_join": op10_ngram_join,
    "op11_vector_codes": op11_vector_codes,
    "op12_word_bpe": op12_word_bpe,
    "op13_resampling": op13_resampling,
}


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Every round spelled out: c holds a round's codebooks (part, entry, e), a its assignments."""
    nearest = """
a{n} AS MATERIALIZED (
  SELECT v.rid, v.part, v.p, arg_min(c.entry, {d} * 1024 + c.entry) AS entry, min({d}) AS d
  FROM p v JOIN c{n} c ON c.part = v.part GROUP BY ALL)"""
    apart = "CAST(list_sum(list_transform(list_zip(v.p, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    means = """
x{n} AS (SELECT part, entry, i, CAST(floor(sum(p[i]) / count(*)) AS BIGINT) AS m, sum(p[i]) AS s, count(*) AS k
  FROM a{n}, LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i) GROUP BY ALL),
y{n} AS (SELECT part, entry, list(CASE WHEN s % k < 0 THEN s // k - 1 ELSE s // k END ORDER BY i) AS e FROM x{n} GROUP BY ALL),
c{m} AS MATERIALIZED (SELECT c.part, c.entry, CAST(coalesce(y.e, c.e) AS BIGINT[]) AS e FROM c{n} c LEFT JOIN y{n} y USING (part, entry))"""
    steps = [nearest.format(n=0, d=apart)]
    for n in range(rounds):
        steps += [means.format(n=n, m=n + 1), nearest.format(n=n + 1, d=apart)]
    return f"""
WITH k AS (
  SELECT row_number() OVER () AS rid, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT rid, vec_id, part, q[part * len(q) // {parts} + 1 : (part + 1) * len(q) // {parts}] AS p
  FROM k, LATERAL (SELECT unnest(range({parts})) AS part)),
f AS (SELECT rid, row_number() OVER (ORDER BY vec_id, q) - 1 AS entry FROM k WHERE vec_id IS NOT NULL),
c0 AS MATERIALIZED (SELECT part, entry, p AS e FROM p JOIN f USING (rid) WHERE entry < {entries}),{",".join(steps)},
o AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid),
h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS h FROM c{rounds})
SELECT k.vec_id, o.code, o.error, CAST(sum(o.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, h.h AS codebooks_sha256
FROM k JOIN o USING (rid), h
"""


#: CRC-32 of a feature, bit by bit, lowest bit of each byte first.
_RESAMPLING_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
fd AS (
  SELECT rid, array_to_string(w[i : i + n - 1], ' ') AS f
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (VALUES (1), (2), (3)) AS r(n))),
fb AS (
  SELECT array_to_string(w[i : i + n - 1], ' ') AS f
  FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b, (VALUES (1), (2), (3)) AS r(n))),
u AS (SELECT DISTINCT f FROM (SELECT f FROM fd UNION ALL SELECT f FROM fb)),
x AS (SELECT f, hex(encode(f)) AS h FROM u),
y AS (
  SELECT f, list_transform(range(4 * length(h)),
    lambda i: ((instr('123456789ABCDEF', h[CAST(2 * (i // 8) + CASE WHEN i % 8 < 4 THEN 2 ELSE 1 END AS INT)])) >> CAST(i % 4 AS INT)) & 1) AS bits FROM x),
z AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(bits, lambda v: CAST(v AS BIGINT))),
    lambda c, v: xor(c >> 1, 3988292384 * (xor(c, v) & 1))), 4294967295) % 10000 AS k FROM y),
s AS (SELECT k, count(*) AS s FROM fd JOIN z USING (f) GROUP BY k),
t AS (SELECT k, count(*) AS t FROM fb JOIN z USING (f) GROUP BY k),
n AS (SELECT (SELECT count(*) FROM fd) AS ns, (SELECT count(*) FROM fb) AS nt),
g AS (
  SELECT s.k, CAST(floor(1000 * ln((coalesce(t.t, 0) + 1.0::DOUBLE) * (n.ns + 10000) / ((s.s + 1.0::DOUBLE) * (n.nt + 10000)))) AS BIGINT) AS gain
  FROM n, s LEFT JOIN t ON t.k = s.k),
w AS (SELECT rid, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM fd JOIN z USING (f) JOIN g USING (k) GROUP BY rid),
a AS (
  SELECT d.doc_id, len(d.w) AS words, coalesce(w.n_features, 0) AS n_features, coalesce(w.weight, 0) AS weight,
    coalesce(w.weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || d.doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN w USING (rid)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY words >= 20 AND score IS NOT NULL ORDER BY score DESC, doc_id) AS place,
    count(*) FILTER (words >= 20 AND score IS NOT NULL) OVER () AS able FROM a)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CASE WHEN words >= 20 AND score IS NOT NULL AND place <= 5 * able // 100 THEN CAST(place AS BIGINT) END AS rank FROM r
"""
ORACLE_SQL: dict[str, str] = {
    "op10_ngram_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
  SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o.o >= 80 * (x.n + y.n - o.o)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, min(r.b)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id, n.n
""",
    "op1_substring_dedup": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
w AS (
  SELECT rid, i, array_to_string(words[i : i + 34], ' ') AS s
  FROM (SELECT rid, words, unnest(range(1, len(words) - 33)) AS i FROM d)),
r AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1),
c AS (
  SELECT rid, list(DISTINCT p) AS gone
  FROM (SELECT rid, unnest(range(i, i + 35)) AS p FROM w JOIN r USING (s)) GROUP BY rid),
k AS (
  SELECT doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
    CASE WHEN gone IS NULL THEN words
      ELSE list_select(words, list_filter(range(1, len(words) + 1), lambda p: NOT list_contains(gone, p))) END AS kept
  FROM d LEFT JOIN c USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
  sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
""",
    "op4_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op11_vector_codes": _codes_sql(),
    "op13_resampling": _RESAMPLING_SQL,
}
