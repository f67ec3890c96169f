"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms of a document are hashed: the shapes of its words (runs of capitals, small letters and digits become one
sign each, other signs stay), pairs of shapes, words equal to the word before, and the words themselves. Weighted
by inverse document frequency they are projected on the leading singular vectors of a bounded labelled sample.
The sample's vectors are broadcast; every document's cosines with all of them are computed exactly, in blocks,
and its nearest neighbours vote with weights that grow with the similarity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inputlens.llm.common import hashed_words, labelled_sample, mix, span_hashes

#: Labelled documents in the sample at most (about).
SAMPLE_DOCS = 6000
#: Hashed terms: of shapes, of pairs of shapes, of words; singular vectors; neighbours; sharpness of their weights.
SHAPES, PAIRS, LEXICAL, RANK, NEIGHBOURS, SHARPNESS = 512, 1024, 1024, 48, 15, 20.0
TERMS = SHAPES + PAIRS + LEXICAL + 1
#: Share of a vector's length that words have beside shapes.
LEXICAL_WEIGHT = 0.25
#: Documents whose cosines are computed at once.
BLOCK = 512

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[0x80:] = ord("a")
_CLASS[ord("0") : ord("9") + 1] = ord("0")


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


def counts(column: pa.Array) -> np.ndarray:
    """Term counts, a row for each text (null as empty); every word of the whole text counts."""
    out = np.zeros((len(column), TERMS), dtype=np.float32)
    for at, to, words in hashed_words(column, (1,), lower=True):
        text = words.text
        sign = _CLASS[text]
        keep = np.ones(len(text), dtype=bool)
        run = (sign[1:] == sign[:-1]) & np.isin(sign[1:], np.frombuffer(b"Aa0", dtype=np.uint8))
        keep[1:] = ~run
        keep[words.starts] = True  # words stay words
        offsets = np.concatenate([[0], np.cumsum(keep)])
        row = np.repeat(np.arange(to - at), np.diff(words.bounds))
        shape = _shapes(sign[keep], offsets[words.starts], offsets[words.ends])
        word = words.hashes[0]
        add = lambda term, rows: np.add.at(out, (at + rows, term), 1)
        add((shape % np.uint64(SHAPES)).astype(np.int64), row)
        if len(word) > 1:
            within = row[1:] == row[:-1]
            pair = mix(shape[:-1] * np.uint64(3) + shape[1:]) % np.uint64(PAIRS)
            add(SHAPES + pair.astype(np.int64)[within], row[1:][within])
            again = within & (word[1:] == word[:-1])
            add(np.full(again.sum(), TERMS - 1), row[1:][again])
        add(SHAPES + PAIRS + (word % np.uint64(LEXICAL)).astype(np.int64), row)
    return out


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, place, label, text) with the text's term counts, compressed, in place of the text."""
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            part = batch.slice(a, BLOCK)
            terms = [zlib.compress(row.tobytes(), 1) for row in counts(part.column(3))]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(terms, pa.binary())], names=["doc_id", "place", "label", "terms"])


def _shapes(signs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words' shapes, given where each word's signs start and end."""
    return span_hashes(signs, starts, ends, 2, False)


def weighted(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Logarithmic counts relative to the document's length, times idf; shapes and words each of fixed length."""
    x = n / np.maximum(1.0, n[:, :SHAPES].sum(1, keepdims=True))
    x = np.log1p(50 * x) * idf
    parts = [x[:, : SHAPES + PAIRS], x[:, SHAPES + PAIRS : -1], x[:, -1:]]
    unit = lambda p: p / np.maximum(1e-9, np.linalg.norm(p, axis=1, keepdims=True))
    return np.hstack([unit(parts[0]), LEXICAL_WEIGHT * unit(parts[1]), np.minimum(1.0, parts[2] / np.maximum(1e-9, idf[-1] * np.log1p(50 * 0.3)))])


def leading_axes(x: np.ndarray, rank: int, rounds: int = 3) -> np.ndarray:
    """Leading right singular vectors by a randomised range finder with power iterations."""
    rank = min(rank, *x.shape)
    q = np.linalg.qr(x @ np.random.default_rng(7).standard_normal((x.shape[1], rank + 12), dtype=np.float32))[0]
    for _ in range(rounds):
        q = np.linalg.qr(x @ (x.T @ q))[0]
    return np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from the documents (doc_id, text) that ``labels`` (doc_id, label 0/1) names: both classes in equal
    parts if there are enough of each.

    A bounded sample: of either class about half of SAMPLE_DOCS documents, with their whole texts (null: no words). Their
    terms are counted in tasks; the driver gets the counts, not the texts. The prior is the share of label 1 among all
    labelled documents of ``docs``; without rows every score is 0.5."""
    rows, sizes = labelled_sample(docs, labels, SAMPLE_DOCS // 2)
    rows = sorted(rows.mapInArrow(counted, "doc_id long, place double, label int, terms binary").collect(), key=lambda r: (r.place, r.doc_id))
    if not rows:
        return Model(np.ones(TERMS), np.zeros((TERMS, 1)), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    n = np.empty((len(rows), TERMS), dtype=np.float32)
    for i, r in enumerate(rows):
        n[i] = np.frombuffer(zlib.decompress(bytes(r.terms)), np.float32)
    idf = np.log((1 + len(n)) / (1 + (n > 0).sum(0))) + 0.1
    for a in range(0, len(n), BLOCK):  # in place: the sample's matrix is the driver's largest array
        n[a : a + BLOCK] = weighted(n[a : a + BLOCK], idf)
    axes = leading_axes(n, RANK)
    z = n @ axes
    z /= np.maximum(1e-9, np.linalg.norm(z, axis=1, keepdims=True))
    return Model(idf, axes, z.astype(np.float32), np.array([r.label for r in rows], float), sizes.get(1, 0) / sum(sizes.values()))


def cosines(z: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines of unit rows with unit rows, rounded to 1e-6: a text's votes must not depend on the block it stands in."""
    return np.round((z @ vectors.T).astype(np.float64), 6)


def score(model: Model, column: pa.Array) -> np.ndarray:
    """Weighted share of label 1 among the nearest labelled vectors; neighbours as near as the last one all vote, so ties
    need no choice. Texts without words get the prior."""
    out = np.full(len(column), model.prior)
    if not len(model.labels):
        return out
    k = min(NEIGHBOURS, len(model.labels))
    for a in range(0, len(column), BLOCK):
        part = column.slice(a, BLOCK)
        n = counts(part)
        z = weighted(n, model.idf) @ model.axes
        z = (z / np.maximum(1e-9, np.linalg.norm(z, axis=1, keepdims=True))).astype(np.float32)
        has = np.flatnonzero(n[:, :SHAPES].sum(1) > 0)
        c = cosines(z[has], model.vectors)
        last = np.partition(c, len(model.labels) - k, axis=1)[:, len(model.labels) - k]
        row, neighbour = np.nonzero(c >= last[:, None])
        weights = np.exp(SHARPNESS * (c[row, neighbour] - 1))
        for_one = np.bincount(row, weights=weights * model.labels[neighbour], minlength=len(has))
        out[a + has] = np.round(for_one / np.maximum(1e-300, np.bincount(row, weights=weights, minlength=len(has))), 6)
    return np.clip(out, 0.0, 1.0)


def predict(text: Column, model: Model) -> Column:
    """Score from 0 to 1 of a text column (higher: label 1 likelier), of whole texts at any length. Null, empty and blank
    texts get the prior; rows that repeat get equal scores."""
    from pyspark.sql import SparkSession

    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def vote(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(score(shared.value, texts), pa.float64())

    return vote(text)
