"""Language identification by compression: a text belongs to the language whose dictionaries encode it smallest.

A language's dictionaries are raw text of its own, so zstandard finds the text's letter sequences there and saves
bytes. Every text, of any size, is measured in one way: its words (lower case, letters only) are encoded behind each of
PASSAGES passages of the language with each of DICTS dictionaries; what counts is the mean number of bytes that the
text adds to the passage. A margin over the second language that learning showed to be too narrow is a rejection.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sample: documents of a language at most (about); bytes of a dictionary at least, dictionaries, passages of a language,
#: their bytes, and bytes of the texts that they are taken from, at equal distances.
SAMPLE_DOCS, DICT_BYTES, DICTS, PASSAGES, PASSAGE_BYTES, SOURCE_BYTES = 800, 1 << 17, 2, 3, 300, 1 << 15
#: Share of right answers among the calibration documents that rejection may cost at most.
COST = 0.002
LEVEL = 3

UNKNOWN = "und"
_LETTERS = regex.compile(r"\p{L}+")


def canonical(text: str | None) -> bytes:
    return " ".join(_LETTERS.findall((text or "").lower())).encode()


@dataclass
class Model:
    """Dictionaries and passages by language, and the relative margin up to which a text is rejected."""

    dictionaries: dict[str, list[bytes]]
    passages: dict[str, list[bytes]] = field(default_factory=dict)
    narrow: float = 0.0


def fit(labelled: DataFrame) -> Model:
    """Model from rows (doc_id, text, lang); null texts and languages teach nothing.

    A bounded sample: of each language the rows whose hash falls under a share that gives about SAMPLE_DOCS, with
    their whole texts. Dictionaries are filled with whole texts, one after another, then the passages; the texts that are
    left calibrate the rejection."""
    labelled = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    counts = labelled.groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return Model({})
    share = F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, SAMPLE_DOCS / n)])
    rows = labelled.filter(place < share[F.col("lang")]).select("lang", "text", place.alias("place")).collect()
    return learned([(r.lang, r.text) for r in sorted(rows, key=lambda r: (r.place, r.text))])


def learned(rows: list[tuple[str, str]]) -> Model:
    """Model from a sample (lang, text)."""
    by: dict[str, list[bytes]] = {}
    for lang, text in rows:
        if words := canonical(text):
            by.setdefault(lang, []).append(words)
    model, left = Model({}), []
    for lang, texts in sorted(by.items()):
        parts: list[list[bytes]] = [[]]
        for t in texts:
            full = sum(map(len, parts[-1])) >= (DICT_BYTES if len(parts) <= DICTS else SOURCE_BYTES)
            if full and len(parts) <= DICTS:
                parts.append([])
                full = False
            if full:
                left.append((lang, t))
            else:
                parts[-1].append(t)
        model.dictionaries[lang] = [b"\n".join(p) for p in parts[:DICTS]]
        source = b" ".join(parts[-1])  # of a small sample, the last dictionary
        step = max(1, len(source) // PASSAGES)
        model.passages[lang] = [source[i * step : i * step + PASSAGE_BYTES] + b" " for i in range(PASSAGES)]
    classify = Classifier(model)
    found = [(classify.ranked(words), lang) for lang, words in left]
    right = np.sort([_margin(sizes) for sizes, lang in found if sizes[0][1] == lang])
    wrong = [_margin(sizes) for sizes, lang in found if sizes[0][1] != lang]
    if len(right) and wrong:
        model.narrow = min(max(wrong), float(right[int(COST * len(right))]))
    return model


def _margin(sizes: list[tuple[float, str]]) -> float:
    return (sizes[1][0] - sizes[0][0]) / max(sizes[0][0], 1.0) if len(sizes) > 1 else math.inf


def _encoder(raw: bytes) -> zstandard.ZstdCompressor:
    content = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    content.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=content, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)


class Classifier:
    def __init__(self, model: Model):
        self.narrow, self.by = model.narrow, []
        for lang in sorted(model.dictionaries):
            coders = [_encoder(raw) for raw in model.dictionaries[lang]]
            self.by.append((lang, [(c, p, len(c.compress(p))) for c in coders for p in model.passages[lang]]))

    def ranked(self, words: bytes) -> list[tuple[float, str]]:
        """Mean encoded size by language, smallest first."""
        return sorted((sum(len(c.compress(p + words)) - n for c, p, n in ways) / len(ways), lang) for lang, ways in self.by)

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        words = canonical(text)
        if not words or not self.by:
            return UNKNOWN, 0.0, True
        sizes = self.ranked(words)
        best, lang = sizes[0]
        scale = 0.5 + 0.01 * best
        score = 1 / sum(math.exp(max(-50.0, (best - s) / scale)) for s, _ in sizes)
        return lang, score, _margin(sizes) <= self.narrow


def predict(text: Column, model: Model) -> Column:
    """Struct (lang, score, rejected) of a text column. ``und`` and rejected: null text or no letter, or a model without
    languages. Ties go to the first language by name, and are rejected. The score is 1 for a clear winner, 1/n for n equal
    ones. Texts count whole, however long; rows that repeat get equal answers."""
    from pyspark.sql import SparkSession

    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, rejected boolean")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classifier = Classifier(shared.value)
        for texts in batches:
            yield pd.DataFrame([classifier(t) for t in texts], columns=["lang", "score", "rejected"])

    return classify(text)
