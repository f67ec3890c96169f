import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from inputlens.llm import word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(PATH)
    made.no_truncation()
    made.no_padding()
    return made


def ids(text):
    return np.frombuffer(word_bpe.codec(PATH).encode(text), dtype="<u4").tolist()


ODD = [
    "", " ", "\t\n", "Hello, World's 123 it'll", "ΣΑΣ ὈΔΥΣΣΕΎΣ", "İstanbul ﬁ ǅ", "é É ́", "a b c　d",
    "x<|endoftext|>y <|startoftext|>", "<|endoftext", "日本語テキスト", "👩‍👩‍👧 🙂", "\x00\x1c\x1f\x85", "a" * 5000, "ab" * 3000, "ꟋꟚ x", "'s't's",
]


@pytest.mark.parametrize("text", ODD)
def test_as_the_library(library, text):
    expected = library.encode(text, add_special_tokens=False).ids
    assert ids(text) == expected
    machine = word_bpe.texts(word_bpe.codec(PATH), np.array(expected, dtype=np.int64))
    assert "".join(machine) == library.decode(expected, skip_special_tokens=False)


LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_as_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    made, codec = ids(text), word_bpe.codec(PATH)
    assert made == LIBRARY.encode(text, add_special_tokens=False).ids
    meant = [part if part in codec.added else "".join(codec.words(part)) for part in codec.special.split(text)]
    assert "".join(word_bpe.texts(codec, np.array(made, dtype=np.int64), words=True)).replace(" ", "") == "".join(meant)


def test_library_on_many_texts(library):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdeinorst 'é1Ωß́.") for _ in range(rng.choice([3, 40, 900]))) for _ in range(300)]
    for text, expected in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids(text) == expected.ids


def some_merges(rng, base=3):
    pairs, makes, n = [], [], base
    for _ in range(rng.randint(0, 12)):
        pair = (rng.randrange(n), rng.randrange(n))
        if pair not in pairs:
            pairs.append(pair)
            makes.append(n)
            n += 1
    return word_bpe.Merges(pairs, makes, n)


def test_lookahead_decides_every_boundary():
    rng = random.Random(3)
    for _ in range(200):
        merges = some_merges(rng)
        for _ in range(20):
            word = [rng.randrange(3) for _ in range(rng.randint(1, 40))]
            final = set(merges.merged(word)[1])
            for cut in range(1, len(word)):
                seen = set(merges.merged(word[:cut])[1])
                decided = range(1, cut - merges.lookahead + 1)
                assert [j in seen for j in decided] == [j in final for j in decided]


def test_transducer_with_any_window_gives_the_whole_word():
    rng = random.Random(4)
    for _ in range(200):
        merges = some_merges(rng)
        merges.window = merges.lookahead + rng.randint(1, 5)
        word = [rng.randrange(3) for _ in range(rng.randint(1, 200))]
        machine, out, at = word_bpe.Transducer(merges), [], 0
        while at < len(word):
            n = rng.randint(1, 9)
            out += machine.push(word[at : at + n])
            at += n
            assert len(machine.held) <= 2 * merges.window + 20
        assert out + machine.finish() == merges.merged(word)[0]


def test_memory_does_not_grow_with_a_word():
    merges = word_bpe.codec(PATH).merges
    machine = word_bpe.Transducer(merges)
    most = 0
    for _ in range(200):
        machine.push([word_bpe.codec(PATH).inner[97]] * 500)
        most = max(most, len(machine.held))
    assert most <= 2 * merges.window


def test_text_machine_keeps_incomplete_characters():
    codec = word_bpe.codec(PATH)
    raw = "é日🙂"
    single = [codec.inner[b] for b in raw.encode()]
    machine = word_bpe.TextMachine(codec, words=True)
    assert "".join(machine.feed([i]) for i in single) + machine.finish() == raw
    machine = word_bpe.TextMachine(codec, words=True)
    assert machine.feed(single[:1]) + machine.finish() == "�"


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        word_bpe.WordCodec(public_tokenizers.path("byte_bpe_50k.json"))


def test_columns(spark, library):
    rows = [(1, "Some text", "x"), (1, "Some text", "y"), (2, None, "z"), (3, "", None), (None, "tail <|endoftext|>", "q"), (5, "long " * 40_000, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = docs.select("doc_id", "text", word_bpe.digest(docs.text, PATH).alias("d"), word_bpe.encode(docs.text, PATH).alias("ids")).collect()
    assert len(got) == len(rows)
    for r in got:
        expected = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == expected and r.d.n_tokens == len(expected)
        assert r.d.ids_sha256 == hashlib.sha256(np.array(expected, dtype="<u4").tobytes()).hexdigest()
        assert r.d.decoded_sha256 == hashlib.sha256(library.decode(expected, skip_special_tokens=False).encode()).hexdigest()
    back = spark.createDataFrame([([320, 10**6, -1],), (None,), ([],)], "ids array<int>")
    assert [r[0] for r in back.select(word_bpe.decode(back.ids, PATH)).collect()] == [library.decode([320], skip_special_tokens=False), None, ""]
    assert docs.limit(0).select(word_bpe.digest(docs.text, PATH)).count() == 0
