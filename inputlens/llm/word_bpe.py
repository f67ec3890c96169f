"""BPE with word ends, encoded by a streaming transducer of bounded lookahead; decoding by a state machine from bytes to text.

Whether a boundary between two symbols of a word survives all merges depends on what follows it only up to a number of symbols that
the merge list fixes, its *sufficient lookahead* (``Merges.lookahead``). So a word is read from left to right, the symbols held
back are merged (a heap over linked symbols, lowest rank first, leftmost on ties), and tokens that end at least that far
behind the last symbol read go out for good: memory does not grow with the word. Short words are kept in a bounded memo.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise
from struct import pack

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words kept per Python worker, and the longest that is kept (characters).
MEMO_SIZE, MEMO_CHARS = 800_000, 48
#: Characters normalised at once (a run without white space may be longer), ids decoded at once.
SLICE_CHARS, SLICE_IDS = 1 << 16, 1 << 14
#: How the file splits texts (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: White space as the file's patterns mean it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@functools.cache
def by_pattern():
    return regex.compile(WORDS.replace(r"\s", SPACE)).findall


@functools.cache
def by_library():
    """The library's own normaliser and splitter, slower, for texts with characters that Python's tables lack."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    normal = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()]).normalize_str
    split = pre_tokenizers.Split(Regex(WORDS), "removed", invert=True).pre_tokenize_str
    return lambda text: [word for word, _ in split(normal(text))]


#: Below this every character is older than Python's tables.
OLD = "\u0558"


@functools.cache
def newer():
    """Finds a character that has come to Unicode since Python's tables."""
    unknown = "".join(c for c in map(chr, range(ord(OLD), 0x40000)) if unicodedata.category(c) == "Cn")
    return regex.compile(f"[{regex.escape(''.join(regex.findall(r'\P{Cn}', unknown)))}]").search


class Merges:
    """A merge list over symbols: ``pairs`` (a, b) in order of rank, and the symbol that each makes."""

    def __init__(self, pairs: list[tuple[int, int]], makes: list[int], symbols: int):
        if len(set(makes)) < len(makes):
            raise ValueError("a symbol that several merges make has no single derivation")
        self.makes = makes
        #: follow[a][b]: rank of the merge of a and b
        self.follow: list[dict[int, int]] = [{} for _ in range(symbols)]
        for rank, (a, b) in enumerate(pairs):
            self.follow[a].setdefault(b, rank)
        self.lookahead = self._lookahead(pairs, symbols)
        #: Symbols held back before tokens go out: the more, the less is merged twice.
        self.window = 4 * self.lookahead + 256

    def _lookahead(self, pairs: list[tuple[int, int]], symbols: int) -> int:
        """Symbols after a boundary that decide its fate.

        Compare two texts that agree around a boundary, and let a merge p = (a, b) cross it in one text only. The earliest merge in
        which the texts differ right of it, before p and as far as b reaches, must cross b's right end: it is a q = (x, y) with x a
        symbol on the right edge of b's derivation, earlier than the merge that takes x into b (or than p, if x is b). The
        same holds of q, with ever lower ranks. So reach(p) = len(b) + the largest reach of such a q."""
        length = [1] * symbols
        whole: dict[int, tuple[int, int]] = {}  # symbol: rank of the merge that makes it, its right part
        led: dict[int, tuple[list[int], list[int]]] = {}  # left part: ranks of its merges, largest reach up to each
        most = 0
        for rank, ((a, b), made) in enumerate(zip(pairs, self.makes, strict=True)):
            length[made] = length[a] + length[b]
            further, x, taken = 0, b, rank
            while True:
                ranks, reaches = led.get(x, ((), ()))
                if (n := bisect_left(ranks, taken)) > 0:
                    further = max(further, reaches[n - 1])
                if x not in whole:
                    break
                taken, x = whole[x]
            reach = length[b] + further
            whole[made] = (rank, b)
            ranks, reaches = led.setdefault(a, ([], []))
            ranks.append(rank)
            reaches.append(max(reach, reaches[-1] if reaches else 0))
            most = max(most, reach)
        return most

    def merged(self, part: list[int]) -> tuple[list[int], list[int]]:
        """Tokens of a list of symbols, and where each ends."""
        follow, makes, n = self.follow, self.makes, len(part)
        part = list(part)
        # a heap entry is rank and place in one integer, ordered as the pair
        heap = [r * n + i for i, (a, b) in enumerate(pairwise(part)) if (r := follow[a].get(b)) is not None]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            rank, i = divmod(heappop(heap), n)
            j, left = after[i], part[i]
            if left < 0 or j >= n or follow[left].get(part[j]) != rank:
                continue
            part[i], part[j] = made, _ = makes[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := follow[made].get(part[k])) is not None:
                    heappush(heap, r * n + i)
            h = before[i]
            if h >= 0 and (r := follow[part[h]].get(made)) is not None:
                heappush(heap, r * n + h)
        alive = [i for i in range(n) if part[i] >= 0]
        return [part[i] for i in alive], [after[i] for i in alive]


class Transducer:
    """Symbols of one word in, tokens out as soon as nothing that follows can change them."""

    def __init__(self, merges: Merges):
        self.merges, self.held = merges, []

    def push(self, symbols: list[int]) -> list[int]:
        out, window = [], self.merges.window
        for at in range(0, len(symbols), window):
            self.held += symbols[at : at + window]
            if len(self.held) > window:
                tokens, ends = self.merges.merged(self.held)
                n = bisect_left(ends, len(self.held) - self.merges.lookahead + 1)
                out += tokens[:n]
                del self.held[: ends[n - 1] if n else 0]
        return out

    def finish(self) -> list[int]:
        out = self.merges.merged(self.held)[0] if self.held else []
        self.held = []
        return out


class WordCodec(dict):
    """Encoder and decoder of one file of the ``tokenizers`` library; as a dict, the bounded memo from word to packed ids.

    The file's model is BPE over a byte alphabet with an ending for the last byte of a word; texts are composed (NFC) and
    lower-cased, white space is dropped, and special tokens in a text are themselves. Any other kind of file is refused."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model, steps = made["model"], made["pre_tokenizer"].get("pretokenizers", [])
        normal = [(n["type"], n.get("pattern"), n.get("content")) for n in (made["normalizer"] or {}).get("normalizers", [])]
        ending = model["end_of_word_suffix"]
        odd = [model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")]
        if model["type"] != "BPE" or not ending or any(odd) or made["decoder"] is not None or made["post_processor"] is not None:
            raise ValueError(f"{path} is no BPE with word ends only")
        if normal != [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]:
            raise ValueError(f"{path} normalises texts in another way")
        shape = [(s["type"], s.get("behavior"), s.get("invert"), s.get("use_regex")) for s in steps]
        if shape != [("Split", "Removed", True, None), ("ByteLevel", None, None, False)] or steps[1]["add_prefix_space"]:
            raise ValueError(f"{path} splits texts in another way")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in made["added_tokens"]):
            raise ValueError(f"{path} has added tokens of another kind")
        self.added = {t["content"]: t["id"] for t in made["added_tokens"]}
        names = sorted(map(regex.escape, self.added), key=len, reverse=True)
        self.special = regex.compile(f"({'|'.join(names)})") if names else None
        if steps[0]["pattern"].get("Regex") != WORDS:
            raise ValueError(f"{path} splits texts by another pattern")
        # the byte alphabet: printable characters stand for their bytes, others follow from 256 on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        vocab: dict[str, int] = model["vocab"]
        self.inner = [vocab[letter[b]] for b in range(256)]
        self.last = [vocab[letter[b] + ending] for b in range(256)]
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        size = max(*vocab.values(), *self.added.values()) + 1
        self.merges = Merges([(vocab[a], vocab[b]) for a, b in pairs], [vocab[a + b] for a, b in pairs], size)
        #: by id: the token as the file spells it, and the bytes that it stands for (a word's end is a space)
        self.spelled, self.meant = [b""] * size, [b""] * size
        byte = {c: b for b, c in letter.items()}
        for token, i in vocab.items():
            body = token.removesuffix(ending)
            self.spelled[i] = token.encode()
            self.meant[i] = bytes(byte[c] for c in body) + (b" " if body != token else b"")
        for token, i in self.added.items():
            self.spelled[i] = self.meant[i] = token.encode()

    def __missing__(self, word: str) -> bytes:
        out, machine = [], Transducer(self.merges)
        # the last byte has a symbol of its own, so it stays back
        for at in range(0, len(word), SLICE_CHARS):
            raw = word[at : at + SLICE_CHARS].encode()
            final = at + SLICE_CHARS >= len(word)
            out += machine.push([self.inner[b] for b in (raw[:-1] if final else raw)])
        out += machine.push([self.last[raw[-1]]]) + machine.finish()
        packed = pack(f"<{len(out)}I", *out)
        if len(word) <= MEMO_CHARS:
            self[word] = packed
        return packed

    def words(self, text: str) -> list[str]:
        """Words of a text as they are encoded: composed, in lower case, without white space."""
        if text.isascii():
            return by_pattern()(text.lower())
        # a capital sigma becomes the plain small one, wherever it stands; Python's rule for the end of a word is another
        if max(text) >= OLD and newer()(text):
            return by_library()(text)
        return by_pattern()(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _slices(self, text: str) -> Iterator[str]:
        """The text in pieces that begin with white space: nothing composes or is split across such a place."""
        at, space = 0, regex.compile(f"[{SPACE}]")
        while len(text) - at > SLICE_CHARS:
            found = space.search(text, at + SLICE_CHARS)
            to = found.start() if found else len(text)
            yield text[at:to]
            at = to
        yield text[at:]

    def encoded(self, text: str | None) -> Iterator[bytes]:
        """Ids piece by piece, each as a little-endian unsigned 32-bit integer."""
        for piece in self._slices(text or ""):
            if len(self) > MEMO_SIZE:
                self.clear()
            for k, part in enumerate(self.special.split(piece) if self.special else [piece]):
                yield pack("<I", self.added[part]) if k % 2 else b"".join(map(self.__getitem__, self.words(part)))

    def encode(self, text: str | None) -> bytes:
        return b"".join(self.encoded(text))


class TextMachine:
    """Ids to text, piece by piece. Its state: the bytes of a character that is not complete, and whether a token came before.

    As the file has no decoder, tokens come spelled as in the file with a space between; ``words`` gives the text that they
    mean instead, a space after each word. Bytes that are no UTF-8 become U+FFFD."""

    def __init__(self, codec: WordCodec, words: bool = False):
        self.table, self.gap = (codec.meant, b"") if words else (codec.spelled, b" ")
        self.bytes_in = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def feed(self, ids: list[int]) -> str:
        if not ids:
            return ""
        raw = self.gap.join(map(self.table.__getitem__, ids))
        raw, self.begun = self.gap * self.begun + raw, True
        return self.bytes_in.decode(raw)

    def finish(self) -> str:
        return self.bytes_in.decode(b"", final=True)


def texts(codec: WordCodec, ids: np.ndarray, words: bool = False) -> Iterator[str]:
    machine = TextMachine(codec, words)
    for at in range(0, len(ids), SLICE_IDS):
        yield machine.feed(ids[at : at + SLICE_IDS].tolist())
    yield machine.finish()


@functools.cache
def codec(path: str) -> WordCodec:
    return WordCodec(path)


def encode(text: Column, path: str) -> Column:
    """Array of token ids of a text column; null text is empty, an empty text has no ids."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path)
        for column in batches:
            yield pd.Series([np.frombuffer(c.encode(t), dtype="<i4") for t in column])

    return ids(text)


def decode(ids: Column, path: str, words: bool = False) -> Column:
    """Text of an array of token ids (see ``TextMachine``); a null array is null, an id that the file lacks is nothing."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path)
        for arrays in batches:
            known = [None if a is None else (n := np.asarray(a, dtype=np.int64))[(n >= 0) & (n < len(c.spelled))] for a in arrays]
            yield pd.Series([None if a is None else "".join(texts(c, a, words)) for a in known], dtype=object)

    return text(ids)


def digest(text: Column, path: str) -> Column:
    """Struct (n_tokens, ids_sha256, decoded_sha256): ids and text are made, hashed and dropped piece by piece. Null text
    counts as empty; rows that repeat stay as often as they are, other columns are not read."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for column in batches:
            rows = []
            for t in column:
                n, of_ids, of_text, machine = 0, hashlib.sha256(), hashlib.sha256(), TextMachine(c)
                for packed in c.encoded(t):
                    n += len(packed) // 4
                    of_ids.update(packed)
                    of_text.update(machine.feed(np.frombuffer(packed, dtype="<u4").tolist()).encode())
                of_text.update(machine.finish().encode())
                rows.append((n, of_ids.hexdigest(), of_text.hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return both(text)
