"""BPE encoding and decoding with forced boundaries.

A pair of neighbouring symbols that stands inside no vocabulary token can never
be joined by a merge, whatever surrounds it.  Each such pair is a certain cut:
the fragments between cuts are encoded on their own and their ids concatenated,
which gives what encoding the word as a whole gives.

``encode`` and ``decode`` are narrow: texts stay in their partitions and nothing
is shuffled.  Every executor process keeps the ids of the words it has met of late
(``CACHE_WORDS``).  A text is encoded whole in one task, whatever its length.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import cache, cached_property
from hashlib import sha256
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.common import per_text, table

#: Words whose ids an executor process remembers, at most twice over: when so many are new, those not met since the last time go.
CACHE_WORDS = 120_000
#: Fragments longer than this are merged with a heap.
SHORT = 48


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that byte-level BPE writes for each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    shifted = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


def _simple_chars() -> tuple[str, str]:
    """Character-class bodies: all characters of the quick path, and its letters.

    Below U+0180 and in the general punctuation taken here, text is stable under
    NFC and lower-cases character by character, to letters below U+0250.
    """
    letters = "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == "L")
    return "\\x00-\u017f\u2010-\u2027\u20ac", letters


class Known(dict):
    """The ids of words, computed when first asked for: those met of late, and in ``before`` those met before them."""

    def __init__(self, compute):
        self.compute, self.before = compute, {}

    def __missing__(self, word: str) -> list[int]:
        ids = self.before.get(word)
        if ids is None:
            ids = self.compute(word)
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.before = self.copy()
                self.clear()
            self[word] = ids
        return ids


class ForcedBoundaryBPE:
    """Encoder for a ``tokenizers`` BPE file with a byte-level alphabet and a word-end suffix."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.added.items()]}
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.inside = {pair for t in self.vocab for pair in self._pairs(t)}
        self.symbols = byte_symbols()
        simple, letters = _simple_chars()
        numbers = "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == "N")
        space = "\\x09-\\x0d\\x20\\x85\\xa0"
        self.other = re.compile(f"[^{simple}]")
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+").findall
        self.special = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.known = Known(self.encode_word)
        self.decimal = {i: str(i) for i in self.tokens}

    @cached_property
    def library(self):
        """For texts whose normal form needs tables; made when the first one comes."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _pairs(self, token: str) -> list[tuple[str, str]]:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = [*token[: -len(self.suffix)]]
            body[-1] += self.suffix
        else:
            body = [*token]
        return list(zip(body, body[1:]))

    def fragments(self, symbols: list[str]) -> list[list[str]]:
        """``symbols`` split wherever two neighbours stand together in no token."""
        out, start = [], 0
        for i in range(1, len(symbols)):
            if (symbols[i - 1], symbols[i]) not in self.inside:
                out.append(symbols[start:i])
                start = i
        out.append(symbols[start:])
        return out

    def merge(self, parts: list[str]) -> list[str]:
        """The lowest-ranked pair first, the leftmost among equals."""
        if len(parts) > SHORT:
            return self._merge_long(parts)
        rank, none = self.ranks.get, len(self.ranks)
        ranks = [rank(pair, none) for pair in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            joined = parts[i] + parts[i + 1]
            parts[i : i + 2] = [joined]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], joined), none)
            if i < len(ranks):
                ranks[i] = rank((joined, parts[i + 1]), none)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        n = len(parts)
        part: list[str | None] = [*parts]
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if part[i] != left or j >= n or part[j] != right:
                continue
            part[i], part[j] = left + right, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (r := self.ranks.get((part[a], part[b]))) is not None:
                    heapq.heappush(heap, (r, a, part[a], part[b]))
        return [p for p in part if p is not None]

    def encode_symbols(self, symbols: list[str]) -> list[int]:
        symbols[-1] += self.suffix
        return [self.vocab[t] for f in self.fragments(symbols) for t in self.merge(f)]

    def encode_word(self, word: str) -> list[int]:
        return self.encode_symbols([self.symbols[b] for b in word.encode()])

    def _plain(self, text: str, ids: list[int]) -> None:
        if self.other.search(text):
            # Characters whose normal form needs tables: the library normalises and splits, the merges stay here.
            for mapped, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text)):
                ids += self.encode_symbols([*mapped])
            return
        ids += chain.from_iterable(map(self.known.__getitem__, self.words(text.lower())))

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        if self.special is None:
            self._plain(text, ids)
            return ids
        for i, piece in enumerate(self.special.split(text) if "<" in text else [text]):
            if i % 2:
                ids.append(self.added[piece])
            elif piece:
                self._plain(piece, ids)
        return ids

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by blanks, as the library does for a file without a decoder; unknown ids are left out."""
        tokens = self.tokens
        try:
            return " ".join(map(tokens.__getitem__, ids))
        except KeyError:
            return " ".join([tokens[i] for i in ids if i in tokens])


@cache
def encoder(path: str) -> ForcedBoundaryBPE:
    return ForcedBoundaryBPE(path)


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, ids array<int>`` for each row; a null text counts as empty and has no ids."""
    path = tokenizer or default_tokenizer()

    def run(texts: list[str | None]) -> list:
        e = encoder(path)
        return [[e.encode(t or "") for t in texts]]

    return per_text(docs, ["doc_id"], run, "ids array<int>")


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, text`` for each row of ``encode``'s form; null ids count as none."""
    path = tokenizer or default_tokenizer()

    def run(lists: list[list[int] | None]) -> list:
        e = encoder(path)
        return [[e.decode(ids or []) for ids in lists]]

    return per_text(encoded.select("doc_id", F.col("ids").alias("text")), ["doc_id"], run, "decoded string").withColumnRenamed("decoded", "text")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Digests of what ``encode`` and then ``decode`` give, in one pass over the texts.

    Columns: doc_id, n_tokens, ids_sha256, decoded_sha256.  A null or empty text
    has no tokens and the digests of the empty string; a very long text is one
    text like others; repeated rows and rows without an id stay; an empty table
    gives an empty one; other columns are ignored.
    """
    path = tokenizer or default_tokenizer()

    def run(texts: list[str | None]) -> list:
        e, rows = encoder(path), []
        for t in texts:
            ids = e.encode(t) if t else []
            rows.append((len(ids), sha256(" ".join(map(e.decimal.__getitem__, ids)).encode()).hexdigest(), sha256(e.decode(ids).encode()).hexdigest()))
        return [*zip(*rows)] or [[], [], []]

    return per_text(docs, ["doc_id"], run, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
