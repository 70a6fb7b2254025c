"""Substring deduplication with suffix automata.

Words that lie in a window of ``WINDOW`` words which also starts earlier in the
corpus are removed.  Candidate segments (see ``windows``) are dealt to shards by
content.  A shard's reference, its different segments in corpus order, becomes
suffix automata whose states know where their strings end first.  The segments
are then streamed through: the matching statistic at a word is the longest
suffix found in the reference, and where it reaches the threshold the state tells
whether an earlier window is the same.

Automata are not broadcast: all shards together grow with the corpus.  Each goes
to the one task that its segments are dealt to.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from terrace.llm import windows
from terrace.llm.common import table

WINDOW, GRAM, PIECE, HOT = 20, 8, 2, 256
#: Different segments whose automaton a task builds in one piece.
SHARD = 1000


def word_units(text: str) -> tuple[list[bytes], np.ndarray]:
    words = text.encode().split()
    h = np.fromiter(map(crc32, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        return words, (h + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)


SPEC = windows.Spec(WINDOW, GRAM, PIECE, HOT, word_units, b" ".join)


class SuffixAutomaton:
    """All substrings of the sequences added; each state knows the place at which its strings ended first.

    Sequences are to be added in the order of their places.
    """

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [(-1, -1)]

    def _state(self, length: int, first: tuple[int, int], edges: dict, link: int) -> int:
        self.length.append(length)
        self.first.append(first)
        self.next.append(edges)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, symbol: bytes, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.first[q], self.next[q].copy(), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, symbols: list[bytes], doc: int, start: int) -> None:
        last = 0
        for i, symbol in enumerate(symbols):
            q = self.next[last].get(symbol)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, symbol, q)
                continue
            new = self._state(self.length[last] + 1, (doc, start + i), {}, 0)
            p = last
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][symbol]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, symbol, q)
            last = new

    def statistics(self, symbols: list[bytes], limit: int) -> Iterator[tuple[int, tuple[int, int]]]:
        """At each symbol the length of the longest suffix found, at most ``limit``, and where that suffix ended first."""
        state = matched = 0
        following, link, length = self.next, self.link, self.length
        for symbol in symbols:
            while state and symbol not in following[state]:
                state = link[state]
                matched = length[state]
            q = following[state].get(symbol)
            if q is not None:
                state, matched = q, matched + 1
            if matched >= limit:
                matched = limit
                while length[link[state]] >= limit:
                    state = link[state]
            yield matched, self.first[state]


def repeats(shard: list[tuple[int, int, int, list[bytes]]], limit: int) -> Iterator[tuple[int, int, int]]:
    """``doc, first window, windows`` of stretches that start earlier; ``shard``: doc, first, windows and words of each segment, by place."""
    automaton, distinct = SuffixAutomaton(), {}
    for doc, first, count, words in shard:
        if distinct.setdefault(tuple(words), (doc, first)) == (doc, first):
            automaton.add(words, doc, first)
    for doc, first, count, words in shard:
        run = None
        for i, (matched, (at, end)) in enumerate(automaton.statistics(words, limit)):
            if matched >= limit and (at, end) < (doc, first + i):
                start = first + i - limit + 1
                if run and run[0] + run[1] == start:
                    run[1] += 1
                else:
                    if run:
                        yield doc, *run
                    run = [start, 1]
        if run:
            yield doc, *run


def _frame(rows: list, columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns)


def split(shard: list[tuple[int, int, int, int, list[bytes]]], length: int, piece: int) -> Iterator[list[tuple[int, int, int, list[bytes]]]]:
    """A shard of very many segments as small ones: windows whose anchors lie at about the same offset, by the words that all of them hold.

    Equal windows have equal anchors at equal offsets, so they stay together.
    """
    parts: dict[tuple[int, tuple[bytes, ...]], list[tuple[int, int, int, list[bytes]]]] = {}
    for doc, first, count, offset, words in shard:
        for g in range((offset - count + 1) // piece, offset // piece + 1):
            near, far = g * piece, g * piece + piece - 1
            lo, hi = max(0, offset - far), min(count - 1, offset - near)
            own = words[lo : hi + length]
            core = tuple(words[offset - near : offset - far + length])
            parts.setdefault((g, core), []).append((doc, first + lo, hi - lo + 1, own))
    yield from parts.values()


def removals(texts: DataFrame, found: DataFrame, hot: np.ndarray, spec: windows.Spec = SPEC) -> DataFrame:
    """``doc, first, count``: ranges of windows that also start earlier."""
    columns, shape = ["key", "doc", "first", "count", "offset", "data"], ["doc", "first", "count"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for seen in windows.flushed(pdf, spec, hot):
                rows = []
                for (key, data, offset, count), places in seen.items():
                    rows.append((key, *places[0], count, offset, data))
                    rows += [(d ^ f << 32, d, f, count, 0, None) for d, f in places[1:]]
                for i in range(0, len(rows), windows.ROWS):
                    yield _frame(rows[i : i + windows.ROWS], columns)

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Equal segments become one as they come: the earliest stays, and all windows of the others are known to be repeated.
        shards: dict[int, dict[bytes, tuple[int, int, int, int]]] = {}
        for pdf in batches:
            known = pdf["data"].isna()
            out = []
            for key, doc, first, count, offset, data in pdf[~known].itertuples(index=False, name=None):
                shard = shards.setdefault(key, {})
                new, old = (doc, first, count, offset), shard.get(data)
                if old is None or new < old:
                    shard[data] = new
                if old is not None:
                    out.append(max(old, new)[:3])
            yield pd.concat([pdf.loc[known, shape], _frame(out, shape)]) if out else pdf.loc[known, shape]
        out = []
        for key in [*shards]:
            shard = sorted((*place, data.split(b" ")) for data, place in shards.pop(key).items())
            if len(shard) > SHARD:
                parts = split(shard, spec.length, spec.piece)
            else:
                parts = [[(doc, first, count, words) for doc, first, count, _, words in shard]] if len(shard) > 1 else []
            for part in parts:
                out += repeats(part, spec.length)
            if len(out) >= windows.ROWS:
                yield _frame(out, shape)
                out = []
        yield _frame(out, shape)

    sent = windows.with_candidates(texts, found).mapInPandas(cut, "key long, doc long, first int, count int, offset int, data binary").repartition("key")
    return sent.mapInPandas(match, "doc long, first int, count int")


def deduplicate(docs: DataFrame, keep_text: bool = True, spec: windows.Spec = SPEC) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` and, if wanted, ``kept`` (the words left, joined by one blank) and ``removed`` (spans of word numbers, end exclusive).

    A null text has no words; texts shorter than a window lose nothing; a very long
    one is searched whole; of equal rows the later ones count as later documents, and
    rows without an id as the first; other columns are ignored; an empty table gives
    an empty one.
    """
    rows = windows.numbered(docs)
    found, hot = windows.candidates(rows, spec)
    texts = windows.dealt(rows)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, firsts, counts in zip(*(c.to_pylist() for c in b.columns[1:])):
                words = text.encode().split() if text else []
                gone = windows.spans(firsts, counts, spec.length) if firsts else []
                kept, at = [], 0
                for a, z in gone:
                    kept += words[at:a]
                    at = z
                kept += words[at:]
                line = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), sha256(line).hexdigest(), line.decode(), gone))
            yield windows.finished(b, out, shape)

    shape = "n_words long, n_removed long, kept_sha256 string" + ", kept string, removed array<array<int>>" * keep_text
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(shape).fields])
    return windows.with_removals(texts, removals(texts, found, hot, spec)).mapInArrow(finish, schema)


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"), keep_text=False)
