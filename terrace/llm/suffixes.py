"""Suffix-array deduplication by a merge sort that knows common prefixes.

Bytes that lie in a window of ``WINDOW`` bytes which also starts earlier in the
corpus are removed.  What is sorted are the suffixes at repeated anchors (see
``windows``), as far as a window reaches.  Each batch of documents sorts its own
and sends them front-coded, as runs: for every suffix how many bytes it shares
with the one before, and the rest.  The task that a run is dealt to combines all
its runs in a loser tree.  Every head knows how much it shares with the last
suffix put out; heads that share different lengths are ordered by these alone,
and bytes known to be common are never looked at again.

In the merged order suffixes of one anchor stand together, and the common prefix
of any two is the smallest between them.  With the same for the bytes before the
anchors, read backwards, this tells which windows of which suffixes are equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.llm import windows
from terrace.llm.common import shuffle_partitions, table

WINDOW, GRAM, PIECE, HOT = 100, 32, 9, 256
#: Different suffixes of an anchor that are compared one by one; larger groups are resolved offset by offset.
FEW = 8


def byte_units(text: str) -> tuple[bytes, np.ndarray]:
    data = text.encode()
    return data, np.frombuffer(data, np.uint8)


SPEC = windows.Spec(WINDOW, GRAM, PIECE, HOT, byte_units, bytes)
#: A suffix in a run: bytes from the anchor on, bytes before it backwards, number of the document, first window.
Suffix = tuple[bytes, bytes, int, int]


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of the longest common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7) // 8


def encode_run(suffixes: list[Suffix]) -> bytes:
    """Sorted suffixes, front-coded."""
    shape, places, rest = np.zeros((len(suffixes), 4), "<u2"), np.zeros((len(suffixes), 2), "<i8"), []
    right = left = b""
    for i, (r, l, doc, first) in enumerate(suffixes):
        a, b = common(right, r), common(left, l)
        shape[i] = a, len(r) - a, b, len(l) - b
        places[i] = doc, first
        rest += r[a:], l[b:]
        right, left = r, l
    return len(suffixes).to_bytes(4, "little") + shape.tobytes() + places.tobytes() + b"".join(rest)


def decode_run(run: bytes) -> Iterator[tuple[int, Suffix]]:
    """Each suffix with the length that it shares with the one before."""
    n = int.from_bytes(run[:4], "little")
    shape = np.frombuffer(run, "<u2", 4 * n, 4).reshape(-1, 4).tolist()
    places = np.frombuffer(run, "<i8", 2 * n, 4 + 8 * n).reshape(-1, 2).tolist()
    at, right, left = 4 + 24 * n, b"", b""
    for (a, more_right, b, more_left), (doc, first) in zip(shape, places):
        right = right[:a] + run[at : at + more_right]
        at += more_right
        left = left[:b] + run[at : at + more_left]
        at += more_left
        yield a, (right, left, doc, first)


def merge(runs: list[bytes]) -> Iterator[tuple[int, Suffix]]:
    """All suffixes of the runs in order, each with the length that it shares with the one before."""
    sources = [decode_run(r) for r in runs]
    count = len(sources)
    heads: list[Suffix | None] = [None] * count
    shared = [-1] * count  # with the last one put out; -1: the run is at its end

    def advance(i: int) -> None:
        shared[i], heads[i] = next(sources[i], (-1, None))

    def play(i: int, j: int) -> tuple[int, int]:
        """Winner and loser; what the loser shares with the winner is noted."""
        if shared[i] != shared[j]:
            return (i, j) if shared[i] > shared[j] else (j, i)
        if shared[i] < 0:
            return i, j
        a, b = heads[i][0], heads[j][0]
        n = common(a, b, shared[i])
        if n == len(a) or n < len(b) and a[n] < b[n]:
            shared[j] = n
            return i, j
        shared[i] = n
        return j, i

    for i in range(count):
        advance(i)
    losers = [-1] * count
    winner = -1
    for i in range(count):  # each climbs until it meets an empty place
        at, mover = (i + count) >> 1, i
        while at:
            if losers[at] < 0:
                losers[at] = mover
                mover = -1
                break
            mover, losers[at] = play(mover, losers[at])
            at >>= 1
        if mover >= 0:
            winner = mover
    while count and heads[winner] is not None:
        yield shared[winner], heads[winner]
        advance(winner)
        at = (winner + count) >> 1
        while at:
            winner, losers[at] = play(winner, losers[at])
            at >>= 1


def resolve(rights: list[int], suffixes: list[Suffix], length: int) -> Iterator[tuple[int, int, int]]:
    """``doc, first window, windows`` of stretches that start earlier, for the suffixes of one anchor in order.

    ``rights[i]`` is the common prefix of suffixes ``i - 1`` and ``i``.
    """
    number, gaps, members = -1, [], {}
    for i, (r, l, doc, first) in enumerate(suffixes):
        if not i or rights[i] < len(r) or len(r) != len(suffixes[i - 1][0]):
            number += 1
            gaps.append(rights[i])
        members.setdefault((number, l, len(r)), []).append((doc, first))
    distinct = []
    for (n, l, size), places in members.items():
        places.sort()
        distinct.append((*places[0], n, l, length - size))
        windows_ = len(l) + size - length + 1
        yield from ((doc, first, windows_) for doc, first in places[1:])
    if len(distinct) == 1:
        return
    distinct.sort(key=lambda m: m[:2])
    if len(distinct) <= FEW:
        for i, (doc, first, n, l, least) in enumerate(distinct):
            for _, _, n2, l2, least2 in distinct[:i]:
                lo, hi = min(n, n2), max(n, n2)
                right = min(gaps[lo + 1 : hi + 1], default=length - max(least, least2))
                low, high = max(length - right, least, least2), common(l, l2)
                if low <= high:
                    yield doc, first + len(l) - high, high - low + 1
        return
    docs, firsts, order, least = (np.array([m[k] for m in distinct]) for k in (0, 1, 2, 4))
    most = np.array([len(m[3]) for m in distinct])
    by_left = sorted(range(len(distinct)), key=lambda i: distinct[i][3])
    left_gaps = np.array([0] + [common(distinct[a][3], distinct[b][3]) for a, b in zip(by_left, by_left[1:])])
    rank = np.empty(len(distinct), int)
    rank[by_left] = np.arange(len(distinct))
    right_gaps = np.array(gaps)
    for before in range(int(least.min()), int(most.max()) + 1):
        here = np.flatnonzero((least <= before) & (before <= most))
        if len(here) < 2:
            continue
        code = np.cumsum(right_gaps < length - before)[order[here]] * (len(distinct) + 1) + np.cumsum(left_gaps < before)[rank[here]]
        _, earliest = np.unique(code, return_index=True)
        later = np.ones(len(here), bool)
        later[earliest] = False
        for i in here[later].tolist():
            yield int(docs[i]), int(firsts[i] + most[i] - before), 1


def removals(texts: DataFrame, found: DataFrame, hot: np.ndarray, spec: windows.Spec = SPEC) -> DataFrame:
    """``doc, first, count``: ranges of windows that also start earlier."""
    buckets = 4 * shuffle_partitions(texts.sparkSession)
    columns = ["bucket", "run", "doc", "first", "count"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for seen in windows.flushed(pdf, spec, hot):
                runs: dict[int, list[Suffix]] = {}
                rows = []
                for (key, data, offset, count), places in seen.items():
                    runs.setdefault(key % buckets, []).append((data[offset:], data[:offset][::-1], *places[0]))
                    rows += [((d ^ f) % buckets, None, d, f, count) for d, f in places[1:]]
                rows += [(bucket, encode_run(sorted(run)), 0, 0, 0) for bucket, run in runs.items()]
                for i in range(0, len(rows), windows.ROWS):
                    yield pd.DataFrame(rows[i : i + windows.ROWS], columns=columns)

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs: dict[int, list[bytes]] = {}
        for pdf in batches:
            known = pdf["run"].isna()
            if known.any():
                yield pdf.loc[known, ["doc", "first", "count"]]
            for bucket, run in pdf.loc[~known, ["bucket", "run"]].itertuples(index=False, name=None):
                runs.setdefault(bucket, []).append(run)
        out: list[tuple[int, int, int]] = []
        for bucket in sorted(runs):
            rights, suffixes = [], []
            for shared, suffix in merge(runs.pop(bucket)):
                if shared < spec.gram and suffixes:
                    if len(suffixes) > 1:
                        out += resolve(rights, suffixes, spec.length)
                    rights, suffixes = [], []
                rights.append(shared)
                suffixes.append(suffix)
            if len(suffixes) > 1:
                out += resolve(rights, suffixes, spec.length)
            while len(out) >= windows.ROWS:
                yield pd.DataFrame(out[: windows.ROWS], columns=["doc", "first", "count"])
                out = out[windows.ROWS :]
        yield pd.DataFrame(out, columns=["doc", "first", "count"])

    sent = windows.with_candidates(texts, found).mapInPandas(cut, "bucket int, run binary, doc long, first int, count int").repartition(F.col("bucket"))
    return sent.mapInPandas(combine, "doc long, first int, count int")


def deduplicate(docs: DataFrame, keep_text: bool = True, spec: windows.Spec = SPEC) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if wanted, ``kept`` (binary, as a cut may split a character) and ``removed`` (byte spans, end exclusive).

    A null text counts as empty; texts shorter than a window lose nothing; a very long
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
                data = text.encode() if text else b""
                gone = windows.spans(firsts, counts, spec.length) if firsts else []
                edges = [0, *(x for span in gone for x in span), len(data)]
                kept = b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2]))
                out.append((len(data), len(data) - len(kept), len(gone), sha256(kept).hexdigest(), kept, gone))
            yield windows.finished(b, out, shape)

    shape = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, removed array<array<int>>" * keep_text
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(shape).fields])
    return windows.with_removals(texts, removals(texts, found, hot, spec)).mapInArrow(finish, schema)


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"), keep_text=False)
