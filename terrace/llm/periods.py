"""Periodic runs of words: stretches that repeat a block at least twice.

Blocks of two to the power of a level have a number, the same for equal blocks of one
document: those of the next level are named by the pair of numbers of their halves
(Karp, Miller and Rosenberg), and blocks that occur once drop out.  How far two places
agree, forwards or backwards, is read off by going down the levels.

A run of period ``q`` and length ``L`` holds ``L - q`` places that equal the one
``q`` further, at least ``max(LEAST - q, q)``; a grid of that width meets each run.
Every grid place that equals the one ``q`` further is a candidate and is extended
both ways by the levels.  Nothing is hashed, and no suffix is sorted.  A document is
handled by itself, whole, so the work is one pass without a shuffle; what a task holds
is about ``UNITS`` words, or one document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.common import WORD, only, per_text, table

#: The shortest run, in words.
LEAST = 12
#: Words, and candidates of a document, that are handled at once, about.
UNITS, PAIRS = 1 << 18, 1 << 21
#: Documents up to this many words share the grids of their size, rounded up to ``STEP``.
SMALL, STEP = 4096, 64


def named(codes: np.ndarray) -> list[np.ndarray]:
    """The names of blocks of 1, 2, 4 and so on places, by level; a block that occurs once, or leaves the array, has a negative one of its own."""
    alone = -1 - np.arange(len(codes), dtype=np.int64)
    levels, names, span = [], codes.astype(np.int64), 1
    while True:
        _, where, count = np.unique(names, return_inverse=True, return_counts=True)
        names = np.where((count[where] > 1) & (names >= 0), where, alone)
        levels.append(names)
        at = np.flatnonzero((names[:-span] >= 0) & (names[span:] >= 0)) if span < len(names) else np.zeros(0, np.int64)
        if not len(at):
            return levels
        pairs, names = names[at] * len(codes) + names[at + span], alone.copy()
        names[at] = pairs
        span *= 2


def agreeing(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """How many places from each of ``a`` on equal those from ``b > a`` on; with ``back``, those before them."""
    n = np.zeros(len(a), np.int64)
    for k in reversed(range(len(levels))):
        span = 1 << k
        i, j = (a - n - span, b - n - span) if back else (a + n, b + n)
        inside = (i >= 0) & (j < len(levels[0]))
        n += span * (inside & (levels[k][np.maximum(i, 0)] == levels[k][np.minimum(j, len(levels[0]) - 1)]))
    return n


def _grids(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grid places and periods of a document of ``n`` words, about ``PAIRS`` at a time."""
    q = np.arange(1, n // 2 + 1)
    wide = np.maximum(LEAST - q, q)
    many = -(-(n - q) // wide)
    ends = np.cumsum(many)
    a = 0
    while a < len(q):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, side="right")))
        begins = np.repeat(ends[a:b] - many[a:b], many[a:b])
        step = np.arange(len(begins)) + (ends[a - 1] if a else 0) - begins
        yield step * np.repeat(wide[a:b], many[a:b]), np.repeat(q[a:b], many[a:b])
        a = b


@lru_cache(maxsize=SMALL // STEP)
def _grid(n: int) -> tuple[np.ndarray, np.ndarray]:
    parts = list(_grids(n))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _candidates(codes: np.ndarray, begins: Sequence[int], sizes: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods of the grid whose word occurs a period later too, about ``PAIRS`` at a time."""
    places, periods, held = [], [], 0
    for s, n in zip(begins, sizes):
        if n < LEAST:
            continue
        for at, q in [_grid(-(-n // STEP) * STEP)] if n <= SMALL else _grids(n):
            if n <= SMALL:
                fits = (at + q < n) & (2 * q <= n)
                at, q = at[fits], q[fits]
            same = codes[s + at] == codes[s + at + q]
            places.append(s + at[same])
            periods.append(q[same])
            held += len(periods[-1])
            if held >= PAIRS:
                yield np.concatenate(places), np.concatenate(periods)
                places, periods, held = [], [], 0
    if held:
        yield np.concatenate(places), np.concatenate(periods)


def _least(start: np.ndarray, length: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each stretch once, with the least of its periods."""
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    return start[new], length[new], q[new]


def found(texts: Sequence[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``start, length, period`` of each run of each list of words, by start and then period."""
    parts, first = [np.array([0], np.int64)], 1
    for words in texts:  # a name is a word of one document, so that blocks of several are never equal
        number = {w: first + i for i, w in enumerate(dict.fromkeys(words))}
        first += len(number)
        parts.append(np.array([*map(number.__getitem__, words), first], np.int64))  # and a word between them
        first += 1
    sizes = np.array([len(w) for w in texts], np.int64)
    begins = np.cumsum(sizes + 1) - sizes
    codes, levels = np.concatenate(parts), None
    start = length = q = np.zeros(0, np.int64)
    for at, period in _candidates(codes, begins.tolist(), sizes.tolist()):
        levels = levels or named(codes)
        back, forth = agreeing(levels, at, at + period, back=True), agreeing(levels, at, at + period)
        size = back + period + forth
        long = size >= np.maximum(LEAST, 2 * period)
        start, length, q = _least(*(np.concatenate([x, y[long]]) for x, y in ((start, at - back), (length, size), (q, period))))
    order = np.lexsort((q, start))
    start, length, q = start[order], length[order], q[order]
    edges = np.searchsorted(start, [*begins.tolist(), len(codes)])
    return [(start[a:b] - s, length[a:b], q[a:b]) for a, b, s in zip(edges, edges[1:], begins.tolist())]


def _collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> str:
    if not len(start):
        return b" ".join(words).decode()
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)).decode()


def _of_texts(texts: list[bytes | None]) -> tuple[list, list, list, list]:
    out: tuple[list, list, list, list] = ([], [], [], [])
    i = 0
    while i < len(texts):
        words, held = [], 0
        while i < len(texts) and held < UNITS:
            words.append((texts[i] or b"").split())  # bytes split at the very six characters
            held += len(words[-1])
            i += 1
        for w, runs in zip(words, found(words)):
            for into, column in zip(out, (*(r.tolist() for r in runs), _collapsed(w, *runs))):
                into.append(column)
    return out


def runs(docs: DataFrame) -> DataFrame:
    """``doc_id, starts, lengths, periods, collapsed``: the runs of each text, by start and then period, and the text without the repeats.

    Words are runs of anything but spaces and the five other white-space controls.  A run is a stretch
    of at least ``LEAST`` words and two periods that no neighbouring word extends; its period is the
    smallest.  ``collapsed`` leaves out each word that stands behind the first period of a run, and has
    a space between the others.  A null or empty text has no runs and collapses to the empty one; ids
    may be null or repeated, and each row is answered by itself; other columns are ignored; an empty
    table gives an empty one.
    """
    texts = only(docs, "doc_id", "text").withColumn("text", F.col("text").cast("binary"))
    return per_text(texts, ["doc_id"], _of_texts, "starts array<long>, lengths array<long>, periods array<long>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: in one document of ten, by the check sum of its id, the words from some place on repeat a block."""
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    g, n = F.floor(hashed / 10), F.size(words)
    a = F.try_mod(g, n).cast("int")
    p = 1 + F.floor((n - a) / (3 + g % 8)).cast("int")
    block = F.slice(words, a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    text = F.when((hashed % 10 == 0) & F.col("text").rlike(WORD), F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the runs of every document come to, after a block is repeated in some."""
    each = runs(planted(only(table(spark, sf_dir, "documents"), "doc_id", "text")))
    zipped = F.arrays_zip("starts", "lengths", "periods")
    longest = F.array_max(F.transform(zipped, lambda r: F.struct(r["lengths"].alias("n"), (-r["starts"]).alias("s"), (-r["periods"]).alias("p"))))
    lines = F.array_join(F.transform(zipped, lambda r: F.concat(F.concat_ws(",", r["starts"].cast("string"), r["lengths"].cast("string"), r["periods"].cast("string")), F.lit("\n"))), "")
    made = each.select("doc_id", F.size("starts").cast("long").alias("n_runs"), longest.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.s"), F.col("best.n"), -F.col("best.p")
    return made.select(
        "doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )
