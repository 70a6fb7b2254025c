"""Ranked lexical search with MaxScore in shards of documents.

A shard is some hundred documents of a task with an inverted index of the terms that are
asked for: for each the documents that hold it, ascending, and the impact there.  The
greatest impact of a term in the shard, times its weight, bounds what it can add to a
score.  For each question the terms are put in the order of their bounds; the longest
prefix whose bounds together stay below the question's tenth best score so far is
*non-essential*: a document with none of the other, *essential* terms can't enter the
result.  Candidates come from the essential lists alone.  Then the non-essential lists
are probed, greatest bound first, for those candidates whose score and remaining bounds
still reach the tenth best.  The best of a question are carried from shard to shard, so
that the lists of common terms are hardly read after the first; each task answers with
its best documents, and those are ranked.

Texts are read twice, once for the number of documents that hold each term asked for, once
to rank; nothing but counts and results is shuffled.  Questions are sent to all tasks,
at most ``PACK`` bytes of them at once; more of them are several packs, each a reading.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrace.llm.common import ROWS, materialise, only, table

#: Bytes of questions that a task holds at once, about, and documents of a shard.
PACK, SHARD = 8 << 20, 512
#: Bytes that separate terms become spaces, and A to Z small letters; all others belong to terms.
TERMS = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters beyond ASCII, A to Z as small letters."""
    return (text or b"").translate(TERMS).split()


@dataclass(frozen=True)
class Questions:
    """A pack of questions: the terms of all by number, and of each question its terms' numbers and how often it has them."""

    keys: list[str]
    number: dict[bytes, int]
    asked: list[tuple[np.ndarray, np.ndarray]]


def questions(rows: list[tuple[str, bytes]]) -> Questions:
    number: dict[bytes, int] = {}
    asked = []
    for _, text in rows:
        counts = Counter(terms(text))
        asked.append((np.array([number.setdefault(t, len(number)) for t in counts], np.int64), np.array([*counts.values()], np.int64)))
    return Questions([k for k, _ in rows], number, asked)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of some hundred rows, whose texts are turned into Python objects."""
    for whole in batches:
        for i in range(0, whole.num_rows, ROWS):
            yield whole.slice(i, ROWS)


def statistics(docs: DataFrame, asked: Questions) -> tuple[int, int, np.ndarray]:
    """The documents with a term, all their terms, and the documents that hold each term asked for."""
    held = docs.sparkSession.sparkContext.broadcast(asked.number)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, n, total, of = held.value, 0, 0, np.zeros(len(held.value), np.int64)
        for b in _texts(batches):
            for text in b.column(0).to_pylist():
                all_terms = terms(text)
                n += bool(all_terms)
                total += len(all_terms)
                for t in set(all_terms):
                    if (k := number.get(t)) is not None:
                        of[k] += 1
        there = np.flatnonzero(of)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *there.tolist()], pa.int64()), pa.array([total, n, *of[there].tolist()], pa.int64())], names=["term", "n"])

    found = dict(docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect())  # as many as the pack's terms
    df = np.zeros(len(asked.number), np.int64)
    for k, v in found.items():
        if k >= 0:
            df[k] = v
    return found.get(-1, 0), found.get(-2, 0), df


class Shard:
    """The inverted index of some documents for the terms asked for."""

    def __init__(self, texts: list[bytes | None], number: dict[bytes, int], n_docs: int, total: int):
        doc, term, tf, sizes = [], [], [], []
        for i, text in enumerate(texts):
            all_terms = terms(text)
            sizes.append(len(all_terms))
            for t, c in Counter(all_terms).items():
                if (k := number.get(t)) is not None:
                    doc.append(i)
                    term.append(k)
                    tf.append(c)
        self.size = len(texts)
        d, t, c = np.array(doc, np.int64), np.array(term, np.int64), np.array(tf, np.int64)
        m = 25 + 75 * np.array(sizes, np.int64) * n_docs // max(total, 1)
        impact = 1_000_000_000 * c // (1000 * c + 8 * m[d]) if len(d) else c
        order = np.argsort(t, kind="stable")
        self.docs, self.impacts = d[order], impact[order]
        self.terms, self.starts = np.unique(t[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(t))
        self.most = np.maximum.reduceat(self.impacts, self.starts) if len(t) else np.zeros(0, np.int64)

    def find(self, asked: tuple[np.ndarray, np.ndarray], weights: np.ndarray, k: int, least: int, probed: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Documents that can be among the best ``k`` and their scores, where the ``k``-th best so far is ``least``; ``probed`` counts places looked at."""
        numbers, times = asked
        at = np.searchsorted(self.terms, numbers)
        here = at < len(self.terms)
        here[here] = self.terms[at[here]] == numbers[here]
        at, factor = at[here], weights[numbers[here]] * times[here]
        bound = factor * self.most[at]
        order = np.argsort(bound, kind="stable")
        at, factor, bound = at[order], factor[order], np.cumsum(bound[order])  # bound: of a term and all below
        essential = int(np.searchsorted(bound, max(least, 1)))
        score = np.zeros(self.size, np.int64)
        for a, w in zip(at[essential:].tolist(), factor[essential:].tolist()):
            s, e = self.starts[a], self.ends[a]
            score[self.docs[s:e]] += w * self.impacts[s:e]
            if probed is not None:
                probed[0] += int(e - s)
        found = np.flatnonzero(score)
        value = score[found]
        for i in range(essential - 1, -1, -1):
            fits = value + bound[i] >= least
            found, value = found[fits], value[fits]
            if not len(found):
                break
            s, e = int(self.starts[at[i]]), int(self.ends[at[i]])
            place = s + np.searchsorted(self.docs[s:e], found)
            hit = place < e
            hit[hit] = self.docs[place[hit]] == found[hit]
            value[hit] += factor[i] * self.impacts[place[hit]]
            if probed is not None:
                probed[0] += len(found)
        fits = value >= max(least, 1)
        return found[fits], value[fits]


def _ranked(docs: DataFrame, asked: Questions, k: int) -> DataFrame:
    """``key, doc_id, score``: the best of each task."""
    n_docs, total, df = statistics(docs, asked)
    # In doubles, as the weight is defined; there are as many as terms in the pack.
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    held = docs.sparkSession.sparkContext.broadcast((asked, weights, n_docs, total))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights, n_docs, total = held.value
        best: list[list[tuple[int, int]]] = [[] for _ in asked.asked]  # heaps of score and id, least first; a null id comes last
        nulls = -(1 << 63)
        ids: list[int | None] = []
        texts: list[bytes | None] = []

        def flush() -> None:
            shard = Shard(texts, asked.number, n_docs, total)
            for q, question in enumerate(asked.asked):
                heap = best[q]
                found, value = shard.find(question, weights, k, heap[0][0] if len(heap) == k else 0)
                for d, v in zip(found.tolist(), value.tolist()):
                    entry = (v, nulls if ids[d] is None else -ids[d])
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
            ids.clear()
            texts.clear()

        for b in _texts(batches):
            ids += b.column(0).to_pylist()
            texts += b.column(1).to_pylist()
            if len(ids) >= SHARD:
                flush()
        if ids:
            flush()
        rows = [(key, None if i == nulls else -i, v) for key, heap in zip(asked.keys, best) for v, i in heap]
        kinds = (("key", pa.string()), ("doc_id", pa.int64()), ("score", pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    return docs.mapInArrow(search, "key string, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each row of ``items`` the ``k`` rows of ``docs`` with the highest scores above 0.

    Both have an id and a ``text``.  Equal scores go by smaller id, null last.  Null texts and
    texts without terms are found by nothing and ask for nothing.  Each row of ``docs`` counts for itself, whatever ids
    it shares; rows of ``items`` that share id and text are one question, those that share an id alone are several, each with its own ranks.
    Long texts are read whole; other columns are ignored; empty tables give an empty one.
    """
    spark = docs.sparkSession
    # By id and hash, not by row: the same question gets the same key in each reading.
    each = only(items, "item_id", "text").where("text is not null").distinct().withColumn("key", F.sha2(F.concat_ws(" ", F.coalesce(F.col("item_id").cast("string"), F.lit("-")), "text"), 256))
    size = each.agg(F.coalesce(F.sum(F.octet_length("text") + 200), F.lit(0))).first()[0]
    packs = max(1, -(-2 * size // PACK))
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    parts = []
    for p in range(packs):  # one, unless there are more than PACK bytes of questions
        pack = each if packs == 1 else each.where(F.pmod(F.xxhash64("key"), F.lit(packs)) == p)
        asked = questions([(r.key, r.text.encode()) for r in pack.select("key", "text").collect()])
        if asked.number:
            parts.append(_ranked(rows, asked, k))
    if not parts:
        return only(items, "item_id").where("false").selectExpr("item_id", "0 AS rank", "0L AS doc_id", "0L AS score")
    found = reduce(DataFrame.unionByName, parts if len(parts) == 1 else [materialise(f, "ranked") for f in parts])
    order = W.partitionBy("key").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(each.select("key", "item_id"), "key").select("item_id", "rank", "doc_id", "score")


def op13_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
