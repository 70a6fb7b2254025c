"""Candidate windows for exact substring deduplication.

A window is ``length`` consecutive units (words or bytes) of one document.  Its
anchor is the leftmost of its ``gram``-unit pieces with the smallest hash, so
equal windows have equal anchors at equal offsets, and neighbouring windows mostly
share theirs.  Only anchors travel: those that occur once in the corpus clear all
windows they stand for, and the rest leave *candidate segments*, the stretch of
windows around one repeated anchor.

No anchor gathers in one task.  Each batch of documents sends one row for each
anchor it holds, with its count; further occurrences in the batch are known to be
repeated and travel by another key.  Segments go to the shard that the anchor's
hash names; the few anchors that occur most (``hot``) name shards by nearly the
whole window instead, so that a common phrase in many contexts is spread as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from terrace.llm.common import arrow_type, columns, materialise, only, shuffle_partitions

#: Units handled at once by the array work, about; and bytes of text whose segments are compared before they are sent.
UNITS, FLUSH = 1 << 20, 8 << 20
#: Rows of a frame that a task hands on.
ROWS = 100_000


@dataclass(frozen=True)
class Spec:
    """How documents become units, and how long windows and anchors are."""

    length: int
    gram: int
    #: Windows of a segment that share a shard where the anchor is hot.
    piece: int
    #: An anchor is hot in its partition if it has more occurrences than this, and than one in ``share`` of the partition's.
    hot: int
    #: A text's units, as a sequence that slices, and their hashes.
    units: Callable[[str], tuple[object, np.ndarray]]
    #: The bytes of a slice of units.
    join: Callable[[object], bytes]
    share: int = 8


def numbered(docs: DataFrame) -> DataFrame:
    """``doc_id, text, _doc``: rows with a unique number in the order of ``doc_id``.

    Where ids are unique they are the numbers.  Else rows are numbered by id, null
    first, and a hash of the text; equal rows count as earlier and later ones.  Texts are
    no sort keys, so that none is sampled for the ranges.
    """
    rows = only(docs, "doc_id", "text")
    if not rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        return rows.withColumn("_doc", F.col("doc_id").cast("long"))
    marked = rows.withColumn("_mark", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_mark")]
    ordered = marked.repartitionByRange(shuffle_partitions(docs.sparkSession), *order, F.rand(1)).sortWithinPartitions(*order).drop("_mark")
    return materialise(ordered.withColumn("_doc", F.monotonically_increasing_id()), "numbered")


def groups(texts: list, spec: Spec) -> Iterator[tuple[list[int], list, np.ndarray, np.ndarray]]:
    """Indices, unit sequences, unit hashes end to end and each document's end, for about ``UNITS`` units at a time; only documents that hold a window."""
    index, seqs, hashes, total = [], [], [], 0
    for i, text in enumerate(texts):
        if not isinstance(text, str) or len(text) < spec.length // 4:
            continue
        seq, h = spec.units(text)
        if len(h) < spec.length:
            continue
        index.append(i)
        seqs.append(seq)
        hashes.append(h)
        total += len(h)
        if total >= UNITS:
            yield index, seqs, np.concatenate(hashes), np.cumsum([len(h) for h in hashes])
            index, seqs, hashes, total = [], [], [], 0
    if index:
        yield index, seqs, np.concatenate(hashes), np.cumsum([len(h) for h in hashes])


def anchors(units: np.ndarray, ends: np.ndarray, spec: Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Valid window starts, the anchor position of each, and the hash at every position."""
    with np.errstate(over="ignore"):
        h, span, factor = units.astype(np.uint64), 1, np.uint64(0x9E3779B97F4A7C15)
        while span < spec.gram:  # twice as long in each turn
            h = h[:-span] * factor + h[span:]
            factor, span = factor * factor, span * 2
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    wide = spec.length - spec.gram + 1
    at, span = np.arange(len(h), dtype=np.int32), 1
    while span < wide:
        step = min(span, wide - span)
        left, right = at[:-step], at[step:]
        at = np.where(h[right] < h[left], right, left)
        span += step
    edge = np.zeros(len(at) + spec.length, np.int32)
    np.add.at(edge, np.maximum(ends[:-1] - spec.length + 1, 0), 1)
    np.add.at(edge, ends[:-1], -1)
    starts = np.flatnonzero(np.cumsum(edge[: len(at)]) == 0)
    return starts, at[starts], h


def candidates(rows: DataFrame, spec: Spec) -> tuple[DataFrame, np.ndarray]:
    """``doc, pos`` of every anchor occurrence whose hash occurs again, and the hashes of hot anchors."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, parts = pdf["_doc"].to_numpy(np.int64), []
            for index, _, units, ends in groups(pdf["text"].tolist(), spec):
                _, at, h = anchors(units, ends, spec)
                at = np.unique(at)
                doc = np.searchsorted(ends, at, side="right")
                parts.append((h[at].view(np.int64), ids[np.array(index)[doc]], at - np.concatenate([[0], ends])[doc]))
            if not parts:
                continue
            h, doc, pos = map(np.concatenate, zip(*parts))
            order = np.argsort(h, kind="stable")
            h, doc, pos = h[order], doc[order], pos[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            n = np.zeros(len(h), np.int32)
            n[first] = np.diff(np.append(first, len(h)))
            key = np.where(n > 0, h, (doc * 0x5851F42D4C957F2D + pos * 0x14057B7EF767814F).astype(np.int64))
            out = pd.DataFrame({"key": key, "doc": doc, "pos": pos.astype(np.int32), "n": n})
            for i in range(0, len(out), ROWS):
                yield out.iloc[i : i + ROWS]

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, doc, pos, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for pdf in batches:
            known = pdf["n"].to_numpy() == 0
            if known.any():
                yield pdf.loc[known, ["doc", "pos"]].assign(hot=None).astype({"hot": "Int64"})
            for into, c in ((key, "key"), (doc, "doc"), (pos, "pos"), (n, "n")):
                into.append(pdf[c].to_numpy()[~known])
        key, doc, pos, n = map(np.concatenate, (key, doc, pos, n))
        order = np.argsort(key, kind="stable")
        key, doc, pos, n = key[order], doc[order], pos[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        total = np.add.reduceat(n, first) if len(first) else n
        several = np.repeat(total > 1, np.diff(np.append(first, len(key))))
        out = pd.DataFrame({"doc": doc[several], "pos": pos[several]})
        for i in range(0, len(out), ROWS):
            yield out.iloc[i : i + ROWS].assign(hot=None).astype({"hot": "Int64"})
        hot = np.flatnonzero(total > max(spec.hot, int(n.sum()) // spec.share))  # fewer than spec.share
        yield pd.DataFrame({"doc": np.full(len(hot), -1), "pos": np.full(len(hot), -1, np.int32), "hot": pd.array(key[first[hot]], "Int64")})

    sent = rows.select("_doc", "text").mapInPandas(emit, "key long, doc long, pos int, n int").repartition("key")
    met = materialise(sent.mapInPandas(meet, "doc long, pos int, hot long"), "repeated-anchors")
    # Fewer than spec.share of each partition.
    hot = met.where("hot is not null").select("hot").toPandas()["hot"].to_numpy(np.int64)
    return met.where("hot is null").select("doc", "pos"), np.sort(hot)


def segments(units: np.ndarray, ends: np.ndarray, seqs: list, listed: list, hot: np.ndarray, spec: Spec) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """Candidate segments of some documents: key, number of the document here, first window, windows, anchor's offset, bytes."""
    starts, at, h = anchors(units, ends, spec)
    begins = np.concatenate([[0], ends])
    repeated = np.zeros(len(units) + 1, bool)
    repeated[np.concatenate([begins[i] + np.asarray(p, np.int64) for i, p in enumerate(listed)])] = True
    starts, at = starts[repeated[at]], at[repeated[at]]
    if not len(starts):
        return
    cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    first, last, anchor = starts[cut], starts[np.append(cut[1:], len(starts)) - 1], at[cut]
    key = h[anchor].view(np.int64)
    is_hot = np.isin(key, hot)
    doc = np.searchsorted(ends, first, side="right")
    first, last, anchor = first - begins[doc], last - begins[doc], anchor - begins[doc]
    L, P = spec.length, spec.piece
    for k, d, a, b, m, heated in zip(key.tolist(), doc.tolist(), first.tolist(), last.tolist(), anchor.tolist(), is_hot.tolist()):
        seq = seqs[d]
        if not heated:
            yield k, d, a, b - a + 1, m - a, spec.join(seq[a : b + L])
            continue
        for g in range((m - b) // P, (m - a) // P + 1):  # windows whose anchor lies g*P to g*P+P-1 units from their start
            near, far = g * P, g * P + P - 1
            core = xxh64_intdigest(spec.join(seq[m - near : m - far + L]), seed=k & 0xFFFFFFFF)
            lo, hi = max(a, m - far), min(b, m - near)
            yield (core ^ g) - (1 << 63), d, lo, hi - lo + 1, m - lo, spec.join(seq[lo : hi + L])


def removed_ranges(pdf_first: list, pdf_count: list) -> list[tuple[int, int]]:
    """Merged ``[first, end)`` ranges of window starts."""
    out: list[list[int]] = []
    for a, n in sorted(zip(pdf_first, pdf_count)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n)
        else:
            out.append([a, a + n])
    return [(a, b) for a, b in out]


def spans(firsts, counts, length: int) -> list[tuple[int, int]]:
    """Maximal runs ``[first, end)`` of units covered by the given ranges of windows."""
    out: list[list[int]] = []
    for a, b in removed_ranges(firsts, counts):
        if out and a <= out[-1][1]:
            out[-1][1] = b + length - 1
        else:
            out.append([a, b + length - 1])
    return [(a, b) for a, b in out]


def dealt(rows: DataFrame) -> DataFrame:
    """The texts dealt out by document number; both joins of an operator read this one exchange."""
    return rows.select("_doc", "doc_id", "text").repartition(shuffle_partitions(rows.sparkSession), "_doc")


def with_candidates(texts: DataFrame, found: DataFrame) -> DataFrame:
    """``_doc, doc_id, text, listed``: the texts that hold repeated anchors and where; other rows have nulls."""
    lists = found.groupBy("doc").agg(F.collect_list("pos").alias("listed"))
    joined = texts.join(lists, F.col("_doc") == F.col("doc"), "left")
    # doc_id stays, so that this join and the last one ask for the same columns and share one exchange.
    return joined.select("_doc", "doc_id", F.when(F.col("listed").isNotNull(), F.col("text")).alias("text"), "listed")


def with_removals(texts: DataFrame, removals: DataFrame) -> DataFrame:
    """``doc_id, text, firsts, counts`` for every document: ranges of windows that occur earlier, or nulls."""
    lists = removals.groupBy("doc").agg(F.collect_list("first").alias("firsts"), F.collect_list("count").alias("counts"))
    return texts.join(lists, F.col("_doc") == F.col("doc"), "left").select("doc_id", "text", "firsts", "counts")


def finished(batch: pa.RecordBatch, rows: list[tuple], shape: str) -> pa.RecordBatch:
    """The batch's ids as they are, and the leading columns of ``rows`` that ``shape`` names."""
    made = columns(shape)
    values = [*zip(*rows)] or [[]] * len(made)
    return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, arrow_type(t)) for v, (_, t) in zip(values, made))], names=["doc_id", *(n for n, _ in made)])


def flushed(pdf: pd.DataFrame, spec: Spec, hot: np.ndarray) -> Iterator[dict]:
    """For about ``FLUSH`` bytes of text at a time: each different segment with its earliest place, and the places of the rest.

    Maps ``(key, bytes, offset, windows)`` to a list of ``(doc, first)``, ascending.
    """
    pdf = pdf[pdf["listed"].notna() & pdf["text"].notna()]
    ids, lists, seen, size = pdf["_doc"].to_numpy(np.int64), pdf["listed"].tolist(), {}, 0
    for index, seqs, units, ends in groups(pdf["text"].tolist(), spec):
        for key, d, first, count, offset, data in segments(units, ends, seqs, [lists[i] for i in index], hot, spec):
            seen.setdefault((key, data, offset, count), []).append((int(ids[index[d]]), first))
            size += len(data)
        if size >= FLUSH:
            yield {k: sorted(v) for k, v in seen.items()}
            seen, size = {}, 0
    if seen:
        yield {k: sorted(v) for k, v in seen.items()}
