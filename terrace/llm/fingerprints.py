"""Document fingerprints: a homomorphic multiset hash of a text's paragraphs.

A paragraph hashes to a wide vector of unsigned numbers, and a text's fingerprint is the
sum of its paragraphs' vectors, each lane modulo a power of two.  So the order of
paragraphs doesn't matter, and one is inserted or deleted by adding or subtracting its
vector, without the rest of the text.

The vector has two parts.  ``WIDE`` lanes modulo 2**64 are uniform bits of BLAKE2b of the
whole paragraph: sums of different multisets agree in all of them by chance alone.
``NEAR`` lanes modulo 2**16 count the paragraph's pairs of neighbouring words, each with
a sign in the lane that its hash names, so that the product of two texts' lanes estimates
how many pairs they share, with an error of about ``NEAR ** -0.5`` of all.  Where one pair stands over 32,767 times
its lane wraps: such a text's fingerprint is as good for equality, but tells little of likeness.

Texts with the same fingerprint are equal but for the order of paragraphs.  This guards
against chance, not against someone who searches for collisions of sums: for that take
many more wide lanes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from terrace.llm.common import only, per_text, shuffle_partitions, table

#: Lanes of 64 bits, eight from each hash, and lanes of 16 bits, a power of two.
WIDE, NEAR = 16, 512
#: Words whose hash a task remembers, and characters handled at once, about.
WORDS, CHARS = 200_000, 1 << 21
SIZE = 8 * WIDE + 2 * NEAR


class _Hashes(dict):
    """Word to hash; forgets all when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = h = xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def vectors(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The wide and the near lanes of each text: the sums over its paragraphs, which line feeds separate."""
    wide, near = np.zeros((len(texts), WIDE), np.uint64), np.zeros((len(texts), NEAR), np.uint16)
    hashes: list[int] = []
    ends, owner = [], []  # of paragraphs, in words
    for i, text in enumerate(texts):
        digests = []
        for p in text.encode("utf-8", "surrogatepass").split(b"\n"):
            digests += [hashlib.blake2b(p, salt=bytes([k])).digest() for k in range(WIDE // 8)]
            if words := p.split():
                hashes += map(_HASHES.__getitem__, words)
                ends.append(len(hashes))
                owner.append(i)
        wide[i] = np.frombuffer(b"".join(digests), "<u8").reshape(-1, WIDE).sum(0, dtype=np.uint64)
    if not hashes:
        return wide, near
    h, edge = np.array(hashes, np.uint64), np.array(ends)
    size = np.diff(edge, prepend=0)
    with np.errstate(over="ignore"):
        pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    whose = np.repeat(np.array(owner), size)
    inside = np.ones(len(h), bool)
    inside[edge - 1] = False  # no pair spans two paragraphs
    alone = edge[size == 1] - 1  # a paragraph of one word has that word
    keys, whose = np.concatenate([pairs[inside[:-1]], h[alone]]), np.concatenate([whose[inside], whose[alone]])
    with np.errstate(over="ignore"):
        keys = (keys ^ keys >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    lane = (keys >> np.uint64(40)).astype(np.int64) % NEAR
    sign = 1 - 2 * (keys >> np.uint64(63)).astype(np.int64)
    counts = np.bincount(whose * NEAR + lane, sign, len(texts) * NEAR)
    return wide, counts.astype(np.int64).astype(np.uint16).reshape(len(texts), NEAR)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of near lanes and that of the other: 1 for equal ones, about the share of word pairs in common, at least 0."""
    u, v = a.view(np.int16).astype(np.float64), b.view(np.int16).astype(np.float64)
    own = (u * u).sum(1) + (v * v).sum(1)
    return np.where(own > 0, np.clip(2 * (u * v).sum(1) / np.maximum(own, 1), 0, 1), 1.0)


def written(wide: np.ndarray, near: np.ndarray) -> list[str]:
    """Fingerprints as text: base 64 of the lanes, little-endian."""
    rows = np.concatenate([wide.astype("<u8").view(np.uint8), near.astype("<u2").view(np.uint8)], axis=1)
    return [base64.b64encode(r.tobytes()).decode() for r in rows]


def read(fingerprints: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of ``written``."""
    raw = np.frombuffer(b"".join(map(base64.b64decode, fingerprints)), np.uint8).reshape(-1, SIZE)
    return np.ascontiguousarray(raw[:, : 8 * WIDE]).view("<u8"), np.ascontiguousarray(raw[:, 8 * WIDE :]).view("<u2")


def changed(fingerprint: str, inserted: Sequence[str] = (), deleted: Sequence[str] = ()) -> str:
    """The fingerprint after paragraphs were inserted and deleted, wherever they stand."""
    wide, near = read([fingerprint])
    more, less = vectors(["\n".join(inserted)] if inserted else []), vectors(["\n".join(deleted)] if deleted else [])
    return written(wide + more[0].sum(0, dtype=np.uint64) - less[0].sum(0, dtype=np.uint64), near + more[1].sum(0, dtype=np.uint16) - less[1].sum(0, dtype=np.uint16))[0]


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of each row.

    A null text counts as the empty one, which has one empty paragraph; equal texts have equal
    fingerprints.  Ids may be null or repeated; other columns are ignored; an empty table gives
    an empty one.  What a task holds is some hundred texts and their lanes.
    """
    return per_text(only(docs, "doc_id", "text"), ["doc_id"], lambda texts: (written(*vectors([t or "" for t in texts])),), "fingerprint string")


# Each document beside the next one


def _key() -> list[Column]:
    return [F.col("doc_id").asc_nulls_first(), F.col("mark").asc()]


def with_next(docs: DataFrame, compute, shape: str) -> DataFrame:
    """``doc_id`` and what ``compute`` makes of lists of ids, texts and next texts.

    The next document is the one that follows by ``doc_id``, null first, and among equal ids by a
    hash of the text; the first follows the last.  Rows with equal ids and texts count as one
    document, and each gets its answer.

    One exchange deals whole texts out by ranges of the key, whose bounds are keys of the table:
    the first of each range is known, and is sent to the range before too.  A range is read
    row by row, so that a task holds a few texts however many there are; repeats of a row are
    put together before they are sent.
    """
    spark, n = docs.sparkSession, shuffle_partitions(docs.sparkSession)
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    # The least key of each of some ranges: one row for each, however long the table.
    keys = rows.select("doc_id", "mark").distinct().repartitionByRange(n, *_key()).sortWithinPartitions(*_key())
    least = keys.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("doc_id", "mark")).alias("least")).select("least.*").collect()
    bounds = sorted((_order(r.doc_id, r.mark) for r in least))
    if not bounds:
        return docs.select("doc_id").where("false").select(F.col("doc_id"), *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in shape.split(", "))])
    held = spark.sparkContext.broadcast(bounds)
    kind, types = docs.schema["doc_id"].dataType.simpleString(), [x.split() for x in shape.split(", ")]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        bounds, firsts = held.value, {b: i for i, b in enumerate(held.value)}
        for batch in batches:
            ids, marks = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            times: dict[tuple, list[int]] = {}
            for i, key in enumerate(map(_order, ids, marks)):
                times.setdefault(key, [i, 0])[1] += 1
            take, part, many = [], [], []
            for key, (i, count) in times.items():
                take.append(i)
                part.append(bisect_right(bounds, key) - 1)
                many.append(count)
                if key in firsts:
                    take.append(i)
                    part.append((firsts[key] - 1) % len(bounds))
                    many.append(0)
            picked = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(part, pa.int32()), pa.array(many, pa.int64())], names=["doc_id", "text", "mark", "part", "times"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, group, size = None, None, [], 0  # before: key, id, text and times of the last row
        for batch in batches:
            for i, text, mark, now, times in zip(*(c.to_pylist() for c in batch.columns)):
                key = _order(i, mark)
                if now != part:
                    part, before = now, None
                if before and before[0] == key and times and before[3]:
                    before[3] += times
                    continue
                if before and before[3]:  # else a copy of the next range's first row
                    group.append((before[1], before[2], text, before[3]))
                    size += len(before[2])
                before = [key, i, text, times]
                if size >= CHARS:
                    yield answered(group)
                    group, size = [], 0
        if group:
            yield answered(group)

    def answered(group: list[tuple]) -> pa.RecordBatch:
        ids, texts, following, times = map(list, zip(*group))
        made = [ids, *compute(texts, following)]
        each = np.repeat(np.arange(len(ids)), times)
        whole = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(v, {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[t]) for v, (_, t) in zip(made[1:], types))], names=["doc_id", *(c for c, _ in types)])
        return whole.take(pa.array(each)) if len(each) != len(ids) else whole

    dealt = rows.mapInArrow(deal, "doc_id long, text string, mark long, part int, times long").repartitionById(n, "part")
    ordered = dealt.sortWithinPartitions("part", F.col("times") == 0, *_key())
    return ordered.mapInArrow(walk, "doc_id long, " + shape).withColumn("doc_id", F.col("doc_id").cast(kind))


def _order(doc_id: int | None, mark: int) -> tuple[bool, int, int]:
    return doc_id is not None, doc_id or 0, mark


def _edited(texts: list[str], following: list[str]) -> tuple[list, ...]:
    """``n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of each text."""
    cuts = [len(t) - len(t) // 4 for t in texts]
    edits = [t[:c] + f[: len(t) - c] for t, c, f in zip(texts, cuts, following)]
    # Paragraphs that end before the cut are the same: only the rest goes out and comes in.
    kept = [t.rfind("\n", 0, c) + 1 for t, c in zip(texts, cuts)]
    n = len(texts)
    wide, near = vectors([*texts, *(t[k:] for t, k in zip(texts, kept)), *(e[k:] for e, k in zip(edits, kept)), *following])
    new_wide, new_near = wide[:n] - wide[n : 2 * n] + wide[2 * n : 3 * n], near[:n] - near[n : 2 * n] + near[2 * n : 3 * n]
    hashes = [hashlib.sha256(e.encode()).hexdigest() for e in edits]
    return [*map(len, texts)], hashes, written(wide[:n], near[:n]), written(new_wide, new_near), likeness(near[:n], new_near), likeness(near[:n], near[3 * n :])


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its text with the last quarter taken from the next document."""
    shape = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(table(spark, sf_dir, "documents"), _edited, shape)
