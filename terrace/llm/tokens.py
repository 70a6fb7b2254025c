"""Token ids in binary files: frequency ranks in bytes of variable number.

Ids are ranked by how often the corpus holds them, so that the commonest 256 take
one byte each.  A rank has one to four data bytes, the lowest first; two bits in
separate control bytes tell how many, four ranks to a control byte, the first in
the lowest bits.  A table over the 256 control bytes turns control bytes back
into lengths, and numpy gathers all ranks of a block at once.

Files are a Parquet table of blocks, so that any store Spark writes to can hold
them: ``part, seq, doc_ids, counts, control, data``.  Parts follow each other in
ascending document id, and so do blocks in a part and documents in a block; each
document starts a new control byte.  The table ``ranks`` beside it maps ranks to ids.

Texts are encoded once, into a table of ids and counts; what is shuffled to the part
that a document's id belongs to is its coded form.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import compress, repeat
from operator import is_
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.llm.bpe import _simple_chars, byte_symbols, default_tokenizer
from terrace.llm.common import arrow_type, columns, materialise, only, scratch, shuffle_partitions, table

#: The id that ends each document.
END = 2
#: Data bytes in a block, about, and characters of text that are encoded together.
BLOCK_BYTES, PART = 1 << 20, 4 << 20
#: A row of the table of blocks.
BLOCK = "part int, seq int, doc_ids array<long>, counts array<int>, control binary, data binary"
#: Words and pieces of text whose ids an executor process remembers, at most twice over.
CACHE_WORDS = 750_000
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Marks that are a word of their own behind letters.
MARKS = frozenset(".,;:!?")
#: The four lengths that each control byte stands for.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class LibraryIds:
    """Ids of whole texts by the ``tokenizers`` library.

    Its splitter cuts a text at white space and further into words, whose ids don't
    depend on each other.  What stands between white space is looked up as a whole; of
    what hasn't been met yet the library's model gets the new words, and what it gives
    is remembered.  Texts with characters outside the
    quick path's, or with special tokens, go to it whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        simple, letters = _simple_chars()
        self.odd = re.compile(f"[^{simple}]").search
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        numbers = "".join(re.escape(chr(c)) for c in range(0x250) if chr(c).isnumeric() and not chr(c).isalpha())
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\x09-\\x0d\\x20\\x85\\xa0{letters}{numbers}]+").findall
        self.symbols = dict(enumerate(byte_symbols()))
        #: Ids by word, and by what stands between white space, as bytes: those met of late, and those met before them.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def is_odd(self, text: str) -> bool:
        """Whether the quick path doesn't hold: Python splits at the separators 0x1C to 0x1F, the library doesn't."""
        return not is_latin(text) and self.odd(text) is not None or any(c in text for c in SEPARATORS) or "<|" in text and any(x in text for x in self.special)

    def missing(self, keys: set[str]) -> list[str]:
        """The keys that are not remembered; those from before are as good as new again."""
        out = []
        for k in keys:
            if k not in self.known:
                if (ids := self.before.get(k)) is None:
                    out.append(k)
                else:
                    self.known[k] = ids
        return out

    def learn(self, pieces: set[str]) -> None:
        """Make every piece known; when memory is full, what wasn't asked for since the last time goes."""
        if len(self.known) + len(pieces) > CACHE_WORDS:
            self.before, self.known = self.known, {}
        tokenize, symbols = self.library.model.tokenize, self.symbols
        words, split = set(), []
        for p in self.missing(pieces):
            if p.isalpha():
                words.add(p)
            else:
                # Most others are a word with one mark behind it, which needs no search.
                split.append((p, (p[:-1], p[-1]) if p[-1] in MARKS and p[:-1].isalpha() else self.words(p)))
        for _, found in split:
            words.update(found)
        new, ids, stops = self.missing(words), array("I"), [0]
        for w in new:
            # Printable ASCII stands for itself.
            ids.extend([t.id for t in tokenize(w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(symbols))])
            stops.append(len(ids))
        raw = ids.tobytes()
        self.known.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(new, stops, stops[1:]))
        for p, found in split:
            if len(found) > 1:
                self.known[p] = b"".join([self.known[w] for w in found])

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts one after the other, ``end`` after each, and how many each has; give about ``PART`` characters at a time.

        Each different piece is looked up once; its ids are then copied to the places where it stands.
        """
        # What stands before and between white space, as Python splits it; blank pieces have no ids, and names with a line end are no pieces.
        own = {"": b"", "\n": b"" if end is None else np.uint32(end).astype("<u4").tobytes()}
        quick, lasts = [], []
        for i, t in enumerate(texts):
            odd = self.is_odd(t)
            quick.append("" if odd else t.lower())
            lasts.append(f"\n{i}" if odd else "\n")
            if odd:
                own[lasts[-1]] = self.whole(t).astype("<u4").tobytes() + own["\n"]
        if not texts:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        split = pc.utf8_split_whitespace(pa.array(quick, pa.large_string()))
        edges = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        enders, last = np.unique(lasts, return_inverse=True)
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        # Behind the pieces of each text comes what ends it, or all of it where it went to the library.
        at = np.insert(coded.indices.to_numpy(), edges[1:] - edges[0], len(names) + last)
        stops = edges - edges[0] + np.arange(len(edges))
        names += enders.tolist()
        found = [*map(self.known.get, names)]
        if None in found:
            self.learn({*compress(names, map(is_, found, repeat(None)))} - own.keys())
            found = [(own[p] if p in own else self.known[p]) if f is None else f for p, f in zip(names, found)]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ends = np.concatenate([[0], np.cumsum(sizes[at])])
        first = (np.cumsum(sizes) - sizes)[at] - ends[:-1]
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(first, sizes[at]) + np.arange(ends[-1])]
        return ids, np.diff(ends[stops])


@cache
def library(path: str) -> LibraryIds:
    return LibraryIds(path)


def pack(ranks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes and data bytes of the ranks of documents with these counts, one after the other, and how many of each a document has."""
    width = 4 if len(ranks) and ranks.max() > 0xFFFF else 2
    r = ranks.astype(f"<u{width}")
    keep = np.ones((len(r), width), bool)
    for k in range(1, width):
        np.greater_equal(r, 1 << 8 * k, out=keep[:, k])
    lengths = keep.sum(1, dtype=np.uint8)
    fours = -(-counts // 4)
    stops = np.cumsum(counts)
    codes = np.zeros(4 * int(fours.sum()), np.uint8)
    codes[np.repeat(4 * (np.cumsum(fours) - fours) - (stops - counts), counts) + np.arange(len(r))] = lengths - 1
    four = codes.reshape(-1, 4)
    bytes_before = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6, r.view(np.uint8)[keep.ravel()], fours, bytes_before[stops] - bytes_before[stops - counts]


def binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column, each row with the bytes of its count of ``values``."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * values.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, one row after the other, and how many each has."""
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset) if len(column) else np.zeros(1, np.int32)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8), np.diff(ends).astype(np.int64)


def unpack(control: bytes, data: bytes, counts: np.ndarray) -> np.ndarray:
    """The ranks of a block of documents with these counts, one after the other."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()
    padded = -(-counts // 4) * 4
    real = np.arange(padded.sum()) - np.repeat(np.cumsum(padded) - padded, padded) < np.repeat(counts, padded)
    lengths = lengths[real]
    at = np.cumsum(lengths) - lengths
    raw = np.frombuffer(data, np.uint8)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        long = np.flatnonzero(lengths > k)
        out[long] |= raw[at[long] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def encoded(docs: DataFrame, tokenizer: str, end: int = END) -> tuple[DataFrame, DataFrame]:
    """``doc_id, ids`` of every row, the ids as bytes and the end included; and ``id, n``, how often each id occurs.

    The texts are encoded once: both come from one table in the shared folder, into
    which each task puts its documents and, last, its counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = library(tokenizer)
        size = max(end + 1, e.library.get_vocab_size())
        kind, total, id_type = "<u2" if size <= 1 << 16 else "<u4", np.zeros(size, np.int64), None
        for b in batches:
            doc_ids, texts, start, held = b.column(0), [t or "" for t in b.column(1).to_pylist()], 0, 0
            id_type = doc_ids.type
            for i, t in enumerate(texts):
                held += len(t)
                if held < PART and i + 1 < len(texts):
                    continue
                ids, counts = e.encode(texts[start : i + 1], end)
                total += np.bincount(ids, minlength=size)
                part, none = doc_ids.slice(start, i + 1 - start), pa.nulls(i + 1 - start, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part, binaries(ids.astype(kind), counts), none, none], names=names)
                start, held = i + 1, 0
        if id_type is not None:
            met = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, pa.binary()), pa.array([met], pa.list_(pa.int64())), pa.array([total[met]], pa.list_(pa.int64()))], names=names)

    names = ["doc_id", "ids", "counted", "counts"]
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("ids binary, counted array<long>, counts array<long>").fields])
    both = materialise(only(docs, "doc_id", "text").mapInArrow(run, schema), "token-ids")
    pairs = both.where("counted is not null").select(F.explode(F.arrays_zip("counted", "counts")).alias("p"))
    return both.where("ids is not null").select("doc_id", "ids"), pairs.groupBy(F.col("p.counted").alias("id")).agg(F.sum("p.counts").alias("n"))


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END) -> None:
    """Encode ``doc_id, text`` of every row into the table of blocks at ``path``.

    A null or empty text has no ids but its end; a very long one is one document in
    one block; rows of one id stand together, ordered by what they hold (but where there are so many
    that they have several parts); rows without an id come first; other columns are ignored; an empty table gives files without
    blocks.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    stored, counted = encoded(docs, tokenizer, end)
    # At most as many rows as the vocabulary has ids.
    ranked = counted.orderBy(F.desc("n"), "id").toPandas()
    ids = ranked["id"].to_numpy(np.int64)
    spark.createDataFrame(ranked.assign(rank=np.arange(len(ranked))), "id long, n long, rank long").coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(int(ids.max()) + 1 if len(ids) else end + 1, np.uint32)
    rank[ids] = np.arange(len(ids))
    held, wide = spark.sparkContext.broadcast(rank), "<u2" if max(end + 1, library(tokenizer).library.get_vocab_size()) <= 1 << 16 else "<u4"
    parts = shuffle_partitions(spark)
    cuts, absent, total = stored.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5]), F.count_if(F.col("doc_id").isNull()), F.count("*")).first()
    # An id with several of the cuts has as many parts, and rows without an id have their share.
    edges, lacking = np.array(cuts or [], np.int64), parts * absent // max(total, 1)

    def rank_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, size = held.value, np.dtype(wide).itemsize
        for b in batches:
            doc_ids = b.column(0)
            raw, sizes = raw_bytes(b.column(1))
            counts = sizes // size
            control, data, fours, widths = pack(r[raw.view(wide)], counts)
            plain_ids = doc_ids.fill_null(0).to_numpy(zero_copy_only=False)
            turn = (np.arange(b.num_rows, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)  # in no step with the rows
            last, first = np.searchsorted(edges, plain_ids, side="right"), np.searchsorted(edges, plain_ids, side="left") + 1
            at = np.where(first < last, first + turn % np.maximum(last - first + 1, 1), last) + lacking
            part = np.where(doc_ids.is_null().to_numpy(zero_copy_only=False), turn % max(lacking, 1), at)
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(counts, pa.int32()), binaries(control, fours), binaries(data, widths), pa.array(part, pa.int32())], names=["doc_id", "n", "control", "data", "part"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, part, held_rows, size = 0, None, [], 0

        def block() -> pa.RecordBatch:
            ids, counts, control, data = zip(*held_rows)
            values = ([part], [seq], [ids], [counts], [b"".join(control)], [b"".join(data)])
            return pa.RecordBatch.from_arrays([pa.array(v, arrow_type(t)) for v, (_, t) in zip(values, columns(BLOCK))], names=[n for n, _ in columns(BLOCK)])

        for b in batches:
            for doc_id, n, control, data, p in zip(*(c.to_pylist() for c in b.columns)):
                if held_rows and (p != part or size >= BLOCK_BYTES):
                    yield block()
                    seq, held_rows, size = seq + 1, [], 0
                part = p
                held_rows.append((doc_id, n, control, data))
                size += len(data)
        if held_rows:
            yield block()

    coded = stored.mapInArrow(rank_all, T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("n int, control binary, data binary, part int").fields]))
    placed = coded.repartitionById(len(edges) + 1 + lacking, F.col("part")).sortWithinPartitions("part", "doc_id", "n", "data")
    placed.mapInArrow(blocks, BLOCK).write.option("compression", "zstd").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, ids`` of every document in the files at ``path``; ``ids`` only if wanted."""
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").select("id").toPandas()["id"].to_numpy(np.uint32)
    held = spark.sparkContext.broadcast(ranks)
    stored = spark.read.parquet(f"{path}/blocks")
    size = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    heads = stored.select("part", "seq", size.alias("size"))
    # One row for each block of about a MB; running sums within a part, then over the parts.
    parts = heads.groupBy("part").agg(F.sum("size").alias("all")).select("part", F.coalesce(F.sum("all").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    starts = heads.select(F.col("part"), "seq", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("within")).join(parts, "part").select("part", "seq", (F.col("before") + F.col("within")).alias("base"))

    shape = "part int, seq int, doc_id long, offset long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_of = held.value
        for b in batches:
            for i in range(b.num_rows):
                part, seq, doc_ids, counts, control, data = (b.column(n)[i] for n, _ in columns(BLOCK))
                counts = counts.values.to_numpy().astype(np.int64)
                ids = id_of[unpack(control.as_buffer(), data.as_buffer(), counts)].astype("<u4")
                stops = np.cumsum(counts)
                raw, crc = memoryview(ids).cast("B"), []
                for a, z in zip((4 * (stops - counts)).tolist(), (4 * stops).tolist()):
                    crc.append(crc32(raw[a:z]))
                out = [pa.array(np.full(len(counts), part.as_py()), pa.int32()), pa.array(np.full(len(counts), seq.as_py()), pa.int32()), doc_ids.values, pa.array(stops - counts), pa.array(counts), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]), pa.int32()), pa.array(ids, pa.int64())))
                yield pa.RecordBatch.from_arrays(out, names=[n for n, _ in columns(shape)])

    rows = stored.select(*[n for n, _ in columns(BLOCK)]).mapInArrow(decode, shape).join(starts, ["part", "seq"])
    return rows.select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    write(table(spark, sf_dir, "documents"), path)
    return read(spark, path, with_ids=False)
