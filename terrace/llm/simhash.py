"""SimHash near-duplicates, linked through BK-trees (op2), and the pipeline's near-duplicate stage, which goes on to compare shingles themselves (``copies``).

A document's fingerprint has a bit set where over half of its shingles' hashes
have it.  Equal fingerprints are one from here on.  Two that differ in at most
``RADIUS`` of 64 bits agree in all but ``RADIUS`` of any ``blocks`` blocks of
bits, so each fingerprint goes to one shard for every choice of agreeing blocks
(``BLOCKS``), and every link lies inside a shard.

Each shard is a BK-tree: a node's children are keyed by their Hamming distance to
it, and a search follows the edges within ``RADIUS`` of the distance it finds.
The trees of a task are built and searched together, level by level, in numpy.
A shard answers with one link from each fingerprint to the first one of its
cluster there, and joins connect the clusters.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.common import materialise, only, per_text, plain, restored, salted_lookup, table
from terrace.llm.copies import groups
from terrace.llm.graph import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Blocks that the 64 bits are cut into.  Seven give 35 choices of 27 bits each: on average a shard holds 75 of ten
#: billion fingerprints.  The number is the same at every size; a corpus of many more asks for one block more.
BLOCKS = 7
#: Fingerprints of a chunk, where a shard has more than twice as many.
CHUNK = 8192
#: Nodes of the trees searched together, and pairs of query and node looked at in one step.
FOREST, PAIRS = 50_000, 250_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text; A-Z count as a-z; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    last = max(1, len(words) - shingle + 1)
    hashes = np.array([xxh64_intdigest(line[a : b - 1], SEED) for a, b in zip(starts[:last], ends[min(shingle, len(words)) - 1 :])], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long.  A null text has no words."""
    return per_text(docs, ["doc_id"], lambda texts: [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)], "fp long")


def masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """Bit masks of all choices of ``blocks - radius`` blocks, one of which any two fingerprints within ``radius`` agree on."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    whole = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(whole, blocks - radius)]


def forest(values: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """BK-trees over ``values``; ``roots`` has each one's root.  Row ``i`` of the result has node ``i``'s child at each distance, or -1."""
    child = np.full((len(values), 65), -1, np.int32)
    todo = np.flatnonzero(roots != np.arange(len(values)))
    at = roots[todo]
    while len(todo):
        d = np.bitwise_count(values[todo] ^ values[at])
        edge = at.astype(np.int64) * 65 + d
        first, where = np.unique(edge, return_index=True)
        empty = child.ravel()[first] < 0
        child.ravel()[first[empty]] = todo[where[empty]]
        at = child[at, d]
        stay = at != todo
        todo, at = todo[stay], at[stay]
    return child


def clusters(values: np.ndarray, roots: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """The first member of each value's cluster: values of a tree linked within ``radius``, directly or through others."""
    child = forest(values, roots)
    label = np.arange(len(values))
    tree_size = np.bincount(roots, minlength=len(values))[roots]
    begin = 0
    while begin < len(values):
        end = begin + max(1, int(np.searchsorted(np.cumsum(tree_size[begin:]), PAIRS, side="right")))
        asked = np.arange(begin, end)
        node = roots[begin:end]
        while len(asked):
            d = np.bitwise_count(values[asked] ^ values[node]).astype(np.int8)
            near = (d <= radius) & (asked != node)
            _join(label, asked[near], node[near])
            on: list[tuple[np.ndarray, np.ndarray]] = []
            for step in range(-radius, radius + 1):  # one edge length at a time, so that no matrix of all is made
                there = np.flatnonzero((d >= -step) & (d <= 64 - step))
                below = child[node[there], d[there] + step]
                on.append((asked[there[below >= 0]], below[below >= 0]))
            asked, node = (np.concatenate(x) for x in zip(*on))
        begin = end
    return label


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label != label[label]).any():
            label[:] = label[label]


def link(fps: DataFrame, radius: int = RADIUS, chunk: int = CHUNK, blocks: int = BLOCKS) -> DataFrame:
    """``a, b``: links that connect distinct fingerprints (column ``fp``) as all pairs within ``radius`` do."""
    chosen = masks(radius, blocks)
    signed = [m - (1 << 64) if m >> 63 else m for m in chosen]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("mask", "key"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b.to_numpy(np.int64) for b in batches]
        if not got:
            return
        rows = np.concatenate(got)
        rows = rows[np.lexsort(rows.T[::-1])]
        fp, new = rows[:, 3], np.ones(len(rows), bool)
        new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
        root = np.flatnonzero(new)[np.cumsum(new) - 1]
        several = np.bincount(root, minlength=len(rows))[root] > 1
        fp, root = fp[several].view(np.uint64), (np.cumsum(several) - 1)[root[several]]
        begin = 0
        while begin < len(fp):  # whole trees, about FOREST nodes at a time
            end = begin + FOREST
            end = len(fp) if end >= len(fp) else max(int(root[end]), begin) if root[end] > begin else int(np.searchsorted(root, root[begin], side="right"))
            first = clusters(fp[begin:end], root[begin:end] - begin, radius)
            linked = np.flatnonzero(first != np.arange(end - begin))
            part = fp[begin:end].view(np.int64)
            yield pd.DataFrame({"a": part[linked], "b": part[first[linked]]})
            begin = end

    # Fingerprints close to each other can fill a shard however many there are.  Such a shard is cut into chunks, and each
    # pair of chunks is a shard of its own: no pair of fingerprints is lost and no task holds more than two chunks.
    full = keyed.groupBy("mask", "key").count().where(F.col("count") > 2 * chunk).select("mask", "key", F.ceil(F.col("count") / chunk).alias("chunks"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    cell = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda other: F.least(own, other) * F.col("chunks") + F.greatest(own, other))
    dealt = keyed.join(full, ["mask", "key"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).select("mask", "key", F.explode(cell).alias("cell"), "fp")
    return dealt.repartition("mask", "key", "cell").mapInPandas(run, "a long, b long")


def near_fingerprints(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id`` for each row.

    The component is the smallest id reachable over links.  Texts without words
    share fingerprint 0; a very long text has one fingerprint like others.  Repeated
    rows stay; a row without an id has the component that its text leads to (null if
    no row there has an id); other columns are ignored; an empty table gives an
    empty one.
    """
    fps = materialise(fingerprints(docs), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    distinct = materialise(distinct, "distinct-fingerprints")
    found = components(link(distinct.select("fp"), radius))
    grouped = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("component"))
    grouped = materialise(grouped, "fingerprint-components")
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(least, "component").select("fp", "n", "component_id")
    return salted_lookup(fps, named, "fp", "n").select("doc_id", "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_fingerprints(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, component_id`` for each row, by the similarity of five-word shingles (``copies``).

    The component is the smallest id reachable over near copies; a row without an
    id has the component that its text leads to.  Texts without words are one group;
    very long texts are compared whole; other columns are ignored; an empty table
    gives an empty one.
    """
    numbered = materialise(only(docs, "doc_id", "text").toDF("_id", "text").withColumn("row", F.monotonically_increasing_id()), "numbered")
    grouped = groups(numbered.select("row", "text"))
    placed = materialise(numbered.select("row", F.col("_id").alias("doc_id")).join(grouped, "row").select("doc_id", "group"), "placed")
    least = placed.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return placed.join(least, "group").select("doc_id", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: the one with the smallest id, rows without an id after all others, and of repeated ids the first as read.

    Texts without words, null ones too, are one group; other columns, whatever their
    names and types, come through; an empty table gives an empty one.
    """
    rows, (doc_id, text) = plain(docs, "doc_id", "text")
    numbered = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    grouped = groups(numbered.select("row", F.col(text).alias("text")))
    ids = numbered.select("row", F.col(doc_id).alias("id"))
    first = F.min(F.struct(F.col("id").isNull().alias("lacks"), "id", "row"))["row"]
    kept = materialise(grouped.join(ids, "row").groupBy("group").agg(first.alias("row")).select("row"), "kept")
    return restored(numbered.hint("merge").join(kept, "row", "left_semi"), docs)
