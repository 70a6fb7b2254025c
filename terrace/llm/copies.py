"""Near copies of texts: pairs whose five-word shingles have a Jaccard similarity of ``JACCARD`` or more, and what they connect.

Texts with equal sets of shingles are one *node*.  Candidates are nodes whose SimHash
fingerprints, over the set of shingles, the BK-trees of ``simhash`` link; and, as most pairs
near the threshold differ in more bits than those allow, nodes that share a key of
min-hash bands: a node has ``BANDS`` keys, each of ``ROWS`` minima, and two nodes at the
threshold share none of them with a probability of (1 - 0.8**4)**32, about 5e-8.
A candidate pair counts only if the sets themselves, sent to the task where the
key's nodes meet, are similar enough; pairs connected already are not compared.

Candidates are gathered under the least node that a key of theirs has, and a
gathering with many nodes is cut into chunks.  First each chunk is compared within
itself and with the least node, which connects most of what belongs together.
Then, where nodes are still apart, pairs of chunks meet, but not those whose nodes
all lie in the least node's component.  No pair of candidates is left out, and no
task holds more than two chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import batches_of, counted, materialise, per_text, salted_lookup
from terrace.llm.graph import components

SHINGLE = 5
#: The similarity of near copies as a fraction.
JACCARD = (4, 5)
BANDS, ROWS = 32, 4
#: Nodes of a chunk.
CHUNK = 512
#: Shingles hashed in one step, and rows in a batch for Python.
STEP, BATCH = 4096, 1000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.random.default_rng(5).integers(0, 2**63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """The sorted hashes of a text's different shingles; A-Z count as a-z, fewer words than a shingle's are one, and no words none."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    size = min(SHINGLE, len(each))
    out = np.full(len(each) - size + 1, size, np.uint64)
    for i in range(size):
        out = _mixed(out + each[i : i + len(out)])
    return np.unique(out)


def keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band of a set that isn't empty."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), STEP):
        np.minimum(least, (hashes[i : i + STEP, None] * _FACTORS).min(0), out=least)
    out = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        out = _mixed(out + row)
    return out


def similar(both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of ``a`` and ``b`` members with ``both`` in common are near copies."""
    over, under = JACCARD
    return (over + under) * both >= over * (a + b)


def connect(sets: list[np.ndarray], label: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of near copies that connect what all such pairs connect, beside equal labels, which count as connected."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True)) if label[0] != label[1] else 0
        return [(0, 1)] if both and similar(both, *sizes) else []
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mark, label, out = np.zeros(len(names), np.int64), label.copy(), []
    for i in range(len(sets) - 1):
        open_ = label[i + 1 :] != label[i]
        if not open_.any():
            continue
        own = flat[starts[i] : starts[i + 1]]
        mark[own] = 1
        both = np.add.reduceat(mark[flat[starts[i + 1] :]], starts[i + 1 : -1] - starts[i + 1])
        mark[own] = 0
        for j in (np.flatnonzero(open_ & similar(both, sizes[i], sizes[i + 1 :])) + i + 1).tolist():
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def _links(met: DataFrame) -> DataFrame:
    """``a, b`` from ``cell, node, component, shingles``: the nodes of a cell meet in one task, one cell after the other."""

    def pairs(cell: pd.DataFrame) -> list[tuple[int, int]]:
        nodes = cell["node"].to_numpy()
        found = connect([np.asarray(s) for s in cell["shingles"]], np.unique(cell["component"].to_numpy(), return_inverse=True)[1])
        return [(int(nodes[i]), int(nodes[j])) for i, j in found]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            at = pdf["cell"].to_numpy()
            edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
            out: list[tuple[int, int]] = []
            for a, b in zip(edges, edges[1:]):
                if held and held[-1]["cell"].iloc[-1] != at[a]:
                    whole = pd.concat(held) if len(held) > 1 else held[0]
                    out += pairs(whole) if len(whole) > 1 else []
                    held = []
                held.append(pdf.iloc[a:b])
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)
        if held:
            yield pd.DataFrame(pairs(pd.concat(held)) if sum(map(len, held)) > 1 else [], columns=["a", "b"], dtype=np.int64)

    return met.repartition("cell").sortWithinPartitions("cell").mapInPandas(run, "a long, b long")


def _upto(count: Column) -> Column:
    """The numbers below ``count``, none for 0."""
    return F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array().cast("array<long>"))


def groups(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``row, group``, see ``_groups``; texts and sets of shingles go to Python ``BATCH`` rows at a time."""
    with batches_of(rows.sparkSession, BATCH):
        return _groups(rows, chunk)


def candidate_keys(signed: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, key`` from ``row, keys, fp`` and ``node``: the bands, and what the BK-trees connect a node's fingerprint with."""
    from terrace.llm.simhash import link

    own = signed.join(nodes.select("node"), F.col("row") == F.col("node"))
    bands = own.select("node", F.explode("keys").alias("key"))
    prints = materialise(own.where("size(keys) > 0").select("node", "fp"), "node-fingerprints")
    found = components(link(prints.select("fp").distinct())).withColumnRenamed("node", "_fp")
    linked = prints.join(found, F.col("fp") == F.col("_fp"), "left").select("node", F.xxhash64(F.lit("fingerprint"), F.coalesce("component", "fp")).alias("key"))
    return bands.unionByName(linked)


def _groups(rows: DataFrame, chunk: int) -> DataFrame:
    """``row, group`` from ``row, text``: rows with equal groups are near copies, directly or through others.

    ``row`` is unique and the same whenever ``rows`` is read.  Texts without words,
    null ones too, are one group.
    """
    from xxhash import xxh3_128_digest

    from terrace.llm.simhash import majority

    def sign(texts: list[str | None]) -> list:
        sets = [shingles(t) for t in texts]
        prints = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
        return [[xxh3_128_digest(s.tobytes()) for s in sets], [keys(s).view(np.int64) if len(s) else [] for s in sets], prints]

    signed = materialise(per_text(rows, ["row"], sign, "digest binary, keys array<long>, fp long"), "signatures")
    nodes = materialise(signed.groupBy("digest").agg(F.min("row").alias("node"), F.count("*").alias("rows")), "nodes")
    keyed = candidate_keys(signed, nodes)

    # Nodes with a key in common meet under the key's least node, which for most of the keys of a group is the same one.
    mark = F.xxhash64("node")
    least = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1").select("key", "least")
    members = materialise(keyed.join(least, "key").select("least", "node").distinct(), "candidates")
    counts = members.groupBy("least").agg(F.count("*").alias("n"))
    members = materialise(members.join(counts, "least").select(F.col("least").alias("key"), "n", "least", "node"), "members")

    cut = F.ceil(F.col("n") / chunk)
    own = F.when(F.col("node") == F.col("least"), _upto(cut)).otherwise(F.array(F.pmod(mark, cut)))
    first = members.select("key", "node", F.explode(own).alias("chunk")).select(F.xxhash64("key", "chunk").alias("cell"), "node", F.col("node").alias("component"))
    # A node's text is joined once with the cells that it goes to.  Which texts are wanted has no bound but the corpus, so
    # this is a sort-merge join whatever the size.
    wanted = first.groupBy("node").agg(F.collect_list(F.struct("cell", "component")).alias("cells"))
    texts = rows.hint("merge").join(wanted, F.col("row") == F.col("node")).select("node", "cells", "text")
    sets = materialise(per_text(texts, ["node", "cells"], lambda ts: [pa.array([shingles(t).view(np.int64) for t in ts], pa.list_(pa.int64()))], "shingles array<long>"), "shingles")
    met = sets.select("node", F.explode("cells").alias("at"), "shingles").select("at.cell", "node", "at.component", "shingles")
    links = materialise(_links(met), "near-pairs")
    found = components(links)

    full = members.where(F.col("n") > chunk).join(found.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("key", "node", "least", F.coalesce("component", "node").alias("component"))
    tops = full.where("node = least").select("key", F.col("component").alias("top"))
    full = materialise(full.join(tops, "key").select("key", "node", "component", (F.col("component") == F.col("top")).alias("inner")), "full-keys")
    apart = full.groupBy("key").agg(F.ceil(F.count_if("inner") / chunk).alias("inners"), F.ceil(F.count_if(~F.col("inner")) / chunk).alias("outers")).where("outers > 0")
    inners, outers = _upto(F.col("inners")), F.transform(_upto(F.col("outers")), lambda i: i + F.col("inners"))
    place = F.when(F.col("inner"), F.pmod(mark, F.col("inners"))).otherwise(F.col("inners") + F.pmod(mark, F.col("outers")))
    others = F.when(F.col("inner"), outers).otherwise(F.concat(inners, outers))
    dealt = full.join(apart, "key").withColumn("place", place).select("key", "node", "component", "place", F.explode(others).alias("other"))
    second, later = counted(dealt.select(F.xxhash64("key", F.least("place", "other"), F.greatest("place", "other")).alias("cell"), "node", "component"), "later-cells")
    if later:
        again = second.join(sets.select("node", "shingles"), "node")
        found = components(links.unionByName(materialise(_links(again), "later-near-pairs")))

    named = nodes.join(found.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("digest", "rows", F.coalesce("component", "node").alias("group"))
    return salted_lookup(signed.select("row", "digest"), named, "digest", "rows").select("row", "group")
