"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on at most ``SAMPLE`` vectors, those with the smallest hash of
their id; every row is indexed in the leaf that its descent ends in.  Leaves with over
``FULL`` rows become trees of their own, each fitted on about ``SAMPLE`` of its rows at
most, in passes that only count, until none is so full or there are ``LEAVES``, beyond which
none is made: every task gets the tree, so its size is bounded.  The index is written once.

A query walks the tree best bin first: a priority queue holds the nodes not yet opened by
how far beyond the border of the nearest bin they begin, summed (in squares) down the tree,
and leaves are visited in the order in which they come out.  How many
is calibrated: the true neighbours of ``CALIBRATION`` queries in the whole table are found by
one pass over it, and visits are widened until ``RECALL`` of them lie in leaves visited.  As
leaves grow in number and not in size, neighbours that lie close together stay as few leaves away.

Leaves are gathered into groups of about ``PART`` rows, fuller ones spread over
several.  Each row goes to one group, and each query to the groups it visits; a
task holds a group's rows while the queries stream by, ``PACK`` at a time, scores
them by a matrix product and keeps what lies in leaves visited.  Queries that find fewer
than asked for are asked again with more visits, up to all leaves.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from terrace.llm.common import materialise, table

SAMPLE, BRANCHES, LEAF, TURNS = 16_000, 8, 256, 12
RECALL, CALIBRATION = 0.96, 400
PART, PACK = 2_000, 1_000
#: Rows of a leaf that is refined, and leaves at most.
FULL, LEAVES = 8_000, 65_536
#: How many times more leaves are visited by queries that found too few.
WIDEN = 8


@dataclass
class Tree:
    """Node 0 is the root; a leaf has no children and a number."""

    centre: np.ndarray
    children: list[list[int]]
    leaf: list[int]

    @property
    def leaves(self) -> int:
        return max(self.leaf) + 1

    def order(self, v: np.ndarray, enough) -> list[int]:
        """Leaves in the order of a best-bin-first walk, until ``enough`` of the leaves so far."""
        queue, out = [(0.0, 0)], []
        while queue and not enough(out):
            key, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
                continue
            below = self.children[node]
            centres = self.centre[below]
            far = ((centres - v) ** 2).sum(1)
            best = int(far.argmin())
            apart = np.sqrt(((centres - centres[best]) ** 2).sum(1))
            beyond = (far - far[best]) / np.maximum(2 * apart, 1e-12)
            for d, c in zip((key + beyond * beyond).tolist(), below):
                heapq.heappush(queue, (d, c))
        return out

    def descend(self, vs: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out, todo = np.zeros(len(vs), np.int64), [(0, np.arange(len(vs)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            below = np.array(self.children[node])
            near = (vs[rows] @ self.centre[below].T * 2 - (self.centre[below] ** 2).sum(1)).argmax(1)
            todo += [(int(c), rows[near == i]) for i, c in enumerate(below) if (near == i).any()]
        return out


def _kmeans(vs: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = vs[rng.choice(len(vs), k, replace=False)]
    for _ in range(TURNS):
        near = (vs @ centres.T * 2 - (centres**2).sum(1)).argmax(1)
        centres = np.array([vs[near == i].mean(0) if (near == i).any() else centres[i] for i in range(k)])
    return centres


def fit(vs: np.ndarray, seed: int = 0, most: int = 0, limit: int = 0) -> Tree:
    """A tree over unit vectors with at most ``most`` (``LEAF``) in a leaf and ``limit`` (``LEAVES``) leaves; a node whose rows can't be told apart stays a leaf.

    The fullest nodes are split first, so that a limit leaves the others whole.
    """
    rng = np.random.default_rng(seed)
    most, limit = most or LEAF, limit or LEAVES
    centres, children, open_nodes = [np.zeros(vs.shape[1])], [[]], 1  # open: leaves, if nothing more is split
    todo, turn = [(-len(vs), 0, 0, vs)], 1
    while todo:
        size, _, node, rows = heapq.heappop(todo)
        room = limit - open_nodes + 1
        if -size <= most or room < 2 or len(distinct := np.unique(rows, axis=0)) < 2:
            continue
        found = _kmeans(distinct, min(BRANCHES, max(2, -(size * 3 // (2 * most))), len(distinct), room), rng)
        near = (rows @ found.T * 2 - (found**2).sum(1)).argmax(1)
        parts = [(found[i], rows[near == i]) for i in range(len(found)) if (near == i).any()]
        if len(parts) < 2:
            continue
        open_nodes += len(parts) - 1
        for c, below in parts:
            children[node].append(len(centres))
            centres.append(c)
            children.append([])
            heapq.heappush(todo, (-len(below), turn, len(centres) - 1, below))
            turn += 1
    leaf, count = [], 0
    for below in children:
        leaf.append(-1 if below else count)
        count += not below
    return Tree(np.array(centres), children, leaf)


def grafted(tree: Tree, below: dict[int, Tree]) -> Tree:
    """The tree with some leaves replaced by trees; a replaced leaf's number passes to one of the new leaves."""
    centres, children, leaf, count = [*tree.centre], [[*c] for c in tree.children], [*tree.leaf], tree.leaves
    at = {n: node for node, n in enumerate(tree.leaf) if n >= 0}
    for number in sorted(below):
        sub, node, start = below[number], at[number], len(centres) - 1  # node i > 0 of the new tree becomes start + i
        for i in range(1, len(sub.leaf)):
            centres.append(sub.centre[i])
            children.append([start + c for c in sub.children[i]])
            leaf.append(-1 if sub.leaf[i] < 0 else number if sub.leaf[i] == 0 else count + sub.leaf[i] - 1)
        children[node], leaf[node] = [start + c for c in sub.children[0]], -1
        count += sub.leaves - 1
    return Tree(np.array(centres), children, leaf)


def _matrix(column: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Usable rows and their vectors in double precision: ``width`` components, all finite and not all zero."""
    keep, rows = [], []
    for i, v in enumerate(column):
        if v is None or len(v) != width or any(x is None for x in v):
            continue
        a = np.asarray(v, np.float64)
        if np.isfinite(a).all() and a.any():
            keep.append(i)
            rows.append(a)
    return np.array(keep, int), np.array(rows) if rows else np.zeros((0, width))


def _width(rows: DataFrame) -> int | None:
    """The commonest length of the usable vectors, of equally common ones the greatest; None without any."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.where(finite & F.exists("v", lambda x: x != 0))
    found = usable.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return found and found["width"]


def _unit(vs: np.ndarray) -> np.ndarray:
    scaled = vs / np.abs(vs).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _mark(vec_id: int, v: np.ndarray) -> int:
    """Of a row: the same for rows with the same id and vector."""
    return xxh64_intdigest(np.ascontiguousarray(v).tobytes(), seed=vec_id & (1 << 63) - 1) >> 1


def _placer(held, width: int):
    """The leaf of each usable row, and its mark; rows of a batch that repeat another are left out."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep, vs = _matrix(pdf["v"], width)
            if len(keep):
                rows = pdf.iloc[keep].assign(leaf=held.value.descend(_unit(vs)), mark=[_mark(i, v) for i, v in zip(pdf["vec_id"].iloc[keep].tolist(), vs)])
                yield rows.drop_duplicates(["vec_id", "mark"])

    return place


def _refined(placed: DataFrame, full: dict[int, int], leaves: int) -> dict[int, Tree]:
    """Trees for the leaves in ``full`` (leaf to its rows), each fitted on about ``SAMPLE`` of its rows at most; none for a leaf whose rows can't be told apart.

    Together they add no more leaves than there is room for, dealt out by rows.
    """
    room, total = LEAVES - leaves, sum(full.values())
    spark = placed.sparkSession
    # New leaves aim at a quarter of a full one.
    parts = [(leaf, share := min(1.0, SAMPLE / n), 1 + room * n // total, max(1, int(share * FULL / 4))) for leaf, n in full.items()]
    shares = spark.createDataFrame(parts, "leaf long, share double, room long, most long")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = fit(_unit(np.array(pdf.sort_values(["vec_id", "mark"])["v"].tolist())), most=int(pdf["most"].iloc[0]), limit=int(pdf["room"].iloc[0]))
        return pd.DataFrame({"leaf": pdf["leaf"].iloc[:1].values, "tree": [pickle.dumps(tree)]})

    chosen = placed.join(F.broadcast(shares), "leaf").where(F.pmod(F.xxhash64("mark", F.lit(2)), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    # Trees, not rows; with the leaves there are, at most LEAVES nodes' centres and their parents'.
    grown = chosen.select("leaf", "vec_id", "mark", "v", "room", "most").groupBy("leaf").applyInPandas(grow, "leaf long, tree binary").collect()
    trees = {r.leaf: pickle.loads(r.tree) for r in grown}
    return {leaf: t for leaf, t in trees.items() if t.leaves > 1}


def calibrate(index: DataFrame, queries: DataFrame, held, k: int) -> int:
    """The number of leaves to visit so that ``RECALL`` of the true neighbours of some queries lie in them."""
    spark = index.sparkSession
    chosen = queries.orderBy(F.xxhash64("mark"), "mark").limit(CALIBRATION).select("vec_id", "mark", "v").collect()
    if not chosen:
        return 1
    asked = np.array([r.vec_id for r in chosen], np.int64)
    sent = spark.sparkContext.broadcast((asked, _unit(np.array([r.v for r in chosen]))))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, qs = sent.value
        best = pd.DataFrame({"query": [], "score": [], "mark": [], "leaf": []}).astype({"query": "int64", "mark": "int64", "leaf": "int64"})
        for pdf in batches:
            for i in range(0, len(pdf), PACK * 4):
                part = pdf.iloc[i : i + PACK * 4]
                near = qs @ _unit(np.array(part["v"].tolist())).T
                near[asked[:, None] == part["vec_id"].to_numpy(np.int64)] = -3
                n = min(4 * k, len(part))  # some more, as a row may be there several times
                at = np.argpartition(-near, n - 1, axis=1)[:, :n]
                q = np.repeat(np.arange(len(asked)), n)
                flat = at.ravel()
                rows = pd.DataFrame({"query": q, "score": near[q, flat], "mark": part["mark"].to_numpy(np.int64)[flat], "leaf": part["leaf"].to_numpy(np.int64)[flat]})
                best = pd.concat([best, rows[rows["score"] > -2]]).sort_values("score", ascending=False, kind="stable").drop_duplicates(["query", "mark"]).groupby("query").head(k)
        yield best

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, qs = sent.value
        for pdf in batches:
            at = []
            for q, leaves in zip(pdf["query"], pdf["leaves"]):
                left = set(leaves)
                seen = held.value.order(qs[q], lambda out: not left.difference(out[-1:]) or left.difference_update(out[-1:]))
                places = {leaf: i + 1 for i, leaf in enumerate(seen)}
                at += [places[x] for x in leaves]
            yield pd.DataFrame({"place": at})

    found = index.select("vec_id", "v", "mark", "leaf").mapInPandas(nearest, "query long, score double, mark long, leaf long")
    # A row that is there several times is one neighbour.
    first = found.groupBy("query", "mark").agg(F.max("score").alias("score"), F.first("leaf").alias("leaf"))
    top = first.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "mark"))).where(F.col("r") <= k)
    places = top.groupBy("query").agg(F.collect_list("leaf").alias("leaves")).mapInPandas(place, "place int").toPandas()["place"].to_numpy()  # CALIBRATION times k
    return int(np.quantile(places, RECALL, method="higher")) if len(places) else 1


def _scorer(k: int):
    """Of rows in the order of group, index rows before queries: the best of a group for each query that visits it."""

    def score(index: list[pd.DataFrame], queries: pd.DataFrame) -> list[tuple[int, int, int, int, float]]:
        rows = pd.concat(index).drop_duplicates(["vec_id", "mark"]) if len(index) > 1 else index[0]
        index[:] = [rows]
        vs, ids, asked = np.array(rows["v"].tolist()), rows["vec_id"].to_numpy(np.int64), queries["vec_id"].to_numpy(np.int64)
        marks, own = rows["mark"].to_numpy(np.int64), queries["mark"].to_numpy(np.int64)
        qs = np.array(queries["v"].tolist())
        with np.errstate(over="ignore", under="ignore"):
            norms, owns = np.sqrt((vs * vs).sum(1)), np.sqrt((qs * qs).sum(1))
        fine = np.isfinite(norms) & (norms > 1e-150)
        rough = _unit(qs) @ _unit(vs).T
        leaves, leaf = np.unique(rows["leaf"].to_numpy(np.int64), return_inverse=True)
        visited = np.array([np.isin(leaves, seen) for seen in queries["seen"]])
        rough[~visited[:, leaf] | (ids == asked[:, None])] = -3
        least = np.partition(rough, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(asked), -2.0)
        out = []
        for i, q in enumerate(asked.tolist()):
            near = np.flatnonzero(rough[i] >= max(least[i] - 1e-9, -2))
            with np.errstate(all="ignore"):
                exact = (vs[near] * qs[i]).sum(1) / (norms[near] * owns[i])
            # Where squares leave the range of doubles, the scaled vectors' product stands.
            exact = np.where(fine[near] & np.isfinite(owns[i]) & (owns[i] > 1e-150) & np.isfinite(exact), exact, rough[i, near])
            best = np.lexsort((marks[near], ids[near], -exact))[:k]
            out += zip([q] * len(best), [own[i]] * len(best), ids[near][best].tolist(), marks[near][best].tolist(), exact[best].tolist())
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, index = None, []
        for pdf in batches:
            at, asks = pdf["group"].to_numpy(np.int64), pdf["leaf"].to_numpy(np.int64) < 0
            edges = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(at)]
            out: list[tuple[int, int, int, int, float]] = []
            for a, b in zip(edges, edges[1:]):
                if at[a] != group:
                    group, index = at[a], []
                if not asks[a]:
                    index.append(pdf.iloc[a:b].drop_duplicates(["vec_id", "mark"]))
                elif index:
                    for i in range(a, b, PACK):
                        out += score(index, pdf.iloc[i : min(b, i + PACK)])
            yield pd.DataFrame(out, columns=["query_id", "query", "vec_id", "mark", "score"])

    return run


FOUND = "query_id long, query long, vec_id long, mark long, score double"


def _search(indexed: DataFrame, queries: DataFrame, held, span: dict[int, tuple[int, int]], visits: int, k: int) -> DataFrame:
    """``query_id, query, vec_id, mark, score``: the best of each query in the first ``visits`` leaves that hold rows."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for q, mark, v in zip(pdf["vec_id"], pdf["mark"], pdf["v"]):
                seen = [x for x in held.value.order(_unit(np.array([v]))[0], lambda out: len(out) >= visits) if x in span]
                out += [(q, v, mark, -1, seen, g) for g in sorted({g for x in seen for g in range(span[x][0], span[x][0] + span[x][1])})]
                if len(out) >= PACK:
                    yield pd.DataFrame(out, columns=["vec_id", "v", "mark", "leaf", "seen", "group"])
                    out = []
            yield pd.DataFrame(out, columns=["vec_id", "v", "mark", "leaf", "seen", "group"])

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            first, parts = (np.array([span[x][i] for x in pdf["leaf"]], np.int64) for i in (0, 1))
            yield pdf.assign(seen=None, group=first + pdf["mark"].to_numpy(np.int64) % parts)

    shape = "vec_id long, v array<double>, mark long, leaf long, seen array<long>, group long"
    left = indexed.select("vec_id", "v", "mark", "leaf").mapInPandas(deal, shape)
    right = queries.select("vec_id", "mark", "v").mapInPandas(walk, shape)
    met = left.unionByName(right).repartition("group").sortWithinPartitions("group", F.col("leaf") < 0)
    found = met.mapInPandas(_scorer(k), FOUND)
    rank = F.row_number().over(W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id", "mark"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score`` from ``vec_id, embedding``: for each query row the nearest other rows found, by cosine.

    Rows without an id, and vectors that are null, zero, or hold null or non-finite
    components, take no part, nor do vectors of another length than most usable ones
    have (of equally common lengths, the greatest).  Rows with the query's id count as
    its own.  A row that is there several times, with the same id and vector, is one candidate and
    one query; rows that share an id alone are candidates, and queries with ranks, each for itself.  Fewer
    than ``k`` come back only where there are fewer; equal scores go by smaller id; other columns are
    ignored; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked")).where("vec_id is not null")
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = _width(rows)
    if width is None:
        return none
    rows = rows.where(F.size("v") == width)
    taken = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas().sort_values("vec_id")
    _, sample = _matrix(taken["v"], width)
    if not len(sample):
        return none
    tree = fit(_unit(sample))
    shape = "vec_id long, v array<double>, asked boolean, leaf long, mark long"
    while True:
        held = spark.sparkContext.broadcast(tree)
        placed = rows.mapInPandas(_placer(held, width), shape)
        last = tree.leaves >= LEAVES
        # One number for each leaf, of which there are at most LEAVES.
        filled = dict(placed.groupBy("leaf").count().collect())
        full = {leaf: n for leaf, n in filled.items() if n > FULL}
        below = _refined(placed, full, tree.leaves) if full and not last else {}
        if not below:
            break
        tree = grafted(tree, below)
    indexed = materialise(placed, "indexed")
    queries = materialise(indexed.where("asked").select("vec_id", "mark", "v").dropDuplicates(["vec_id", "mark"]), "queries")
    visits = calibrate(indexed, queries, held, k)

    # Leaves in order fill groups of about PART rows; a fuller leaf spreads over several.
    span, at, room = {}, 0, PART
    for leaf in sorted(filled):
        parts = -(-filled[leaf] // PART)
        if filled[leaf] > room:
            at, room = at + 1, PART
        span[leaf] = (at, parts)
        at, room = (at + parts - 1, room - filled[leaf]) if parts == 1 else (at + parts, PART)

    out = []
    while True:
        found = materialise(_search(indexed, queries, held, span, visits, k), "found")
        if visits >= tree.leaves:
            out.append(found)
            break
        done = found.groupBy(F.col("query_id").alias("vec_id"), F.col("query").alias("mark")).count().where(F.col("count") >= k).drop("count")
        short = queries.join(done, ["vec_id", "mark"], "left_anti")
        out.append(found.join(done.select(F.col("vec_id").alias("query_id"), F.col("mark").alias("query")), ["query_id", "query"], "left_semi"))
        if short.isEmpty():
            break
        # Few, if any: those whose visited leaves hold hardly any rows but their own and repeated ones.
        queries, visits = materialise(short, "short"), visits * WIDEN
    return reduce(DataFrame.unionByName, out).select("query_id", "rank", "vec_id", "score")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
