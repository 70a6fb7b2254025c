import numpy as np
from pyspark.sql import functions as F

from terrace.llm import neighbours


def brute(ids, vs, q, k):
    i = ids.index(q)
    score = (vs * vs[i]).sum(1) / (np.sqrt((vs * vs).sum(1)) * np.sqrt((vs[i] * vs[i]).sum()))
    order = sorted((j for j in range(len(ids)) if ids[j] != q), key=lambda j: (-score[j], ids[j]))
    return [(ids[j], score[j]) for j in order[:k]]


def test_recall(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    ids, vs = table.vec_id.tolist(), np.array([np.asarray(v, float) for v in table.embedding])
    got = neighbours.op7_neighbours(spark, sf_dir).toPandas()
    hit = total = 0
    for q in [i for i in ids if i % 50 == 0]:
        mine = got[got.query_id == q].sort_values("rank")
        want = brute(ids, vs, q, 5)
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5] and (np.diff(mine.score) <= 0).all()
        exact = dict(brute(ids, vs, q, len(ids)))
        assert all(abs(exact[i] - s) < 1e-12 for i, s in zip(mine.vec_id, mine.score))
        hit += len({i for i, _ in want} & set(mine.vec_id))
        total += 5
    assert hit / total >= 0.9


def test_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, float("nan")]), (6, [1.0, None]), (None, [1.0, 1.0]), (7, [0.5, 0.5]), (8, [1e200, 0.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r)[:3] for r in neighbours.search(df, F.col("vec_id") < 8).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 2), (1, 2, 8), (1, 3, 7), (2, 1, 1), (2, 2, 8), (2, 3, 7), (7, 1, 1), (7, 2, 2), (7, 3, 8)]
    assert neighbours.search(df.limit(0), F.lit(True)).count() == 0


def test_many_equal_vectors(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(300)], "vec_id long, embedding array<float>")
    got = neighbours.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4, 5] + [0, 1, 2, 3, 4] * 2


def test_rows_of_another_length(spark):
    """They take no part, wherever in a batch or the sample they come."""
    rng = np.random.default_rng(0)
    good = [(i, rng.normal(size=4).tolist()) for i in range(10, 60)]
    odd = [(0, [1.0, 2.0]), (1, [float("nan")] * 4), (5, [1.0] * 7), (70, [3.0, 1.0]), *((i, [0.0] * 3) for i in range(100, 200))]
    search = lambda rows: sorted(map(tuple, neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1), F.col("vec_id") % 5 == 0).collect()))
    want = search(good)
    assert len(want) == 50 and search(odd + good) == search(good[:20] + odd + good[20:]) == want


def small(monkeypatch, **more):
    for name, value in ({"SAMPLE": 400, "LEAF": 40, "FULL": 60, "PART": 50, "PACK": 7} | more).items():
        monkeypatch.setattr(neighbours, name, value)


def clustered(n, clusters, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, 16)) * 4
    return centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, 16))


def watched(monkeypatch):
    """What trees were grafted, and how many leaves are visited of how many."""
    grafts, visits = [], []
    monkeypatch.setattr(neighbours, "grafted", lambda t, b, f=neighbours.grafted: grafts.append(f(t, b)) or grafts[-1])
    monkeypatch.setattr(neighbours, "calibrate", lambda i, q, held, k, f=neighbours.calibrate: visits.append((f(i, q, held, k), held.value.leaves)) or visits[-1][0])
    return grafts, visits


def recall(spark, vs, step=50):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vs)], "vec_id long, embedding array<double>")
    got = neighbours.search(df, F.col("vec_id") % step == 0).toPandas()
    asked = range(0, len(vs), step)
    hit = sum(len({i for i, _ in brute(list(range(len(vs))), vs, q, 5)} & set(got[got.query_id == q].vec_id)) for q in asked)
    assert len(got) == 5 * len(asked)
    return hit / len(got)


def test_leaves_grow_with_the_table(spark, monkeypatch):
    """Clustered vectors, small leaves and groups: the tree is refined, few leaves are visited, and recall holds."""
    small(monkeypatch)
    grafts, visits = watched(monkeypatch)
    assert recall(spark, clustered(3000, 60)) >= 0.9
    tree = grafts[-1]
    assert visits[0][1] == tree.leaves > 40 and visits[0][0] < 0.5 * visits[0][1]
    assert sorted(n for n in tree.leaf if n >= 0) == list(range(tree.leaves))


def test_visits_do_not_grow_with_the_table(spark, monkeypatch):
    """Ten times the rows in ten times the clusters: over ten times the leaves, some three times as many visited, and recall."""
    small(monkeypatch)
    grafts, visits = watched(monkeypatch)
    assert recall(spark, clustered(2000, 40)) >= 0.9 and recall(spark, clustered(20_000, 400), 200) >= 0.9
    (few, leaves), (many, more) = visits
    assert more > 8 * leaves and many <= 3 * few + 3


def test_the_tree_is_bounded(spark, monkeypatch):
    """Leaves stop at their limit, exactly, and every row is found all the same."""
    small(monkeypatch, LEAVES=30)
    grafts, visits = watched(monkeypatch)
    assert recall(spark, clustered(3000, 60)) >= 0.9 and visits[0][1] <= 30
    rng = np.random.default_rng(0)
    for limit in (1, 2, 3, 9, 10, 50):
        tree = neighbours.fit(neighbours._unit(rng.normal(size=(500, 4))), most=3, limit=limit)
        assert tree.leaves <= limit and sorted(n for n in tree.leaf if n >= 0) == list(range(tree.leaves))


def exact(rows, k=5):
    """Of distinct usable rows, each query's nearest ones with another id."""
    kept = list(dict.fromkeys((i, tuple(v)) for i, v in rows))
    out = []
    for q, w in kept:
        if q % 50 == 0:
            cosine = lambda v: float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)))
            out += [(q, r + 1, i) for r, (_, i) in enumerate(sorted((-round(cosine(v), 12), i) for i, v in kept if i != q)[:k])]
    return sorted(out)


def test_repeated_rows(spark):
    """A row that is there several times is one query and one candidate, whichever batch its copies are in."""
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    for extra in ([rows[50]] * 2, [rows[3]] * 40 + [rows[50]] * 7 + [rows[0]] * 500):
        df = spark.createDataFrame(rows + extra, "vec_id long, embedding array<double>").repartition(7)
        got = sorted(tuple(r)[:3] for r in neighbours.search(df, F.col("vec_id") % 50 == 0).collect())
        assert got == exact(rows) and len(got) == 10


def test_rows_that_share_an_id_alone(spark):
    """They are rows of their own: each is a query with its ranks, none finds another of its id, and others find all."""
    rng = np.random.default_rng(2)
    rows = [(50, rng.normal(size=4).tolist()), (50, rng.normal(size=4).tolist()), *((i, rng.normal(size=4).tolist()) for i in (1, 1, 2, 3, 4))]
    got = sorted(tuple(r)[:3] for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect())
    assert got == exact(rows) and len(got) == 10


def test_a_hot_id(spark, monkeypatch):
    """3,000 different rows have the query's id: the 59 others are searched until five are found."""
    small(monkeypatch)
    rng = np.random.default_rng(4)
    rows = [(0, (np.array([9, 9, 9, 9]) + rng.normal(size=4) / 9).tolist()) for _ in range(3000)] + [(i, rng.normal(size=4).tolist()) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(df, (F.col("vec_id") == 0) & (F.col("embedding")[0] > 9.2)).toPandas()
    asked = sum(i == 0 and v[0] > 9.2 for i, v in rows)
    assert len(got) == 5 * asked > 0 and (got.vec_id != 0).all() and sorted(got["rank"].value_counts().tolist()) == [asked] * 5


def test_ids_beside_nulls_infinities_and_other_columns(spark):
    big = 2**60 + 1
    rows = [(big, [1.0, 0.5]), (big + 2, [0.5, 1.0]), (None, [1.0, 1.0]), (big + 4, [float("inf"), 1.0]), (big + 6, [1.0, float("-inf")]), (big + 8, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1, 2.0, 3) for r in rows], "vec_id long, embedding array<double>, label string, leaf int, score double, rank int").coalesce(1)
    got = [tuple(r)[:3] for r in neighbours.search(df, F.col("vec_id").isin(big, big + 4)).orderBy("query_id", "rank").collect()]
    assert got == [(big, 1, big + 2), (big, 2, big + 8)]
