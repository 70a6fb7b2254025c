import pandas as pd
import pytest

from terrace.llm import mixing
from tests.llm.helpers import documents, tricky


def waterfill(sizes):
    """Targets by resharing the excess until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if unit * weight[s] > 2 * sizes[s]}
        if not above:
            return out | {s: unit * weight[s] for s in open_}
        for s in above:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= above
    return out


def check(got: pd.DataFrame, docs: pd.DataFrame):
    size = [len((t or "").encode().split()) for t in docs.text]
    source = [s if isinstance(s, str) else None for s in docs.source]
    by = {}
    for s, n in zip(source, size):
        by[s] = by.get(s, 0) + n
    goal = waterfill(by)
    assert sorted(got["size"]) == sorted(size) and (got.taken <= 2 * got["size"]).all() and (got.taken >= 0).all()
    took = {}
    for r in got.itertuples():
        s = r.source if isinstance(r.source, str) else None
        assert r.target == pytest.approx(goal[s]) and r.source_size == by[s]
        took[s] = took.get(s, 0) + r.taken
    for s in by:
        assert abs(took[s] - goal[s]) <= 1


def test_targets_are_met(spark, sf_dir):
    docs = documents(spark, sf_dir)
    got = mixing.taken(docs).toPandas()
    check(got, docs.toPandas())
    again = mixing.taken(docs.repartition(7)).toPandas()
    key = ["doc_id", "taken"]
    assert sorted(map(tuple, got[key].values.tolist())) == sorted(map(tuple, again[key].values.tolist()))


def test_edges(spark):
    docs = tricky(spark)
    check(mixing.taken(docs).toPandas(), docs.toPandas())
    assert mixing.taken(docs.limit(0)).count() == 0
    out = mixing.stage(spark, docs, "")
    assert out.columns == docs.columns and out.where("doc_id = 7").count() <= 4


def test_many_sources(spark):
    """A source for nearly every document: none meets the others in one task, and targets are those of plain resharing."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 37), f"host{i % 700:03}" if i % 3 else "host000") for i in range(3000)], "doc_id long, text string, source string")
    got = mixing.taken(docs)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan.replace("_p", "")
    check(got.toPandas(), docs.toPandas())
    number = {r.source: r.source_no for r in mixing.targets(mixing.sizes(docs)).collect()}
    assert [number[s] for s in sorted(number)] == list(range(1, len(number) + 1))


def test_schedule_interleaves(spark, sf_dir):
    """Every stretch of the mix holds the sources about as often as the whole does."""
    _, goals = mixing.prepare(documents(spark, sf_dir))
    plan = mixing.schedule(goals).toPandas()
    slots = len(plan)
    assert plan.groupby("source_no").block.apply(lambda b: sorted(b) == list(range(len(b)))).all()
    whole = plan.source_no.value_counts(normalize=True)
    half = plan[plan.slot < slots // 2].source_no.value_counts(normalize=True).reindex(whole.index).fillna(0)
    assert ((half - whole).abs() * (slots // 2) <= 4).all()


def test_stays_in_the_jvm(spark, sf_dir):
    plan = mixing.taken(documents(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_stage_repeats_rows_without_a_key_of_their_own(spark):
    """Many rows without an id beside the least id, and repeats of one id: each comes as often as its words are taken, without maps of rows."""
    ids = [None] * 60 + [-(1 << 63)] + [7] * 40 + list(range(100, 140))
    docs = spark.createDataFrame([(i, f"t{n} " * (50 + n), "abc"[n % 3]) for n, i in enumerate(ids)], "doc_id long, text string, source string")
    out = mixing.stage(spark, docs, "")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "map_from_entries" not in plan
    size = {s: sum(50 + n for n in range(len(ids)) if n % 3 == i) for i, s in enumerate("abc")}
    goal, got = waterfill(size), {}
    for r in out.collect():
        got.setdefault((r.doc_id, r.text), []).append(r.source)
    assert max(map(len, got.values())) == 2 and len({k for k in got if k[0] is None}) > 20
    times = mixing.taken(docs).where("taken > 0").selectExpr("sum(ceil(taken / size))").first()[0]
    assert abs(sum(map(len, got.values())) - times) <= 6
    for s in "abc":
        assert sum(len(t.split()) * len(v) for (_, t), v in got.items() if v[0] == s) >= goal[s] - 1
