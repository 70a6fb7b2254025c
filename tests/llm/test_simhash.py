import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from terrace.llm import simhash
from terrace.llm.common import salted_lookup
from terrace.llm.graph import components
from tests.llm.helpers import TRICKY, documents, rows, tricky


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    label = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for i, x in zip(ids, label):
        least[x] = min(least.get(x, i), i)
    return {i: least[x] for i, x in zip(ids, label)}


def test_fingerprints(spark, sf_dir):
    for text in (t for _, t, _, _ in TRICKY):
        assert simhash.fingerprint(text) == brute_fingerprint(text)
    assert spark.sql("SELECT xxhash64('a b c d')").first()[0] % 2**64 == xxh64_intdigest("a b c d", 42)


def test_query(spark, sf_dir):
    docs = documents(spark, sf_dir).toPandas()
    fps = [brute_fingerprint(t) for t in docs.text]
    want = brute_components(docs.doc_id.tolist(), fps)
    got = simhash.op2_simhash(spark, sf_dir).toPandas()
    assert dict(zip(got.doc_id, got.component_id)) == want
    assert dict(zip(got.doc_id, got.fingerprint)) == {i: f"{f:016x}" for i, f in zip(docs.doc_id, fps)}
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("blocks", [5, 7, 9])
def test_masks_are_complete(blocks):
    rng = np.random.default_rng(0)
    chosen = simhash.masks(blocks=blocks)
    for _ in range(300):
        flips = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))
        assert any(flips & m == 0 for m in chosen)


def test_common_fingerprints_are_salted(spark):
    """A key with a third of all rows is dealt to several tasks, and all rows find their names."""
    rows = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 0, id) as fp")
    named = rows.groupBy("fp").count().selectExpr("fp", "count as n", "fp + 1 as name")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = salted_lookup(rows, named, "fp", "n")
        assert sorted(map(tuple, got.select("fp", "id", "name").collect())) == sorted((i if i % 3 else 0, i, (i if i % 3 else 0) + 1) for i in range(3000))
        spread = got.where("fp = 0").groupBy(F.spark_partition_id()).count().count()
        assert spread > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_trees_find_all_links():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 20).astype(np.uint64)
    values = np.unique(np.array([c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 3))) for c in np.repeat(centres, 30)], np.uint64))
    label = simhash.clusters(values, np.zeros(len(values), int))
    want = brute_components(list(range(len(values))), values.tolist())
    assert label.tolist() == [want[i] for i in range(len(values))]


def test_full_shards_are_cut(spark):
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 2**62))
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(60, 2)) for _ in range(300)} | {int(x) for x in rng.integers(0, 2**62, 200)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    assert rows(components(simhash.link(df, chunk=20))) == rows(components(simhash.link(df)))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (None, 3)]
    got = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges(spark):
    docs = tricky(spark)
    got = simhash.near_duplicates(docs)
    by = dict((r.doc_id, r.component_id) for r in got.collect())
    assert got.count() == docs.count() and by[1] == by[2] == by[3] == 1 and by[6] == by[7] == 6
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 4, 5, 6, 8, 9] and kept.where("doc_id is null").count() == 1
