import random

import pytest

from terrace.llm import copies, simhash
from tests.llm.helpers import documents, tricky


def brute(texts):
    """The first near copy of each text, directly or through others, by the similarity of all pairs."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(sets)))
    for j in range(len(sets)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if label[i] != label[j] and (sets[i] == sets[j] or both / (len(sets[i]) + len(sets[j]) - both) >= 0.8):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def varied(seed=0):
    """Texts of several similarities: chains, copies with a few changed words, a passage that many share, and texts without words."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    out, passage = [None, "", " \n", "one", "One", "two words"], [word() for _ in range(40)]
    for _ in range(40):
        base = [word() for _ in range(rng.randrange(50, 200))] + passage * rng.randrange(2)
        out.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            base = list(base)
            for _ in range(rng.randrange(1, 1 + len(base) // 25)):
                base[rng.randrange(len(base))] = word()
            out.append(" ".join(base))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("chunk", [copies.CHUNK, 3])
def test_groups_are_those_of_all_pairs(spark, chunk):
    texts = varied()
    got = dict(copies.groups(spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(5), chunk).collect())
    want = brute(texts)
    assert got == dict(enumerate(want)) and 40 < len(set(want)) < len(want) - 40


def test_stage_links_by_similarity(spark, sf_dir):
    """Near copies whose fingerprints differ in more than four bits go, and what only has a near fingerprint stays."""
    texts = varied(1)
    fps = [simhash.fingerprint(t) for t in texts]
    want = brute(texts)
    assert sum((fps[i] ^ fps[w]).bit_count() > 4 for i, w in enumerate(want)) > 10
    kept = simhash.stage(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_stage_on_documents(spark, sf_dir):
    docs = documents(spark, sf_dir)
    have = docs.orderBy("doc_id").collect()
    want = {have[i].doc_id for i in brute([r.text for r in have])}
    assert {r.doc_id for r in simhash.stage(spark, docs, sf_dir).collect()} == want


def test_fingerprint_edges(spark):
    docs = tricky(spark)
    got = simhash.near_fingerprints(docs)
    by = dict((r.doc_id, r.component_id) for r in got.collect())
    assert got.count() == docs.count() and by[1] == by[2] == by[3] == 1 and by[6] == by[7] == 6
    assert simhash.near_fingerprints(docs.limit(0)).count() == 0


def test_stage_takes_rows_not_ids(spark):
    """An id's rows with unrelated texts stay, copies without an id go, and a copy doesn't stay for its id's other text."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    docs = spark.createDataFrame([(1, a), (1, b), (2, b), (2, c), (None, c), (None, d), (None, d), (None, None), (3, "")], "doc_id long, text string")
    kept = sorted(map(tuple, simhash.stage(spark, docs, "").collect()), key=repr)
    assert kept == sorted([(1, a), (1, b), (2, c), (None, d), (3, "")], key=repr)


def test_fingerprints_bring_candidates(spark):
    """Nodes that share no band meet if the BK-trees link their fingerprints, directly or through others; texts without words don't."""
    fps = [0b0, 0b1111, 0b11111111, -1, -2, 0]
    signed = spark.createDataFrame([(i, [100 + i] if i < 5 else [], fp) for i, fp in enumerate(fps)], "row long, keys array<long>, fp long")
    keys = {}
    for r in copies.candidate_keys(signed, signed.select(signed.row.alias("node"))).collect():
        keys.setdefault(r.key, set()).add(r.node)
    assert sorted(sorted(k) for k in keys.values() if len(k) > 1) == [[0, 1, 2], [3, 4]] and all(5 not in k for k in keys.values())
