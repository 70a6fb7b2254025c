import math
import random
import re
from collections import Counter

import duckdb
import numpy as np

from terrace.llm import ranking
from terrace.llm.entries import ORACLE_SQL
from tests.llm.helpers import TRICKY, rows, tricky

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, k=10):
    """Every item against every document, by the definition."""
    counts = [(i, Counter(split(t))) for i, t in docs]
    n_docs, total, df = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts), Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            score = 0
            for t in split(text):
                if t in c:
                    m = 25 + 75 * sum(c.values()) * n_docs // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def test_terms():
    for text in ("Ab-c9 d_e", "ÀÉ x-é À", "漢字 a\x7fb", "@[`{/:", "", "a b"):
        assert [t.decode() for t in ranking.terms(text.encode())] == split(text)
    assert ranking.terms(None) == []


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = ranking.op13_ranking(spark, sf_dir)
    want = sorted(map(tuple, con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL['op13_ranking']})").fetchall()), key=repr)
    assert rows(df) == want and len(want) >= 100


def test_edges_against_brute_force(spark):
    """Null ids come last among equals; null and empty texts, repeated rows and items, terms in half of all documents."""
    items = [(1, "same WORDS one"), (1, "same WORDS one"), (1, "ipsum"), (2, None), (None, "here 3 Times 漢字"), (4, "   "), (5, "nowhere"), (6, "x" * 5000 + " lorem lorem dolor"), (7, "id without ünïcödé")]
    frame = spark.createDataFrame([(i, t, "clash", 1) for i, t in items], "item_id long, text string, score string, key int")
    asked = list(dict.fromkeys((i, t) for i, t in items if t))
    docs = [(i, t) for i, t, *_ in TRICKY] + [(None, "one")]
    table = tricky(spark).unionByName(spark.createDataFrame([(None, "one")], "doc_id long, text string"), allowMissingColumns=True)
    assert rows(ranking.rank(table, frame)) == brute(docs, asked)
    assert rows(ranking.rank(table, frame, 2)) == brute(docs, asked, 2)
    assert ranking.rank(table.limit(0), frame).count() == ranking.rank(table, frame.limit(0)).count() == 0
    assert ranking.rank(table, frame.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def made(rng, n):
    common, rare = [f"c{i}" for i in range(8)], [f"r{i}" for i in range(400)]
    return [(i, " ".join(rng.choices(common, k=rng.randint(1, 30)) + rng.choices(rare, k=rng.randint(0, 5)))) for i in range(n)]


def test_packs_and_shards(spark, monkeypatch):
    """Questions in several packs, shards of a few documents, many ties."""
    rng = random.Random(3)
    docs, items = made(rng, 300), [(i, f"c{i % 8} c1 r{i} r{7 * i % 400} r{i}") for i in range(40)]
    docs += [(i + 1000, t) for i, t in docs[:100]]
    monkeypatch.setattr(ranking, "SHARD", 9)
    monkeypatch.setattr(ranking, "PACK", 4000)
    got = ranking.rank(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got) == brute(docs, items)


def test_lists_of_common_terms_are_hardly_read():
    """With a tenth best score known, a shard looks at far fewer places, and gives the same documents."""
    rng = random.Random(4)
    docs = made(rng, 2000)
    texts = [t.encode() for _, t in docs]
    pack = ranking.questions([("q", b"c0 c1 c2 r5 r9 r14")])
    df = np.array([sum(t in x.split() for x in texts) for t in pack.number])
    weights = np.array([math.floor(1000 * math.log((2 * 2000 + 2) / (2 * d + 1))) for d in df])
    total = sum(len(t.split()) for t in texts)
    shard = ranking.Shard(texts, pack.number, 2000, total)
    everything, few = [0], [0]
    found, value = shard.find(pack.asked[0], weights, 10, 0, everything)
    best = np.sort(value)[-10]
    again, same = shard.find(pack.asked[0], weights, 10, int(best), few)
    assert again.tolist() == found[value >= best].tolist() and same.tolist() == value[value >= best].tolist()
    assert few[0] < 0.3 * everything[0]
