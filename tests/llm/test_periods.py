import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from terrace.llm import periods
from terrace.llm.entries import ORACLE_SQL
from tests.llm.helpers import LONG, TRICKY, documents, ordered, rows, tricky


def brute(words):
    """Every stretch of every period by its definition."""
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = max(i + 1, j)
    return sorted(((a, n, q) for (a, n), q in out.items()), key=lambda r: (r[0], r[2]))


def test_random_words():
    rng = random.Random(1)
    for _ in range(150):
        texts = []
        for _ in range(5):
            words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 80))]
            if words and rng.random() < 0.5:
                p = rng.randint(1, max(1, len(words) // 3))
                words = [words[i % p] for i in range(len(words))]
            texts.append(words)
        for words, got in zip(texts, periods.found(texts)):
            assert list(zip(*(g.tolist() for g in got))) == brute(words)


def test_large_documents_in_parts(monkeypatch):
    """Grids of documents beyond the shared size, made some at a time, meet the same runs."""
    rng = random.Random(2)
    block = [b"%d" % rng.randrange(9) for _ in range(500)]
    words = [b"a"] * 40 + block * 5 + [b"%d" % i for i in range(300)] + block[:100] * 3
    want = brute(words)
    monkeypatch.setattr(periods, "SMALL", 100)
    monkeypatch.setattr(periods, "PAIRS", 1000)
    assert list(zip(*(g.tolist() for g in periods.found([words])[0]))) == want and len(want) >= 3


def test_levels_name_blocks():
    """Two blocks have the same name if and only if they are equal and no block is alone with a name."""
    codes = np.array([1, 2, 1, 2, 1, 2, 3, 1, 2, 1], np.int64)
    for k, level in enumerate(periods.named(codes)):
        span = 1 << k
        for i in range(len(codes) - span + 1):
            for j in range(i + 1, len(codes) - span + 1):
                assert (level[i] == level[j]) == (codes[i : i + span].tolist() == codes[j : j + span].tolist())


def test_collapsed_texts(spark):
    df = spark.createDataFrame([(1, "x " + "a b c " * 5 + "y"), (2, "a b c a b c a b c a b"), (3, "z " * 30 + "end")], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in periods.runs(df).collect()}
    assert got == {1: ([1], [15], [3], "x a b c y"), 2: ([], [], [], "a b c a b c a b c a b"), 3: ([0], [30], [1], "z end")}


def test_query_against_brute_force(spark, sf_dir):
    got = {r.doc_id: r for r in periods.op11_periods(spark, sf_dir).collect()}
    seen = 0
    for i, text in ordered(documents(spark, sf_dir)).itertuples(index=False):
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
        if n > 4000:
            continue
        runs = brute(words)
        gone = {j for a, m, q in runs for j in range(a + q, a + m)}
        assert got[i].n_runs == len(runs) and got[i].runs_sha256 == hashlib.sha256("".join(f"{a},{m},{q}\n" for a, m, q in runs).encode()).hexdigest()
        assert got[i].collapsed_sha256 == hashlib.sha256(b" ".join(w for j, w in enumerate(words) if j not in gone)).hexdigest()
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        assert (got[i].start, got[i].length, got[i].period, got[i].exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        seen += bool(runs)
    assert seen > 5


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    df = periods.op11_periods(spark, sf_dir)
    assert rows(df) == sorted(map(tuple, con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL['op11_periods']})").fetchall()), key=repr)


def test_edges(spark):
    """Nulls, empty, repeated and very long rows; ids may be null; the planted text of a row without an id is its own."""
    got = {(r.doc_id, tuple(r.starts), tuple(r.lengths), tuple(r.periods)) for r in periods.runs(tricky(spark)).collect()}
    assert got == {(i, *zip(*brute((t or "").encode().split()))) if t == LONG else (i, (), (), ()) for i, t, *_ in TRICKY}
    assert periods.runs(tricky(spark)).count() == len(TRICKY) and periods.runs(tricky(spark).limit(0)).count() == 0
    out = {(r.doc_id, r.text) for r in periods.planted(tricky(spark)).collect()}
    assert (None, "a row without an id") in out and (1, None) in out and (2, "") in out


@pytest.mark.parametrize("doc_id, words", [(27, 100), (27, 0), (27, 1)])
def test_planted(spark, doc_id, words):
    i = next(i for i in range(doc_id, 1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    given = [f"w{j}" for j in range(words)]
    text = periods.planted(spark.createDataFrame([(i, "\n".join(given))], "doc_id long, text string")).first().text
    g = zlib.crc32(str(i).encode()) // 10
    a = g % words if words else 0
    p = 1 + (words - a) // (3 + g % 8)
    assert text.split() == [given[j] if j < a else given[a + (j - a) % p] for j in range(words)]
