"""Operators 1 and 10 against brute force over all windows."""

import random
from dataclasses import replace
from hashlib import sha256

import numpy as np
import pytest

from terrace.llm import substrings, suffixes, windows
from tests.llm.helpers import documents, ordered, rows, tricky


def covered(units, length, seen):
    out = [False] * len(units)
    for p in range(len(units) - length + 1):
        k = units[p : p + length]
        k = k if isinstance(k, bytes) else tuple(k)
        if k in seen:
            out[p : p + length] = [True] * length
        seen.add(k)
    return out


def brute(docs, module):
    seen, out = set(), {}
    for doc_id, text in ordered(docs).itertuples(index=False):
        data = (text or "").encode()
        if module is substrings:
            words = data.split()
            gone = covered(words, 20, seen)
            out[doc_id] = (len(words), sum(gone), sha256(b" ".join(w for w, g in zip(words, gone) if not g)).hexdigest())
        else:
            gone = covered(data, 100, seen)
            runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
            out[doc_id] = (len(data), sum(gone), runs, sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("module", [substrings, suffixes])
def test_against_brute_force(spark, sf_dir, module):
    docs = documents(spark, sf_dir)
    want = brute(docs, module)
    got = {r[0]: tuple(r[1:]) for r in module.deduplicate(docs, False).collect()}
    assert got == want and any(v[1] for v in want.values())


@pytest.mark.parametrize("module", [substrings, suffixes])
def test_hot_anchors(spark, sf_dir, module):
    """Anchors that name shards by nearly the whole window change nothing."""
    docs = documents(spark, sf_dir)
    spec = replace(module.SPEC, hot=1, share=10**9)
    assert len(windows.candidates(windows.numbered(docs), spec)[1])
    assert rows(module.deduplicate(docs, False, spec)) == rows(module.deduplicate(docs, False))


@pytest.mark.parametrize("module", [substrings, suffixes])
def test_edges(spark, module):
    docs = tricky(spark)
    got = module.deduplicate(docs)
    assert got.count() == docs.count()
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0][1] == 0 and by[2][0][2] == 0 and by[4][0][2] == 0
    assert by[5][0][2] > 0.9 * by[5][0][1]  # its passages repeat inside it
    assert module.deduplicate(docs.limit(0)).count() == 0


def test_one_common_phrase_in_many_contexts(spark):
    rng = random.Random(1)
    phrase = " ".join(f"p{i}" for i in range(15))
    made = [(i, " ".join(f"w{rng.random()}" for _ in range(10)) + f" {phrase} " + " ".join(f"w{rng.random()}" for _ in range(10))) for i in range(600)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    assert substrings.deduplicate(docs, False).where("n_removed > 0").count() == 0


def test_full_shards_are_split(spark, sf_dir, monkeypatch):
    """A shard with more segments than a task should build one automaton of gives the same windows in parts."""
    docs = documents(spark, sf_dir)
    rng = random.Random(6)
    words = lambda: [f"w{rng.randrange(3)}" for _ in range(rng.randint(0, 12))]
    made = [words() + [f"a{i}" for i in range(10)] + words() for _ in range(300)]
    shard = {}
    for i, w in enumerate(made):
        at = next(j for j, x in enumerate(w) if x == "a0")
        length = 14
        first, last = max(0, at + 10 - length), min(at, len(w) - length)
        if first <= last:
            shard.setdefault(tuple(w[first : last + length]), (i, first, last - first + 1, at - first, w[first : last + length]))
    shard = sorted(shard.values())
    whole = {(d, f + k) for d, f, n in substrings.repeats([(d, f, n, w) for d, f, n, _, w in shard], 14) for k in range(n)}
    parts = {(d, f + k) for part in substrings.split(shard, 14, 2) for d, f, n in substrings.repeats(part, 14) for k in range(n)}
    assert whole == parts and len(whole) > 50
    assert rows(substrings.deduplicate(docs, False)) == sorted(((k, *v) for k, v in brute(docs, substrings).items()), key=repr)


def test_automaton():
    rng = random.Random(2)
    for _ in range(200):
        texts = [[rng.choice("ab") for _ in range(rng.randint(0, 9))] for _ in range(4)]
        automaton = substrings.SuffixAutomaton()
        for d, t in enumerate(texts[:3]):
            automaton.add(t, d, 0)
        for i, (n, first) in enumerate(automaton.statistics(texts[3], 4)):
            best = next(n for n in range(min(4, i + 1), -1, -1) if any(texts[3][i - n + 1 : i + 1] == t[j : j + n] for t in texts[:3] for j in range(len(t) - n + 1)))
            assert n == best
            if n:
                assert first == min((d, j + n - 1) for d, t in enumerate(texts[:3]) for j in range(len(t) - n + 1) if t[j : j + n] == texts[3][i - n + 1 : i + 1])


def test_merge():
    rng = random.Random(3)
    for _ in range(200):
        every = [(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 8))), b"", i, 0) for i in range(rng.randint(0, 50))]
        runs = [[] for _ in range(rng.randint(1, 7))]
        for s in every:
            rng.choice(runs).append(s)
        got = list(suffixes.merge([suffixes.encode_run(sorted(r)) for r in runs]))
        assert [s[0] for _, s in got] == sorted(s[0] for s in every)
        assert all(n == suffixes.common(a[0], b[0]) for (_, a), (n, b) in zip(got, got[1:]))
    assert list(suffixes.merge([])) == []


@pytest.mark.parametrize("few", [0, 100])
def test_resolve(monkeypatch, few):
    """Both ways of comparing the suffixes of one anchor."""
    monkeypatch.setattr(suffixes, "FEW", few)
    rng = random.Random(4)
    for _ in range(200):
        length, anchor = 8, b"##"
        made = []
        for d in range(rng.randint(1, 12)):
            left, right = (bytes(rng.choice(b"ab") for _ in range(rng.randint(3, 6))) for _ in range(2))
            if len(left) + len(right) + 2 >= length:
                made.append((anchor + right[:6], left[:6][::-1], d, 50))
        made.sort()
        shared = [suffixes.common(a[0], b[0]) for a, b in zip([(b"",)] + made, made)]
        got = {(d, f + i) for d, f, n in suffixes.resolve(shared, made, length) for i in range(n)}
        seen, want = set(), set()
        for r, l, d, first in sorted(made, key=lambda s: s[2]):
            data = l[::-1] + r
            for i in range(len(data) - length + 1):
                k = (len(l) - i, data[i : i + length])
                if k in seen:
                    want.add((d, first + i))
                seen.add(k)
        assert got == want


def test_anchors_follow_content():
    units = np.random.default_rng(5).integers(0, 4, 400).astype(np.uint64)
    units[200:260] = units[20:80]
    starts, at, _ = windows.anchors(units, np.array([400]), substrings.SPEC)
    where = dict(zip(starts.tolist(), (at - starts).tolist()))
    assert len(starts) == 381 and all(where[20 + i] == where[200 + i] for i in range(41))
