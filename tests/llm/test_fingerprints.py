import hashlib

import numpy as np

from terrace.llm import fingerprints as fp
from tests.llm.helpers import LONG, TRICKY, documents, ordered, tricky


def one(text):
    return fp.written(*fp.vectors([text]))[0]


def test_a_multiset_of_paragraphs():
    a, b, c = "one two three", "four\tfive", "six seven eight nine"
    assert one(f"{a}\n{b}\n{c}") == one(f"{c}\n{a}\n{b}") != one(f"{a}\n{b}")
    assert one(f"{a}\n{a}\n{b}") != one(f"{a}\n{b}") and one(f"{a}\n{b} ") != one(f"{a}\n{b}")
    assert fp.changed(one(f"{a}\n{b}"), inserted=[c, a], deleted=[b]) == one(f"{c}\n{a}\n{a}")
    assert fp.changed(one(a), deleted=[a], inserted=[a]) == one(a) and fp.changed(one(a)) == one(a)
    wide, near = fp.read([one(f"{a}\n{b}")])
    assert fp.written(wide, near) == [one(f"{a}\n{b}")] and wide.shape == (1, fp.WIDE) and near.shape == (1, fp.NEAR)


def test_lanes_wrap():
    many = "\n".join(["same pair"] * 70_000)
    assert fp.changed(one(many), deleted=["same pair"] * 69_999) == one("same pair")


def test_likeness_follows_shared_pairs():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in rng.integers(0, 5000, 3000)]
    base = fp.vectors([" ".join(words)])[1]
    for share in (0.0, 0.25, 0.5, 0.75, 1.0):
        n = int(share * 3000)
        other = fp.vectors([" ".join(words[:n] + [f"v{i}" for i in range(3000 - n)])])[1]
        assert abs(fp.likeness(base, other)[0] - share) < 0.1
    empty = fp.vectors(["", "x"])[1]
    assert fp.likeness(empty[:1], empty[:1])[0] == 1 and fp.likeness(empty[:1], empty[1:])[0] == 0


def edited(text, following):
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def test_query_against_brute_force(spark, sf_dir):
    docs = ordered(documents(spark, sf_dir))
    texts = [t or "" for t in docs.text]
    got = fp.op12_fingerprints(spark, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert got.doc_id.tolist() == docs.doc_id.tolist()
    near = 0
    for i, (text, following) in enumerate(zip(texts, texts[1:] + texts[:1])):
        new = edited(text, following)
        assert got.n_chars[i] == len(text) and got.edited_sha256[i] == hashlib.sha256(new.encode()).hexdigest()
        assert got.fingerprint[i] == one(text) and got.edited_fingerprint[i] == one(new)
        (_, a), (_, b), (_, c) = fp.vectors([text]), fp.vectors([new]), fp.vectors([following])
        assert (got.near_edited[i], got.near_next[i]) == (fp.likeness(a, b)[0], fp.likeness(a, c)[0])
        near += got.near_edited[i] > got.near_next[i]
    assert near > 0.95 * len(texts) and got.near_edited.median() > 0.6 and got.near_next.median() < 0.2
    assert len(set(zip(got.fingerprint, texts))) == len(set(texts))


def test_next_documents(spark):
    """By id, null first, equal rows as one, over many ranges and batches; the last is followed by the first."""
    df = tricky(spark)
    pairs = lambda texts, following: ([f"{len(t)}:{t[:9]}" for t in texts], [f"{len(t)}:{t[:9]}" for t in following])
    got = sorted(map(tuple, fp.with_next(df, pairs, "a string, b string").collect()), key=repr)
    rows = sorted({(i is not None, i or 0, t or "") for i, t, *_ in TRICKY}, key=lambda r: r[:2])
    # Ids of TRICKY are unique but for one repeated row, so that no hash orders them.
    head = [f"{len(t)}:{t[:9]}" for _, _, t in rows]
    want = [(i if there else None, head[j], head[(j + 1) % len(head)]) for j, (there, i, _) in enumerate(rows)]
    want.append(next(w for w in want if w[0] == 7))
    assert got == sorted(want, key=repr) and len(got) == len(TRICKY)
    assert any(len(LONG) == int(a.split(":")[0]) for _, a, _ in got)
    empty = fp.with_next(df.limit(0), pairs, "a string, b string")
    assert empty.count() == 0 and empty.columns == ["doc_id", "a", "b"]
    assert [tuple(r) for r in fp.with_next(df.where("doc_id = 4"), pairs, "a string, b string").collect()] == [(4, "3:one", "3:one")]


def test_a_hot_row(spark):
    """A third of all rows are one and the same; one row a batch of them is sent."""
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 7L, id) AS doc_id", "if(id % 3 = 0, 'hot', concat('t', id)) AS text")
    keep = lambda texts, following: (list(texts), list(following))
    got = fp.with_next(df, keep, "a string, b string")
    assert got.count() == 3000 and got.where("a = 'hot'").count() == 1000
    # Id 7 has another text too; which of both is first goes by a hash.
    assert len({r.b for r in got.where("a = 'hot'").collect()}) == 1 and got.where("b = 'hot'").count() == 1


def test_general_fingerprints(spark):
    got = {(r.doc_id, r.fingerprint) for r in fp.fingerprints(tricky(spark)).collect()}
    assert got == {(i, one(t or "")) for i, t, *_ in TRICKY}
