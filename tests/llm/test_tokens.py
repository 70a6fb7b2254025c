"""Operators 3 and 5 against the library, and round trips."""

import tracemalloc
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from tokenizers import Tokenizer

from terrace.llm import bpe, tokens
from terrace.llm.common import scratch
from tests.llm.helpers import TRICKY, documents, ordered, rows, tricky


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_tokenizer())


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_bpe_query(spark, sf_dir, library):
    want = set()
    for doc_id, text in ordered(documents(spark, sf_dir)).itertuples(index=False):
        x = ids(library, text)
        want.add((doc_id, len(x), sha256(" ".join(map(str, x)).encode()).hexdigest(), sha256(library.decode(x, skip_special_tokens=False).encode()).hexdigest()))
    assert set(map(tuple, bpe.op5_bpe(spark, sf_dir).collect())) == want


def test_odd_texts(library):
    e = bpe.encoder(bpe.default_tokenizer())
    odd = [t or "" for _, t, _, _ in TRICKY] + ["it's we'LL '’“”…", "a\x1cb\x85c\xa0d　e", "ab" * 3000 + "!!'s" * 50, "<|startoftext|><|endoftext|> x", "①½² १२", "ǅ ŉ ﬁ"]
    odd += [f"a{chr(c)}b {chr(c)}{chr(c)}" for c in [*range(1, 0x180), *range(0x2010, 0x2028), 0x20AC]]
    for text in odd:
        x = ids(library, text)
        assert e.encode(text) == x, text[:30]
        assert e.decode(x) == library.decode(x, skip_special_tokens=False)
        assert tokens.library(bpe.default_tokenizer()).encode([text])[0].tolist() == x, text[:30]


def test_forced_cuts_are_where_no_token_has_the_pair():
    e = bpe.encoder(bpe.default_tokenizer())
    word = [e.symbols[b] for b in b"~q\x00zj@@x"]
    parts = e.fragments(word)
    assert sum(parts, []) == word and len(parts) > 1
    assert not any((a[-1], b[0]) in e._pairs(t) for a, b in zip(parts, parts[1:]) for t in e.vocab)


def test_encode_and_decode(spark, library):
    docs = tricky(spark)
    back = bpe.decode(bpe.encode(docs))
    want = sorted(((i, library.decode(ids(library, t), skip_special_tokens=False)) for i, t, _, _ in TRICKY), key=repr)
    assert rows(back) == want
    assert bpe.round_trip(docs).count() == len(TRICKY) and bpe.round_trip(docs.limit(0)).count() == 0


def test_files(spark, sf_dir, library):
    want, start = [], 0
    for doc_id, text in ordered(documents(spark, sf_dir)).itertuples(index=False):
        x = np.array(ids(library, text) + [2], "<u4")
        want.append((doc_id, start, len(x), crc32(x.tobytes())))
        start += len(x)
    assert rows(tokens.op3_tokens(spark, sf_dir)) == sorted(want, key=repr)


def test_files_edges(spark, library):
    docs, path = tricky(spark), scratch(spark, "t")
    tokens.write(docs, path)
    got = tokens.read(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9]
    assert all(list(r.ids) == ids(library, t) + [2] for r, (_, t, _, _) in zip(got, TRICKY))
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:]))
    tokens.write(docs.limit(0), empty := scratch(spark, "t"))
    assert tokens.read(spark, empty).count() == 0


def test_packing():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        r = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data, fours, widths = tokens.pack(r, np.array([n]))
        assert len(control) == fours[0] == -(-n // 4) and len(data) == widths[0] and tokens.unpack(control.tobytes(), data.tobytes(), np.array([n])).tolist() == r.tolist()
    counts = np.array([3, 0, 1, 6])
    r = np.array([1, 300, 70000, 5, *range(250, 256)], np.uint32)
    control, data, fours, widths = tokens.pack(r, counts)
    assert fours.tolist() == [1, 0, 1, 2] and widths.tolist() == [6, 0, 1, 6]
    assert tokens.unpack(control.tobytes(), data.tobytes(), counts).tolist() == r.tolist()
    alone = [tokens.pack(x, np.array([len(x)])) for x in np.split(r, np.cumsum(counts)[:-1])]
    assert control.tobytes() == b"".join(x[0].tobytes() for x in alone) and data.tobytes() == b"".join(x[1].tobytes() for x in alone)
    assert len(tokens.pack(np.arange(256, dtype=np.uint32), np.array([256]))[1]) == 256


def test_memory_of_words_turns_over(library, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 10)
    e = tokens.LibraryIds(bpe.default_tokenizer())
    texts = [f"alpha{i} beta{i % 3} gamma {chr(97 + i)}{i}!!" for i in range(40)]
    for i in range(0, 40, 4):
        found, counts = e.encode(texts[i : i + 4], 2)
        want = [ids(library, t) + [2] for t in texts[i : i + 4]]
        assert found.tolist() == sum(want, []) and counts.tolist() == [*map(len, want)]
        assert len(e.before) <= 40


def test_ids_beside_nulls_stay_whole(spark):
    docs = spark.createDataFrame([(None, "a b"), (2**60 + 1, "c"), (2**60 + 3, "d e f")], "doc_id long, text string").coalesce(1)
    tokens.write(docs, path := scratch(spark, "t"))
    assert [r.doc_id for r in tokens.read(spark, path).orderBy("start").collect()] == [None, 2**60 + 1, 2**60 + 3]
    assert {r.doc_id for r in bpe.round_trip(docs).collect()} == {r.doc_id for r in bpe.decode(bpe.encode(docs)).collect()} == {None, 2**60 + 1, 2**60 + 3}


def test_a_common_id_has_several_parts(spark):
    """Half of all rows share an id and a fifth have none: no part holds them all, and the files are in the order of ids."""
    rows_ = [(None if i % 5 == 0 else 7 if i % 2 else i, f"text {i}") for i in range(4000)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    tokens.write(docs, path := scratch(spark, "hot"))
    spread = {}
    for b in spark.read.parquet(f"{path}/blocks").select("part", "doc_ids").collect():
        for i in b.doc_ids:
            spread.setdefault(i, set()).add(b.part)
    assert len(spread[7]) >= 2 and max(len(p) for i, p in spread.items() if i not in (7, None)) == 1
    back = tokens.read(spark, path, with_ids=False).orderBy("start").collect()
    order = [-1 if r.doc_id is None else r.doc_id for r in back]
    assert order == sorted(order) and len(back) == 4000 and all(a.start + a.n_tokens == b.start for a, b in zip(back, back[1:]))


def test_pieces_are_no_python_objects(library):
    """Blanks at either end, texts for the library among others, and a common text whose pieces aren't held as strings of their own."""
    e = tokens.LibraryIds(bpe.default_tokenizer())
    texts = ["", " ", "\t a\xa0b,\x85c. \n", "日本 x", "it's we'll! x?!", "İx. ŉ; a\x1cb", "a" * 50 + ".", ".", "<|endoftext|>", "é.É,e."]
    found, counts = e.encode(texts, 2)
    want = [ids(library, t) + [2] for t in texts]
    assert found.tolist() == sum(want, []) and counts.tolist() == [*map(len, want)]
    common = "one two three four, five. " * 40_000
    e.encode([common[:1000]], 2)
    tracemalloc.start()
    found, counts = e.encode([common], 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts[0] == len(ids(library, common)) + 1 and peak / 200_000 < 70
