import itertools
from zlib import crc32

import numpy as np

from terrace.llm import language
from tests.llm.helpers import documents, tricky


def test_held_out_accuracy(spark, sf_dir):
    docs = documents(spark, sf_dir)
    got = language.op9_language(spark, sf_dir).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert all(h == (crc32(str(i).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out))
    held = got[got.held_out]
    assert len(held) > 20 and (held.lang_pred == held.lang).mean() > 0.97 and got.score.between(0, 1).all()


def one_score(m, word):
    """A word's scores, one trigram and one language after the other."""
    candidates = m.scripts.get(language.script(word))
    if candidates is None:
        return [0.0] * len(m.languages)
    whole, out = language.padded(word), []
    for i in range(len(m.languages)):
        spelling = sum(m.chain[m.trigrams.get(whole[k : k + 3], -1)][i] for k in range(len(whole) - 2))
        if word in m.words:
            spelling = np.log(language.WORD_WEIGHT * np.exp(m.frequency[m.words[word]][i]) + (1 - language.WORD_WEIGHT) * np.exp(spelling))
        out.append(spelling if candidates[i] else -np.inf)
    return [max(x - max(out), -language.CLIP) if c else -language.EXCLUDED for x, c in zip(out, candidates)]


def test_query_by_brute_force(spark, sf_dir, monkeypatch):
    """The whole query against word-by-word scores and every step of the path; so too where words are forgotten and texts are cut."""
    docs = documents(spark, sf_dir)
    model = language.learn(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.op9_language(spark, sf_dir).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    known: dict = {}
    for r in rows[::4]:
        words = language.pieces(r.text or "")
        if not words:
            assert got[r.doc_id] == ("und", 0.0)
            continue
        known.update({w: one_score(model, w) for w in words if w not in known})
        labels = language._viterbi(np.array([known[w] for w in words], np.float32), language.SWITCH)
        share = np.bincount(labels, [language.letters(w) for w in words], len(model.languages))
        best = int(share.argmax())
        assert got[r.doc_id][0] == model.languages[best] and abs(got[r.doc_id][1] - share[best] / share.sum()) < 0.02
    monkeypatch.setattr(language, "CACHE_WORDS", 64)
    model.rows.clear()
    model.memory = None
    for r in rows[:40]:
        lang, score, _ = language.judged(model, r.text)
        assert (lang, score) == got[r.doc_id]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for _ in range(200):
        s = np.round(-rng.random((rng.integers(1, 6), 3)) * 5, 2)
        cost = lambda path: sum(s[i, x] for i, x in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))  # noqa: B023, E731
        best = max(map(cost, itertools.product(range(3), repeat=len(s))))
        assert abs(cost(language.viterbi(s, 2.0).tolist()) - best) < 1e-9


def test_mixed_text_has_spans(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = language.learn(docs)
    by = {r.lang: r.text for r in docs.where("length(text) > 1500").collect()}
    a, b = sorted(by)[:2]
    mixed = spark.createDataFrame([(1, by[a][:800] + "\n" + by[b][:800])], "doc_id long, text string")
    found = language.spans(mixed, model).orderBy("first_word").collect()
    assert [r.lang for r in found] == [a, b] and found[0].last_word + 1 == found[1].first_word


def test_scripts():
    assert [language.script(w) for w in ("été", "привет", "αβγ", "漢字", "かな", "한국", "שלום", "ไทย")] == ["latin", "cyrillic", "greek", "han", "kana", "hangul", "hebrew", "thai"]


def test_edges(spark):
    docs = tricky(spark)
    model = language.learn(docs)
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[1].score == 0
    assert got[5].lang_pred == "en" and got[None].held_out is False
    none = language.learn(docs.limit(0))
    assert none.languages == [] and {r.lang_pred for r in language.predict(docs, none).collect()} == {"und"}
    assert language.predict(docs.limit(0), model).count() == 0


def test_long_runs_of_another_script(spark):
    """Text without blanks counts whole, by its script, and wherever in a run it stands."""
    han = "".join(chr(0x4E00 + i * 37 % 900) for i in range(3000))
    rows = [(4 * i, "the cat sat on the mat and saw a dog", "en") for i in range(20)] + [(4 * i + 1, han[i * 50 : i * 50 + 900], "zh") for i in range(20)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = {1: f"the cat {han} saw a dog", 2: f"thecat{han}", 3: "the cat sat on 漢 the mat and saw a dog"}
    got = {r.doc_id: r for r in language.predict(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["zh", "zh", "en"] and got[1].n_spans == 3 and got[1].score == 3000 / 3013 and got[2].score == 3000 / 3006


def test_pieces_hold_all_letters_and_trigrams():
    for word in ("a" * 39 + "bcdefg" * 30, "漢字" * 41, "x" * 40, "ab", "漢" * 81):
        parts = language.pieces(word)
        grams = lambda p: [p[i : i + 3] for i in range(len(p) - 2)]
        assert sum(map(language.letters, parts)) == len(word) and [g for p in parts for g in grams(language.padded(p))] == grams(f"^{word}$")
    assert language.pieces("Abcかな漢字x") == ["abc", "かな", "漢字", "x"]
