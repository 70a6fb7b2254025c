import re
from collections import Counter

import numpy as np
import pandas as pd

from terrace.llm import quality
from tests.llm.helpers import TRICKY, documents, tricky


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


def test_query(spark, sf_dir):
    docs = documents(spark, sf_dir).toPandas()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    got = quality.op8_quality(spark, sf_dir).toPandas().set_index("doc_id")
    for doc_id, text in zip(docs.doc_id, docs.text):
        r, want = got.loc[doc_id], brute(text)
        assert tuple(r[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]]) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.kept and r.base_failed)
    judged = got.join(labels.set_index("doc_id"), how="inner")
    good = judged[(judged.quality == 1) & ~judged.base_failed]
    assert good.kept.mean() > 0.98


def test_rules_on_rows_they_have_not_seen(spark):
    """Learned from the labels of half the documents and judged on the other half: most bad ones go, and few good ones."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.learn(docs, labels.where("doc_id % 2 = 0"))
    judged = quality.judge(docs, rules).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").select("quality", "kept").toPandas()
    bad, gone = judged.quality == 0, ~judged.kept
    assert bad.sum() > 8 and (bad & gone).sum() >= 0.9 * gone.sum() and (bad & gone).sum() >= 0.7 * bad.sum()


def test_counts_of_odd_texts():
    for text in [t for _, t, _, _ in TRICKY] + ["a b c a b c", "a a a a", "x\r\ny\n\nx\r\n", "a b\x0bc", "*|*"]:
        assert quality.measure(text)[:5] == brute(text), text


def test_learned_list():
    rng = np.random.default_rng(0)
    n = 3000
    x = pd.DataFrame({k: rng.random(n) for k in quality.FEATURES})
    x["bad"] = ((x["upper"] > 0.8) & (x["digits"] > 0.5)) | (x["exclaim"] > 0.9)
    x["part"], x["doc_id"] = rng.integers(0, 3, n), range(n)
    rules = quality.fit(x)
    assert rules and len(rules) <= quality.RULES
    said = np.logical_or.reduce([r.covers(x) for r in rules])
    assert (x["bad"][said]).mean() > 0.95 and said[x["bad"]].mean() > 0.6
    assert quality.fit(x[~x["bad"]]) == [] and quality.fit(x.iloc[:0]) == []


def test_edges(spark, tmp_path):
    docs = tricky(spark)
    labels = spark.createDataFrame([(5, 0), (5, 1), (None, 0), (6, None)], "doc_id long, quality int")
    rules = quality.learn(docs, labels)
    assert quality.judge(docs, rules).count() == docs.count() and quality.judge(docs.limit(0), rules).count() == 0
    assert quality.learn(docs.limit(0), labels.limit(0)) == []
    assert quality.judge(docs, [quality.Rule((("upper", True, 0.5),))]).where("kept").count() == 0
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert quality.stage(spark, docs, str(tmp_path)).columns == docs.columns


def made_documents(n=900):
    """Texts of 60 words of their own: shouting with numbers is bad, either alone is good, and so many exclamation marks are bad."""
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9)))
    rows, bad = [], []
    for i in range(n):
        kind = i % 5
        words = [word() for _ in range(60)]
        if kind in (0, 1):
            words = [w.upper() for w in words]
        if kind in (0, 2):
            words = [w if j % 2 else f"{w}{rng.integers(1000, 99999)}" for j, w in enumerate(words)]
        if kind == 3 and i % 2:
            words = [f"{w}!!!" for w in words]
        rows.append((i, " ".join(words)))
        bad.append(kind == 0 or (kind == 3 and i % 2 == 1))
    return rows, np.array(bad)


def test_an_ordered_list_with_a_conjunction(spark):
    """Labels that no single condition tells: several rules, one with two conditions; judged on documents that they were not learned from."""
    rows, bad = made_documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(not bad[i])) for i, _ in rows if i % 3], "doc_id long, quality int")
    rules = quality.learn(docs, labels)
    assert len(rules) >= 2 and max(len(r.conditions) for r in rules) >= 2
    judged = quality.judge(docs, rules).select("doc_id", "kept", "rule", "base_failed").toPandas().sort_values("doc_id")
    unseen = (judged.doc_id % 3 == 0).to_numpy()
    assert not judged.base_failed.any() and (judged.kept.to_numpy() == ~bad)[unseen].mean() > 0.97
    # The number is that of the first rule that covers a document, by the features as numbers.
    made = docs.withColumn("f", quality.counts("text")).selectExpr("doc_id", *[f"{e} AS {k}" for k, e in quality.FEATURES.items()]).toPandas().sort_values("doc_id")
    want = np.zeros(len(made), int)
    for n, rule in reversed(list(enumerate(rules, 1))):
        covered = np.ones(len(made), bool)
        for name, above, cut in rule.conditions:
            covered &= (made[name] > cut).to_numpy() if above else (made[name] <= cut).to_numpy()
        want[covered] = n
    assert judged.rule.tolist() == want.tolist() and (judged.kept == (judged.rule == 0)).all() and len(set(want)) >= 3


def test_the_query_keeps_what_its_rules_keep(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rules = quality.learn(docs, labels)
    got = {r.doc_id: r for r in quality.op8_quality(spark, sf_dir).collect()}
    names = [c.split()[0] for c in quality.COUNTS.split(", ")]
    for doc_id, text in docs.select("doc_id", "text").collect():
        f = dict(zip(names, quality.measure(text or "")))
        values = {k: eval(e.replace("f.", "").replace("greatest", "max"), {"max": max}, f) for k, e in quality.FEATURES.items()}
        hit = next((n for n, r in enumerate(rules, 1) if all((values[k] > cut) if above else (values[k] <= cut) for k, above, cut in r.conditions)), 0)
        failed = f["n_words"] < 50 or 100 * f["n_repeat_words"] > 50 * f["n_words"]
        assert (got[doc_id].rule, got[doc_id].kept) == (hit, not failed and not hit)
