"""The pipeline against its stages done plainly."""

from hashlib import sha256
from itertools import product

from tokenizers import Tokenizer

import corpus_pipeline
from terrace.llm import mixing, private, quality, simhash
from terrace.llm.bpe import default_tokenizer
from tests.llm.helpers import documents, tricky


def test_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "personal data", "mixing", "encoding"]
    docs = documents(spark, sf_dir)
    kept = {r.doc_id for r in quality.op8_quality(spark, sf_dir).where("kept").collect()}
    one = docs.where(docs.doc_id.isin(kept))
    first = {r.doc_id for r in simhash.near_duplicates(one).collect() if r.doc_id == r.component_id}
    two = one.where(one.doc_id.isin(first))
    model = private.learn(two)
    texts = {r.doc_id: private.redact(r.text, private.find(r.text, model)[1]) for r in two.collect()}
    three = spark.createDataFrame([(r.doc_id, texts[r.doc_id], r.source) for r in two.collect()], "doc_id long, text string, source string")
    library, want = Tokenizer.from_file(default_tokenizer()), []
    for r in mixing.taken(three).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        row = (r.doc_id, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        want += [row] * -(-r.taken // max(1, r["size"]))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(want)


def test_edges(spark, tmp_path):
    """Rows with nulls, empty and very long texts, copies and extra columns; an empty table gives an empty one."""
    words = ["".join(p) for p in product("bdfg", "aeiou", "klmn", "aeiou")]
    one, two = " ".join(words[:180]) + ".", " ".join(reversed(words[200:])) + "."
    good = [(None, one, "en", None), (11, one, "en", "s"), (12, two, None, "t"), (12, two, None, "t"), (None, two + " more", "en", "t")]
    docs = tricky(spark).unionByName(spark.createDataFrame([(*g, 0, "x", "y", 2) for g in good], tricky(spark).schema))
    for name, rows in (("some", docs), ("none", docs.limit(0))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(11, 1, 0), (4, 0, None), (None, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/some")
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    library = Tokenizer.from_file(default_tokenizer())
    decoded = {i: library.decode(library.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for i, t in ((11, one), (12, two))}
    assert {(r.doc_id, r.decoded_sha256) for r in got.collect()} == {(i, sha256(t.encode()).hexdigest()) for i, t in decoded.items()}
    none = corpus_pipeline.run(spark, f"{tmp_path}/none")
    assert none.dtypes == got.dtypes and none.count() == 0
