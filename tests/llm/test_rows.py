"""What holds for every operator: ids beside nulls keep all digits, and extra columns of any name and type come through stages."""

import pytest

from terrace.llm import bpe, fingerprints, language, mixing, periods, private, quality, ranking, simhash, substrings, suffixes, tokens
from terrace.llm.common import scratch

IDS = {None, 2**60 + 1, 2**60 + 3}


def files(docs):
    tokens.write(docs, path := scratch(docs.sparkSession, "t"))
    return tokens.read(docs.sparkSession, path)


OPERATORS = {
    "op1": substrings.deduplicate, "op2": simhash.near_fingerprints, "op2 stage": simhash.near_duplicates, "op3": files, "op4": mixing.taken, "op5": bpe.round_trip,
    "op6": lambda d: private.detect(d, private.learn(d)), "op8": lambda d: quality.judge(d, []), "op9": lambda d: language.predict(d, language.learn(d)), "op10": suffixes.deduplicate,
    "op11": periods.runs, "op12": fingerprints.fingerprints, "op12 next": lambda d: fingerprints.with_next(d, lambda a, b: (a,), "a string"), "op13": lambda d: ranking.rank(d, d.selectExpr("1 AS item_id", "'a d g' AS text")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_beside_nulls_stay_whole(spark, name):
    rows = [(None, "a b c", "en", "s"), (2**60 + 1, "d e f 12", "en", "s"), (2**60 + 3, "g h i", "de", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)
    assert {r.doc_id for r in OPERATORS[name](docs).collect()} == IDS


NAMES = ["_n", "_id", "_size", "_copy", "_key", "_row", "row", "times", "_0", "_1", "_salt", "f", "kept", "rule", "group", "node", "bad"]


@pytest.mark.parametrize("stage", [simhash.stage, mixing.stage, private.stage, quality.stage])
def test_extra_columns_come_through(spark, tmp_path, stage):
    text = " ".join(f"w{i} word{i % 17}" for i in range(60))
    extra = ", ".join(f"'{n}' AS `{n}`" for n in NAMES)
    docs = spark.sql(f"SELECT * FROM VALUES (1L, '{text}', 's'), (2L, '{text} more', 't'), (3L, reverse('{text}'), NULL) AS t(doc_id, text, source)").selectExpr("*", extra.split(", ")[0], *extra.split(", ")[1:], "map('a', 1) AS m", "array(struct(1 AS x)) AS deep")
    spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    rows = out.collect()
    assert rows and all(r[n] == n for r in rows for n in NAMES) and all(r.m == {"a": 1} and r.deep[0].x == 1 for r in rows)
