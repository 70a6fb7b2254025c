"""Rows with nulls, empty and very long texts, ties, repeated rows and extra columns."""

import pandas as pd

LONG = "lorem ipsum dolor " * 4000
TRICKY = [
    (None, "a row without an id", "en", "s"), (1, None, "en", None), (2, "", None, "s"), (3, " \n\t ", "de", "s"), (4, "one", "en", "s"), (5, LONG, "en", "t"),
    (6, "Same words here, 3 times.", "en", "s"), (7, "Same words here, 3 times.", "en", "s"), (7, "Same words here, 3 times.", "en", "s"),
    (8, "Ünïcödé Σας ΟΔΟΣ İstanbul 漢字 <|endoftext|> é", "fr", "s"), (9, "x" * 5000, None, None),
]


def tricky(spark):
    rows = [(i, t, lang, source, len(t or ""), "clash", "clash", 1) for i, t, lang, source in TRICKY]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, key string, _doc int")


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ordered(docs) -> pd.DataFrame:
    return docs.select("doc_id", "text").toPandas().sort_values("doc_id")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)
