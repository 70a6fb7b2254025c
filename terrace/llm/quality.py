"""Quality rules: a learned decision list over counts of a text.

Sequential covering grows conjunctions of thresholds that single out rejected
documents, prunes each on rows it was not grown on, and keeps it if it is
precise there.  Each round does so for every way of keeping a part of the rows
back, and takes the best rule.  The list becomes an ordered chain of ``when``
expressions, so applying it is a projection.  Rules are fitted on at most
``SAMPLE_ROWS`` labelled rows, those with the smallest hash of their id, less
those that the base rejects anyway; everything else covers all rows and whole
texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.common import ROWS, columns, only, table

#: Labelled rows that the rules are fitted on, at most.
SAMPLE_ROWS = 20_000
#: A rule is kept if so large a part of what it covers is rejected rightly, on rows it was not grown on.
PRECISION = 0.9
#: The least number of such rows that a rule must cover, and the most rules and conditions.
COVER, RULES, CONDITIONS = 3, 12, 3
#: Parts of the labelled rows, each of which prunes the rules grown on the others.
PARTS = 3
#: Candidate thresholds of a feature.
CUTS = 24

SYMBOLS = "#*$%&|<>"
ALPHABET = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
#: What a line of prose ends with.
ENDS = frozenset(".!?:;\"'”’»…。！？")
SPACE = " \t\n\v\f\r"
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_digits long, n_exclaim long, n_distinct long, n_top long, n_bare long, n_ends long"
#: What rules compare, as SQL over the struct ``f`` of counts.
FEATURES = {
    "symbols_per_word": "f.n_symbols / greatest(f.n_words, 1)",
    "chars_per_word": "f.word_chars / greatest(f.n_words, 1)",
    "dup_lines": "f.n_dup_lines / greatest(f.n_lines, 1)",
    "repeat_words": "f.n_repeat_words / greatest(f.n_words, 1)",
    "upper": "f.n_upper / greatest(f.word_chars, 1)",
    "digits": "f.n_digits / greatest(f.word_chars, 1)",
    "exclaim": "f.n_exclaim / greatest(f.n_words, 1)",
    "distinct": "f.n_distinct / greatest(f.n_words, 1)",
    "top": "f.n_top / greatest(f.n_words, 1)",
    "bare": "f.n_bare / greatest(f.n_words, 1)",
    "ends": "f.n_ends / greatest(f.n_lines, 1)",
    "words_per_line": "f.n_words / greatest(f.n_lines, 1)",
}


BASE_FAILED = "f.n_words < 50 or 100 * f.n_repeat_words > 50 * f.n_words"


def repeated(ids: list[int], n: int = 3) -> int:
    """Positions covered by an n-gram that stands at two places or more."""
    if len(ids) < n:
        return 0
    a = np.array(ids, np.int64)
    code = a[: len(a) - n + 1]
    for k in range(1, n):
        code = np.unique(code, return_inverse=True)[1] * (int(a.max()) + 1) + a[k : len(a) - n + 1 + k]
    _, where, count = np.unique(code, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[where] > 1)
    covered = np.zeros(len(a), bool)
    for k in range(n):
        covered[starts + k] = True
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of ``COUNTS``; all 0 for a null text."""
    if not text:
        return (0,) * 13
    words = text.encode().split()
    numbers: dict[bytes, int] = {}
    ids = [numbers.setdefault(w, len(numbers)) for w in words]
    each = np.bincount(np.array(ids, np.int64), minlength=1)
    bare = np.array([w.isascii() and not w.isalnum() and not any(c in ALPHABET for c in w) for w in numbers] or [False])
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    lower = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
    upper = int((points != lower).sum()) if len(points) == len(lower) else sum(map(str.isupper, text))
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated(ids),
        len(lines),
        upper,
        int(((points >= 48) & (points <= 57)).sum()),
        text.count("!"),
        len(numbers),
        int(each.max()),
        int(each[bare].sum()),
        sum(x.rstrip(SPACE)[-1] in ENDS for x in lines),
    )


def counts(text: str) -> Column:
    """The struct of counts of the column ``text``."""

    def run(texts: pa.Array) -> pa.Array:
        rows = [measure(t) for i in range(0, len(texts), ROWS) for t in texts.slice(i, ROWS).to_pylist()]
        made = [*zip(*rows)] or [[]] * len(columns(COUNTS))
        return pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in made], names=[n for n, _ in columns(COUNTS)])

    return F.arrow_udf(run, COUNTS)(text)


@dataclass(frozen=True)
class Rule:
    """Reject where every ``(feature, above?, threshold)`` holds."""

    conditions: tuple[tuple[str, bool, float], ...]

    def covers(self, x: pd.DataFrame) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, above, cut in self.conditions:
            out &= (x[name] > cut).values if above else (x[name] <= cut).values
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, cut in self.conditions:
            out = out & ((F.expr(FEATURES[name]) > F.lit(cut)) if above else (F.expr(FEATURES[name]) <= F.lit(cut)))
        return out


def _grow(x: pd.DataFrame, bad: np.ndarray, cuts: dict[str, np.ndarray]) -> Rule | None:
    """Conditions added while they raise the information gained about rejected rows."""
    inside, conditions = np.ones(len(x), bool), []
    while len(conditions) < CONDITIONS:
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p or not n:
            break
        best, gain = None, 0.0
        for name, values in cuts.items():
            v = x[name].values
            for cut in values:
                for above in (True, False):
                    now = inside & ((v > cut) if above else (v <= cut))
                    q, m = int((now & bad).sum()), int((now & ~bad).sum())
                    if q and (g := q * (np.log2(q / (q + m)) - np.log2(p / (p + n)))) > gain + 1e-9:
                        best, gain = (name, above, float(cut)), g
        if best is None:
            break
        conditions.append(best)
        inside &= Rule((best,)).covers(x)
    return Rule(tuple(conditions)) if conditions else None


def _widen(rule: Rule, grow: pd.DataFrame) -> Rule:
    """Each threshold moved half the way to the bulk of the rejected rows, so that accepted ones near it stay."""
    inside = grow[rule.covers(grow) & grow["bad"].values]
    moved = [(name, above, (cut + float(inside[name].quantile(0.05 if above else 0.95))) / 2) for name, above, cut in rule.conditions]
    return Rule(tuple(moved))


def _pruned(grow: pd.DataFrame, prune: pd.DataFrame) -> tuple[tuple[float, int], Rule] | None:
    """A rule grown on some rows and pruned on others, with its worth there: precision, and rows rejected rightly."""
    if not grow["bad"].any() or not prune["bad"].any():
        return None
    cuts = {name: np.unique(np.quantile(grow.loc[grow["bad"], name], np.linspace(0, 1, CUTS))) for name in FEATURES}
    cuts = {k: np.unique(np.concatenate([v, np.quantile(grow.loc[~grow["bad"], k], [0, 0.01, 0.99, 1])])) if (~grow["bad"]).any() else v for k, v in cuts.items()}
    rule = _grow(grow, grow["bad"].values, cuts)
    if rule is None:
        return None

    def worth(r: Rule) -> tuple[float, int]:
        c = r.covers(prune)
        p, n = int((c & prune["bad"]).sum()), int((c & ~prune["bad"]).sum())
        return (p / (p + n), p) if p >= COVER else (0.0, p)

    while len(rule.conditions) > 1 and worth(shorter := Rule(rule.conditions[:-1])) >= worth(rule):
        rule = shorter
    return worth(rule), rule


def fit(sample: pd.DataFrame) -> list[Rule]:
    """A decision list from rows with the columns of ``FEATURES``, ``bad`` and ``part`` (0 to ``PARTS`` - 1)."""
    rules: list[Rule] = []
    left = sample.reset_index(drop=True)
    while len(rules) < RULES and len(left):
        found = [r for k in range(PARTS) if (r := _pruned(left[left["part"] != k], left[left["part"] == k]))]
        found = [r for r in found if r[0][0] >= PRECISION]
        if not found:
            break
        rule = _widen(max(found, key=lambda r: r[0])[1], left)
        covered = rule.covers(left)
        if not covered.any() or left.loc[covered, "bad"].mean() < PRECISION:
            break
        rules.append(rule)
        left = left[~covered].reset_index(drop=True)
    return rules


def learn(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules from ``labels`` (``doc_id, quality``); of several labels of a document the smallest counts, null ones don't."""
    of = only(labels, "doc_id", "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = of.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS).withColumnRenamed("doc_id", "_id")
    rows = only(docs, "doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).withColumn("f", counts("text"))
    sample = rows.select((F.col("quality") == 0).alias("bad"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(PARTS)).alias("part"), "doc_id", F.expr(BASE_FAILED).alias("failed"), *[F.expr(e).alias(k) for k, e in FEATURES.items()])
    # Rows of repeated ids may be more than the labels; the first ones by hash and features are the same at every run.
    first = sample.orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(SAMPLE_ROWS)
    found = first.toPandas()
    return fit(found[~found["failed"]].sort_values(["doc_id", *FEATURES]).reset_index(drop=True))


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that rejects, from 1; 0 if none does.  Needs the struct ``f`` of ``counts``."""
    if not rules:
        return F.lit(0)
    chain = F.when(rules[0].column(), 1)
    for i, rule in enumerate(rules[1:], 2):
        chain = chain.when(rule.column(), i)
    return chain.otherwise(0)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` with ``f``, ``base_failed``, ``rule`` and ``kept``.

    A null or empty text has no words and fails the base; a very long one is measured
    whole; repeated rows are judged alike; other columns come through, but not those
    of the names made here; an empty table gives an empty one.
    """
    return docs.withColumn("f", counts("text")).withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    judged = judge(docs, learn(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", *[f"f.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept", "rule")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep.

    Null, empty and short texts go by the base; columns of any name and type come
    through; an empty table gives an empty one.
    """
    rules = learn(docs, table(spark, sf_dir, "labels"))
    columns = docs.columns
    plain = docs.toDF(*[f"_{i}" for i in range(len(columns))])
    judged = judge(plain.withColumn("text", F.col(f"_{columns.index('text')}")), rules).where("kept")
    return judged.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(columns)])
