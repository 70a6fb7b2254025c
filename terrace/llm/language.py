"""Language identification of mixed-language text.

A word's script narrows the languages it may be in.  Each candidate scores the
word by its share in the language's words and by a character-trigram chain, and
a Viterbi pass over the words with a penalty for switching labels spans.  A
document's language is the one whose spans hold most letters.

The model is learned from at most ``ROWS_PER_LANGUAGE`` training rows of each
language, those with the smallest hash of their id; prediction covers every word
of every text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrace.llm.common import materialise, only, per_text, table

#: Training rows of a language, at most.
ROWS_PER_LANGUAGE = 800
#: Words and trigrams of the model, at most, by frequency.
WORDS, TRIGRAMS = 40_000, 120_000
#: The cost of changing the language between two words, and the most that one word can speak for or against a language.
SWITCH, CLIP = 9.0, 5.0
#: What a word costs in a language that its script excludes: more than leaving the language and coming back.
EXCLUDED = 2 * SWITCH + CLIP
#: Letters of a word, at most; longer runs of letters are cut, and ``CUT`` and two letters of context stand at the cuts.
PIECE, CUT = 40, "\0"
#: The weight of whole-word frequency against spelling.
WORD_WEIGHT = 0.7
#: Words whose scores an executor process remembers.
CACHE_WORDS = 300_000
LETTERS = re.compile(r"[^\W\d_]+")

#: First code points of script ranges, in order; what lies before the first is Latin.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0xFF21, "latin"), (0xFF5B, "kana"), (0x10000, "other"), (0x20000, "han"),
]
_STARTS = [s for s, _ in SCRIPTS]


def _classes() -> tuple[re.Pattern, re.Pattern]:
    """Runs of one script, and what is not Latin."""
    ranges: dict[str, str] = {}
    for (a, name), b in zip(SCRIPTS, [*_STARTS[1:], 0x110000]):
        ranges[name] = ranges.get(name, "") + f"\\U{a:08x}-\\U{b - 1:08x}"
    return re.compile("|".join(f"[{r}]+" for r in ranges.values())), re.compile(f"[^{ranges['latin']}]")


_RUNS, _NOT_LATIN = _classes()


def script(word: str) -> str:
    """The script of a word's first letter."""
    return SCRIPTS[bisect_right(_STARTS, ord(word.lstrip(CUT)[0])) - 1][1]


def pieces(text: str) -> list[str]:
    """The words of a text in lower case: runs of letters of one script, long ones in parts that together have all of their letters and trigrams."""
    words = LETTERS.findall(text.lower())
    if max(map(len, words), default=0) <= PIECE and not _NOT_LATIN.search("".join(words)):
        return words
    out = []
    for w in words:
        for run in [w] if w.isascii() else _RUNS.findall(w):
            if len(run) <= PIECE:
                out.append(run)
                continue
            for a in range(0, len(run), PIECE):
                out.append((CUT + run[a - 2 : a] if a else "") + run[a : a + PIECE] + (CUT if a + PIECE < len(run) else ""))
    return out


def letters(piece: str) -> int:
    """The letters of a piece that are its own."""
    return len(piece) - 3 * piece.startswith(CUT) - piece.endswith(CUT)


def padded(piece: str) -> str:
    """A piece with the marks of a word's ends, where it has them."""
    return ("" if piece[0] == CUT else "^") + piece.strip(CUT) + ("" if piece[-1] == CUT else "$")


@dataclass
class Model:
    """Log-probabilities of words and trigrams per language, and each script's languages."""

    languages: list[str]
    default: str
    scripts: dict[str, np.ndarray]
    words: dict[str, int]
    frequency: np.ndarray
    trigrams: dict[str, int]
    chain: np.ndarray
    rows: dict[str, int] = field(default_factory=dict)
    memory: tuple[np.ndarray, ...] | None = None

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word one number a language, its letters, and whether any language has its script.

        The best candidate has 0, others at least ``-CLIP``, and those without the
        script ``-EXCLUDED``; where no language has it all have 0.
        """
        get, at, starts = self.trigrams.get, [], []
        for w in words:
            whole = padded(w)
            starts.append(len(at))
            at += [get(whole[i : i + 3], -1) for i in range(len(whole) - 2)]
        total = np.add.reduceat(self.chain[at], starts, axis=0)  # the last row of the chain is for unseen trigrams
        number = np.array([self.words.get(w, -1) for w in words])
        known = number >= 0
        total[known] = np.logaddexp(self.frequency[number[known]] + np.log(WORD_WEIGHT), total[known] + np.log(1 - WORD_WEIGHT))
        nobody = np.zeros(len(self.languages), bool)
        candidates = np.array([self.scripts.get(script(w), nobody) for w in words])
        read = candidates.any(1)
        total = np.where(candidates | ~read[:, None], total, -np.inf)
        scores = np.where(candidates, np.maximum(total - total.max(1, keepdims=True), -CLIP), -EXCLUDED)
        scores[~read] = 0
        return scores.astype(np.float32), np.array([letters(w) for w in words], np.int32), read

    def emissions(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``score`` of every word; words that are not remembered are scored at once."""
        if len(words) > (step := CACHE_WORDS // 4):  # a very long text could turn the memory over
            parts = [self.emissions(words[i : i + step]) for i in range(0, len(words), step)]
            return tuple(np.concatenate(p) for p in zip(*parts))
        at = [*map(self.rows.get, words)]
        if None in at:
            new = [*dict.fromkeys(w for w, r in zip(words, at) if r is None)]
            if self.memory is None or len(self.rows) + len(new) > CACHE_WORDS:
                self.rows.clear()
                self.memory = np.zeros((CACHE_WORDS, len(self.languages)), np.float32), np.zeros(CACHE_WORDS, np.int32), np.zeros(CACHE_WORDS, bool)
                new = [*dict.fromkeys(words)]
            n = len(self.rows)
            for kept, made in zip(self.memory, self.score(new)):
                kept[n : n + len(new)] = made
            self.rows.update(zip(new, range(n, n + len(new))))
            at = [*map(self.rows.get, words)]
        where = np.array(at)
        return tuple(kept[where] for kept in self.memory)


def viterbi(s: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each row of ``s`` where every change of label costs ``switch``.

    If no stretch of rows gains as much as one switch by leaving the label that is
    best overall, that label is the answer for all rows.
    """
    if not len(s):
        return np.zeros(0, int)
    main = int(s.sum(0, dtype=np.float64).argmax())
    gain = np.cumsum(s.max(1) - s[:, main], dtype=np.float64)
    if gain[-1] >= switch:
        others = np.delete(s, main, 1)
        if others.shape[1]:
            run = np.concatenate([[0.0], np.cumsum(others.max(1) - s[:, main], dtype=np.float64)])
            if (run - np.minimum.accumulate(run)).max() >= switch:
                return _viterbi(s, switch)
    return np.full(len(s), main)


def _viterbi(s: np.ndarray, switch: float) -> np.ndarray:
    rows = s.astype(float).tolist()
    best, back = rows[0], []
    states = range(s.shape[1])
    for row in rows[1:]:
        top = max(best)
        lead, jump = best.index(top), top - switch
        back.append([lead if b < jump else i for i, b in enumerate(best)])
        best = [(b if b >= jump else jump) + row[i] for i, b in zip(states, best)]
    label = best.index(max(best))
    out = [label]
    for step in reversed(back):
        label = step[label]
        out.append(label)
    return np.array(out[::-1])


def label(model: Model, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word (``pieces``) of a text the number of its language, its letters, and whether any language has its script."""
    words = pieces(text) if text else []
    if not words or not model.languages:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
    scores, size, read = model.emissions(words)
    return viterbi(scores), size, read


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of words, trigrams and scripts in the training rows of a batch."""
    for pdf in batches:
        counts: dict[tuple[str, str], Counter] = {}
        for lang, text in zip(pdf["lang"], pdf["text"]):
            words = Counter(pieces(text)) if text else Counter()
            counts.setdefault((lang, "word"), Counter()).update({w: n for w, n in words.items() if CUT not in w})
            grams, scripts = counts.setdefault((lang, "gram"), Counter()), counts.setdefault((lang, "script"), Counter())
            for w, n in words.items():
                whole = padded(w)
                for i in range(len(whole) - 2):
                    grams[whole[i : i + 3]] += n
                scripts[script(w)] += n * letters(w)
        rows = [(lang, kind, k, n) for (lang, kind), c in counts.items() for k, n in c.items()]
        yield pd.DataFrame(rows, columns=["lang", "kind", "item", "n"])


def learn(docs: DataFrame) -> Model:
    """The model, from rows with a language whose hash doesn't hold them out; a null or letterless text teaches nothing."""
    rows = only(docs, "doc_id", "text", "lang")
    # Ids first, then their texts.  A language's rows below a hash bound that leaves about twice the rows wanted are
    # ranked, so that no task meets a whole language.
    key = F.xxhash64("doc_id")
    labelled = rows.select("doc_id", "lang").where(F.col("lang").isNotNull() & ~held_out())
    share = labelled.groupBy("lang").agg((2.0 * ROWS_PER_LANGUAGE / F.count("*")).alias("_share"))
    low = labelled.join(F.broadcast(share), "lang").where(F.pmod(key, F.lit(1_000_003)) < F.col("_share") * 1_000_003)
    ranked = low.withColumn("_rank", F.row_number().over(W.partitionBy("lang").orderBy(key, "doc_id")))
    chosen = ranked.where(F.col("_rank") <= ROWS_PER_LANGUAGE).select(F.col("doc_id").alias("_id")).distinct()
    train = rows.where(F.col("lang").isNotNull()).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("lang", "text")
    counts = train.mapInPandas(_grams, "lang string, kind string, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    # One table of counts, read for each of the three rankings.
    counts = materialise(counts, "language-counts")
    totals = counts.groupBy("kind", "item").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    top = [totals.where(F.col("kind") == k).orderBy(F.desc("all"), "item").limit(n).collect() for k, n in (("script", 100), ("word", WORDS), ("gram", TRIGRAMS))]
    return build(*top)


def build(scripts: list, words: list, grams: list) -> Model:
    languages = sorted({lang for r in scripts for lang in r["by"]})
    number, L = {x: i for i, x in enumerate(languages)}, len(languages)

    def matrix(rows: list) -> np.ndarray:
        out = np.zeros((len(rows), L))
        for i, r in enumerate(rows):
            for lang, n in r["by"].items():
                if lang in number:
                    out[i, number[lang]] = n
        return out

    by_script = matrix(scripts)
    total = by_script.sum(0) if L else np.zeros(0)
    candidates = {r["item"]: by_script[i] > 0.01 * total for i, r in enumerate(scripts)}
    candidates = {k: v for k, v in candidates.items() if v.any()}
    w = matrix(words)
    with np.errstate(divide="ignore"):
        logs = np.log(w / np.maximum(w.sum(0), 1)) if L else w
    g = matrix(grams)
    heads: dict[str, np.ndarray] = {}
    for r, row in zip(grams, g):
        heads[r["item"][:2]] = heads.get(r["item"][:2], 0) + row
    alphabet = max(1, len({r["item"][2] for r in grams}))
    base = np.array([heads[r["item"][:2]] for r in grams]).reshape(len(grams), L)
    chain = np.log((g + 0.05) / (base + 0.05 * alphabet))
    unseen = np.full(L, np.log(1 / (20 * alphabet)))
    default = languages[int(total.argmax())] if L else "und"
    return Model(languages, default, candidates, {r["item"]: i for i, r in enumerate(words)}, logs, {r["item"]: i for i, r in enumerate(grams)}, np.vstack([chain, unseen]) if L else chain)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def judged(m: Model, text: str | None) -> tuple[str, float, int]:
    """The language of a text, its share of the letters, and the number of spans."""
    labels, size, read = label(m, text)
    if not len(labels):
        return "und", 0.0, 0
    if not read.any():
        return m.default, 0.0, 0
    share = np.bincount(labels, size, len(m.languages))
    best = int(share.argmax())
    return m.languages[best], float(share[best] / share.sum()), 1 + int((np.diff(labels) != 0).sum())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, n_spans`` for each row.

    The score is the part of the letters in spans of the predicted language.  A
    null text or one without letters is ``und`` with score 0; one whose scripts no
    language was learned for gets the commonest language with score 0.  A very long
    text is labelled whole.  Repeated rows and rows without an id stay; other columns
    are ignored; an empty table gives an empty one.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str | None]) -> list:
        return [*zip(*(judged(held.value, t) for t in texts))] or [[], [], []]

    return per_text(only(docs, "doc_id", "text").withColumn("held_out", held_out()), ["doc_id", "held_out"], run, "lang_pred string, score double, n_spans long")


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, first_word, last_word, lang`` for each stretch of words in one language."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str | None]) -> list:
        out = []
        for text in texts:
            labels = label(held.value, text)[0]
            edges = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
            out.append(([a for a, b in zip(edges, edges[1:]) if b > a], [b - 1 for a, b in zip(edges, edges[1:]) if b > a], [held.value.languages[labels[a]] for a, b in zip(edges, edges[1:]) if b > a]))
        return [*zip(*out)] or [[], [], []]

    found = per_text(docs, ["doc_id"], run, "first_word array<int>, last_word array<int>, lang array<string>")
    return found.select("doc_id", F.explode(F.arrays_zip("first_word", "last_word", "lang")).alias("s")).select("doc_id", "s.first_word", "s.last_word", "s.lang")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, learn(docs))
