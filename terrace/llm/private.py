"""Personal data: fixed patterns, and spans learned by weak supervision.

Emails, IP addresses, card and phone numbers are found by pattern (``base``).
Beyond these every token with a digit is a candidate, and every token that is
assigned to a name such as a password's (``HINTS``).  Regex, gazetteer and context
labelers vote on it: private, not private, or nothing.  One gazetteer is taken from
the corpus: short tokens in many contexts, which are never taken for secrets.  Expectation-maximisation
over the counts of vote patterns in the whole corpus estimates how far each labeler
can be relied on and how likely each pattern is private; a logistic span classifier
is trained on these likelihoods and decides from the token's shape and context.

The corpus sends one row for each different pair of votes and flags with its count,
at most ``2 ** (labelers + flags)`` of them; the classifier is fitted on the
``PATTERNS`` commonest.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from hashlib import sha256
from itertools import accumulate
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.common import ROWS, only, per_text, table

KINDS = ["email", "ip", "card", "phone", "secret"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
SPACE = re.compile(r"\s")
HINTS = ("token", "secret", "passw", "pwd", "api", "key", "auth", "bearer", "ssn", "iban", "passport", "login")
UNITS = ("page", "version", "chapter", "figure", "year", "%", "km", "kg")
#: How keys of well-known services begin, and what stands where a secret would.
PREFIXES = ("sk-", "sk_", "pk_", "ghp_", "gho_", "github_pat_", "glpat-", "xox", "akia", "asia", "aiza", "ya29.", "eyj", "npm_", "hf_")
PLACEHOLDERS = frozenset(("none", "null", "true", "false", "example", "changeme", "password", "secret", "token", "default", "required", "optional", "string", "yes", "no"))
#: Tokens of the corpus's gazetteer, at most, the different contexts that one must be met in, so that copies of a document
#: count once, and its characters, at most: what is long and common may be a secret that was passed on.
GAZETTEER, CONTEXTS, SHORT = 10_000, 3, 16
#: Pairs of votes and flags that the classifier is fitted on, at most, by frequency.
PATTERNS = 200_000
#: How often any labeler is taken to err, at least.
NOISE = 0.02
SIGN, AROUND = re.compile(r"[:=]"), re.compile(r"[@:=]")
EDGES = "\"'`.,;:!?()[]{}<>|#*$%&"
#: A candidate is taken from this likelihood on.
ACCEPT = 0.5

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield "email", start, (end := m.end())
        at = text.find("@", at + 1)


def addresses(text: str) -> Iterator[Span]:
    for m in CHAIN.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield "ip", at, at + size
            at += size + 1


def base(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start and then kind."""
    out = [*emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += addresses(text)
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def tokens(text: str) -> Iterator[tuple[int, int]]:
    """Stretches without white space that hold a digit or are assigned to a hinted name, each once, in order."""
    found = set()
    m = DIGIT.search(text)
    while m:
        start = m.start()
        while start and not text[start - 1].isspace():
            start -= 1
        stop = SPACE.search(text, m.end())
        end = stop.start() if stop else len(text)
        found.add((start, end))
        m = DIGIT.search(text, end)
    for m in SIGN.finditer(text):
        name = text[max(0, m.start() - 24) : m.start()].rstrip(" \"'").lower().rpartition(" ")[2]
        if any(h in name for h in HINTS):
            start = m.end()
            while start < len(text) and text[start] in " \"'":
                start += 1
            stop = SPACE.search(text, start)
            end = stop.start() if stop else len(text)
            while start and end > start and start > m.end() and not text[start - 1].isspace():  # with the quotes, as tokens with digits are
                start -= 1
            if end > start:
                found.add((start, end))
    yield from sorted(found)


def candidates(text: str, taken: list[Span]) -> Iterator[tuple[int, int]]:
    """``tokens`` without the punctuation around them; those that a span of ``taken`` covers or crosses are left out, those that hold one are not."""
    starts = [a for _, a, _ in taken]
    reach = [*accumulate((b for _, _, b in taken), max)]
    before = 0
    for start, end in tokens(text):
        token = text[start:end]
        a = start + len(token) - len(token.lstrip(EDGES))
        b = end - (len(token) - len(token.rstrip(EDGES)))
        if a >= b or a < before:
            continue
        first, last = bisect_left(starts, a), bisect_left(starts, b)
        inside = all(z <= b and (y, z) != (a, b) for _, y, z in taken[first:last])
        if inside and not (first and reach[first - 1] > a):
            before = b
            yield a, b


def evidence(text: str, a: int, b: int, common: frozenset[str] = frozenset()) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """The labelers' votes on a token (1 private, -1 not, 0 none) and the classifier's flags; ``common`` is the corpus's gazetteer."""
    token = text[a:b]
    low, before, after = token.lower(), text[max(0, a - 24) : a].lower(), text[b : b + 12].lower()
    digits = sum(c in "0123456789" for c in token)
    letters = sum(map(str.isalpha, token))
    kinds = [c.isdigit() for c in token if c.isalnum()]
    turns = sum(x != y for x, y in zip(kinds, kinds[1:]))
    hexa = len(token) >= 24 and re.fullmatch(r"[0-9a-fA-F]+", token) is not None
    hint = any(h in before for h in HINTS)
    assigned = before.rstrip(" \"'").endswith(("=", ":"))
    quoted = before[-1:] in {'"', "'"} and after[:1] == before[-1:]
    plain = digits == len(token)
    cased = sum(x.islower() and y.isupper() or x.isupper() and y.islower() for x, y in zip(token, token[1:]))
    votes = (
        # regex: the token's form
        1 if hexa and letters else 0,
        1 if len(token) >= 16 and letters and turns >= 4 else 0,
        -1 if plain else 0,
        -1 if letters and digits and turns <= 1 else 0,
        -1 if len(token) <= 6 else 0,
        # gazetteers: the token itself, and the words beside it
        1 if low.startswith(PREFIXES) and len(token) >= 12 else 0,
        -1 if low in common or low in PLACEHOLDERS else 0,
        -1 if any(u in before[-10:] or u in after for u in UNITS) else 0,
        # context
        1 if hint else 0,
        1 if assigned else 0,
        1 if quoted else 0,
    )
    vowels = sum(c in "aeiouy" for c in low)
    flags = (
        len(token) >= 8, len(token) >= 12, len(token) >= 16, len(token) >= 24, len(token) >= 32, len(token) >= 48, hint, assigned, quoted, hint and assigned,
        2 * len(set(token)) >= len(token), 4 * digits >= len(token), 2 * digits >= len(token), 8 * vowels < len(token), turns >= 2, turns >= 4, turns >= 8, cased >= 3, any(c in "-_./+=" for c in token), token.isupper(), bool(letters),
    )
    return votes, tuple(map(int, flags))


@dataclass
class Classifier:
    """Weights of the flags, the constant last; what EM found of each labeler, P(right | it votes); and the corpus's gazetteer."""

    weights: np.ndarray
    reliability: list[float]
    common: frozenset[str] = frozenset()

    @cached_property
    def plain(self) -> frozenset[str]:
        return self.common | PLACEHOLDERS

    def likelihood(self, flags: tuple[int, ...]) -> float:
        return float(1 / (1 + np.exp(-(np.dot(self.weights[:-1], flags) + self.weights[-1]))))


def reliabilities(votes: np.ndarray, n: np.ndarray, turns: int = 50) -> tuple[np.ndarray, list[float]]:
    """Each pattern's likelihood of being private, and each labeler's precision, by expectation-maximisation from the majority's view."""
    p = np.clip(0.5 + 0.4 * np.sign(votes.sum(1)), 0.1, 0.9)
    for _ in range(turns):
        yes, no = n * p, n * (1 - p)
        odds = np.full(len(n), np.log((yes.sum() + 1) / (no.sum() + 1)))
        for j in range(votes.shape[1]):
            for v in (-1, 0, 1):
                has = votes[:, j] == v
                if has.any():  # no vote is held for surer than NOISE allows
                    of_yes, of_no = ((x[has].sum() + 0.5) / (x.sum() + 1.5) * (1 - 2 * NOISE) + NOISE for x in (yes, no))
                    odds[has] += np.log(of_yes) - np.log(of_no)
        p = np.clip(1 / (1 + np.exp(-np.clip(odds, -30, 30))), NOISE, 1 - NOISE)
    if (n * p * votes.sum(1)).sum() / max((n * p).sum(), 1e-9) < (n * (1 - p) * votes.sum(1)).sum() / max((n * (1 - p)).sum(), 1e-9):
        p = 1 - p  # the classes changed places
    right = []
    for j in range(votes.shape[1]):
        cast = votes[:, j] != 0
        right.append(float((n * np.where(votes[:, j] > 0, p, 1 - p))[cast].sum() / n[cast].sum()) if cast.any() else 0.5)
    return p, right


def train(rows: list[tuple[list[int], list[int], int]], common: frozenset[str] = frozenset()) -> Classifier | None:
    """A classifier from ``votes, flags, count`` rows; None without rows."""
    if not rows:
        return None
    rows = sorted(rows)
    votes, flags, n = (np.array(x, float) for x in zip(*rows))
    p, right = reliabilities(votes, n)
    x = np.column_stack([flags, np.ones(len(n))])
    w, share = np.zeros(x.shape[1]), n / n.sum()
    for _ in range(100):  # Newton steps of the penalised likelihood
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (q - p)) + 1e-4 * w
        hess = (x * (share * q * (1 - q))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return Classifier(w, right, common)


def gazetteer(docs: DataFrame) -> frozenset[str]:
    """The commonest candidate tokens, in lower case: at most ``GAZETTEER``, each after ``CONTEXTS`` different texts or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            met = set()
            for text in pdf["text"]:
                if text and (DIGIT.search(text) or SIGN.search(text)):
                    met.update((text[a:b].lower(), crc32(text[max(0, a - 24) : a].encode())) for a, b in candidates(text, base(text)) if b - a <= SHORT)
            yield pd.DataFrame([*met], columns=["token", "context"])

    met = only(docs, "text").mapInPandas(run, "token string, context long").distinct()
    counted = met.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= CONTEXTS)
    return frozenset(r.token for r in counted.orderBy(F.desc("n"), "token").limit(GAZETTEER).collect())


def learn(docs: DataFrame) -> Classifier | None:
    """The classifier, from the candidates of every text."""
    common = gazetteer(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                if text and (DIGIT.search(text) or SIGN.search(text)):
                    counts.update(evidence(text, a, b, common) for a, b in candidates(text, base(text)))
        yield pd.DataFrame([([*v], [*f], n) for (v, f), n in counts.items()], columns=["votes", "flags", "n"])

    counted = only(docs, "text").mapInPandas(run, "votes array<int>, flags array<int>, n long").groupBy("votes", "flags").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "votes", "flags").limit(PATTERNS).collect()
    return train([(list(r.votes), list(r.flags), r.n) for r in rows], common)


def find(text: str, classifier: Classifier | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and those with the learned ones, each in order."""
    own = base(text)
    if classifier is None:
        return own, own
    plain = classifier.plain  # these words are no secrets, whatever the context says
    more = [("secret", a, b) for a, b in candidates(text, own) if text[a:b].lower() not in plain and classifier.likelihood(evidence(text, a, b, classifier.common)[1]) >= ACCEPT]
    return own, sorted(own + more, key=lambda s: (s[1], KINDS.index(s[0])))


def line(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, classifier: Classifier | None) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, n_secret, n_spans, base_sha256, spans`` for each row.

    A null text counts as empty; a very long one is searched whole; repeated rows and
    rows without an id stay; other columns are ignored; an empty table gives an empty
    one.
    """

    def run(texts: list[str | None]) -> list:
        out = []
        for text in texts:
            own, every = find(text, classifier) if text else ([], [])
            count = Counter(k for k, _, _ in every)
            out.append((*(count[k] for k in KINDS), len(every), sha256(line(own).encode()).hexdigest(), line(every)))
        return [*zip(*out)] or [[]] * (len(KINDS) + 3)

    return per_text(docs, ["doc_id"], run, ", ".join(f"n_{k} long" for k in KINDS) + ", n_spans long, base_sha256 string, spans string")


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; of spans that overlap, what lies before the later one's end goes once."""
    out, at = [], 0
    for kind, a, b in spans:
        if b <= at:
            continue
        out += text[at : max(a, at)], f"<{kind.upper()}>"
        at = b
    return "".join([*out, text[at:]])


def op6_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return detect(docs, learn(docs))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data replaced, and ``n_chars`` as it is then.

    Null and empty texts stay as they are; a very long one is searched whole; columns
    of any name and type come through; an empty table gives an empty one.
    """
    classifier = learn(docs)

    def clean_text(t: str | None) -> str | None:
        return redact(t, find(t, classifier)[1]) if t and (DIGIT.search(t) or AROUND.search(t)) else t

    def run(texts: pa.Array) -> pa.Array:
        parts = [pa.array([clean_text(t) for t in texts.slice(i, ROWS).to_pylist()], pa.string()) for i in range(0, len(texts), ROWS)]
        return pa.concat_arrays(parts or [pa.array([], pa.string())])

    clean = docs.withColumn("text", F.arrow_udf(run, "string")("text"))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else clean
