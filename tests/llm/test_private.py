import random
import re
from hashlib import sha256

from terrace.llm import private
from tests.llm.helpers import documents, tricky

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and sum(sum(map(int, str(int(d) * (1 + i % 2)))) for i, d in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], private.KINDS.index(s[0])))


def test_base_is_the_patterns():
    rng = random.Random(0)
    for _ in range(20000):
        text = "".join(rng.choice("a1+.@- 29()0b") for _ in range(rng.randint(0, 40)))
        assert private.base(text) == brute(text), text
    for text in ("a@" * 2000, "9" * 6000, "1." * 5000, "+1" + " " * 5000, "a" * 50000 + "@"):
        private.find(text, None)


def test_query(spark, sf_dir):
    texts = dict(documents(spark, sf_dir).select("doc_id", "text").collect())
    found = private.op6_private(spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        own = brute(texts[r.doc_id])
        assert r.base_sha256 == sha256(private.line(own).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in own) for kind in PATTERNS]
        spans = r.spans.split(",") if r.spans else []
        assert {f"{k}:{a}:{b}" for k, a, b in own} <= set(spans) and len(spans) == len(own) + r.n_secret


def test_learns_secrets(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    secret = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    made, keys = [], []
    for i in range(300):
        keys.append(secret())
        made.append((i, f'{word()} {rng.randint(1, 99)} {word()} token = "{keys[-1]}" {word()} page {rng.randint(1, 400)} in {rng.randint(1900, 2020)}'))
    docs = spark.createDataFrame(made, "doc_id long, text string")
    model = private.learn(docs)
    for (_, text), key in zip(made, keys):
        assert [text[a:b] for k, a, b in private.find(text, model)[1] if k == "secret"] == [key]
    assert all(private.redact(t, private.find(t, model)[1]).count("<SECRET>") == 1 for _, t in made)
    assert all(0.5 <= r < 0.999 for r in model.reliability)


def test_learns_what_has_no_digit(spark):
    """A password of letters is a candidate by the name that it is assigned to; what many documents hold in its place is no secret."""
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
    made, keys = [], []
    for i in range(400):
        keys.append(word(20) if i % 2 else "required")
        made.append((i, f'{word(6)} password: "{keys[-1]}" {word(7)} in {rng.randint(1900, 2020)} page {rng.randint(1, 90)} {word(3)}{rng.randint(1, 9)}'))
    model = private.learn(spark.createDataFrame(made, "doc_id long, text string"))
    assert "required" in model.common
    found = [[text[a:b] for k, a, b in private.find(text, model)[1]] for _, text in made]
    assert sum(f == [k] for f, k in zip(found[1::2], keys[1::2])) > 190 and sum(map(len, found[::2])) < 10


def test_tokens():
    texts = [f"{text[a:b]}" for text in ["x1 y", 'api_key="abc def', "password : 'q w", "a key=", "time: now", "2:3"] for a, b in private.candidates(text, [])]
    assert texts == ["x1", "abc", "q", "2:3"]


def test_edges(spark):
    docs = tricky(spark)
    assert private.detect(docs, private.learn(docs)).count() == docs.count()
    assert private.learn(docs.limit(0)) is None and private.detect(docs.limit(0), None).count() == 0
    out = private.stage(spark, docs, "")
    assert out.columns == docs.columns and out.count() == docs.count()
    assert private.redact("ab cd ef", [("ip", 0, 5), ("card", 3, 8)]) == "<IP><CARD>"


def test_precision_and_recall_on_a_given_table(spark):
    """The tables' secrets are keys of 40 hex digits: each is found, and nothing else is taken for one."""
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = private.learn(texts)
    truth, found = set(), set()
    for doc_id, text in texts.collect():
        truth |= {(doc_id, m.start(), m.end()) for m in re.finditer(r"(?<![0-9A-Za-z])(?=[0-9a-f]*[0-9])[0-9a-f]{40}(?![0-9A-Za-z])", text or "")}
        found |= {(doc_id, a, b) for k, a, b in private.find(text or "", model)[1] if k == "secret"}
    assert len(truth) >= 10
    assert len(truth & found) / len(truth) >= 0.95 and len(truth & found) / len(found) >= 0.95
