"""Personal data: rules against the plain expressions, message passing against enumeration, and what the field adds."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import personal_data as pd_

SCHEMA = "doc_id long, text string"
rng = random.Random(5)


def plain_luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def plain_base(t):
    d = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 1, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(d(m[0])) <= 19 and plain_luhn(d(m[0]))]
    out += [(m.start(), 4, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(d(m[0])) <= 15]
    return sorted(out)


def card():
    body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(body + c for c in "0123456789" if plain_luhn(body + c))


MADE = [
    lambda: f"{rng.choice(['ann', 'bob.x', 'c-d'])}.{rng.randint(10, 99)}@mail{rng.randint(1, 9)}.example.com",
    lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
    card,
    lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}",
]


def sentence(n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus(n=400):
    out = []
    for i in range(n):
        extra = [rng.choice(MADE)()] if i % 2 else [str(rng.randint(1, 3000)), "".join(rng.choice("0123456789") for _ in range(16))]
        out.append((i, f"{sentence(20)} {' '.join(extra)} {sentence(15)}, version 2.0.\n"))
    return out


TAUGHT = corpus()
ODD = [(900, None), (901, ""), (902, " \n"), (903, "é@" * 2000), (904, "1" * 100_000 + ".1.2.3"), (905, "x" * 20_000 + " a.b@c.de"), (906, "a@b.c@d.e+1 (482) 555-7163 ٣٤@x ²²²² 1.2.3.4.5.6.7.8"), (None, "mail no.id7@x.org"), (907, "+" * 5000 + "1" * 12)]


@pytest.fixture(scope="module")
def model(spark):
    return pd_.fit_crf(spark.createDataFrame(TAUGHT, SCHEMA))


def test_rules_against_the_plain_expressions():
    pieces = ["1", "22", "255", "256", "007", ".", ".", "-", " ", " ", "@", "a", "b.c", "+", "(", ")", "é", "\n", "4111111111111111", "555-7163", "@x.org", "+1 (482) 555-7163", "10.0.0.1", "%", "_"]
    for _ in range(6000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 30)))
        assert pd_.base_spans(t) == plain_base(t), t
    for t in ("1." * 50, "a@b." * 30, "é+12345678901é", "1 2-3 4-5 6-7 8-9 0-1 2-3 4 5 6 8"):
        assert pd_.base_spans(t) == plain_base(t), t


def test_long_texts_take_linear_time():
    for t in ("1" * 300_000, "1." * 150_000, "a" * 300_000 + "@", "@" * 300_000, "1 " * 150_000, "+1" * 150_000, "(" * 300_000 + "1"):
        pd_.all_spans([t], None)
        pd_.tokens(t)


def exact(unary, edges, potentials):
    n, k = unary.shape
    p = np.zeros((n, k))
    for y in itertools.product(range(k), repeat=n):
        w = np.exp(sum(unary[i, y[i]] for i in range(n)) + sum(q[y[a], y[b]] for (a, b), q in zip(edges, potentials, strict=True)))
        for i in range(n):
            p[i, y[i]] += w
    return p / p.sum(axis=1, keepdims=True)


def test_messages_against_enumeration():
    g = np.random.default_rng(2)
    for trial in range(20):
        n, k = 6, 3
        unary = g.normal(size=(n, k))
        forest = np.array([(int(g.integers(0, i)), i) for i in range(1, n) if g.random() < 0.8] or [(0, 1)])
        for edges, close in ((forest, 1e-3), (np.vstack([forest, [[0, n - 1]]]), 0.08)):  # on a loop it is an approximation
            q = g.normal(size=(len(edges), k, k)) * (1 if close < 0.01 else 0.5)
            q = q + q.transpose(0, 2, 1)
            assert np.abs(pd_.marginals(unary, edges, q) - exact(unary, edges, q)).max() < close, trial
    assert np.allclose(pd_.marginals(unary, np.zeros((0, 2), int), np.zeros((0, k, k))).sum(axis=1), 1)


def test_what_the_field_adds(model):
    read = lambda t: [(pd_.KINDS[k - 1], t[s:e]) for s, k, e in pd_.all_spans([t], model)[1][0]]
    far = " " + sentence(300) + " "
    c = card()
    assert read(f"+1 (482) 555-7163{far}482-555-7163 and 482-555-9999 twice 482-555-9999") == [("phone", "+1 (482) 555-7163"), ("phone", "482-555-7163")]
    assert read(f"write to ann.42@mail7.example.com{far}ann.42 said, bob.43 did not") == [("email", "ann.42@mail7.example.com"), ("email", "ann.42")]
    assert ("card", c) in read(f"{sentence(5)} +1 (269) 555-3296 {c} {sentence(5)}") and not plain_base(f"+1 (269) 555-3296 {c}")  # the rules take both for one number and drop it
    assert read(f"{far} 12 of 3000 in 2024, 3.5 and v2.0.1, 482-555-7163, 1234567890123456, abc123def456") == []


def test_rows_of_all_kinds(spark, model):
    rows = corpus(60) + ODD + ODD[:2]
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit("clash").alias(c) for c in ("base", "spans", "kind", "s_id", "mask"))).repartition(3)
    for m in (model, None):
        found = pd_.find_personal_data(docs, m).collect()
        assert len(found) == len(rows)
        plain = lambda spans: tuple((s["start"], pd_.KINDS.index(s["kind"]) + 1, s["end"]) for s in spans)
        wanted = sorted(((d, tuple(plain_base(t or "")) if d != 904 else ()) for d, t in rows), key=str)
        assert sorted(((r["doc_id"], plain(r["base"])) for r in found), key=str) == wanted
        for r in found:
            assert set(plain(r["base"])) <= set(plain(r["spans"])) and list(plain(r["spans"])) == sorted(plain(r["spans"]))
    masked = {r["doc_id"]: r["text"] for r in pd_.mask_personal_data(docs, model).collect()}
    assert masked[900] is None and masked[901] == "" and masked[None] == "mail [email]" and masked[905].endswith(" [email]")
    assert pd_.fit_crf(spark.createDataFrame([], SCHEMA)) is None
    assert pd_.find_personal_data(spark.createDataFrame([], SCHEMA), None).count() == 0


def test_fit_is_repeatable(spark, model):
    again = pd_.fit_crf(spark.createDataFrame(TAUGHT, SCHEMA).repartition(7))
    assert np.array_equal(again.unary, model.unary) and np.array_equal(again.skip, model.skip)
    assert (np.diag(model.skip)[1:] > 0).all()  # alike tokens share labels
