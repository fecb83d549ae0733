"""Personal data by a skip-chain conditional random field over each document.

Rules find e-mail addresses, IP addresses, card and phone numbers; what they find stays. The field adds what they miss: numbers that the rules take together with a neighbour and
drop, and mentions of the same address or number in another form elsewhere in the document. Its tokens are the words with a digit or an @, neighbouring pieces of one
number taken together; all other words are observed as ordinary, so they bound the graph and cost nothing. Potentials: features of a token's form, a chain between neighbouring
tokens, and skip edges between tokens that repeat each other or are similar (the same last seven digits, the same local part), however far apart. Each such token is tied to the next one alike, so a
document of m tokens has less than 2 m edges. Tokens that the rules have found are observed; loopy belief propagation over the graphs of a batch of documents at once carries their labels
along the edges. A token whose likeliest kind has a marginal of ADD_AT or more becomes a span.

Weights are fitted by pseudo-likelihood on at most `fit_rows` documents, those of the least hash of doc_id, and copies of them in which found data are mentioned once more in a form that the rules do not take,
beside decoys of the same form with other digits. What the fit reads is counted as patterns of features and neighbouring labels; MOST_PATTERNS of them reach the driver.

Defined results: null and empty texts have no spans. Without a found item in the sample nothing is added. Rows are judged one by one: repeated rows have equal results; rows without a doc_id are judged,
and teach nothing. Very long texts are read whole, in linear time. Spans are in code points, ends exclusive, ordered by start and then kind; added spans overlap no other. Extra columns, whatever their names, do no harm.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ensure_importable, map_rows

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = 1, 2, 3, 4  # labels; 0 is ordinary
N_LABELS = 5
FIT_ROWS, MOST_PATTERNS = 20_000, 20_000
ADD_AT = 0.9
ROUNDS, DAMPING, SETTLED = 40, 0.3, 1e-4
#: Digits that make two numbers similar.
TAIL = 7
SPANS = "array<struct<kind:string,start:int,end:int>>"

_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_space = frozenset(" \t\n\x0b\x0c\r")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match can begin only where a run of digits does
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_marks = re.compile(r"[0-9@]+")
_word_end = re.compile(r"[\x20\x09-\x0D]")
_digits = re.compile(r"[0-9]+")
_numeric = re.compile(r"[0-9+()./-]+")
_address = re.compile(r"[^@]+@[^@]+\.[^@.]+")


def digits_of(text: str) -> str:
    return "".join(_digits.findall(text))


def luhn(digits: str) -> bool:
    doubled = sum(divmod(2 * int(d), 10)[0] + 2 * int(d) % 10 for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """From one @ to the next, so that long runs without one cost nothing."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        if m := _domain.match(text, at + 1):
            start = at
            while start > end and text[start - 1] in _local:
                start -= 1
            if start < at:
                out.append((start, end := m.end()))
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, label, end) of what the rules find, sorted."""
    found = [(s, EMAIL, e) for s, e in emails(text)]
    if _digits.search(text):
        found += [(m.start(), IP, m.end()) for m in _ip.finditer(text) if all(len(p := x.lstrip("0")) < 3 or len(p) == 3 and p <= "255" for x in m[0].split("."))]
        found += [(m.start(), CARD, m.end()) for m in _card.finditer(text) if len(m[0]) < 40 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found += [(m.start(), PHONE, m.end()) for m in _phone.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(found)


def tokens(text: str) -> list[tuple[int, int]]:
    """(start, end) of words with a digit or an @, without the punctuation around them; pieces of one number are one token."""
    out: list[tuple[int, int]] = []
    seen, loose = 0, -1  # loose: where the last token's word ends, if it may go on
    for m in _marks.finditer(text):
        if m.start() < seen:
            continue
        start = m.start()
        while start > seen and text[start - 1] not in _space:
            start -= 1
        stop = _word_end.search(text, m.end())
        seen = word_end = stop.start() if stop else len(text)
        end = word_end
        while start < end and not (text[start].isalnum() or text[start] in "+(@"):
            start += 1
        while end > start and not (text[end - 1].isalnum() or text[end - 1] == ")" and "(" in text[start:end]):
            end -= 1
        if end <= start:
            continue
        plain = end - start < 64 and bool(_numeric.fullmatch(text, start, end))
        own = len(digits_of(text[start:end])) if plain else 0
        if plain and out and start - loose == 1 and text[loose] in " \t" and text[start] != "+":
            before = text[out[-1][0] : out[-1][1]]
            held = len(digits_of(before))
            if held + own <= 15 and before[0] in "+(" or held + own <= 19 and own < TAIL and held % 4 == 0 and own <= 4 and before[0].isdigit():
                out[-1] = (out[-1][0], end)
                loose = end if end == word_end else -1
                continue
        out.append((start, end))
        loose = end if plain and end == word_end else -1
    return out


FEATURES = 30


def features(token: str) -> int:
    """Bits of a token's form."""
    digits = digits_of(token)
    n, plain, at = len(digits), bool(_numeric.fullmatch(token.replace(" ", ""))), "@" in token
    parts = token.split(".")
    quad = len(parts) == 4 and all(len(p) <= 3 and bool(_digits.fullmatch(p)) and int(p) <= 255 for p in parts)
    full = n >= 13 and plain and luhn(digits)
    on = [
        True, at, at and bool(_address.fullmatch(token)), at and not _address.fullmatch(token), not plain and not at, plain, token[0] == "+", token[0] == "(", "(" in token, quad, plain and not quad and "." in token,
        plain and "-" in token, " " in token, "/" in token, 0 < n < 7, n == 7, n in (8, 9), n == 10, n == 11, n in (12, 13), n in (14, 15), n == 16, 17 <= n <= 19, n > 19,
        full and not quad, n >= 13 and plain and not full, token[0] == "+" and plain and 10 <= n <= 15, not plain and not at and "." in token, not plain and not at and "=" in token, not plain and len(token) > 24,
    ]
    return sum(1 << i for i, x in enumerate(on) if x)


def likeness(token: str) -> str | None:
    """Tokens of one document with the same key are repeated or similar."""
    if "@" in token:
        return "a" + token.partition("@")[0].lower()
    if _numeric.fullmatch(token.replace(" ", "")):
        return "n" + d[-TAIL:] if len(d := digits_of(token)) >= TAIL else None
    return "a" + token.lower() if len(token) >= 5 else None


@dataclass
class Graph:
    """Of some documents: tokens and the edges between them."""

    spans: list[tuple[int, int]]
    masks: np.ndarray
    observed: np.ndarray  # the label that the rules give, or 0
    chain: np.ndarray  # pairs of tokens
    skip: np.ndarray


def graph(texts: list[str], found: list[list[tuple[int, int, int]]]) -> tuple[Graph, list[int]]:
    """The graph of all texts, and where each text's tokens begin in it."""
    spans, masks, observed, chain, skip, at = [], [], [], [], [], [0]
    for text, base in zip(texts, found, strict=True):
        last: dict[str, int] = {}
        i = 0
        for start, end in tokens(text):
            node = len(spans)
            while i < len(base) and base[i][2] <= start and all(b[2] <= start for b in base[i : i + 4]):
                i += 1
            observed.append(next((k for s, k, e in base[i : i + 4] if s < end and e > start), 0))
            if node > at[-1] and text[spans[-1][1] : start].isspace() and start - spans[-1][1] <= 2:
                chain.append((node - 1, node))
            token = text[start:end]
            if (key := likeness(token)) is not None:
                if key in last:
                    skip.append((last[key], node))
                last[key] = node
            spans.append((start, end))
            masks.append(features(token))
        at.append(len(spans))
    pairs = lambda x: np.array(x, np.int64).reshape(-1, 2)
    return Graph(spans, np.array(masks, np.int64), np.array(observed, np.int64), pairs(chain), pairs(skip)), at


def unpacked(masks: np.ndarray) -> np.ndarray:
    return ((masks[:, None] >> np.arange(FEATURES)) & 1).astype(float)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def marginals(unary: np.ndarray, edges: np.ndarray, potentials: np.ndarray) -> np.ndarray:
    """Loopy belief propagation, exact on forests. unary: a row of log potentials for each node; edges: pairs of nodes; potentials: for each edge a symmetric matrix of log potentials."""
    n = len(edges)
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    both, back = np.concatenate([potentials, potentials]), np.concatenate([np.arange(n, 2 * n), np.arange(n)])
    messages = np.zeros((2 * n, unary.shape[1]))
    belief = unary.copy()
    for _ in range(ROUNDS):
        if not n:
            break
        new = log_sum((belief[source] - messages[back])[:, :, None] + both, 1)
        new -= new.max(axis=1, keepdims=True)
        moved = np.abs(new - messages).max()
        messages = new if moved < SETTLED else (1 - DAMPING) * new + DAMPING * messages
        belief = unary.copy()
        np.add.at(belief, target, messages)
        if moved < SETTLED:
            break
    belief = np.exp(belief - belief.max(axis=1, keepdims=True))
    return belief / belief.sum(axis=1, keepdims=True)


@dataclass
class Crf:
    unary: np.ndarray  # FEATURES x N_LABELS
    chain: np.ndarray  # symmetric
    skip: np.ndarray

    def label(self, g: Graph) -> tuple[np.ndarray, np.ndarray]:
        """For each token the likeliest label and its marginal."""
        if not len(g.spans):
            return np.zeros(0, np.int64), np.zeros(0)
        unary = unpacked(g.masks) @ self.unary
        sides = np.bincount(g.chain.ravel(), minlength=len(unary))  # a token has two neighbours; those that are no tokens are ordinary
        unary += (2 - sides)[:, None] * self.chain[0]
        known = g.observed > 0
        unary[known] = -60.0
        unary[known, g.observed[known]] = 0.0
        potentials = np.concatenate([np.broadcast_to(self.chain, (len(g.chain), N_LABELS, N_LABELS)), np.broadcast_to(self.skip, (len(g.skip), N_LABELS, N_LABELS))])
        p = marginals(unary, np.concatenate([g.chain, g.skip]), potentials)
        return p.argmax(axis=1), p.max(axis=1)

    def added(self, texts: list[str], found: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
        """For each text (start, label, end) of the spans that the rules lack."""
        g, at = graph(texts, found)
        label, sure = self.label(g)
        out = []
        for (first, last), base in zip(zip(at, at[1:]), found, strict=True):
            picked = [i for i in range(first, last) if label[i] and sure[i] >= ADD_AT and not g.observed[i]]
            out.append([(s, int(label[i]), e) for i in picked for s, e in [g.spans[i]] if not any(b < e and s < f for b, _, f in base)])
        return out


def other_form(kind: int, text: str, pick: int) -> str:
    """The same data as the rules do not take it."""
    d = digits_of(text)
    if kind == EMAIL:
        return text.partition("@")[0]
    if kind == PHONE:
        d = d[-10:]
        return (f"{d[:3]}-{d[3:6]}-{d[6:]}", f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", d)[pick % 4]
    if kind == CARD:
        return "./"[pick % 2].join(d[i : i + 4] for i in range(0, len(d), 4))
    return "-/"[pick % 2].join(text.split("."))


def mentioned_again(text: str, base: list[tuple[int, int, int]]) -> tuple[str, list[tuple[int, int, int]]]:
    """The text and behind it its found data in other forms (label and place of each returned), each beside a decoy: the same form, other digits, said twice."""
    out, at, planted = [text], len(text), []
    for start, kind, end in base[:8]:
        item = text[start:end]
        pick = zlib.crc32(item.encode())
        form = other_form(kind, item, pick)
        decoy = form.translate(str.maketrans("0123456789", "7158269340"))
        for label, words in ((0, "so" if decoy == form else decoy), (kind, form), (0, "so" if decoy == form else decoy)):
            lead = " so on and "
            out += [lead, words]
            at += len(lead)
            if label:
                planted.append((at, label, at + len(words)))
            at += len(words)
        out.append(" and")
        at += 4
    return "".join(out), planted


def patterns(text: str | None) -> list[tuple[int, int]]:
    """(mask, labels) of each token of a text and of its copy with data mentioned again; labels holds those of the token, its neighbours and its skip neighbours, 5 stands for no token."""
    if not text or not _marks.search(text):
        return []
    out = []
    base = base_spans(text)
    for t, extra in [(text, [])] + ([mentioned_again(text, base)] if base else []):
        g, _ = graph([t], [base])
        y = g.observed.copy()
        for s, k, e in extra:
            for i in range(len(g.spans) - 1, -1, -1):
                if g.spans[i][0] < e and g.spans[i][1] > s:
                    y[i] = k
        around = np.zeros((len(y), 4), np.int64)
        around[:, 2:] = 5
        for a, b in g.chain:
            around[a, 1], around[b, 0] = y[b], y[a]
        for a, b in g.skip:
            around[a, 3], around[b, 2] = y[b], y[a]
        out += [(int(m), int(k + 8 * (r[0] + 8 * (r[1] + 8 * (r[2] + 8 * r[3]))))) for m, k, r in zip(g.masks, y, around, strict=True)]
    return out


def fit_crf(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Crf | None:
    """docs: doc_id, text. None where the rules find nothing in the sample."""
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).select(F.col("doc_id").alias("s_id"))
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("s_id")).select("text")  # fit_rows ids at most

    def run(text: list) -> dict[str, list]:
        rows = [p for t in text for p in patterns(t)]
        return {"mask": [m for m, _ in rows], "labels": [k for _, k in rows]}

    counted = map_rows(sample, run, "mask long, labels long").groupBy("mask", "labels").agg(F.count("*").alias("n"))
    rows = counted.orderBy(F.desc("n"), "mask", "labels").limit(MOST_PATTERNS).collect()
    x, labels, n = (np.array([r[c] for r in rows], np.int64) for c in ("mask", "labels", "n"))
    if not len(rows) or not (labels & 7).any():
        return None
    return fitted(x, labels, n)


def fitted(masks: np.ndarray, labels: np.ndarray, n: np.ndarray, steps: int = 500, l2: float = 0.02) -> Crf:
    """The weights of the largest pseudo-likelihood: each token's label given its form and its neighbours' labels."""
    y, left, right, before, after = ((labels >> (3 * i)) & 7 for i in range(5))
    one = np.eye(N_LABELS + 1)
    x = np.hstack([unpacked(masks), one[left][:, :N_LABELS] + one[right][:, :N_LABELS], one[before][:, :N_LABELS] + one[after][:, :N_LABELS]])
    truth, weight = one[y][:, :N_LABELS], n[:, None].astype(float)
    weight = weight / weight.sum()
    w, m, v = np.zeros((x.shape[1], N_LABELS)), 0.0, 0.0
    even = lambda g: np.vstack([g[:FEATURES], g[FEATURES : FEATURES + N_LABELS] + g[FEATURES : FEATURES + N_LABELS].T, g[FEATURES + N_LABELS :] + g[FEATURES + N_LABELS :].T])  # noqa: E731  edges have no direction
    for t in range(1, steps + 1):
        z = x @ w
        p = np.exp(z - log_sum(z, 1)[:, None])
        g = even(x.T @ (weight * (p - truth))) + l2 * w / n.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Crf(w[:FEATURES], w[FEATURES : FEATURES + N_LABELS], w[FEATURES + N_LABELS :])


def all_spans(texts: list[str | None], model: Crf | None) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple[int, int, int]]]]:
    """What the rules find, and that with what the field adds."""
    plain = [t or "" for t in texts]
    base = [base_spans(t) if _marks.search(t) else [] for t in plain]
    if not model:
        return base, base
    open_ = [i for i, t in enumerate(plain) if _marks.search(t)]
    whole = list(base)
    for i, more in zip(open_, model.added([plain[i] for i in open_], [base[i] for i in open_]), strict=True):
        whole[i] = sorted(base[i] + more)
    return base, whole


def find_personal_data(docs: DataFrame, model: Crf | None) -> DataFrame:
    """doc_id, base, spans for each row of docs (doc_id, text): arrays of kind, start, end."""
    named = lambda spans: [{"kind": KINDS[k - 1], "start": s, "end": e} for s, k, e in spans]

    def run(doc_id: list, text: list) -> dict[str, list]:
        base, whole = all_spans(text, model)
        return {"doc_id": doc_id, "base": list(map(named, base)), "spans": list(map(named, whole))}

    return map_rows(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {SPANS}, spans {SPANS}")


def mask_personal_data(docs: DataFrame, model: Crf | None) -> DataFrame:
    """docs with each span of its texts replaced by its kind in brackets; overlapping spans become the first one's kind. A null text stays null."""
    ensure_importable(docs.sparkSession)

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        out = []
        for text, spans in zip(texts, all_spans(texts.tolist(), model)[1], strict=True):
            parts, at = [], 0
            for s, k, e in spans:
                if s >= at:
                    parts += [text[at:s], f"[{KINDS[k - 1]}]"]
                at = max(at, e)
            out.append("".join(parts) + text[at:] if spans else text)
        return pd.Series(out, dtype=object)

    return docs.withColumn("text", masked("text"))
