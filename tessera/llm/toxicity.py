"""Toxicity by compression distance: a text is toxic as far as a dictionary of toxic text compresses its windows better than one of ordinary text.

Toxic texts are ordinary prose but for a word here and there, so dictionaries trained on whole windows of both classes hold much the same and their difference
is noise (README has the figures). Hence what the toxic one is trained on is chosen, and both share what is ordinary.

Two zstandard dictionaries are trained. The ordinary one holds windows of texts labelled 0. The toxic one holds the same, and before it a
dictionary trained on what texts labelled 1 have of their own: their words of which a form (the word or its start) has a log-likelihood ratio against ordinary texts that is significant
after correction for the size of the vocabulary; none of these words is left out, TOXIC_BYTES is no bound to them. As both share their ordinary part, a clean window compresses alike under both and the
difference counts what only toxic text explains. Window differences (largest three, mean, share over 3 bytes) go through a logistic calibration
that knows the share of toxic labels; it is fitted to a half of the sample from which no dictionary is made.

The fit takes at most `fit_rows` labelled texts of each class, those of the least hash of doc_id, and of each at most `fit_bytes` in windows spread
over the whole text. All else is one stage over whole texts: no shuffle, bounded memory.

Defined results: null and empty texts have no windows and get the score of that (low). Without both classes among the rows to learn from, every
score is 0.0. Equal texts get equal scores; null doc_ids are not held out and teach nothing; a doc_id labelled twice takes its larger label. Very long texts
are scored whole, window by window. Extra columns, whatever their names, do no harm.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import lower_ascii, map_rows

WINDOW_BYTES = 96
LEVEL, MIN_MATCH = 12, 4
ORDINARY_BYTES, TOXIC_BYTES = 16 << 10, 4 << 10
FIT_ROWS, FIT_BYTES = 4_000, 32 << 10
PREDICT_AT = 0.7


def windows(text: str | None, size: int = WINDOW_BYTES) -> list[bytes]:
    """Runs of whole words of about `size` bytes, A-Z lower-cased; a word over `size` is cut into pieces."""
    out, run, n = [], [], 0
    for word in lower_ascii((text or "").encode("utf-8", "surrogatepass")).split():
        for at in range(0, len(word), size):
            piece = word[at : at + size]
            run.append(piece)
            n += len(piece) + 1
            if n >= size:
                out.append(b" ".join(run))
                run, n = [], 0
    if run:
        out.append(b" ".join(run))
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@lru_cache(maxsize=8)
def compressor(content: bytes):
    form = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    shared.precompute_compress(compression_params=form)
    return zstandard.ZstdCompressor(dict_data=shared, compression_params=form).compress


def trained(samples: list[bytes], size: int) -> bytes:
    """Content of a zstandard dictionary; where samples are too few to train on, their distinct words, the most frequent nearest to the end."""
    if sum(map(len, samples)) < 4 * size:
        return b" ".join(w for w, _ in reversed(Counter(b" ".join(samples).split()).most_common()))[-size:]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def forms(word: bytes) -> tuple[bytes, ...]:
    """The word, and its starts of 4 to 6 characters: endings vary."""
    text = word.decode("utf-8", "ignore")
    return word, *(b"^" + text[:n].encode() for n in (4, 5, 6) if len(text) >= n)


def toxic_words(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> set[bytes]:
    """All forms of words of toxic texts by their log-likelihood ratio in document counts."""
    n1, n0 = len(toxic), len(ordinary)
    c1, c0 = (Counter(f for x in side for f in {f for w in set(b" ".join(x).split()) for f in forms(w)}) for side in (toxic, ordinary))
    least = 2 * math.log(len(c1) + len(c0) + 1) + 10
    found = set()
    for w, k1 in c1.items():
        k0 = c0.get(w, 0)
        if k1 < 3 or k1 / n1 < 4 * k0 / n0:
            continue
        p, p1, p0 = (k1 + k0) / (n1 + n0), k1 / n1, k0 / n0
        ll = lambda k, n, q: (k * math.log(q) if k else 0) + ((n - k) * math.log(1 - q) if n > k else 0)
        g = 2 * (ll(k1, n1, p1) + ll(k0, n0, p0) - ll(k1, n1, p) - ll(k0, n0, p))
        if g > least:
            found.add(w)
    return found


def own_content(toxic: list[list[bytes]], own: set[bytes]) -> bytes:
    """What the toxic dictionary has before the ordinary part: a dictionary trained on the words with a form in own, and before it those of them that it lacks."""
    spans = [hit for x in toxic if (hit := [w for w in b" ".join(x).split() if not own.isdisjoint(forms(w))])]
    if not spans:
        return b""
    content = trained([b" " + b" ".join(hit) + b" " for hit in spans], TOXIC_BYTES)
    lacking = [w for w, _ in reversed(Counter(w for hit in spans for w in hit).most_common()) if w not in content]
    return b" ".join([*lacking, content])


@dataclass
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray  # of the features, the last one the bias

    def features(self, text: str | None) -> list[float]:
        ordinary, toxic = compressor(self.ordinary), compressor(self.toxic)
        d = sorted((len(ordinary(w)) - len(toxic(w)) for w in windows(text)), reverse=True)
        if not d:
            return [0.0] * 6
        top = (d + [min(0, d[-1])] * 3)[:3]
        return [min(top[0], 24) / 8, min(top[1], 24) / 8, min(top[2], 24) / 8, sum(d) / len(d), sum(x >= 3 for x in d) / len(d), math.log1p(len(d)) / 4]

    def scores(self, texts: list[str | None]) -> list[float]:
        if not texts:
            return []
        x = np.array([self.features(t) for t in texts])
        return (1 / (1 + np.exp(-(x @ self.weights[:-1] + self.weights[-1])))).tolist()


def calibrate(x: np.ndarray, y: np.ndarray, share: float, l2: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton steps; the classes weigh as in all labels, not as in the sample."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    w = np.zeros(x.shape[1])
    ridge = np.diag([l2] * (len(w) - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (weight * np.maximum(p * (1 - p), 1e-6))) @ x + ridge, x.T @ (weight * (p - y)) + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> ToxicityModel | None:
    """None without both classes. labels: doc_id, toxic; held out rows are never read."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).where("toxic in (0, 1)").collect()}
    if len(n) < 2:
        return None
    pick = [usable.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows) for k in (0, 1)]
    wanted = pick[0].unionAll(pick[1]).select(F.col("doc_id").alias("l_id"), "toxic")
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), F.col("doc_id") == F.col("l_id")).select("l_id", "toxic", "text")  # 2 x fit_rows ids at most

    def spread(l_id: list, toxic: list, text: list) -> dict[str, list]:
        out = []
        for t in text:
            w = windows(t)
            step = max(1, math.ceil(len(w) * WINDOW_BYTES / fit_bytes))
            out.append([x.decode("utf-8", "ignore") for x in w[::step]])
        return {"l_id": l_id, "toxic": toxic, "windows": out}

    each = map_rows(rows, spread, f"l_id {rows.schema['l_id'].dataType.simpleString()}, toxic int, windows array<string>")
    found = each.groupBy("l_id").agg(F.min(F.struct("toxic", "windows")).alias("r")).select("r.*").distinct().collect()  # one row a doc_id, whichever task comes first
    found = sorted((r["toxic"], [w.encode() for w in r["windows"]]) for r in found if r["windows"])
    made, rest = found[::2], found[1::2]
    sides = [[w for y, w in made if y == k] for k in (1, 0)]
    if not all(sides):
        return None
    ordinary = trained([w for x in sides[1] for w in x], ORDINARY_BYTES)
    model = ToxicityModel(ordinary, own_content(sides[0], toxic_words(*sides)) + ordinary, np.zeros(7))
    x = np.array([model.features(b" ".join(w).decode("utf-8", "ignore")) for _, w in rest])
    y = np.array([k for k, _ in rest])
    if len(rest) and 0 < y.mean() < 1:
        model.weights = calibrate(x, y, n[1] / (n[0] + n[1]))
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, predict_at: float = PREDICT_AT) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text)."""

    def run(doc_id: list, text: list) -> dict[str, list]:
        return {"doc_id": doc_id, "score": model.scores(text) if model else [0.0] * len(text)}

    scored = map_rows(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= predict_at).cast("int").alias("predicted"))
