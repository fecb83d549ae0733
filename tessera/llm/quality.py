"""Quality rules: gradient-boosted trees over document statistics, with monotonic constraints, scored from flat numpy node arrays.

Statistics come from whole texts in one pass and one stage; no shuffle. The trees are fitted on the driver to the statistics of at most
`fit_rows` labelled documents (those with the least hash of doc_id: a uniform sample; only numbers, no texts, leave the executors). A split on a
constrained feature is taken only if the better side is the right one, and the bound between both sides holds for everything below it, so the
score never rises with, say, the share of repeated words.

Defined results: a null or empty text has no words, fails the base rules and is not kept. Without usable labels (none, or one class) the
model passes everything and the base rules decide. Equal texts get equal results; repeated rows stay. A doc_id labelled more than once takes its
lowest quality. Null doc_ids are judged like others but teach nothing. Extra columns do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_rows, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
#: Labelled documents that the trees are fitted to, at most.
FIT_ROWS = 20_000
KEEP_AT = 0.5

#: Features of the trees, and the direction in which quality may move with each (0: free).
FEATURES = {
    "log_words": 0, "mean_word_chars": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "digit_share": 0,
    "mark_share": 0, "log_lines": 0, "words_per_line": 0, "distinct_share": 0, "stop_line_share": 0, "longest_word": 0, "exclaim_per_word": -1, "bar_per_word": -1,
}


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the contract."""
    words = words_of(text)
    if not words:
        return 0, 0, sum(map((text or "").count, SYMBOLS)), 0, 0
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [x for x in text.encode("utf-8", "surrogatepass").split(b"\n") if x.strip()] if "\n" in text else []
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a run of `window` words found twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    code = w[:n]
    for i in range(1, window):  # exact: after each step the pairs are numbered anew
        code = code * len(ids) + w[i : i + n]
        if i + 1 < window and len(ids) ** 3 >= 2**62:
            code = np.unique(code, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    if not same.any():
        return 0
    starts = np.zeros(len(words) + 1, np.int32)
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    at = np.flatnonzero(hit)
    np.add.at(starts, at, 1)
    np.add.at(starts, at + window, -1)
    return int(np.count_nonzero(np.cumsum(starts[:-1])))


def statistics(text: str | None) -> tuple[tuple[int, ...], list[float]]:
    base = base_counts(text)
    n_words, word_chars, n_symbols, n_dup, n_repeat = base
    if not n_words:
        return base, [0.0] * len(FEATURES)
    lines = text.split("\n")
    words = text.split()
    chars = max(word_chars, 1)
    upper = sum(map(str.isupper, words))
    digits = sum(map(text.count, "0123456789"))
    marks = sum(map(text.count, ".,;:?!"))
    stops = sum(x.rstrip().endswith((".", "!", "?")) for x in lines)
    features = [
        np.log1p(n_words), word_chars / n_words, n_symbols / n_words, n_dup / len(lines), n_repeat / n_words, upper / n_words, digits / chars,
        marks / n_words, np.log1p(len(lines)), n_words / len(lines), len(set(words)) / n_words, stops / len(lines), np.log1p(max(map(len, words), default=0)), text.count("!") / n_words, text.count("|") / n_words,
    ]
    return base, [float(x) for x in features]


@dataclass
class Trees:
    """All trees in flat arrays: a node is a feature, a threshold (<= goes left), two children and a value; leaves are their own children."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities; all rows step through all trees at once."""
        rows = np.arange(len(x))[:, None]
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.bias + self.value[node].sum(axis=1))))


def fit_trees(x: np.ndarray, y: np.ndarray, constraints: list[int], n_trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 10, l2: float = 1.0) -> Trees:
    """Second-order boosting of log loss over quantile bins. The classes count alike, whatever their shares."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots, raw = [], np.zeros(len(y))

    def leaf(at: int, v: float) -> None:
        nodes[at][:] = [0, np.inf, at, at, v]

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        at = len(nodes)
        nodes.append([0, 0, 0, 0, 0])
        weigh = lambda a, b: np.clip(-a / (b + l2), low, high)
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[rows, f]
                gl, hl, nl = (np.cumsum(np.bincount(b, v, len(c) + 1))[:-1] for v in (g[rows], h[rows], None))
                wl, wr = weigh(gl, hl), weigh(gs - gl, hs - hl)
                gain = -(gl * wl + 0.5 * (hl + l2) * wl**2) - ((gs - gl) * wr + 0.5 * (hs - hl + l2) * wr**2)
                w = weigh(gs, hs)
                gain += gs * w + 0.5 * (hs + l2) * w**2
                ok = (nl >= least) & (len(rows) - nl >= least) & (constraints[f] * (wr - wl) >= 0)
                if ok.any() and (top := int(np.argmax(np.where(ok, gain, -np.inf)))) >= 0 and gain[top] > best[0]:
                    best = (gain[top], (f, top, float(wl[top]), float(wr[top])))
        if best[1] is None:
            v = float(weigh(gs, hs)) * rate
            leaf(at, v)
            raw[rows] += v
            return at
        f, k, wl, wr = best[1]
        middle, way = (wl + wr) / 2, constraints[f]
        goes_left = binned[rows, f] <= k
        left = grow(rows[goes_left], g, h, level + 1, *((low, middle) if way > 0 else (middle, high) if way < 0 else (low, high)))
        right = grow(rows[~goes_left], g, h, level + 1, *((middle, high) if way > 0 else (low, middle) if way < 0 else (low, high)))
        nodes[at][:] = [f, cuts[f][k], left, right, 0]
        return at

    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-raw))
        roots.append(grow(np.arange(len(y)), weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6), 0, -4.0, 4.0))
    a = np.array(nodes)
    return Trees(a[:, 0].astype(np.int32), a[:, 1], a[:, 2].astype(np.int32), a[:, 3].astype(np.int32), a[:, 4], np.array(roots, np.int32), depth, 0.0)


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Trees | None:
    """Trees fitted to labels.quality; None without both classes."""
    wanted = (
        labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).select(F.col("doc_id").alias("l_id"), "quality")
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(wanted), F.col("doc_id") == F.col("l_id")).select("l_id", "quality", "text")  # fit_rows rows of two numbers at most
    each = map_rows(sample, _fit_columns, f"l_id {sample.schema['l_id'].dataType.simpleString()}, quality int, x array<double>")
    found = each.groupBy("l_id").agg(F.min(F.struct("quality", "x")).alias("r")).select("r.*").toPandas()  # one row a doc_id, whichever task comes first
    rows = sorted(zip(map(tuple, found["x"]), found["quality"], strict=True))  # the order of arrival must not matter
    y = np.array([q for _, q in rows], float)
    if len(y) == 0 or y.min() == y.max():
        return None
    return fit_trees(np.array([x for x, _ in rows], float), y, list(FEATURES.values()))


def _fit_columns(l_id: list, quality: list, text: list) -> dict[str, list]:
    return {"l_id": l_id, "quality": quality, "x": [statistics(t)[1] for t in text]}


def judge_quality(docs: DataFrame, trees: Trees | None, keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, the counts, base_failed, score and kept for each row of docs (doc_id, text)."""

    def judge(doc_id: list, text: list) -> dict[str, list]:
        found = [statistics(t) for t in text]
        base = [b for b, _ in found]
        score = trees.score(np.array([x for _, x in found], float)) if trees and found else np.ones(len(found))
        failed = [n < MIN_WORDS or 100 * r > MAX_REPEAT_PERCENT * n for n, _, _, _, r in base]
        out = dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), map(list, zip(*base)), strict=True)) if base else dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), [])
        return out | {"doc_id": doc_id, "base_failed": failed, "score": score.tolist(), "kept": [not f and s >= keep_at for f, s in zip(failed, score.tolist(), strict=True)]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), judge, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean")


def keep_good(docs: DataFrame, trees: Trees | None, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of docs that judge_quality keeps, all columns, in place: the verdict is a column of the same pass, so nothing is joined."""
    names = docs.columns
    verdict = "kept_"
    while verdict in names:
        verdict += "_"

    def judge(*columns: list) -> dict[str, list]:
        text = columns[names.index("text")]
        found = [statistics(t) for t in text]
        score = trees.score(np.array([x for _, x in found], float)) if trees and found else np.ones(len(found))
        kept = [not (b[0] < MIN_WORDS or 100 * b[4] > MAX_REPEAT_PERCENT * b[0]) and s >= keep_at for (b, _), s in zip(found, score.tolist(), strict=True)]
        return dict(zip(names, columns, strict=True)) | {verdict: kept}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_rows(docs, judge, f"{schema}, `{verdict}` boolean").where(F.col(f"`{verdict}`")).drop(verdict)
