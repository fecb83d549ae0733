"""Mixing sources to target weights by iterative proportional fitting (raking).

Documents are summed to cells (source, language, topic) of tokens, pre-aggregated before their one small shuffle. A document is kept with the
probability of its cell, 1 at most. The sample's size is a given share of the tokens of all cells that have a target (`SHARE`, expected), whatever cells
there are. The cells' probabilities are raked: each round scales those of the cells that are not yet whole until the kept tokens of sources, then of languages,
then of topics have the target shares, and all three hold. A category that has fewer tokens than its target share of the sample is kept whole and the others
share what it lacks, so a rare category neither shrinks the sample nor the others. The draw is a hash of the document, so a lost executor redraws alike.
Where no probabilities meet all margins at this size, the rounds end when they bring nothing more; `residual` tells how far the worst category then is
from its target, as a share of the sample (below TOLERANCE where the targets hold). A smaller share leaves more room for far targets.

Targets are given as shares, or as a power of the corpus's own token shares (0 uniform, 1 as they are). Cells number at most
|sources| x |languages| x |topics|: up to `max_cells` they are raked on the driver and their probabilities broadcast; beyond that the same rounds run
as DataFrame aggregations and documents join their cells.

The topic of a document is the first of `TOPICS` whose pattern it matches. Tokens are words ([^\\x20\\x09-\\x0D]+).

Defined results: null source or language is a category of its own. Documents without words weigh nothing: they are kept with the probability of
their cell, or 1.0 where the cell has no tokens. Repeated rows (same doc_id and text) are kept or dropped together. Extra columns do no harm.
Target names that the corpus lacks are left out and the other shares scaled up; categories without a target get the share 0 and are dropped.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

TOPICS = (
    ("license", r"(?i)\b(licen[sc]ed?|copyright|all rights reserved)\b"),
    ("contact", r"@[A-Za-z0-9-]+\.|\+?\(?\d{3}\)?[ -]\d{3}"),
    ("table", r"\|.*\|"),
    ("list", r"(?m)^\s*[-*•]\s"),
    ("question", r"\?"),
)
OTHER_TOPIC = "prose"
MARGINS = ("source", "lang", "topic")
#: Powers of the corpus's shares that the targets are: sources and languages are evened out, topics stay.
POWERS: dict[str, float | Mapping[str, float]] = {"source": 0.7, "lang": 0.7, "topic": 1.0}
#: Tokens of the sample, as a share of the tokens in cells that have a target.
SHARE = 2 / 3
ROUNDS, TOLERANCE = 100, 1e-9
#: Rounds without a closer one after which targets count as out of reach.
STALLED = 10
MAX_CELLS = 50_000
SEED = "mix-1"
NONE = "\x00none"


def topic_of(text: Column) -> Column:
    out = F.lit(OTHER_TOPIC)
    for name, pattern in reversed(TOPICS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def cell_columns(docs: DataFrame) -> dict[str, Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return {
        "source": F.coalesce(F.col("source").cast("string"), F.lit(NONE)),
        "lang": F.coalesce(F.col("lang").cast("string"), F.lit(NONE)),
        "topic": topic_of(text),
        "tokens": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"),
    }


def shares(totals: Mapping[str, float], target: float | Mapping[str, float]) -> dict[str, float]:
    """Target share of each category of the corpus."""
    raw = {k: (v**target if v > 0 else 0.0) for k, v in totals.items()} if not isinstance(target, Mapping) else {k: float(target.get(k, 0.0)) if v > 0 else 0.0 for k, v in totals.items()}
    total = sum(raw.values())
    return {k: v / total if total else 0.0 for k, v in raw.items()}


def filled(total: np.ndarray, share: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
    """Tokens wanted of each category: its share of `size`, or all it has where that is less and the others share the rest; and which are wanted whole."""
    level, n = 0.0, -1
    while True:
        whole = level * share >= total
        if whole.sum() == n or whole.all():
            return np.minimum(total, level * share), whole
        n = whole.sum()
        level = (size - total[whole].sum()) / share[~whole].sum()


class Progress:
    """Tells when to stop: the worst gap is within the tolerance, or has not shrunk for STALLED rounds."""

    def __init__(self, tolerance: float):
        self.tolerance, self.best, self.since = tolerance, np.inf, 0

    def done(self, worst: float) -> bool:
        self.since = 0 if worst < self.best * 0.999 else self.since + 1
        self.best = min(self.best, worst)
        return worst < self.tolerance or self.since >= STALLED


def rake(cells: pd.DataFrame, targets: Mapping[str, float | Mapping[str, float]], share: float = SHARE, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> pd.DataFrame:
    """cells (source, lang, topic, tokens) with `probability`: kept tokens are `share` of all, and along each margin in the target shares as closely as the cells allow."""
    out = cells.copy()
    t = out["tokens"].to_numpy(float)
    codes, given, wanted = {}, {}, {}
    for m in MARGINS:
        codes[m], names = pd.factorize(out[m], sort=True)
        totals = dict(zip(names, np.bincount(codes[m], t, len(names)), strict=True))
        of = shares(totals, targets[m])
        given[m] = np.array([of[k] for k in names], float)
    open_ = (t > 0) & np.logical_and.reduce([given[m][codes[m]] > 0 for m in MARGINS])
    t = np.where(open_, t, 0.0)
    size = share * t.sum()
    u = np.where(open_, share, 0.0)  # the probability before it is cut at 1
    for m in MARGINS:
        wanted[m], whole = filled(np.bincount(codes[m], t, len(given[m])).astype(float), given[m], size)
        u = np.where(open_ & whole[codes[m]], np.inf, u)
    progress, worst = Progress(tolerance), 0.0
    for _ in range(rounds if size > 0 else 0):
        worst = 0.0
        for m in MARGINS:
            want, n = wanted[m], len(wanted[m])
            have = np.bincount(codes[m], t * np.minimum(u, 1.0), n).astype(float)
            free = np.bincount(codes[m], np.where(u < 1, t * u, 0.0), n).astype(float)
            worst = max(worst, float(np.abs(have - want).max(initial=0.0)) / size)
            step = np.divide(want - have + free, free, out=np.zeros(n), where=free > 0)  # a Newton step; from below it never goes too far
            back = np.divide(want, have, out=np.ones(n), where=have > 0) ** 4
            factor = np.where(have < want, step, np.maximum(step, back))
            u = u * np.where(factor > 0, factor, 1.0)[codes[m]]
        if progress.done(worst):
            break
    out["probability"] = np.where(out["tokens"] > 0, np.minimum(u, 1.0), 1.0)
    out["residual"] = worst
    return out


def rake_distributed(cells: DataFrame, targets: Mapping[str, float | Mapping[str, float]], share: float = SHARE, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """The same for any number of cells: each margin's sums are aggregated and joined back. Written each round, so lineage stays short."""
    w = cells.withColumn("t", F.greatest(F.col("tokens").cast("double"), F.lit(0.0)))
    given, wanted = {}, {}
    for m in MARGINS:
        own = cells.groupBy(m).agg(F.sum("tokens").cast("double").alias("total"))
        if isinstance(targets[m], Mapping):
            named = F.create_map(*[F.lit(x) for kv in targets[m].items() for x in kv])
            raw = F.when(F.col("total") > 0, F.coalesce(F.try_element_at(named, F.col(m)), F.lit(0.0))).otherwise(0.0)
        else:
            raw = F.when(F.col("total") > 0, F.pow("total", F.lit(float(targets[m])))).otherwise(0.0)
        own = own.select(m, raw.alias("raw"))
        all_raw = own.agg(F.sum("raw")).first()[0] or 1.0
        given[m] = written(own.select(m, (F.col("raw") / F.lit(all_raw)).alias("given")), f"margin-{m}", 8)
        w = w.join(given[m], m).withColumn("t", F.when(F.col("given") > 0, F.col("t")).otherwise(0.0)).drop("given")
    w = written(w.withColumn("u", F.when(F.col("t") > 0, F.lit(float(share))).otherwise(0.0)), "raked", 8)
    size = share * (w.agg(F.sum("t")).first()[0] or 0.0)
    start = w
    for m in MARGINS:
        own = written(w.groupBy(m).agg(F.sum("t").alias("total")).join(given[m], m), f"margin-{m}", 8)
        level, n, whole = 0.0, -1, F.col("total") <= 0
        while True:  # as filled() does
            now, rest, taken = own.agg(F.count_if(whole), F.sum(F.when(~whole, F.col("given"))), F.sum(F.when(whole, F.col("total")))).first()
            if now == n or not rest:
                break
            n, level = now, (size - (taken or 0.0)) / rest
            whole = F.lit(level) * F.col("given") >= F.col("total")
        wanted[m] = written(own.select(m, F.least("total", F.lit(level) * F.col("given")).alias("wanted"), whole.alias("whole")), f"wanted-{m}", 8)
        start = start.join(wanted[m].select(m, "whole"), m).withColumn("u", F.when(F.col("whole") & (F.col("t") > 0), F.lit(float("inf"))).otherwise(F.col("u"))).drop("whole")
    w, progress, worst = written(start, "raked", 8), Progress(tolerance), 0.0
    for _ in range(rounds if size > 0 else 0):
        worst = 0.0
        for m in MARGINS:
            sums = w.groupBy(m).agg(F.sum(F.col("t") * F.least("u", F.lit(1.0))).alias("have"), F.sum(F.when(F.col("u") < 1, F.col("t") * F.col("u")).otherwise(0.0)).alias("free")).join(wanted[m], m)
            worst = max(worst, (sums.agg(F.max(F.abs(F.col("have") - F.col("wanted")))).first()[0] or 0.0) / size)
            step = F.when(F.col("free") > 0, (F.col("wanted") - F.col("have") + F.col("free")) / F.col("free")).otherwise(0.0)
            back = F.when(F.col("have") > 0, F.pow(F.col("wanted") / F.col("have"), F.lit(4.0))).otherwise(1.0)
            factor = F.when(F.col("have") < F.col("wanted"), step).otherwise(F.greatest(step, back))
            w = w.join(sums.select(m, F.when(factor > 0, factor).otherwise(1.0).alias("factor")), m).withColumn("u", F.col("u") * F.col("factor")).drop("factor")
        w = written(w, "raked", 8)
        if progress.done(worst):
            break
    return w.withColumn("probability", F.when(F.col("tokens") <= 0, 1.0).otherwise(F.least("u", F.lit(1.0)))).withColumn("residual", F.lit(worst))


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the document itself."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 11) / F.lit(float(1 << 53))


def mix(docs: DataFrame, targets: Mapping[str, float | Mapping[str, float]] = POWERS, max_cells: int = MAX_CELLS, seed: str = SEED, share: float = SHARE, keep: tuple[str, ...] | None = None) -> DataFrame:
    """For each row of docs: `row` (its columns, or those of `keep`, as a struct), source, lang, topic, tokens, probability, residual and kept.

    Texts are read once: what is told of them is written with the row, then summed, then drawn from."""
    spark = docs.sparkSession
    row = F.struct(*(F.col(f"`{c}`") for c in keep or docs.columns)).alias("row")
    held = written(docs.select(row, *(c.alias(n) for n, c in cell_columns(docs).items()), draw(F.col("doc_id"), F.col("text"), seed).alias("drawn")), "told")
    cells = written(held.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_docs")), "cells", 8)
    if cells.count() <= max_cells:
        raked = rake(cells.toPandas().sort_values(list(MARGINS)), targets, share)
        known = spark.createDataFrame(raked[[*MARGINS, "probability", "residual"]], "source string, lang string, topic string, probability double, residual double")
        known = F.broadcast(known)  # max_cells rows at most
    else:
        known = rake_distributed(cells, targets, share).select(*MARGINS, "probability", "residual")
    return held.join(known, list(MARGINS), "left").select("row", *MARGINS, "tokens", "probability", "residual", (F.col("drawn") < F.col("probability")).alias("kept"))


def sample_documents(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs that the mixture keeps, columns as they were."""
    return mix(docs, **settings).where("kept").select("row.*")
