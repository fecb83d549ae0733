"""Texts of a search within a token budget: what each section shows of its capsules, the outline of a workflow, highlights of recent sessions, and both together for a wake-up.

Rows are picked first (a few of each section), so texts are cut of those alone. `fit` cuts a text to a budget: by subword tokens, or by words where no vocabulary is at hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.codec import success_signals
from tessera.functions.subwords import fit_tokens
from tessera.functions.text import applicability, split_steps, trimmed, within_tokens
from tessera.operators import capsules as C
from tessera.operators import transcripts as T
from tessera.operators.retrieval import ranked
from tessera.plans.capsule_search import Search, pack, section_items, shares_of

# Fixed values of a wake-up.
WAKE_UP_ROWS, WAKE_UP_SESSIONS, WAKE_UP_BLOCKS = 64, 3, 4
LEAST_BUDGET, LEAST_SESSION, LEAST_BLOCK = 80, 40, 20
Fit = Callable[[Column, int], Column]


def by_subwords(text: Column, budget: int) -> Column:
    return fit_tokens(text, budget)


def by_words(text: Column, budget: int) -> Column:
    return within_tokens(text, budget)


def of_section(choices: dict[str, Column]) -> Column:
    out = F.lit(None)
    for name, value in choices.items():
        out = F.when(F.col("section") == name, value).otherwise(out)
    return out


def section_text() -> Column:
    """What a section shows of a capsule: directives and goals their summary, facts their content, patterns their content if it has several lines; each the other text where that is blank."""
    summary, content = F.col("summary"), F.col("content")
    spoken = F.when(trimmed("summary") == "", content).otherwise(summary)
    return of_section({"directive": spoken, "fact": F.when(trimmed("content") == "", summary).otherwise(content), "pattern": F.when(F.contains(content, F.lit("\n")), content).otherwise(summary), "workflow": spoken})


def packed(rows: DataFrame, budget: int, fit: Fit = by_subwords) -> DataFrame:
    """section, pos, capsule_id, text, source_summary, code_refs, applies, steps, signals of ranked capsules, within a budget of tokens (80 at least). A budget of 0 packs nothing."""
    budget, nothing = max(LEAST_BUDGET, budget), budget <= 0
    share = shares_of(budget)
    chosen = pack(rows.where(F.lit(not nothing)), budget)
    text, summary = section_text(), F.col("summary")
    flow = share["workflow"]
    most_steps, most_signals = max(2, section_items(flow)), max(1, section_items(flow))
    each = lambda items, most, n: F.array_compact(F.array(*(fit(F.try_element_at(items, F.lit(i + 1)), n) for i in range(most))))
    of_content, of_summary = split_steps(F.col("content")), split_steps(summary)
    steps = F.when(F.size(of_content) > 0, of_content).otherwise(of_summary)
    only = lambda name, value: F.when(F.col("section") == name, value)
    return chosen.select(
        "section", "pos", "capsule_id", of_section({n: fit(text, flow // 3 + 8 if n == "workflow" else b) for n, b in share.items()}).alias("text"), of_section({n: fit(summary, b // 2 + 8) for n, b in share.items() if n != "workflow"}).alias("source_summary"),
        only("fact", F.col("code_refs")).alias("code_refs"), only("pattern", applicability(F.col("project"), F.col("repo"), F.col("module"))).alias("applies"),
        only("workflow", each(steps, most_steps, flow // most_steps + 6)).alias("steps"), only("workflow", each(success_signals(), most_signals, flow // most_signals + 4)).alias("signals"),
    )


def packed_sessions(highlights: DataFrame, budget: int, cut: Callable[[Column, Column], Column] = fit_tokens) -> DataFrame:
    """session_id, pos, block_id, role, text: the budget is shared by sessions (40 tokens at least), and by the highlights of each (20 at least). A budget of 0 packs nothing. highlights: a bounded
    list (sessions x blocks), as recent_highlights gives it."""
    rows = highlights.where(F.lit(budget > 0))
    sessions = rows.agg(F.count_distinct("session_id").alias("n")).scalar()  # one number
    own = F.greatest(F.lit(LEAST_SESSION), F.floor(F.lit(budget) / F.greatest(F.lit(1), sessions)))
    per_block = F.greatest(F.lit(LEAST_BLOCK), F.floor(own / F.count("*").over(Window.partitionBy("session_id"))))
    return rows.withColumn("own_", per_block).select("session_id", "pos", "block_id", "role", cut(F.col("content"), F.col("own_")).alias("text"))


def wake_up(capsules: DataFrame, blocks: DataFrame | None, s: Search, fit: Fit = by_subwords, cut: Callable[[Column, Column], Column] = fit_tokens) -> tuple[DataFrame, DataFrame | None]:
    """(sections, conversations) for the start of a session: the newest live capsules, those in scope first, get 70 % of the budget (80 tokens at least), and highlights of the newest sessions the rest; without transcripts, the capsules all."""
    own = max(LEAST_BUDGET, s.budget * 70 // 100) if blocks is not None else s.budget
    pool = C.recent_pool(capsules, s.tenant, 4 * WAKE_UP_ROWS).where(C.allowed_in_recall())
    first = [F.when(C.matches_any_scope(s.scope_filters), 0).otherwise(1)] if s.scope_filters else []
    order = (*first, F.desc("updated_at"), F.desc("version"), F.asc("capsule_id"))
    rows = ranked(pool.orderBy(*order).limit(WAKE_UP_ROWS), *order)
    if blocks is None:
        return packed(rows, own, fit), None
    return packed(rows, own, fit), packed_sessions(T.recent_highlights(blocks, s.tenant, WAKE_UP_SESSIONS, WAKE_UP_BLOCKS), s.budget - own, cut)
