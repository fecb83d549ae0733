"""SQL of DuckDB that more than one query needs, written from the rules, not from the Spark code."""

from __future__ import annotations

from tessera.functions.text import WHITE
from tessera.operators.retrieval import UNSPACED

SPACE = f"[{WHITE}]"


def trim(x: str) -> str:
    return f"trim({x}, '{WHITE}')"


def words(x: str) -> str:
    """Search tokens: words as written, unspaced scripts in pairs of neighbours."""
    runs = f"regexp_extract_all(regexp_replace(coalesce({x}, ''), '([{UNSPACED}]+)', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}\\p{{M}}]+')"
    return f"flatten(list_transform({runs}, lambda r: CASE WHEN length(r) > 1 AND regexp_matches(r, '^[{UNSPACED}]') THEN list_transform(generate_series(1, length(r) - 1), lambda i: substring(r, i, 2)) ELSE [r] END))"


def fingerprint(x: str) -> str:
    """Distinct content tokens, first ones first."""
    runs = f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+')"
    cut = f"list_transform({runs}, lambda r: CASE WHEN regexp_matches(r, '^[a-z0-9]+$') THEN CASE WHEN length(r) >= 4 THEN [r] ELSE CAST([] AS VARCHAR[]) END WHEN length(r) >= 2 THEN list_transform(generate_series(1, length(r) - 1), lambda i: substring(r, i, 2)) ELSE CAST([] AS VARCHAR[]) END)"
    return f"flatten({cut})"
