"""Codecs and small checks of records: id lists, vectors as bytes, closed domains, paths, error texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

# Lengths that records allow.
MOST_ERROR_BYTES, MOST_PATH_BYTES = 2000, 240


def encode_ids(ids: Column) -> Column:
    return F.to_json(ids)


def decode_ids(raw: Column) -> Column:
    """An empty list where raw is no JSON list."""
    return F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))


def encode_vector() -> object:
    """array<float> -> little-endian bytes."""
    return F.pandas_udf(lambda v: pd.Series([None if x is None else np.asarray(x, "<f4").tobytes() for x in v]), BinaryType())


def decode_vector(dim: int) -> object:
    """Bytes -> array<float>; null where the length is not the dimension's."""
    return F.pandas_udf(lambda v: pd.Series([None if x is None or len(x) != 4 * dim else np.frombuffer(x, "<f4").tolist() for x in v]), ArrayType(FloatType()))


def in_domain(value: Column, domain: tuple[str, ...]) -> Column:
    """The value if the closed domain has it, else null."""
    return F.when(value.isin(*domain), value)


def truncate_error(message: Column) -> Column:
    """At most 2000 bytes; a character is not cut in two."""
    short = F.substring(message, 1, MOST_ERROR_BYTES)
    return F.when(F.octet_length(message) <= MOST_ERROR_BYTES, message).otherwise(F.aggregate(F.split(short, ""), F.lit(""), lambda a, c: F.when(F.octet_length(a) + F.octet_length(c) <= MOST_ERROR_BYTES, F.concat(a, c)).otherwise(a)))


def path_problem(path: Column) -> Column:
    """Null for a sound relative POSIX path."""
    return (
        F.when((path == "") | (F.octet_length(path) > MOST_PATH_BYTES), "length").when(path.startswith("/"), "absolute").when(F.exists(F.split(path, "/"), lambda p: p.isin("", ".", "..")), "segment")
        .when(path.rlike(r"[\x00-\x1f\x7f\\]"), "character")
    )


def case_key(path: Column) -> Column:
    """Two paths that differ in case alone have one key."""
    return F.lower(path)


def within(line: Column, index: Column, start: tuple[Column, Column], stop: tuple[Column, Column]) -> Column:
    """Whether a block lies in a round, ends included."""
    pair = lambda a, b: F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    return pair(line, index).between(pair(*start), pair(*stop))


# Fixed value: what counts as success where a workflow names nothing.
NO_SIGNAL = "task completed without rollback"


def success_signals() -> Column:
    """The evidence as one text, the code references as another; a default text without both."""
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", "))
    found = F.array_compact(F.array(joined("evidence"), joined("code_refs")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(NO_SIGNAL)))


def anchor_nodes() -> Column:
    """The graph nodes a ranked row stands for."""
    node = lambda prefix, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(prefix), c))
    return F.array_compact(F.array(node("capability_capsule:", "capsule_id"), node("project:", "project"), node("repo:", "repo"), node("module:", "module"), F.when(F.col("capsule_type") == "workflow", F.concat(F.lit("workflow:"), "capsule_id"))))


def sql_quote(text: str) -> str:
    """A literal of SQL. Queries of this package bind parameters instead; this serves SQL text that is made for other engines."""
    return "'" + text.replace("'", "''") + "'"
