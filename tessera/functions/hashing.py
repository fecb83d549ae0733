"""Ids and digests of records: native where Spark has them, vectorised functions for framed hashes, name-based UUIDs and compatibility normal form."""

from __future__ import annotations

import hashlib
import unicodedata
import uuid

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions.pieces import mapped
from tessera.functions.text import SPACE, WHITE, redact, trimmed

# Tags that stand for what varies between tasks, in the order in which they are put in; a word ends where no ASCII letter, digit or _ follows.
NO_WORD_BEFORE, NO_WORD_AFTER = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
TASK_TAGS = (
    (rf"(?i)https?://[^{WHITE}]+\b", "<url>"),
    (rf"(?i){NO_WORD_BEFORE}[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}{NO_WORD_AFTER}", "<uuid>"),
    (rf"(?i)(?:[a-z]:\\[^{WHITE}]+|/(?:[^{WHITE}/]+/)+[^{WHITE}]+)", "<path>"),
    (rf"(?i){NO_WORD_BEFORE}[0-9a-f]{{12,}}{NO_WORD_AFTER}", "<hex>"),
    (rf"{NO_WORD_BEFORE}[0-9]+{NO_WORD_AFTER}", "<num>"),
)
ROUND_ID_TAG = "mem.completed_tool_round.id.v3"
TASK_VERSION, LEAST_TASK_BYTES, MOST_TASK_BYTES = 1, 8, 64 << 10


def framed(parts: list[str | None]) -> str:
    """SHA-256 over parts, each after its length as eight bytes: no two lists of parts give one input."""
    h = hashlib.sha256()
    for p in parts:
        b = (p or "").encode()
        h.update(len(b).to_bytes(8, "big"))
        h.update(b)
    return h.hexdigest()


@F.arrow_udf(StringType())
def framed_sha256(parts: pa.Array) -> pa.Array:
    return mapped(framed, parts, pa.string())


@F.arrow_udf(StringType())
def uuid5_oid(name: pa.Array) -> pa.Array:
    return mapped(lambda n: str(uuid.uuid5(uuid.NAMESPACE_OID, n)), name, pa.string())  # text, or bytes


@F.arrow_udf(StringType())
def nfkc(text: pa.Array) -> pa.Array:
    return mapped(lambda t: unicodedata.normalize("NFKC", t), text, pa.string())


def versioned(version: int, value: Column) -> Column:
    """SHA-256 of the version as four little-endian bytes, a zero byte and the text."""
    head = F.unhex(F.lit(version.to_bytes(4, "little").hex() + "00"))
    return F.sha2(F.concat(head, F.encode(value, "UTF-8")), 256)


def content_hash(*columns: str) -> Column:
    """SHA-256 of a canonical JSON of the columns, in order of their names."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"}), 256)


def key_suffix(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 8)


def task_text(text: Column) -> Column:
    """Redacted, compatibility normal form, lower case, what varies replaced by tags, collapsed; null without a letter (those of tags count) or under eight bytes."""
    out = F.lower(nfkc(redact(text)))
    for pattern, tag in TASK_TAGS:
        out = F.regexp_replace(out, pattern, f" {tag} ")
    out = trimmed(F.regexp_replace(out, SPACE + "+", " "))
    return F.when(out.rlike(r"\p{IsAlphabetic}") & (F.octet_length(out) >= LEAST_TASK_BYTES), out)


def le64(n: Column) -> Column:
    """A number as eight little-endian bytes."""
    digits = F.lpad(F.hex(n.cast("bigint")), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, i, 2) for i in range(15, 0, -2))))


def with_length(value: Column) -> Column:
    """The bytes of a text (none where it is null) behind their number."""
    data = F.encode(F.coalesce(value, F.lit("")), "UTF-8")
    return F.concat(le64(F.octet_length(data)), data)


def round_id(stream: list[Column], message_uuid: Column, line: Column, block: Column) -> Column:
    """The id of the round that starts at a block: it stays the same however often the transcript is read."""
    place = F.when(message_uuid.isNotNull(), F.concat(F.unhex(F.lit("01")), with_length(message_uuid))).otherwise(F.concat(F.unhex(F.lit("00")), le64(line), le64(block)))
    return F.concat(F.lit("round_"), uuid5_oid(F.concat(F.encode(F.lit(ROUND_ID_TAG), "UTF-8"), *map(with_length, stream), place)))


def valid_capsule_id(c: Column) -> Column:
    return c.rlike(r"^mem_[0-9a-f]{8}-")
