"""URL filters by a Bloom filter cascade: exact membership of listed keys without a join.

Level 1 encodes the listed keys. Level 2 encodes those unlisted keys of the corpus that level 1 lets through, level 3 those listed keys that
level 2 lets through, and so on until none is left. The universe is every key that any url of the corpus can form, so on that corpus the
cascade never errs. Its size follows the list, not the corpus: level 1 has a false positive rate of about |listed| / |universe|.
DataFrame functions only; the bits travel as a literal of checked size. A list whose cascade would be larger is split by a hash of the key into as
many shards as it takes, each with a cascade of its own over its part of the universe; urls pass one cascade after the other, without a join.

A rule is a host and a path prefix, like `example.com/en/7`. The keys of a url are, for each shape of rule (labels of the host, characters of
the path), the end of its host and the start of its path. The rule that applies is the longest key that is listed (ties: block before allow
cannot arise, as equal keys are one rule; between two keys of one length the smaller string wins).

Defined results: a null url, or one without ://, has empty host and path and no rule. A url that no rule fits is allowed, as it is not listed.
Repeated rows get equal verdicts; extra columns do no harm.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, written

RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Bits of all levels of one cascade that may travel with a plan; 8 MB.
MAX_BITS = 64 << 20
#: Fewer cannot hold a single key among a few others.
LEAST_BITS = 16


def url_parts(url: Column) -> tuple[Column, Column]:
    at = "(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, at, 1)), F.regexp_extract(url, at, 2)


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def shapes_of(rules: list[str]) -> list[tuple[int, int]]:
    return sorted({(host.count(".") + 1, len(path)) for host, path in map(split_rule, rules)})


def candidate_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Array of the keys that a url can match. Bounded by the shapes of the rules."""
    keys = [F.when((host != "") & (F.char_length(path) >= n), F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, n))) for labels, n in shapes]
    return F.array_distinct(F.array_compact(F.array(*keys)))


@dataclass
class Level:
    bits: int
    hashes: int
    words: list[int]

    def holds(self, key: Column, level: int) -> Column:
        """Bloom test of key; the words are folded into one literal when the plan is made."""
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        out = F.lit(True)
        for p in positions(key, level, self.hashes, self.bits):
            out = out & (F.shiftrightunsigned(F.element_at(words, (F.shiftright(p, 6) + 1).cast("int")), 0).bitwiseAND(one_bit(p)) != 0)
        return out


def one_bit(p: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), p.bitwiseAND(F.lit(63)).cast("int"))


def positions(key: Column, level: int, hashes: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level), F.lit(i), key), F.lit(bits).cast("bigint")) for i in range(hashes)]


def bloom(keys: DataFrame, level: int, n: int, rate: float) -> Level:
    """Filter of n keys (column `key`) with about the given rate of false positives, built by aggregation; at most bits / 64 rows reach the driver."""
    bits = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64) * 64)
    hashes = max(1, round(-math.log2(rate)))
    set_bits = keys.select(F.explode(F.array(*positions(F.col("key"), level, hashes, bits))).alias("p"))
    found = set_bits.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(one_bit(F.col("p"))).alias("b"))
    words = [0] * (bits // 64)
    for row in found.collect():
        words[row["w"]] = row["b"]
    return Level(bits, hashes, words)


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)

    @property
    def bits(self) -> int:
        return sum(x.bits for x in self.levels)

    def contains(self, key: Column) -> Column:
        """In level 1 and not in level 2, or in level 3 and not in level 4, ...: the first level that does not hold the key decides."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(self.levels[i].holds(key, i + 1), out).otherwise(F.lit(i % 2 == 1))
        return out


def build_cascade(listed: DataFrame, universe: DataFrame, max_bits: int = MAX_BITS) -> Cascade | None:
    """listed, universe: column `key`. None if the bits would exceed max_bits. Keys that the filter must tell apart stay in DataFrames."""
    listed = written(listed.distinct(), "listed")
    others = written(universe.distinct().join(listed, "key", "left_anti"), "universe")
    n, m = listed.count(), others.count()
    cascade = Cascade()
    if n == 0:
        return cascade
    inside, outside = listed, others  # what the next level encodes, and what it must keep out
    rate = min(0.5, max(n, 1) * math.sqrt(0.5) / max(m, 1))
    while True:
        if cascade.bits + n * -math.log(rate) / math.log(2) ** 2 > max_bits:
            return None
        level = bloom(inside, len(cascade.levels) + 1, n, rate)
        cascade.levels.append(level)
        through = written(outside.where(level.holds(F.col("key"), len(cascade.levels))), f"through-{len(cascade.levels)}")
        n, rate = through.count(), 0.5
        if n == 0:
            return cascade
        inside, outside = through, inside


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """key, verdict; literals in the plan."""
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(r).alias("key"), F.lit(v).alias("verdict")) for r, v in rules))))


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(shards).cast("bigint"))


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] | DataFrame = RULES, max_bits: int = MAX_BITS, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keep, host, path, rule, verdict for each row of pages. rules: pairs, or a table (key, verdict) for long lists."""
    spark: SparkSession = pages.sparkSession
    listed = rules if isinstance(rules, DataFrame) else rule_table(spark, rules)
    if isinstance(rules, DataFrame):
        host_, path_ = F.substring_index("key", "/", 1), F.regexp_extract("key", "(/.*)$", 1)
        shapes = sorted((r["l"], r["n"]) for r in rules.select(F.regexp_count(host_, F.lit("[.]")).alias("l") + 1, F.char_length(path_).alias("n")).toDF("l", "n").distinct().collect())
    else:
        shapes = shapes_of([r for r, _ in rules])
    host, path = url_parts(F.col(url))
    parts = pages.select(*keep, host.alias("host"), path.alias("path"))
    keyed = parts.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), shapes)).withColumn("hits", F.expr("CAST(array() AS array<struct<n: int, k: string, blocked: boolean>>)"))
    universe = written(keyed.select(F.explode("keys").alias("key")).distinct(), "keys")
    if max_bits < LEAST_BITS:
        raise ValueError(f"max_bits = {max_bits}: at least {LEAST_BITS}")
    n, m = listed.count(), universe.count()
    bits = 1.2 * n * -math.log(min(0.5, max(n, 1) * math.sqrt(0.5) / max(m, 1))) / math.log(2) ** 2
    shards = 1 << max(0, math.ceil(math.log2(max(bits, 1) / max_bits)))
    while (cascades := sharded(listed, universe, shards, max_bits)) is None:
        shards *= 2
    for i, (member, blocked) in enumerate(cascades):
        keyed = keyed.withColumn("hits", F.concat("hits", hits_in(member, blocked, i, shards)))
        if shards > 1:
            keyed = written(keyed, "judged")  # the bits of one shard at a time travel with a plan
    first = F.try_element_at(F.array_sort("hits"), F.lit(1))
    return keyed.withColumn("hit", first).select(*keep, "host", "path", F.col("hit.k").alias("rule"), F.when(F.col("hit.blocked"), "block").otherwise("allow").alias("verdict"))


def hits_in(member: Cascade, blocked: Cascade, shard: int, shards: int) -> Column:
    """The keys of a url that are listed in a shard: (minus its length, key, whether it blocks), so that the longest sorts first."""
    own = F.filter("keys", lambda k: (shard_of(k, shards) == shard) & member.contains(k))
    return F.transform(own, lambda k: F.struct((-F.char_length(k)).alias("n"), k.alias("k"), blocked.contains(k).alias("blocked")))


def sharded(listed: DataFrame, universe: DataFrame, shards: int, max_bits: int) -> list[tuple[Cascade, Cascade]] | None:
    """For each shard, what tells listed keys from the universe, and blocked keys from listed ones; None if a shard needs more bits than may travel."""
    out = []
    for i in range(shards):
        in_shard = F.lit(True) if shards == 1 else shard_of(F.col("key"), shards) == i
        mine = listed.where(in_shard)
        member = build_cascade(mine.select("key"), universe.where(in_shard), max_bits)
        blocked = member and build_cascade(mine.where("verdict = 'block'").select("key"), mine.select("key"), max_bits)
        if member is None or blocked is None:
            return None
        out.append((member, blocked))
    return out
