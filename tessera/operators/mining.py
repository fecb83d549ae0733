"""Batch mining over capsules, episodes and graphs: co-occurrence, shared topics, recurring workflows, near-duplicates, evolution, fact checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import jaccard, normalize_alias, workflow_key
from tessera.operators.capsules import is_episodic, is_guidance, themes
from tessera.operators.neighbours import nearest_in_band, similarity_forest
from tessera.operators.retrieval import SCALE, components, similarity_pairs
from tessera.operators.set_match import best_match
from tessera.operators.storage import first_of_each


def cooccurrence(capsules: DataFrame, least: int) -> DataFrame:
    """Unordered topic pairs of one capsule, counted per project: pairs are made within the (short) topic list of a row, so nothing is joined."""
    t = F.array_sort(F.array_distinct("topics"))
    pairs = F.flatten(F.transform(t, lambda a: F.transform(F.filter(t, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return capsules.select("project", F.explode(pairs).alias("p")).groupBy("project", "p.a", "p.b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def topic_tunnels(capsules: DataFrame, least: int) -> DataFrame:
    """Project pairs that share at least `least` topics, one row for each shared topic. The join is of distinct (topic, project)."""
    t = capsules.select("project", F.explode("topics").alias("topic")).where("project is not null").distinct()
    pairs = t.select(F.col("project").alias("p1"), "topic").join(t.select(F.col("project").alias("p2"), "topic"), "topic").where("p1 < p2")
    counts = pairs.groupBy("p1", "p2").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    return pairs.join(counts, ["p1", "p2"]).select("p1", "p2", "topic", "shared")


def recurrent_workflows(episodes: DataFrame, least: int = 2) -> DataFrame:
    """Successful episodes of one goal and steps, found `least` times or more, with all their evidence."""
    e = episodes.where("outcome = 'success'").withColumn("key", workflow_key(F.col("goal"), F.col("steps")))
    counted = e.groupBy("tenant", "key").agg(F.count("*").alias("n"), F.min("episode_id").alias("first_id"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"))
    return counted.where(F.col("n") >= least)


def ingest_episodes(history: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(episodes, drafts). Each tenant with a new episode gets a draft of the first workflow (by goal and steps in normal form) that two of its successful episodes share, old
    or new: content, evidence and a key under which a draft lands once. episodes: episode_id, tenant, goal, steps, outcome, evidence."""
    every = history.unionByName(incoming.select(*history.columns))
    mine = every.where(normalize_alias(F.col("outcome")) == "success").join(incoming.select("tenant").distinct(), "tenant", "left_semi")
    e = mine.withColumn("key", workflow_key(F.col("goal"), F.col("steps"))).withColumn("g", normalize_alias(F.col("goal"))).withColumn("s", F.transform("steps", normalize_alias))
    counted = e.groupBy("tenant", "key").agg(F.count("*").alias("n"), F.first("g").alias("goal"), F.first("s").alias("steps")).where("n >= 2")
    first = counted.groupBy("tenant").agg(F.min_by(F.struct("key", "goal", "steps"), "key").alias("w")).select("tenant", "w.*")
    proof = e.join(first.select("tenant", "key"), ["tenant", "key"]).select("tenant", "key", F.explode("evidence").alias("x")).distinct().groupBy("tenant", "key").agg(F.array_sort(F.collect_list("x")).alias("evidence"))
    lines = F.transform("steps", lambda x: F.concat(F.lit("- "), x, F.lit("\n")))
    content = F.concat(F.lit("workflow goal: "), "goal", F.lit("\nsteps:\n"), F.array_join(lines, ""), F.lit("success signals:\n- outcome == success"))
    drafts = first.join(proof, ["tenant", "key"], "left")
    return every, drafts.select("tenant", F.concat(F.lit("workflow:"), F.sha2("key", 256)).alias("idempotency_key"), content.alias("content"), F.coalesce("evidence", F.expr("CAST(array() AS array<string>)")).alias("evidence"), F.array(F.lit("workflow_candidate")).alias("tags"))


def corecall(capsules: DataFrame, linked: DataFrame, least: int = 2, most: int = 12) -> DataFrame:
    """Pairs recalled at one instant, in batches of 2 to 12, not linked yet. Larger batches are left out before any pair is made."""
    r = capsules.where("status = 'active' and last_recalled_at is not null").select("tenant", "last_recalled_at", "capsule_id")
    size = r.groupBy("tenant", "last_recalled_at").agg(F.count("*").alias("n")).where(F.col("n").between(least, most))
    r = r.join(size, ["tenant", "last_recalled_at"])
    pairs = r.select("tenant", "last_recalled_at", F.col("capsule_id").alias("a")).join(r.select("tenant", "last_recalled_at", F.col("capsule_id").alias("b")), ["tenant", "last_recalled_at"]).where("a < b")
    return pairs.select("a", "b").join(linked.select("a", "b"), ["a", "b"], "left_anti")


def clusters(capsules: DataFrame, vectors: DataFrame, threshold: float, keys: tuple[str, ...]) -> DataFrame:
    """capsule_id, root, of capsules alike within equal keys; a capsule alone is its own root."""
    v = vectors.join(capsules.select("capsule_id", *keys), "capsule_id")
    roots = components(similarity_forest(v.select("capsule_id", "embedding", *keys), threshold, keys=keys))
    return v.select("capsule_id").distinct().join(roots.withColumnRenamed("node", "capsule_id"), "capsule_id", "left").withColumn("root", F.coalesce("root", "capsule_id"))


def near_duplicate_groups(capsules: DataFrame, vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """capsule_id, root, survivor: within (agent, project, repo); the longest content survives, then the earliest."""
    keys = ("source_agent", "project", "repo")
    live = capsules.where("status = 'active'")
    grouped = clusters(live, vectors, threshold, keys).join(live, "capsule_id")
    best = first_of_each(grouped, ["root"], F.desc(F.octet_length("content")), F.asc("created_at"), F.asc("capsule_id")).select("root", F.col("capsule_id").alias("survivor"))
    return grouped.join(best, "root").select("capsule_id", "root", "survivor")


def band_links(vectors: DataFrame, low: float, high: float, most: int = 4, keys: tuple[str, ...] = ()) -> DataFrame:
    """Neighbours in a band of similarity, the best `most` of each capsule (of equal keys: tenant, model): from, to, sim."""
    return nearest_in_band(vectors, most, low, high, keys)


def detect_merge(clustered: DataFrame) -> DataFrame:
    """Clusters of two or more that are no guidance, without members that supersede a member: root, members."""
    m = clustered.where(~is_guidance())
    ids = m.select("root", F.col("capsule_id").alias("supersedes_id"))
    free = m.join(ids, ["root", "supersedes_id"], "left_anti")
    return free.groupBy("root").agg(F.array_sort(F.collect_list("capsule_id")).alias("members")).where(F.size("members") >= 2)


def detect_generalize(clustered: DataFrame, least: int = 4, least_themes: int = 2, confidence: float = 0.6) -> DataFrame:
    """Four or more episodic members with two shared themes and a mean confidence of .6."""
    e = clustered.where(is_episodic())
    sizes = e.groupBy("root").agg(F.count("*").alias("n"), F.avg("confidence").alias("c")).where((F.col("n") >= least) & (F.col("c") >= confidence - 1e-9))
    shared = e.select("root", F.explode(themes()).alias("theme")).groupBy("root", "theme").agg(F.count("*").alias("k")).join(sizes, "root").where("k = n")
    return shared.groupBy("root").agg(F.max("n").alias("n"), F.count("*").alias("themes")).where(F.col("themes") >= least_themes)


def detect_reweight(clustered: DataFrame, recent: str) -> DataFrame:
    """root, way: up for clusters most of which were recalled lately; decay for lone members never recalled, unless guidance or far decayed."""
    per = clustered.groupBy("root").agg(F.count("*").alias("n"), F.count_if(F.col("last_recalled_at") >= recent).alias("recalled"), F.max("last_recalled_at").alias("ever"), F.max("decay_score").alias("decay"), F.bool_or(is_guidance()).alias("guidance"))
    way = F.when((F.col("n") >= 2) & (F.col("recalled") / F.col("n") > 0.5), "up").when((F.col("n") == 1) & F.col("ever").isNull() & (F.col("decay") <= 0.8) & ~F.col("guidance"), "decay")
    return per.withColumn("way", way).where("way is not null").select("root", "way", "n")


def detect_split(chunks: DataFrame, within: float, apart: float) -> DataFrame:
    """Capsules whose chunk vectors fall into groups that are all far apart: capsule_id, groups. A capsule has a bounded number of chunks."""
    rows = chunks.select("capsule_id", F.concat_ws("#", "capsule_id", F.col("chunk").cast("string")).alias("id"), "embedding")
    close = similarity_pairs(rows, within, keys=("capsule_id",), id_column="id")
    roots = components(close.select("a", "b")).withColumnRenamed("node", "id")
    labelled = rows.select("capsule_id", "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    near = similarity_pairs(rows, apart + 1e-6, keys=("capsule_id",), id_column="id")
    crossing = near.join(labelled.select(F.col("id").alias("a"), F.col("root").alias("ra"), "capsule_id"), "a").join(labelled.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b").where("ra <> rb").select("capsule_id").distinct()
    return labelled.groupBy("capsule_id").agg(F.count_distinct("root").alias("groups")).where("groups >= 2").join(crossing, "capsule_id", "left_anti")


def match_candidates(proposals: DataFrame, pending: DataFrame, least: float = 0.8) -> DataFrame:
    """The pending candidate of the same operation with the most alike members (.8 or more). Equal sets of members meet once, others by their rarest members."""
    asks = proposals.select(F.col("proposal_id").alias("ask"), F.col("op_kind").alias("kind"), "members")
    offers = pending.select(F.col("candidate_id").alias("offer"), F.col("op_kind").alias("kind"), F.col("member_ids").alias("members"), F.lit("").alias("made"))
    return best_match(asks, offers, least, jaccard).select(F.col("ask").alias("proposal_id"), F.col("offer").alias("candidate_id"), "score")


def gate(signals: DataFrame, beta: float = 0.8, execute_at: int = 3, hysteresis: float = 0.25) -> DataFrame:
    """Evidence over sweeps: candidate_id, evidence (millionths), cycles, decision after the last sweep. A sweep with a signal adds one to the decayed
    evidence and to the running count, one without decays it and resets the count. The fold runs over the (short) ordered list of a candidate's sweeps."""
    ordered = signals.groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("sweep", "signal"))).alias("s"))
    start = F.struct(F.lit(0.0).alias("e"), F.lit(0).cast("bigint").alias("c"))
    state = F.aggregate("s", start, lambda acc, x: F.struct((acc["e"] * beta + F.when(x["signal"], 1.0).otherwise(0.0)).alias("e"), F.when(x["signal"], acc["c"] + 1).otherwise(F.lit(0).cast("bigint")).alias("c")))
    out = ordered.withColumn("state", state)
    decision = F.when(F.col("state.c") >= execute_at, "execute").when(F.col("state.e") < hysteresis, "cancel").otherwise("hold")
    return out.select("candidate_id", F.round(F.col("state.e") * SCALE).cast("bigint").alias("evidence"), F.col("state.c").alias("cycles"), decision.alias("decision"))


# fact checks -------------------------------------------------------------------------------------------------------


def segment(length: Column, i: Column, most: int) -> tuple[Column, Column]:
    """(start, size) of the i-th of most + 1 even segments of so many characters."""
    base, longer = F.floor(length / (most + 1)).cast("int"), most + 1 - length % (most + 1)
    return (i * base + F.greatest(F.lit(0), i - longer)).cast("int"), (base + F.when(i >= longer, 1).otherwise(0)).cast("int")


def within_edits(words: DataFrame, names: DataFrame, most: int) -> DataFrame:
    """word, norm, distance (1 to `most`) of words (word) and names (norm), two tables of distinct texts. Exact, by the pigeonhole principle: of the most + 1 segments of a name, an edit
    spoils one at most, so a word within `most` edits holds one of them whole, moved by `most` places at most, and is no more than `most` longer or shorter. A name has most + 1 keys and a word (most + 1) (2 most + 1)^2, however
    long both are; names of `most` characters or less meet all short words."""
    steps = lambda lo, hi: F.explode(F.sequence(F.lit(lo) if isinstance(lo, int) else lo, F.lit(hi) if isinstance(hi, int) else hi))
    n = names.where(F.char_length("norm") > 0).withColumn("length", F.char_length("norm")).withColumn("i", steps(0, most))
    start, size = segment(F.col("length"), F.col("i"), most)
    n = n.select("norm", "length", "i", F.substring("norm", start + 1, size).alias("piece")).where("piece <> '' or i = 0")
    m = F.char_length("word")
    w = words.where(m > 0).withColumn("length", steps(F.greatest(F.lit(1), m - most), m + most)).withColumn("i", steps(0, most)).withColumn("shift", steps(-most, most))
    start, size = segment(F.col("length"), F.col("i"), most)
    at = start + F.col("shift")
    w = w.where((at >= 0) & (at + size <= m)).select("word", "length", "i", F.substring("word", at + 1, size).alias("piece")).where("piece <> '' or i = 0").distinct()
    met = w.join(n, ["length", "i", "piece"]).select("word", "norm").distinct()
    return met.withColumn("distance", F.levenshtein("word", "norm", most)).where(F.col("distance").between(1, most))


def similar_names(words: DataFrame, names: DataFrame, most: int = 2) -> DataFrame:
    """word, name, distance: names within 1 to `most` edits of a word that is no name itself."""
    w = words.select(normalize_alias(F.col("word")).alias("word")).distinct()
    n = names.select(F.col("name"), normalize_alias(F.col("name")).alias("norm")).distinct()
    w = w.join(n, w["word"] == n["norm"], "left_anti")
    return within_edits(w, n.select("norm").distinct(), most).join(n, "norm").select("word", "name", "distance")


# Fixed values of suggestions for a node that has no neighbours.
SUGGEST_EDITS, SUGGESTIONS = 3, 5


def neighbour_suggestions(nodes: DataFrame, entities: DataFrame, limit: int = SUGGESTIONS) -> DataFrame:
    """tenant, node, pos, suggested, canonical_name, distance: entities of the tenant whose name is within three edits of what a node calls (`entity:` before it does not count), nearest first, then by name. nodes: tenant, node."""
    asked = nodes.select("tenant", "node", normalize_alias(F.regexp_replace("node", "^entity:", "")).alias("word")).where("word <> ''").distinct()
    known = entities.select("tenant", "entity_id", "canonical_name", normalize_alias(F.col("canonical_name")).alias("norm"))
    near = within_edits(asked.select("word").distinct(), known.select("norm").distinct(), SUGGEST_EDITS)
    # of the entities of one name only the first few can be suggested: they are as near to any node
    first = known.withColumn("rn_", F.row_number().over(Window.partitionBy("tenant", "norm").orderBy("canonical_name", "entity_id"))).where(F.col("rn_") <= max(1, limit)).drop("rn_")
    found = asked.join(near, "word").join(first, ["tenant", "norm"])
    order = Window.partitionBy("tenant", "node").orderBy("distance", "canonical_name", "entity_id")
    ranked_ = found.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= max(1, limit))
    return ranked_.select("tenant", "node", "pos", F.concat(F.lit("entity:"), "entity_id").alias("suggested"), "canonical_name", "distance")


def relation_conflicts(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """claims (subject, relation, object) against the graph: subject, relation, object, conflict."""
    live = edges.where("valid_to is null")
    key = ["subject", "relation"]
    facts = live.select(F.col("from_node").alias("subject"), "relation", F.col("to_node").alias("known"))
    exact = facts.withColumnRenamed("known", "object").distinct()
    unknown = claims.join(exact, [*key, "object"], "left_anti")
    turned = unknown.join(live.select(F.col("to_node").alias("subject"), "relation", F.col("from_node").alias("object")).distinct(), [*key, "object"]).withColumn("conflict", F.lit("direction"))
    other = unknown.join(facts.select(*key).distinct(), key, "left_semi").withColumn("conflict", F.lit("different_object"))
    closed = edges.where("valid_to is not null").select(F.col("from_node").alias("subject"), "relation", F.col("to_node").alias("object")).distinct()
    stale = unknown.join(closed, [*key, "object"]).withColumn("conflict", F.lit("restates_closed"))
    return turned.unionByName(other).unionByName(stale).distinct()
