"""MinHash near-duplicates by a multi-index Hamming join.

A text's word shingles become a signature of SLOTS min-hashes of `BITS` bits. The distance of two signatures is the number of slots that differ.
Slots are split into CHUNKS chunks. By the pigeonhole principle two signatures within THRESHOLD = CHUNKS * (ERRORS + 1) - 1 of each other agree in
some chunk up to ERRORS slots, so with ERRORS = 1 a signature is listed, for each chunk, under every way to leave out one slot of it: signatures
that share no key are farther apart, always. (At similarity 0.8 a slot differs with probability 0.2; two such texts share no key with
probability 0.345^12, 3 in a million. Pairs beyond the threshold that share a key are looked at as well.) All links are confirmed on full sets.

Texts of equal sets form a class first, so exact copies cost nothing further. A key's members are not paired with each other but with one of
them (its hub). Links found give components. Keys whose members then lie in more than one chain these into families. In a family the members outside the
largest component (strays) meet all others, block by block: a task holds some strays, the others pass by, signatures that differ in at most MOST_DIFFERENT
slots are compared on full sets, and only links between components leave it. Pairs within a component need no look, so no group of copies is paired out, and no
link between components is lost. Texts travel packed (zstandard), in tasks of bounded size: hot hubs are salted, families dealt to blocks by hash; a family of n
members, s of them strays, costs about n s / STRAY_BLOCK copies of a text. Components are found by large-star and small-star rounds over DataFrames; nothing of
the corpus reaches the driver.

Defined results: texts without words have an empty set and are linked with nothing; each is kept. Texts of fewer words than a shingle are one
shingle. doc_id is an integer, or text that reads as one; other text counts as no doc_id. Rows of one doc_id are one document, linked by any of its texts. Rows without a doc_id are linked with nothing, kept, and have no
component. Extra columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import WordHashes, ensure_importable, files_for, lower_ascii, map_rows, mix64, pa_schema, shingle_hashes, tidy, words_of, written

CHUNKS, CHUNK_SLOTS, ERRORS, BITS = 12, 6, 1, 16
SLOTS = CHUNKS * CHUNK_SLOTS
THRESHOLD = CHUNKS * (ERRORS + 1) - 1
#: Pairs of one hub in one task, about.
HUB_PAIRS = 2_000
#: Members of a family in one block of texts, about: those held, and those that pass by.
STRAY_BLOCK, MEMBER_BLOCK = 256, 2_048
#: Signatures that differ in more slots are not confirmed: at similarity 0.8 that is a chance of 2 in ten million.
MOST_DIFFERENT = 34

_words = WordHashes()
_multipliers = mix64(np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_offsets = mix64(np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of a text's shingles, A-Z lower-cased."""
    words = words_of(text)
    return shingle_hashes(_words.of([lower_ascii(w) for w in words]), size)


def signature(hashes: np.ndarray) -> np.ndarray:
    """SLOTS min-hashes, each cut to BITS bits. In blocks, so that a very long text needs little memory."""
    least = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        block = hashes[at : at + 4096, None] * _multipliers + _offsets
        least = np.minimum(least, block.min(axis=0))
    return (mix64(least) & np.uint64((1 << BITS) - 1)).astype("<u2")


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """Rows of SLOTS values -> rows of keys: for each chunk, each of its slots left out once. Equal in all other slots means equal keys."""
    slot = np.arange(SLOTS, dtype=np.uint64)
    mixed = mix64(mix64(slot + np.uint64(1)) ^ (signatures.astype(np.uint64) << np.uint64(1)))
    chunks = mixed.reshape(-1, CHUNKS, CHUNK_SLOTS)
    without = chunks.sum(axis=2, dtype=np.uint64)[:, :, None] - chunks
    return mix64(without.reshape(-1, SLOTS) + mix64(slot * np.uint64(7) + np.uint64(3)))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _arrow_map(df: DataFrame, run, schema: str) -> DataFrame:
    ensure_importable(df.sparkSession)
    return df.mapInArrow(tidy(run), schema)


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, code (a one-to-one scrambling of doc_id, so that the least code of a group is a random member), n_shingles, digest, sig."""

    def run(doc_id: list, text: list) -> dict[str, list]:
        sets = [shingle_set(t, size) for t in text]
        ids = np.array([0 if d is None else d for d in doc_id], np.int64)
        code = mix64(ids.view(np.uint64) + np.uint64(0x632BE59BD9B4E019)).view(np.int64).tolist()
        return {
            "doc_id": doc_id,
            "code": [None if d is None else c for d, c in zip(doc_id, code, strict=True)],
            "n_shingles": list(map(len, sets)),
            "digest": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
            "sig": [signature(s).tobytes() if len(s) else None for s in sets],
        }

    return map_rows(docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text"), run, "doc_id long, code long, n_shingles long, digest binary, sig binary")


def list_keys(classes: DataFrame) -> DataFrame:
    """key, code, n: SLOTS rows for each class."""
    schema = "key long, code long, n long"
    target = pa_schema(classes.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                code, n, sig = batch.slice(at, 2000).columns
                keys = chunk_keys(np.frombuffer(b"".join(sig.to_pylist()), "<u2").reshape(-1, SLOTS))
                each = [np.repeat(c.to_numpy(zero_copy_only=False), SLOTS) for c in (code, n)]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), *map(pa.array, each)], schema=target)

    return _arrow_map(classes.select("code", "n", "sig"), run, schema)


def pack_texts(docs: DataFrame) -> DataFrame:
    def run(doc_id: list, text: list) -> dict[str, list]:
        pack = zstandard.ZstdCompressor(level=1).compress
        return {"doc_id": doc_id, "packed": [pack((t or "").encode("utf-8", "surrogatepass")) for t in text]}

    return map_rows(docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text"), run, "doc_id long, packed binary")


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """pairs (a, b) of codes that are linked, by their full sets. texts: code, packed. The text of b travels with each pair, that of a once for each
    HUB_PAIRS pairs of it; rows of one (a, salt) follow each other, a's own first."""
    spread = pairs.groupBy("a").agg(F.count("*").alias("n")).select("a", F.ceil(F.col("n") / HUB_PAIRS).cast("int").alias("salts"))
    salted = pairs.join(spread, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    theirs = salted.join(texts.withColumnRenamed("code", "b"), "b").select("a", "salt", F.lit(1).alias("kind"), "b", "packed")
    own = spread.join(texts.withColumnRenamed("code", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("a").alias("b"), "packed")
    target = pa_schema(pairs.sparkSession, "a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        at, sets = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for a, salt, kind, b, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = shingle_set(unpack(packed).decode("utf-8", "surrogatepass"), size)
                if at != (a, salt):
                    at, sets = (a, salt), []
                if kind == 0:
                    sets.append(s)  # more than one where rows share a doc_id
                elif any(linked(x, s, percent) for x in sets):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], schema=target)

    rows = own.unionAll(theirs).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")
    return _arrow_map(rows, run, "a long, b long").distinct()


def components(edges: DataFrame, u: str = "a", v: str = "b") -> DataFrame:
    """node, root: the least node of each component of an undirected graph. Large-star and small-star rounds until nothing changes; each star
    is a minimum, aggregated before its shuffle, joined back. Written each round; edges should be a written table, as they are read more than once."""
    state = edges.select(F.greatest(u, v).alias("x"), F.least(u, v).alias("y")).where("x <> y").distinct()
    files, mark = files_for(edges.count()), None
    while True:
        both = state.unionAll(state.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).unionAll(least.select("x", F.col("m").alias("y")))
        state = written(small.where("x <> y").distinct(), "edges", files)
        now = state.agg(F.count("*"), F.bit_xor(F.xxhash64("x", "y")), F.sum(F.xxhash64("y", "x").cast("decimal(38,0)"))).first()
        if now == mark:
            return state.select(F.col("x").alias("node"), F.col("y").alias("root"))
        mark = now


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    rows = written(sketch(docs, size), "sketches")
    usable = rows.where("digest is not null and doc_id is not null")
    files = files_for(rows.count())
    classes = written(usable.groupBy("digest").agg(F.min("code").alias("code"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "classes")
    keys = list_keys(classes)
    hubs = keys.groupBy("key").agg(F.min("code").alias("hub"), F.count("*").alias("members")).where("members > 1").drop("members")
    listed = written(keys.join(hubs, "key"), "listed", 4 * files)  # members of keys that more than one class has
    ids = usable.select("doc_id", "code").join(listed.select("code").distinct(), "code", "left_semi").distinct()
    texts = written(pack_texts(docs).join(ids, "doc_id").select("code", "packed").distinct(), "texts")
    near = F.exists("sizes", lambda n2: F.lit(100) * F.least("n", n2) >= F.lit(percent) * F.greatest("n", n2))

    sizes = classes.groupBy(F.col("code").alias("hub")).agg(F.collect_set("n").alias("sizes"))  # more than one where rows share a doc_id
    stars = listed.where("code <> hub").select("hub", "code", "n").distinct().join(sizes, "hub").where(near).select(F.col("hub").alias("a"), F.col("code").alias("b")).distinct()
    edges = written(confirm(stars, texts, size, percent), "links", files)
    # a document of several texts joins their classes
    own = usable.select("digest", F.col("code").alias("a")).join(classes.select("digest", F.col("code").alias("b")), "digest").select("a", "b").where("a <> b")
    several = usable.groupBy("code").agg(F.min("digest").alias("d1"), F.max("digest").alias("d2")).where("d1 <> d2").select(F.col("code").alias("a"))
    edges = edges.unionAll(own.join(several, "a", "left_semi").distinct())
    edges = written(edges, "links", files)
    edges = written(edges.unionAll(across_components(listed, components(edges), texts, size, percent, files)), "links", files)
    roots = components(edges)

    least_id = usable.groupBy("digest").agg(F.min("doc_id").alias("least"))
    labelled = classes.select("digest", "code").join(least_id, "digest").join(roots.withColumnRenamed("node", "code"), "code", "left").select("digest", F.coalesce("root", "code").alias("root"), "least")
    ids_of = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    known = labelled.join(ids_of, "root").select(F.col("digest").alias("digest_"), "component_id")
    out = rows.join(known, (F.col("digest") == F.col("digest_")) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def across_components(listed: DataFrame, roots: DataFrame, texts: DataFrame, size: int, percent: int, files: int) -> DataFrame:
    """Links (a, b) between components: of members of a key that lie in different ones. A pair of components is reported once a task.

    Keys with one component are done. The others chain their members into families; members outside a family's largest component are strays, and these meet all
    members, block by block."""
    at = listed.select("key", "code", "hub").distinct().join(roots.withColumnRenamed("node", "code"), "code", "left").withColumn("root", F.coalesce("root", "code"))
    several = at.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("r1"), F.max("root").alias("r2")).where("n > 2 and r1 <> r2").select("key")
    at = written(at.join(several, "key", "left_semi"), "open-keys", files)
    chains = components(written(at.where("code <> hub").select("hub", "code").distinct(), "chains", files), "hub", "code")
    chains = chains.unionAll(chains.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("code"), F.col("root").alias("family"))
    own = at.select("code", "root").distinct().join(chains, "code")
    parts = own.groupBy("family", "root").agg(F.count("*").alias("c"))
    whole = parts.groupBy("family").agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.max_by("root", F.struct("c", "root")).alias("top"))
    blocks = whole.select("family", "top", F.ceil((F.col("n") - F.col("most")) / STRAY_BLOCK).cast("int").alias("fs"), F.ceil(F.col("n") / MEMBER_BLOCK).cast("int").alias("fm"))
    place = lambda n: F.pmod(F.xxhash64("code"), F.greatest(F.lit(1), F.col(n))).cast("int")
    placed = own.join(blocks, "family").select("code", "root", "family", (F.col("root") != F.col("top")).alias("stray"), place("fs").alias("i"), place("fm").alias("j"))
    placed = written(placed, "families", files)

    members = placed.join(blocks.select("family", "fs", "fm"), "family").where("fs > 0").join(texts, "code")
    up_to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    strays = members.where("stray").select("family", "i", up_to("fm").alias("j"), F.lit(0).alias("kind"), "code", "root", "packed")
    rows = strays.unionAll(members.select("family", up_to("fs").alias("i"), "j", F.lit(1).alias("kind"), "code", "root", "packed"))
    target = pa_schema(listed.sparkSession, "a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        at, held, index, seen = None, [], None, set()
        for batch in batches:
            found: list[tuple[int, int]] = []
            for family, i, j, kind, code, root, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = shingle_set(unpack(packed).decode("utf-8", "surrogatepass"), size)
                if at != (family, i, j):
                    at, held, index, seen = (family, i, j), [], None, set()
                if not len(s):
                    continue
                if kind == 0:
                    held.append((code, root, s))
                    continue
                if not held:
                    continue
                index = index or StrayIndex(held)
                for k in index.matches(s, root, percent):
                    pair = tuple(sorted((held[k][1], root)))
                    if pair not in seen:
                        seen.add(pair)
                        found.append((held[k][0], code))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], schema=target)

    rows = rows.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "kind")
    return _arrow_map(rows, run, "a long, b long").distinct()


class StrayIndex:
    """Some sets, to be compared with one set at a time: signatures first, then exact intersections of all at once."""

    def __init__(self, held: list[tuple[int, int, np.ndarray]]):
        self.sizes = np.array([len(s) for _, _, s in held])
        self.roots = np.array([r for _, r, _ in held])
        self.signatures = np.stack([signature(s) for _, _, s in held])
        hashes, owners = np.concatenate([s for _, _, s in held]), np.repeat(np.arange(len(held)), self.sizes)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owners = hashes[order], owners[order]

    def matches(self, s: np.ndarray, root: int, percent: int) -> list[int]:
        n = len(s)
        open_ = (self.roots != root) & (100 * np.minimum(self.sizes, n) >= percent * np.maximum(self.sizes, n))
        if not open_.any():
            return []
        open_ &= (self.signatures != signature(s)).sum(axis=1) <= MOST_DIFFERENT
        if not open_.any():
            return []
        lo, hi = np.searchsorted(self.hashes, s, "left"), np.searchsorted(self.hashes, s, "right")
        lengths = hi - lo
        at = np.repeat(lo - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        common = np.bincount(self.owners[at], minlength=len(self.sizes))
        return np.flatnonzero(open_ & (100 * common >= percent * (self.sizes + n - common))).tolist()


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs without near-duplicates: of each component the document of the least doc_id stays, once (of rows that share it, the one whose JSON comes
    first, so that a retry keeps the same). All columns pass."""
    verdict = near_duplicates(docs, size, percent)
    dropped = verdict.where("not kept").select(F.col("doc_id").alias("d_id")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").try_cast("long").alias("d_id_"))
    left = rows.join(dropped, F.col("d_id_") == F.col("d_id"), "left_anti")
    repeats = docs.select(F.col("doc_id").try_cast("long").alias("r_id")).where("r_id is not null").groupBy("r_id").agg(F.count("*").alias("n")).where("n > 1").select("r_id")
    if repeats.isEmpty():
        return left.select("row.*")
    repeated = F.col("d_id_") == F.col("r_id")
    first = F.row_number().over(Window.partitionBy("d_id_").orderBy(F.to_json("row"))) == 1
    again = left.join(repeats, repeated, "left_semi").withColumn("first_", first).where("first_")
    return left.join(repeats, repeated, "left_anti").select("row.*").unionAll(again.select("row.*"))
