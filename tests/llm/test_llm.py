"""Each training-data operator against a brute-force version, and on nulls, empty and very long texts, ties, repeats, empty tables and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, fingerprints, line_dedup, mixing, near_dups, quality, token_counts, token_files, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "This Common Line has more than forty characters in it."
rng = random.Random(7)
WORDS = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(1, 9))) for _ in range(400)]
words = lambda n: [rng.choice(WORDS) for _ in range(n)]


def corpus():
    rows = []
    base = words(120)
    for i in range(40):
        w = list(base) if i % 4 == 0 else words(rng.randint(20, 150))
        if i % 8 == 4:
            w[60] = "changed"
        text = " ".join(w) + (f"\n  {LINE} \n" if i % 3 == 0 else "\n") + " ".join(words(5))
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None]), len(text)))
    rows += [
        (100, None, "en", "a", None), (101, "", None, None, 0), (102, " \n\t ", "en", "b", 4), (103, "one", "en", "b", 3), (104, "one", "en", "b", 3), (105, "Two words", None, "a", 9),
        (None, "no id " + LINE, "en", "a", None), (None, None, None, None, None), rows[0], rows[0], (106, " ".join(words(60_000)), "en", "a", None), (107, "x" * 300_000, "en", "a", None),
        (108, "<|endoftext|> it's 12 #$%\x1c q\r\n\r\n  日本語 e\u0301 😀" * 3, "fr", "c", None), (109, "\n".join(f"{LINE} {LINE}" for _ in range(50)), "fr", "c", None),
    ]
    return rows


CLASHES = ["row", "pos", "key", "lines", "drop", "th", "h1", "d_id", "kept_text", "kept", "kept_", "tokens", "topic", "drawn", "digest", "code", "content", "part", "ghost", "id", "probability", "verdict", "host", "path", "rule", "keys"]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASHES)).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(found, wanted):
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, found), key=key) == sorted(map(tuple, wanted), key=key)


def find_words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


# 1 ---------------------------------------------------------------------------------------------------------------


def base_of(text):
    t, w = text or "", find_words(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if find_words(x)]
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_quality_counts(spark, docs, rows):
    out = quality.judge_quality(docs, None)
    same(out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect(), [(r[0], *base_of(r[1]), not base_of(r[1])[5]) for r in rows])


def test_quality_trees(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    trees = quality.fit_quality(docs, labels)
    found = {r["doc_id"]: r["score"] for r in quality.judge_quality(docs, trees).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert np.mean([(found[d] >= 0.5) == q for d, q in truth.items()]) > 0.9
    x = np.random.default_rng(1).random((500, len(quality.FEATURES)))
    one_by_one = []
    for row in x:  # brute force: walk each tree
        total = trees.bias
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            total += trees.value[node]
        one_by_one.append(1 / (1 + np.exp(-total)))
    assert np.allclose(trees.score(x), one_by_one)


def test_quality_on_documents_that_were_not_learnt(spark, sf_dir):
    """Fitted to one half of the labels, judged on the other, each class by itself."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    trees = quality.fit_quality(docs, labels.where("doc_id % 2 = 0"))
    found = {r["doc_id"]: r["score"] for r in quality.judge_quality(docs, trees).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.where("doc_id % 2 = 1").collect()}
    right = [np.mean([(found[d] >= 0.5) == q for d, q in truth.items() if q == k]) for k in (0, 1)]
    assert min(right) > 0.5 and np.mean(right) > 0.75, right  # of each class


def test_a_split_against_all_splits():
    """One tree of one level: its split has the largest gain of all thresholds of all features."""
    g = np.random.default_rng(9)
    x = g.integers(0, 12, (300, 3)).astype(float)
    y = (x[:, 1] + g.normal(size=300) > 6).astype(float)
    trees = quality.fit_trees(x, y, [0, 0, 0], n_trees=1, depth=1)
    root = trees.roots[0]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    p = 0.5
    best = {}
    for f in range(3):
        for cut in np.unique(x[:, f])[:-1]:
            side = x[:, f] <= cut
            for w in (weight, np.ones(300)):
                gain = sum((w[s] * (p - y[s])).sum() ** 2 / ((w[s] * p * (1 - p)).sum() + 1.0) for s in (side, ~side))
                best.setdefault(len(w) if w is weight else 0, []).append((gain, f, cut))
    chosen = {(max(v)[1], max(v)[2]) for v in best.values()}
    at = int(trees.feature[root]), x[x[:, int(trees.feature[root])] <= trees.threshold[root], int(trees.feature[root])].max()
    assert at in chosen


def test_quality_is_monotonic():
    g = np.random.default_rng(3)
    x = g.random((800, 3))
    y = ((x[:, 0] + 0.6 * g.random(800) - x[:, 1] ** 2) > 0.4).astype(float)
    trees = quality.fit_trees(x, y, [1, -1, 0], n_trees=30)
    grid = np.linspace(0, 1, 60)
    for f, way in ((0, 1), (1, -1)):
        for base in g.random((20, 3)):
            probe = np.repeat(base[None], 60, axis=0)
            probe[:, f] = grid
            assert (way * np.diff(trees.score(probe)) >= -1e-12).all()
    assert ((trees.score(x) > 0.5) == y).mean() > 0.8


def test_quality_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit_quality(docs, none) is None
    assert quality.fit_quality(docs, spark.createDataFrame([(1, 1), (2, 1), (None, 0)], "doc_id long, quality int")) is None
    assert quality.judge_quality(empty, None).count() == 0
    kept = quality.keep_good(docs, None)
    assert kept.columns == docs.columns
    same(kept.select("doc_id", "text", "kept").collect(), [(r[0], r[1], "clash") for r in corpus_rows(docs) if not base_of(r[1])[5]])


def corpus_rows(df):
    return [tuple(r) for r in df.select(*SCHEMA.replace(" long", "").replace(" string", "").split(", ")).collect()]


# 2 ---------------------------------------------------------------------------------------------------------------


def test_token_counts(spark, docs, empty, rows, tmp_path):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    wanted = [(r[0], len((r[1] or "").encode()), len(model.encode(r[1] or ""))) for r in rows]
    path = f"file://{tmp_path}/cache"
    same(token_counts.count_tokens(docs, path).collect(), wanted)
    tokenizer = token_counts.tokenizer_digest(public_tokenizers.path(token_counts.MODEL))
    cached = token_counts.read_cache(spark, path, tokenizer).count()
    assert cached == len({r[1] or "" for r in rows})
    same(token_counts.count_tokens(docs, path).collect(), wanted)  # all hits
    assert token_counts.read_cache(spark, path, tokenizer).count() == cached
    more = spark.createDataFrame([(1, "new text"), (2, rows[0][1])], "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(more, path).collect()} == {1: len(model.encode("new text")), 2: len(model.encode(rows[0][1]))}
    assert token_counts.read_cache(spark, path, tokenizer).count() == cached + 1
    assert token_counts.read_cache(spark, path, "other").count() == 0
    assert token_counts.count_tokens(empty).count() == 0


# 3 ---------------------------------------------------------------------------------------------------------------


def brute_components(rows, size, percent):
    sets = []
    for doc_id, text, *_ in rows:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in find_words(text)]
        k = min(size, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, *_) in enumerate(rows):
        for j in range(i):
            b, common = rows[j][0], len(sets[i] & sets[j])
            if a is not None and b is not None and common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(r[0], len(s), None if r[0] is None else find(r[0]), r[0] is None or find(r[0]) == r[0]) for r, s in zip(rows, sets, strict=True)]


@pytest.mark.parametrize("size", [2, 5])
def test_near_dups(spark, docs, empty, rows, size):
    same(near_dups.near_duplicates(docs, size, 80).collect(), brute_components(rows, size, 80))
    if size == 5:
        assert near_dups.near_duplicates(empty).count() == 0


def test_near_dups_chains_and_groups(spark):
    base = words(200)
    rows = [(500 - i, " ".join(base[: 200 - 4 * i] + words(4 * i)) if i % 2 else " ".join(base[4 * i :]), "", "", 0) for i in range(40)]
    rows += [(1000 + i, " ".join(base[:i] + [f"w{i}"] + base[i + 1 :]), "", "", 0) for i in range(60)]
    rows += [(2000, rows[3][1], "", "", 0), (2000, rows[60][1], "", "", 0)]
    same(near_dups.near_duplicates(spark.createDataFrame(rows, SCHEMA), 2, 80).collect(), brute_components(rows, 2, 80))


def test_near_dups_in_small_blocks(spark, monkeypatch):
    """A template with many blanks: most pairs share keys, few are linked, and they lie in different blocks."""
    for name, most in (("STRAY_BLOCK", 3), ("MEMBER_BLOCK", 5), ("HUB_PAIRS", 4)):
        monkeypatch.setattr(near_dups, name, most)
    g, base = random.Random(8), words(150)
    rows = []
    for i in range(70):
        text = list(base)
        for at in g.sample(range(150), g.choice([2, 6, 10, 14])):
            text[at] = f"x{g.randrange(40)}"
        rows.append((i * 3, " ".join(text), "", "", 0))
    wanted = brute_components(rows, 2, 80)
    assert 2 < len({w[2] for w in wanted}) < 70
    same(near_dups.near_duplicates(spark.createDataFrame(rows, SCHEMA), 2, 80).collect(), wanted)


def test_near_dups_of_a_document_of_unlike_texts(spark):
    """Whichever of the two documents is the hub."""
    g, rows = random.Random(3), []
    some = lambda n: [f"w{g.randrange(100_000)}" for _ in range(n)]
    for i in range(12):
        short, long = some(100), some(1000)
        rows += [(2 * i, " ".join(short), "", "", 0), (2 * i, " ".join(long), "", "", 0), (2 * i + 1, " ".join(short[:99]), "", "", 0)]
    same(near_dups.near_duplicates(spark.createDataFrame(rows, SCHEMA), 2, 80).collect(), brute_components(rows, 2, 80))


def test_signatures_within_the_threshold_share_a_key():
    g = np.random.default_rng(5)
    for _ in range(200):
        a = g.integers(0, 1 << near_dups.BITS, near_dups.SLOTS)
        b = a.copy()
        at = g.choice(near_dups.SLOTS, near_dups.THRESHOLD, replace=False)
        b[at] = (b[at] + g.integers(1, 1 << near_dups.BITS, len(at))) % (1 << near_dups.BITS)
        ka, kb = near_dups.chunk_keys(np.stack([a, b]))
        assert set(ka) & set(kb)
    worst = a.copy().reshape(near_dups.CHUNKS, -1)
    worst[:, :2] += 1  # one slot more than the threshold, two in each chunk
    ka, kb = near_dups.chunk_keys(np.stack([a, worst.ravel() % (1 << near_dups.BITS)]))
    assert not set(ka) & set(kb)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60) if i % 7] + [(100, 3), (100, 100)] + [(200, 200 + i) for i in range(1, 30)]
    found = {r["node"]: r["root"] for r in near_dups.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert all(found.get(x, x) == r for x, r in root.items())


def test_drop_near_duplicates(spark, docs, rows):
    out = near_dups.drop_near_duplicates(docs, 5, 80)
    kept = {r[0] for r in brute_components(rows, 5, 80) if r[3] and r[0] is not None}
    found = [r["doc_id"] for r in out.collect()]
    assert out.columns == docs.columns and Counter(x for x in found if x is not None) == Counter(kept) and found.count(None) == 2


# 4 ---------------------------------------------------------------------------------------------------------------


def tiktoken_encoding():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.bpe_for().ranks, special_tokens={})


def test_bpe(spark, docs, empty, rows):
    enc = tiktoken_encoding()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = [enc.encode_ordinary(r[1] or "") for r in rows]
    same(bpe.digest_documents(docs).collect(), [(r[0], len(i), sha(np.array(i, "<u4").tobytes()), sha((r[1] or "").encode())) for r, i in zip(rows, ids, strict=True)])
    assert bpe.digest_documents(empty).count() == 0
    whole = bpe.encode_documents(docs.where("doc_id < 20")).collect()
    assert all(enc.decode_bytes(r["ids"]) == bytes(r["decoded"]) for r in whole)


def test_bpe_merges_and_hash():
    b, enc = bpe.bpe_for(), tiktoken_encoding()
    g = random.Random(1)
    for _ in range(300):
        piece = "".join(g.choice("aabbcd éß日x1#") for _ in range(g.randint(1, 40)))
        assert [i for x in b.encode([piece]) for i in x] == enc.encode_ordinary(piece)
    slots = b.mph.slots(np.fromiter(map(bpe.xxhash.xxh3_64_intdigest, b.tokens), np.uint64, len(b.tokens)))
    assert sorted(slots.tolist()) == list(range(len(b.tokens)))  # minimal and perfect


# 5 ---------------------------------------------------------------------------------------------------------------


def test_token_files(spark, docs, empty, rows, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(token_files.MODEL))
    path = f"file://{tmp_path}/files"
    token_files.write_token_files(docs, path, ranges=3)
    found = token_files.read_token_files(spark, path).collect()
    ids = lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]
    same([(r["doc_id"], r["n_tokens"], list(r["ids"])) for r in found], [(r[0], len(ids(r[1])), ids(r[1])) for r in rows])
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert order == sorted(order)
    crc = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in token_files.read_token_files(spark, path, digest=True).collect()}
    assert all(crc[r["doc_id"], r["start"]] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in found)
    token_files.write_token_files(empty, f"file://{tmp_path}/none")
    assert token_files.read_token_files(spark, f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 65_536, 65_537, 200_001])
def test_rans_round_trip(n):
    g = np.random.default_rng(n)
    ids = np.minimum(g.zipf(1.4, n), 999).astype(np.uint32)
    coder = token_files.Rans(token_files.frequencies(np.bincount(ids, minlength=1000)))
    packed = coder.encode(ids)
    assert (coder.decode(packed) == ids).all()
    if n > 100_000:
        p = np.bincount(ids) / n
        p = p[p > 0]
        assert 8 * len(packed) / n < -(p * np.log2(p)).sum() * 1.02 + 1.1  # near the entropy


def test_token_files_notice_damage(spark, tmp_path):
    path = f"file://{tmp_path}/bad"
    token_files.write_token_files(spark.createDataFrame([(1, "some words here")], "doc_id long, text string"), path)
    blocks = spark.read.parquet(f"{path}/blocks").withColumn("crc", F.col("crc") + 1).collect()
    spark.createDataFrame(blocks, token_files.BLOCK_SCHEMA).write.mode("overwrite").parquet(f"{path}/blocks")
    with pytest.raises(Exception, match="damaged"):
        token_files.read_token_files(spark, path).collect()


# 6 ---------------------------------------------------------------------------------------------------------------


def test_fingerprints(spark, docs, empty, rows):
    found = fingerprints.fingerprint_documents(docs, ranges=4).collect()
    order = sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in rows))
    wanted = []
    for i, (has, doc_id, text) in enumerate(order):
        following = order[(i + 1) % len(order)][2]
        half = len(text) // 2
        wanted.append((doc_id if has else None, len(text), hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()))
    same([(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found], wanted)
    by_text = {}
    for r in found:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by_text.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert len(by_text[0]) == 1 and by_text[103] == by_text[104] and by_text[100] == by_text[101] == by_text[102] == {""}
    assert fingerprints.fingerprint_documents(empty).count() == 0


def naive_fingerprint(text, bins=64, bits=4, size=5):
    """Bin by bin, with plain integers."""
    import xxhash

    mask = (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    hashes = [xxhash.xxh3_64_intdigest(w.encode()) for w in find_words(text)]
    if not hashes:
        return b""
    width = min(size, len(hashes))
    found = {}
    for i in range(len(hashes) - width + 1):
        h = width
        for w in hashes[i : i + width]:
            h = mix((h * 0x9E3779B97F4A7C15 + w) & mask)
        at = h >> (64 - bins.bit_length() + 1)
        found[at] = min(h, found.get(at, mask))
    values = []
    for j in range(bins):
        at, attempt = j, 0
        while at not in found:
            at, attempt = mix((mix(j + 1) * 31 + attempt) & mask) & (bins - 1), attempt + 1
        values.append(mix(found[at]) & ((1 << bits) - 1))
    per = 8 // bits
    return bytes(sum(values[i + k] << (k * bits) for k in range(per)) for i in range(0, bins, per))


def test_fingerprints_against_plain_integers():
    g = random.Random(2)
    for bits in (1, 4, 8):
        sketch = fingerprints.OnePermutation(64, bits, 5)
        for n in (0, 1, 3, 6, 40, 400):
            text = " ".join(f"w{g.randrange(10_000)}" for _ in range(n))
            assert sketch.fingerprint(text) == naive_fingerprint(text, 64, bits)


def test_fingerprint_likeness():
    sketch = fingerprints.sketcher()
    g = random.Random(2)
    for n in (300, 2000):
        a = words(n)
        for share in (0.1, 0.5, 0.9):
            b = a[: int(n * share)] + words(n - int(n * share))
            A, B = ({tuple(x[i : i + 5]) for i in range(n - 4)} for x in (a, b))
            exact = len(A & B) / len(A | B)
            near = sketch.likeness(sketch.fingerprint(" ".join(a)), sketch.fingerprint(" ".join(b)))
            assert abs(near - exact) < 0.12
    assert sketch.likeness(b"", b"") == 1.0 and sketch.likeness(b"", sketch.fingerprint("a")) == 0.0
    one = sketch.unpack(sketch.fingerprint("single"))
    assert len(set(one.tolist())) == 1 and g


# 7 ---------------------------------------------------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://", "http://com/en/", "HTTP://A.B.EXAMPLE.COM/en/7x?q", "https://example.com/en/8", "https://notexample.com/en/7", "x://example.net/de/8#f", "x://sub.example.net/de/9",
    "x://example.org/es/", "x://example.org/ES/", "x://example.org?/es/", "a://b://example.com/en/7", "http://com", "http://xcom/en/", "http://example.net/de/88/../", "http://.com/en/1", "x://é.org/es/ü", "x://example.com/en/7", "x://example.com/en/7",
]


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in url_filter.RULES:
        h, p = url_filter.split_rule(rule)
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, best[0] if best else None, best[1] if best else "allow"


@pytest.mark.parametrize("max_bits", [url_filter.MAX_BITS, 24])
def test_url_filter(spark, max_bits):
    """24 bits are too few for one cascade: the list is split into shards."""
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    same(url_filter.judge_urls(pages, max_bits=max_bits).collect(), [(i, *judge(u)) for i, u in enumerate(URLS)])
    assert url_filter.judge_urls(pages.limit(0), max_bits=max_bits).count() == 0


def test_url_rules_as_a_table(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    rules = spark.createDataFrame(url_filter.RULES, "key string, verdict string")
    same(url_filter.judge_urls(pages, rules).collect(), [(i, *judge(u)) for i, u in enumerate(URLS)])
    assert {r["verdict"] for r in url_filter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}
    with pytest.raises(ValueError):
        url_filter.judge_urls(pages, max_bits=1)


def test_cascade_is_exact(spark):
    g = random.Random(4)
    universe = [f"host{g.random()}" for _ in range(3000)]
    listed = universe[:200]
    u, s = (spark.createDataFrame([(x,) for x in xs], "key string") for xs in (universe, listed))
    cascade = url_filter.build_cascade(s, u)
    assert len(cascade.levels) > 1
    found = {r["key"] for r in u.where(cascade.contains(F.col("key"))).collect()}
    assert found == set(listed)
    assert not spark.range(1).select(url_filter.build_cascade(s.limit(0), u).contains(F.lit("x")).alias("c")).first()["c"]


# 8 ---------------------------------------------------------------------------------------------------------------


def test_mixing(spark, docs, empty, rows, sf_dir):
    out = mixing.mix(docs).select("row.doc_id", "row.text", "source", "lang", "topic", "tokens", "probability", "kept").toPandas()
    assert len(out) == len(rows) and set(out["tokens"]) == {len(find_words(r[1])) for r in rows}
    assert 0 <= out["probability"].min() and out["probability"].max() == 1
    real = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).toPandas()
    expected = real["tokens"] * real["probability"]
    for m in mixing.MARGINS:
        share = mixing.shares(real.groupby(m)["tokens"].sum().to_dict(), mixing.POWERS[m])
        assert np.allclose(expected.groupby(real[m]).sum() / expected.sum(), [share[k] for k in sorted(share)], atol=1e-6)
    assert out[out["doc_id"] == 0]["kept"].nunique() == 1
    wide = mixing.mix(docs, max_cells=0).select("row.doc_id", "row.text", "probability", "kept").toPandas()
    key = ["doc_id", "text"]
    assert np.allclose(wide.sort_values(key)["probability"], out.sort_values(key)["probability"])
    sample = mixing.sample_documents(docs)
    assert sample.columns == docs.columns and sample.count() == int(out["kept"].sum())
    assert mixing.mix(empty).count() == 0
    named = mixing.mix(docs, targets={"source": {"a": 3, "gone": 5, "b": 1}, "lang": 1.0, "topic": 1.0}).toPandas()
    assert set(named[named["kept"] & (named["tokens"] > 0)]["source"]) <= {"a", "b"}


def test_raking_against_plain_proportional_fitting():
    """Where no cell is full, scaling rows, columns and layers in turn gives the same table."""
    import itertools

    import pandas as pd

    g = random.Random(6)
    cells = pd.DataFrame([(a, b, c, g.randrange(200, 2_000)) for a, b, c in itertools.product("stu", "xy", "pq")], columns=["source", "lang", "topic", "tokens"])
    targets = {"source": {"s": 2, "t": 1, "u": 1}, "lang": {"x": 1, "y": 1}, "topic": 1.0}
    share = 0.2
    kept = {(r.source, r.lang, r.topic): share * r.tokens for r in cells.itertuples()}
    size = share * cells["tokens"].sum()
    for _ in range(300):
        for i, m in enumerate(("source", "lang", "topic")):
            wanted = targets[m] if isinstance(targets[m], dict) else cells.groupby(m)["tokens"].sum().to_dict()
            total = sum(wanted.values())
            for k, w in wanted.items():
                now = sum(v for key, v in kept.items() if key[i] == k)
                kept = {key: v * (size * w / total / now if key[i] == k else 1) for key, v in kept.items()}
    out = mixing.rake(cells, targets, share)
    assert out["residual"].max() < 1e-8 and out["probability"].max() < 1
    for r in out.itertuples():
        assert abs(r.probability * r.tokens - kept[r.source, r.lang, r.topic]) < 1e-4 * size


def test_targets_out_of_reach_leave_a_residual():
    import pandas as pd

    cells = pd.DataFrame([("s", "x", "p", 100), ("t", "y", "p", 100)], columns=["source", "lang", "topic", "tokens"])
    out = mixing.rake(cells, {"source": {"s": 3, "t": 1}, "lang": {"x": 1, "y": 3}, "topic": 1.0}, 0.5)
    assert out["residual"].min() > 0.1


def test_a_rare_cell_shrinks_no_other(spark, sf_dir):
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    stray = spark.createDataFrame([(-1, " ".join(["stray"] * 5), "xx", "stray")], real.schema)
    at = {}
    for name, d, most in (("alone", real, 50_000), ("both", real.unionAll(stray), 50_000), ("wide", real.unionAll(stray), 0)):
        at[name] = mixing.mix(d, max_cells=most).select("row.doc_id", *mixing.MARGINS, "tokens", "probability").toPandas().set_index("doc_id").sort_index()
        t = at[name]["tokens"]
        assert abs((t * at[name]["probability"]).sum() / t.sum() - mixing.SHARE) < 1e-6
    assert at["both"]["probability"][-1] == 1 and (at["both"]["probability"] <= 1).all()
    assert np.allclose(at["both"]["probability"][at["alone"].index], at["alone"]["probability"], atol=0.01)
    assert np.allclose(at["both"]["probability"], at["wide"]["probability"], atol=1e-6)
    kept = (at["both"]["tokens"] * at["both"]["probability"]).groupby(at["both"]["lang"]).sum()
    share = mixing.shares(at["both"].groupby("lang")["tokens"].sum().to_dict(), 0.7)
    rest = sorted(set(share) - {"xx"})  # all of the stray stays; the others keep their proportions
    assert kept["xx"] == 5 and np.allclose(kept[rest] / kept[rest].sum(), [share[k] / (1 - share["xx"]) for k in rest], atol=1e-6)


# 9 ---------------------------------------------------------------------------------------------------------------


def test_toxicity(spark, docs, empty):
    g = random.Random(9)
    bad = ["vilewretch", "filthmonger", "scoundrelly"]
    rows, labels = [], []
    for i in range(600):
        w = [g.choice(WORDS) for _ in range(80)]
        if toxic := i % 4 == 0:
            for _ in range(3):
                w[g.randrange(80)] = g.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(d, lab)
    out = {r["doc_id"]: r for r in toxicity.score_toxicity(d, model).collect()}
    held = [(out[i]["predicted"], t) for i, t in labels if out[i]["held_out"]]
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in labels)
    assert np.mean([p for p, t in held if t]) > 0.9 and np.mean([p for p, t in held if not t]) < 0.02
    edge = toxicity.score_toxicity(docs, model).collect()
    assert all(0 <= r["score"] <= 1 for r in edge) and len(edge) == docs.count()
    assert all(r["predicted"] == 0 and not r["held_out"] for r in edge if r["doc_id"] is None)
    assert toxicity.score_toxicity(empty, model).count() == 0
    assert toxicity.fit_toxicity(d, lab.where("toxic = 1")) is None
    assert {r["score"] for r in toxicity.score_toxicity(docs, None).collect()} == {0.0}


def test_compression_lengths_against_the_library():
    """Lengths under a dictionary that is prepared once are those of a compressor made for each window, and the windows come back."""
    import zstandard

    g = random.Random(12)
    vocabulary = ["".join(g.choice("abcdefgh") for _ in range(g.randrange(2, 9))) for _ in range(80)]
    content = " ".join(vocabulary).encode()
    form = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, min_match=toxicity.MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    for _ in range(40):
        text = " ".join(g.choices(vocabulary, k=g.randrange(1, 120)))
        pieces = toxicity.windows(text)
        assert b" ".join(pieces).split() == text.encode().split()
        for w in pieces:
            raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made = toxicity.compressor(content)(w)
            assert zstandard.ZstdDecompressor(dict_data=raw, format=zstandard.FORMAT_ZSTD1_MAGICLESS).decompress(made, max_output_size=1 << 16) == w
            assert abs(len(made) - len(zstandard.ZstdCompressor(dict_data=raw, compression_params=form).compress(w))) <= 1


def test_ordinary_dictionary_learns_from_whole_texts(spark):
    g = random.Random(4)
    late = "lateordinaryvocabulary behindthefirstwindows"
    rows = [(i, " ".join([*(f"{g.getrandbits(40):x}" for _ in range(300)), *[late] * 30, *["vilewretch"] * (i % 2)])) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit_toxicity(d, spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int"))
    assert all(w.encode() in model.ordinary for w in late.split())


def test_no_significant_toxic_word_is_left_out():
    g = random.Random(6)
    word = lambda n: "".join(g.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)).encode()
    bad, plain = [word(12) for _ in range(800)], [word(12) for _ in range(800)]
    toxic, ordinary = ([toxicity.windows(b" ".join([*g.sample(plain, 40), *(own[(40 * i + j) % 800] for j in range(40))]).decode()) for i in range(600)] for own in (bad, plain))
    own = toxicity.toxic_words(toxic, ordinary)
    assert set(bad) <= own
    content = toxicity.own_content(toxic, own)
    assert all(w in content for w in bad)


# 10 --------------------------------------------------------------------------------------------------------------


def brute_lines(rows):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for doc_id, text, *_ in rows:
        for x in (text or "").split("\n"):
            if doc_id is not None and len(key(x)) >= 40:
                holders.setdefault(key(x), set()).add(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if doc_id is None or len(holders.get(key(x), ())) < 5 or max(holders[key(x)]) == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def test_line_dedup(spark, docs, empty, rows):
    out = line_dedup.dedup_lines(docs)
    wanted = brute_lines(rows)
    same(out.select("row.doc_id", "n_lines", "n_dropped", "kept_text").collect(), wanted)
    assert sum(w[2] for w in wanted) > 10
    whole = line_dedup.dedup_documents(docs)
    assert whole.columns == docs.columns
    same(whole.select("doc_id", F.coalesce("text", F.lit("")), "row").collect(), [(w[0], w[3], "clash") for w in wanted])
    assert line_dedup.dedup_lines(empty).count() == 0


# pipeline --------------------------------------------------------------------------------------------------------


def walked(trees, row):
    """The score of one row, tree by tree, node by node."""
    total = trees.bias
    for node in trees.roots:
        while trees.left[node] != node:
            node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
        total += trees.value[node]
    return 1 / (1 + np.exp(-total))


def brute_keeps(spark, at, rows, sf_dir):
    """Rows that pass the base rules and the trees, one by one."""
    labels = {}
    for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect():
        labels[r["doc_id"]] = min(r["quality"], labels.get(r["doc_id"], 1))
    learnt = sorted((tuple(quality.statistics(r[1])[1]), labels[r[0]]) for r in rows if r[0] in labels)
    y = np.array([q for _, q in learnt], float)
    trees = quality.fit_trees(np.array([x for x, _ in learnt], float), y, list(quality.FEATURES.values())) if len(y) and y.min() < y.max() else None
    return [r for r in rows if not base_of(r[1])[5] and (trees is None or walked(trees, quality.statistics(r[1])[1]) >= quality.KEEP_AT)]


def brute_mix(spark, rows):
    """Rows drawn, with cells and topics made one by one; only the raking is the operator's (it is tested against plain fitting)."""
    import pandas as pd

    def cell(r):
        topic = next((name for name, pattern in mixing.TOPICS if re.search(pattern, r[1] or "")), mixing.OTHER_TOPIC)
        return tuple(mixing.NONE if x is None else x for x in (r[3], r[2])) + (topic,)

    totals = Counter()
    for r in rows:
        totals[cell(r)] += len(find_words(r[1]))
    raked = mixing.rake(pd.DataFrame([(*k, v) for k, v in sorted(totals.items())], columns=["source", "lang", "topic", "tokens"]), mixing.POWERS)
    chance = {(r.source, r.lang, r.topic): r.probability for r in raked.itertuples()}
    ids = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(rows)], "i int, doc_id long, text string")
    drawn = {r["i"]: r["d"] for r in ids.select("i", mixing.draw(F.col("doc_id"), F.col("text")).alias("d")).collect()}
    return [r for i, r in enumerate(rows) if drawn[i] < chance[cell(r)]]


def test_pipeline(spark, docs, empty, rows, sf_dir):
    """Stage by stage against brute force, each on its own input."""
    import corpus_pipeline as p

    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(p.STAGES)
    kept = brute_keeps(spark, real, [(r["doc_id"], r["text"]) for r in real.collect()], sf_dir)
    found = stages["quality_rules"](spark, real, sf_dir).select("doc_id", "text").collect()
    same([tuple(r) for r in found], kept)
    assert 0 < len(found) < real.count()
    at = docs
    for (name, stage), check in zip(p.STAGES, ("keeps", "lines", "near", "mix", "bpe"), strict=True):
        before = corpus_rows(at)
        out = stage(spark, at, sf_dir).persist()
        if name != p.STAGES[-1][0]:
            assert out.columns == at.columns
            after = corpus_rows(out)
        if check == "keeps":
            same(after, brute_keeps(spark, at, before, sf_dir))
        elif check == "lines":
            same([(r[0], r[1] or "") for r in after], [(w[0], w[3]) for w in brute_lines(before)])
        elif check == "near":
            keep = {r[0] for r in brute_components(before, 5, 80) if r[3]}
            assert {r[0] for r in after} == keep and len(after) == len([r for r in {(r[0], r[1]) for r in before} if r[0] in keep])
        elif check == "mix":
            same(after, brute_mix(spark, before))
        else:
            enc = tiktoken_encoding()
            same([(r["doc_id"], r["n_tokens"]) for r in out.collect()], [(r[0], len(enc.encode_ordinary(r[1] or ""))) for r in before])
        at = out
    for _, stage in p.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_pipeline_runs_whole(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in p.STAGES:
        docs = stage(spark, docs, sf_dir)
    same(p.run(spark, sf_dir).collect(), docs.collect())


def test_written_tables_can_be_removed(spark):
    from tessera.llm import common

    common.remove_written(spark)
    df = common.written(spark.range(5), "few", 2)
    assert df.count() == 5 and common.remove_written(spark) == 1
    with pytest.raises(Exception, match=r"FILE_NOT_EXIST|does not exist|FileNotFound"):
        df.collect()


def test_ids_that_are_no_numbers(spark):
    """Text that does not read as an integer counts as no doc_id, and nothing fails."""
    docs = spark.createDataFrame([("1", "one two three four five six"), ("doc-1", "one two three four five six"), ("2", "one two three four five six"), (None, "x")], "doc_id string, text string")
    same(near_dups.near_duplicates(docs, 2, 80).collect(), [(1, 5, 1, True), (2, 5, 1, False), (None, 5, None, True), (None, 1, None, True)])
    assert sorted(r["doc_id"] or "" for r in near_dups.drop_near_duplicates(docs, 2, 80).collect()) == ["", "1", "doc-1"]
    assert fingerprints.fingerprint_documents(docs).count() == 4


def test_fits_do_not_depend_on_the_order_of_repeated_rows(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    again = docs.unionByName(docs.withColumn("text", F.reverse("text")))
    one, two = (quality.fit_quality(again.repartition(n), labels, fit_rows=150) for n in (3, 7))
    assert all(np.array_equal(getattr(one, f), getattr(two, f)) for f in ("feature", "threshold", "left", "right", "value"))
    one, two = (toxicity.fit_toxicity(again.repartition(n), labels, fit_rows=100) for n in (3, 7))
    assert one.ordinary == two.ordinary and one.toxic == two.toxic and np.array_equal(one.weights, two.weights)
