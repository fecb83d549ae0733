"""Token-ID files: static range asymmetric numeral coding (rANS) in independent blocks, with checkpoints and checksums.

Format (a Parquet data set; one row is one block, in ascending doc_id order within and across files):

  part, block   place of the block; blocks of a part follow each other, parts too
  docs, sizes   doc_id and number of ids of each document in the block, in order; a document lies in one block
  payload       the ids: `LANES` interleaved rANS lanes of 64-bit state with 32-bit words, lane l holding ids l, l + LANES, ...
  crc           crc32 of the ids as little-endian unsigned 32-bit integers, checked on reading
  start         ids in all blocks before

A payload is cut into segments of `SEGMENT` ids; each begins with its lane states and the place of its words (a checkpoint), so that segments
decode in parallel, and are: one numpy step advances every lane of every segment. All blocks share one frequency table over the ids of the
whole corpus, stored beside them. Ids never seen (none, on the corpus itself) still have a frequency of 1.

Ids are made in one pass and written once, each row with its range; the table, the totals per part (one number each) and the coding follow
from that. One shuffle, of ids, puts them in order.
No group meets in one task: ranges of doc_id are even, and rows of one doc_id hold one document.

The tokenizers library encodes each distinct piece of a batch once and workers remember pieces (bounded): ids depend on the piece alone.

Defined results: null and empty texts are the end id alone. Repeated rows are written again, each with its own start, ties by text. Null doc_ids come
first. Extra columns do no harm.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ensure_importable, map_rows, pa_schema, tidy, written

MODEL = "word_bpe_49k.json"
END_ID = 1
SCALE_BITS = 20
LANES, SEGMENT, BLOCK = 1024, 1 << 18, 1 << 20
_LOW = np.uint64(1 << 31)
BLOCK_SCHEMA = "part int, block int, docs array<long>, sizes array<long>, payload binary, crc long"


#: Texts of these characters alone are split here: they are in normal form C, lower-case one by one, and their classes are the same in all versions
#: of Unicode. (The capital sigma, whose lower case depends on its place, is not among them.)
PLAIN = r"[\x00-\u024f\u2010-\u2027]*"
#: The tokenizer's own pattern, with its white space spelt out for those characters, and the line feed as a piece that parts words.
PRE_TOKEN = r"\n|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\x09-\x0d\x20\x85\xa0\p{L}\p{N}]+"


class Memo:
    """Strings and the ids of each, by rows of flat arrays. Over MOST of them, those used once since the last time fall out, then the least used."""

    MOST = 450_000

    def __init__(self):
        self.row: dict[str, int] = {}
        self.flat, self.start, self.length, self.used = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def forget(self) -> None:
        if len(self.row) <= self.MOST:
            return
        rank = np.argsort(-self.used, kind="stable")[: self.MOST // 2]
        keep = np.sort(rank[self.used[rank] > 1])
        names = list(self.row)
        self.row = {names[k]: i for i, k in enumerate(keep.tolist())}
        self.flat, self.length, self.used = self.gather(keep), self.length[keep], self.used[keep] // 2
        self.start = np.cumsum(self.length) - self.length

    def add(self, new: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(lengths) - lengths))
        self.flat, self.length, self.used = np.concatenate((self.flat, flat)), np.concatenate((self.length, lengths)), np.concatenate((self.used, np.zeros(len(new), np.int64)))

    def gather(self, rows: np.ndarray) -> np.ndarray:
        """Ids of rows, one after the other."""
        length = self.length[rows]
        ends = np.cumsum(length)
        return self.flat[np.repeat(self.start[rows] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]


class WordEncoder:
    """Ids of texts. A plain text is cut at white space, and each distinct word of a batch by the tokenizer's pattern into pieces; the library encodes each
    distinct piece that is not remembered, many at once, and every piece ends in the one id that carries an end of word. Any other text, or one
    with the tokenizer's special strings, goes to the library whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.size = self.model.get_vocab_size()
        self.specials = [t.content for t in self.model.get_added_tokens_decoder().values()]
        vocab = self.model.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.plain, self.split = regex.compile(PLAIN).fullmatch, regex.compile(PRE_TOKEN).findall
        self.pieces = Memo()

    def is_plain(self, text: str) -> bool:
        return (text.isascii() or self.plain(text) is not None) and not any(s in text for s in self.specials)

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and how many each has. All are cut in one go, a line feed after each."""
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), "\n")[0].as_py().lower() + "\n"
        tokens = pa.array(self.split(joined), pa.string()).dictionary_encode()
        pieces, index = tokens.dictionary.to_pylist(), tokens.indices.to_numpy()
        feed = pieces.index("\n")
        self.pieces.forget()
        known = self.pieces.row
        missing = [p for i, p in enumerate(pieces) if p not in known and i != feed]
        for at in range(0, len(missing), 5000):
            some = missing[at : at + 5000]
            ids = np.array(self.model.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):
                raise ValueError("a piece has no end of word, or more than one")
            self.pieces.add(some, ids, np.diff(stops, prepend=0))
        pieces[feed] = pieces[feed - 1] if feed else pieces[-1]  # any known piece; its ids are not taken
        row_of = np.fromiter(map(known.get, pieces, repeat(0)), np.int64, len(pieces))
        is_feed = index == feed
        rows = row_of[index[~is_feed]]
        self.pieces.used += np.bincount(rows, minlength=len(self.pieces.used))
        upto = np.concatenate(([0], np.cumsum(self.pieces.length[rows])))
        per_word = np.diff(np.flatnonzero(is_feed) - np.arange(len(words)), prepend=0)
        return self.pieces.gather(rows), np.diff(upto[np.concatenate(([0], np.cumsum(per_word)))])

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """Words are cut and told apart by Arrow, so each distinct word of a batch is looked at once."""
        given = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        strings = given.to_pylist()
        plain = [not t or self.is_plain(t) for t in strings]
        cut = pc.ascii_split_whitespace(pc.if_else(pa.array(plain, pa.bool_()), pc.fill_null(given, ""), ""))
        words = cut.flatten().dictionary_encode()
        if len(words):
            flat_of, length = self.of_words(words.dictionary)
            start, rows = np.cumsum(length) - length, words.indices.to_numpy()
            ends = np.cumsum(length[rows])
            flat = flat_of[np.repeat(start[rows] - ends + length[rows], length[rows]) + np.arange(ends[-1])]
        else:
            ends, flat = np.empty(0, np.int64), np.empty(0, np.uint32)
        n_words = np.cumsum(pc.list_value_length(cut).to_numpy())
        stops = np.concatenate(([0], ends))[n_words]
        out, at, end_id = [], 0, np.array([END_ID], np.uint32)
        for t, p, stop in zip(strings, plain, stops.tolist(), strict=True):
            out.append(np.concatenate((flat[at:stop] if p else np.array(self.model.encode(t, add_special_tokens=False).ids, np.uint32), end_id)))
            at = stop
        return out


@lru_cache(maxsize=2)
def encoder_for(name: str = MODEL) -> WordEncoder:
    """Once per worker process."""
    import public_tokenizers

    return WordEncoder(public_tokenizers.path(name))


def frequencies(counts: np.ndarray, scale_bits: int = SCALE_BITS) -> np.ndarray:
    """Counts scaled to a sum of 2^scale_bits, at least 1 each; the largest take up the rounding."""
    total = 1 << scale_bits
    if len(counts) > total:
        raise ValueError("more symbols than the scale has room for")
    spare = total - len(counts)
    f = 1 + np.floor(counts * (spare / max(counts.sum(), 1))).astype(np.int64)
    rest = total - int(f.sum())
    order = np.argsort(-counts, kind="stable")
    f[order[: rest % len(f)]] += 1
    f += rest // len(f)
    return f


class Rans:
    """Coder for one frequency table. Encoding runs backwards over steps of LANES ids, so that decoding runs forwards."""

    def __init__(self, freq: np.ndarray, scale_bits: int = SCALE_BITS):
        self.bits = np.uint64(scale_bits)
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray) -> bytes:
        """Header (ids, segments), then for each segment its number of words and its lane states, then all words."""
        segments = [self._segment(ids[at : at + SEGMENT]) for at in range(0, len(ids), SEGMENT)]
        head = np.array([len(ids), len(segments), *(len(w) for _, w in segments)], "<u4").tobytes()
        return b"".join([head, *(s.astype("<u8").tobytes() for s, _ in segments), *(w.astype("<u4").tobytes() for _, w in segments)])

    def _segment(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        state = np.full(LANES, _LOW)
        steps = -(-len(ids) // LANES)
        out = []
        f_all, s_all = self.freq[ids], self.start[ids]
        limit_all = f_all << (np.uint64(63) - self.bits)  # above it a word leaves first, so that the state stays under 2^63
        for k in range(steps - 1, -1, -1):
            f, s, limit = f_all[k * LANES : (k + 1) * LANES], s_all[k * LANES : (k + 1) * LANES], limit_all[k * LANES : (k + 1) * LANES]
            x = state[: len(f)]
            full = x >= limit
            out.append(x[full].astype(np.uint32))
            x = np.where(full, x >> np.uint64(32), x)
            q = x // f
            state[: len(f)] = (q << self.bits) + (x - q * f) + s
        return state, np.concatenate(out[::-1]) if out else np.empty(0, np.uint32)

    def decode(self, payload: bytes) -> np.ndarray:
        """All segments advance together."""
        n, k = (int(x) for x in np.frombuffer(payload, "<u4", 2))
        if n == 0:
            return np.empty(0, np.uint32)
        counts = np.frombuffer(payload, "<u4", k, 8).astype(np.int64)
        state = np.frombuffer(payload, "<u8", k * LANES, 8 + 4 * k).reshape(k, LANES).copy()
        words = np.frombuffer(payload, "<u4", int(counts.sum()), 8 + 4 * k + 8 * k * LANES).astype(np.uint64)
        words = np.concatenate((words, np.zeros(LANES, np.uint64)))
        at = np.cumsum(counts) - counts
        out = np.zeros((k, SEGMENT), np.uint32)
        size = np.minimum(SEGMENT, n - np.arange(k) * SEGMENT)
        lane, mask = np.arange(LANES), np.uint64((1 << int(self.bits)) - 1)
        for step in range(-(-int(size.max()) // LANES)):
            live = step * LANES + lane[None] < size[:, None]
            slot = state & mask
            sym = self.symbol[slot.astype(np.int64)]
            x = self.freq[sym] * (state >> self.bits) + slot - self.start[sym]
            need = live & (x < _LOW)
            take = at[:, None] + np.cumsum(need, axis=1) - 1
            x = np.where(need, (x << np.uint64(32)) | words[np.where(need, take, 0)], x)
            at += need.sum(axis=1)
            state = np.where(live, x, state)
            out[:, step * LANES : (step + 1) * LANES] = sym
        return out.ravel()[:n] if k == 1 else np.concatenate([o[:z] for o, z in zip(out, size, strict=True)])


def range_parts(ids: DataFrame, ranges: int) -> np.ndarray:
    """Cuts between even ranges of doc_id."""
    return np.array(sorted({int(x) for x in ids.where("doc_id is not null").approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))}) if ranges > 1 else [], np.int64)


def encode_corpus(docs: DataFrame, model: str = MODEL, ranges: int | None = None) -> DataFrame:
    """Written table (part, doc_id, seq, ids): ids as little-endian 32-bit bytes, dealt by ranges of doc_id."""
    spark = docs.sparkSession
    ranges = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text")
    cuts = range_parts(rows.select("doc_id"), ranges)

    def run(doc_id: list, text: list) -> dict[str, list]:
        encoder = encoder_for(model)
        width = "<u2" if encoder.size <= 1 << 16 else "<u4"
        part = [0 if d is None else int(np.searchsorted(cuts, d, side="right")) for d in doc_id]
        ids = encoder.encode(text)
        return {"part": part, "doc_id": doc_id, "size": list(map(len, ids)), "ids": [x.astype(width).tobytes() for x in ids], "tie": [zlib.crc32((t or "").encode()) for t in text]}

    made = map_rows(rows, run, "part int, doc_id long, size long, ids binary, tie long", most_bytes=16 << 20)
    return written(made, "token-ids")


def joined_bytes(column: pa.Array) -> memoryview:
    """The bytes of all values of a binary column, one after the other, where they lie."""
    if not len(column):
        return memoryview(b"")
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    return memoryview(data)[int(ends[0]) : int(ends[-1])] if data else memoryview(b"")


def count_ids(encoded: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs; a worker adds up its rows before the shuffle, so at most size rows a task move and size rows arrive."""
    ensure_importable(encoded.sparkSession)
    target = pa_schema(encoded.sparkSession, "id int, n long")
    width = "<u2" if size <= 1 << 16 else "<u4"

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(joined_bytes(batch.column(0)), width), minlength=size)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(total[ids], pa.int64())], schema=target)

    found = encoded.select("ids").mapInArrow(tidy(run), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def write_token_files(docs: DataFrame, path: str, model: str = MODEL, ranges: int | None = None) -> None:
    """Blocks to path/blocks, the frequency table to path/table, ids before each part to path/parts."""
    spark = docs.sparkSession
    encoded = encode_corpus(docs, model, ranges)
    size = encoder_for(model).size
    freq = frequencies(count_ids(encoded, size))
    width = "<u2" if size <= 1 << 16 else "<u4"
    target = pa_schema(spark, BLOCK_SCHEMA)

    def run(batches):
        coder = Rans(freq)
        part, block, docs_, sizes, held, n = None, 0, [], [], [], 0

        def flush():
            ids = np.concatenate(held) if held else np.empty(0, np.uint32)
            row = [part, block, docs_, sizes, coder.encode(ids), zlib.crc32(ids.astype("<u4").tobytes())]
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, target, strict=True)], schema=target)

        for batch in batches:
            for p, doc_id, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if docs_ and (p != part or n >= BLOCK):
                    yield flush()
                    block, docs_, sizes, held, n = (0 if p != part else block + 1), [], [], [], 0
                part = p
                x = np.frombuffer(ids, width).astype(np.uint32)
                docs_.append(doc_id), sizes.append(len(x)), held.append(x)
                n += len(x)
        if docs_:
            yield flush()

    # a file may be read in pieces, so rows are dealt and sorted by part again
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = encoded.repartitionById(n, F.col("part") % n).sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "tie", "ids")
    ordered.select("part", "doc_id", "ids").mapInArrow(tidy(run), BLOCK_SCHEMA).write.parquet(f"{path}/blocks")
    totals = encoded.groupBy("part").agg(F.sum("size").alias("n")).toPandas().sort_values("part")  # one row a part
    before = pd.DataFrame({"part": totals["part"].astype("int32"), "before": totals["n"].cumsum() - totals["n"]})
    spark.createDataFrame(before, "part int, before long").write.parquet(f"{path}/parts")
    spark.createDataFrame(pd.DataFrame({"id": np.arange(size), "freq": freq}), "id int, freq long").coalesce(1).write.parquet(f"{path}/table")


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (array<int>), or with digest their crc32 as ids_crc32. Raises where a checksum does not hold."""
    table = spark.read.parquet(f"{path}/table").toPandas().sort_values("id")  # as many rows as the vocabulary
    freq = table["freq"].to_numpy(np.int64)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    sums = blocks.select("part", "block", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    from pyspark.sql.window import Window

    ahead = sums.withColumn("within", F.sum("n").over(Window.partitionBy("part").orderBy("block")) - F.col("n"))  # a row a block
    starts = ahead.join(spark.read.parquet(f"{path}/parts"), "part").select(F.col("part").alias("p"), F.col("block").alias("b"), (F.col("before") + F.col("within")).alias("start"))
    kind = "ids_crc32 long" if digest else "ids array<int>"
    schema = f"p int, b int, doc_id long, ahead long, n_tokens long, {kind}"
    target = pa_schema(spark, schema)

    def run(batches):
        coder = Rans(freq)
        for batch in batches:
            for part, block, docs_, sizes, payload, crc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = coder.decode(payload)
                if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
                    raise ValueError(f"block {block} of part {part} is damaged")
                ends = np.cumsum(sizes)
                pieces = [ids[e - n : e] for e, n in zip(ends, sizes, strict=True)]
                own = [zlib.crc32(x.astype("<u4").tobytes()) for x in pieces] if digest else [x.astype(np.int32) for x in pieces]
                columns = [[part] * len(sizes), [block] * len(sizes), docs_, (ends - np.array(sizes)).tolist(), sizes, own]
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(columns, target, strict=True)], schema=target)

    ensure_importable(spark)
    rows = blocks.mapInArrow(tidy(run), schema)
    out = rows.join(starts, ["p", "b"])
    return out.select("doc_id", (F.col("start") + F.col("ahead")).alias("start"), "n_tokens", kind.split()[0])
