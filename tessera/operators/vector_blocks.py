"""Pairs of vectors block by block: what the similarity join, neighbours in a band and clusters share.

Rows of equal keys and length are dealt by the hash of their id to blocks of `block` rows, but to no more than `cells` blocks: beyond cells * block rows the blocks grow instead, so a row travels `cells` times at most and what is
shuffled grows with the rows alone. Vectors travel as bytes. A task holds two blocks and multiplies tiles of them in single precision; a bound on the error leaves the few pairs that double precision has to decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tessera.operators.retrieval import SCALE, unit
from tessera.operators.storage import ensure_importable

BLOCK, CELLS, TASKS = 4096, 16, 256
ROWS, COLUMNS, DENSE = 256, 2048, 0.05
NONE = np.float32(-9)
# a similarity and a position in one number, the best and first the least
PLACE, WORST = 22, 2 * SCALE


def ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def packed(vectors: DataFrame, keys: tuple[str, ...], id_column: str) -> tuple[DataFrame, list[str], str]:
    """(k0, k1, ..., dim, id, v: rows with an id and a vector without nulls; the columns that must be equal; the type of the numbers in v). A key may be null."""
    ensure_importable(vectors.sparkSession)
    kind = vectors.schema["embedding"].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    names = [f"k{i}" for i in range(len(keys))]
    e = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    rows = vectors.select(*(F.col(k).cast("string").alias(n) for k, n in zip(keys, names, strict=True)), F.size("embedding").alias("dim"), F.col(id_column).cast("string").alias("id"), e.alias("v"))
    rows = rows.where(F.col("id").isNotNull() & (F.col("dim") > 0) & ~F.exists("v", lambda x: x.isNull()))
    out = [*names, "dim", "id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(len(out))
            numbers = v.flatten().to_numpy(zero_copy_only=False).astype("<f4" if single else "<f8", copy=False)
            ends = np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))]) * numbers.itemsize
            blob = pa.Array.from_buffers(pa.large_binary(), len(v), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(numbers))])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(out)], blob.cast(pa.binary())], names=[*out, "v"])

    return rows.mapInArrow(run, f"{ddl(rows.drop('v'))}, v binary"), [*names, "dim"], "<f4" if single else "<f8"


def in_blocks(rows: DataFrame, names: list[str], block: int, cells: int) -> DataFrame:
    """rows with the number of blocks of their kind (n) and their own. A row alone of its kind has nothing to meet and is left out, so keys of one row cost no task a call.

    A kind meets its size in `cells` parts, by the hash of the ids, so rows of one kind, all of them perhaps, pass through no single task."""
    parts = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(cells)))
    counts = parts.groupBy(*names, "part").agg(F.count("*").alias("n"))
    sizes = counts.groupBy(*names).agg(F.sum("n").alias("n"), F.collect_list("part").alias("parts")).where("n > 1")
    sizes = sizes.select(*names, F.explode("parts").alias("part"), F.least(F.lit(cells), F.ceil(F.col("n") / block)).cast("int").alias("n"))
    return parts.join(sizes, [*names, "part"]).drop("part").withColumn("own", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))


def in_pairs(placed: DataFrame, between_only: bool = False) -> DataFrame:
    """placed, once for each pair of blocks (i <= j, or i < j) that a row's block is one of."""
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "n")
    return pairs.where("i < j") if between_only else pairs


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows by keys over a fixed number of partitions. Spark joins partitions by their bytes as they were packed: it would give most pairs of blocks, which cost by their products, to a few tasks, and millions of short rows to one."""
    return rows.repartition(max(TASKS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


class Pair:
    """The rows of a task in order of their ids, with the positions of both blocks."""

    def __init__(self, table: pa.Table, kind: str):
        self.table = table.take(pc.sort_indices(table, sort_keys=[("id", "ascending")]))
        dim = table.column("dim")[0].as_py()
        blob = self.table.column("v").cast(pa.large_binary()).combine_chunks()
        blob = blob.chunk(0) if isinstance(blob, pa.ChunkedArray) else blob
        self.m = unit(np.frombuffer(blob.buffers()[2], dtype=kind, count=len(blob) * dim, offset=0).reshape(-1, dim).astype(float))
        self.single = self.m.astype(np.float32)
        # |error| of a product of unit vectors in single precision, and half a millionth for what is rounded
        self.slack = np.float32((dim + 8) * 2.0**-23 + 1e-6)
        self.ids = self.table.column("id").combine_chunks()
        self.ids = self.ids.chunk(0) if isinstance(self.ids, pa.ChunkedArray) else self.ids
        names = self.ids.to_numpy(zero_copy_only=False)
        self.group = np.concatenate([[0], np.cumsum(names[1:] != names[:-1])]).astype(np.int64)  # equal ids are one group
        if "i" in table.column_names:
            own, i, j = self.column("own"), table.column("i")[0].as_py(), table.column("j")[0].as_py()
            self.left, self.right, self.same = np.flatnonzero(own == i), np.flatnonzero(own == j), i == j
        else:  # one block
            self.left, self.right, self.same = np.arange(len(blob)), np.arange(len(blob)), True

    def column(self, name: str) -> np.ndarray:
        return self.table.column(name).to_numpy()

    def sims(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Millionths of the pairs of positions."""
        out = np.empty(len(x), np.int64)
        for at in range(0, len(x), 1 << 16):
            s = slice(at, at + (1 << 16))
            out[s] = np.rint(np.einsum("ij,ij->i", self.m[x[s]], self.m[y[s]]) * SCALE)
        return out

    def in_band(self, low: int, high: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(positions, positions, millionths) of the pairs of both blocks with low <= similarity < high, tile by tile; a pair within one block comes once, and ids are never paired with themselves."""
        least, most = np.float32(low / SCALE) - self.slack, None if high is None else np.float32(high / SCALE) + self.slack
        for r in range(0, len(self.left), ROWS):
            rows = self.left[r : r + ROWS]
            for c in range(0, len(self.right), COLUMNS):
                columns = self.right[c : c + COLUMNS]
                if self.same and columns[-1] <= rows[0]:
                    continue
                sims = self.single[rows] @ self.single[columns].T
                mask = sims >= least
                if most is not None:
                    mask &= sims < most
                x, y = where(mask)
                x, y = rows[x], columns[y]
                if self.same:
                    keep = self.group[x] < self.group[y]
                    x, y = x[keep], y[keep]
                if not len(x):
                    continue
                if len(x) > DENSE * sims.size:
                    s = np.rint(self.m[rows] @ self.m[columns].T * SCALE).astype(np.int64)[np.searchsorted(rows, x), np.searchsorted(columns, y)]
                else:
                    s = self.sims(x, y)
                keep = (s >= low) if high is None else (s >= low) & (s < high)
                if keep.any():
                    yield x[keep], y[keep], s[keep]

    def nearest(self, asks: np.ndarray, low: int, high: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(position, position, millionths): for each row that asks (a flag each) the k best of the other block, or of its own if both are one, as best() has them.

        A tile is multiplied once for both ways, and what cannot be among the k best that a row has by then is not looked at again."""
        if self.group[-1] + 1 < len(self.group) or len(self.group) >= 1 << PLACE:  # ids of several vectors, or more rows than a place can number
            for mine, theirs in [(self.left, self.right)] if self.same else [(self.left, self.right), (self.right, self.left)]:
                yield from self.best(mine[asks[mine]], theirs, low, high, k)
            return
        least, most = np.float32(low / SCALE) - self.slack, np.float32(high / SCALE) + self.slack
        bound = np.where(asks, least, np.float32(np.inf)).astype(np.float32)  # of those that do not ask nothing is looked at
        none = (WORST + WORST) << PLACE
        top = np.full((len(asks), k), none, np.int64)

        def merge(x: np.ndarray, y: np.ndarray, s: np.ndarray) -> None:
            if not len(x):
                return
            rows, at = np.unique(x, return_inverse=True)
            width = 2 * PLACE
            keys = np.concatenate([(np.arange(len(rows))[:, None] << width | top[rows]).ravel(), at << width | (WORST - s) << PLACE | y])
            keys.sort()
            at = keys >> width
            best = (keys[np.arange(len(keys)) - np.searchsorted(at, at) < k] & ((1 << width) - 1)).reshape(-1, k)
            top[rows] = best
            bound[rows] = np.maximum(bound[rows], ((WORST - (best[:, -1] >> PLACE)) / SCALE).astype(np.float32) - 2 * self.slack)

        def look(mine: np.ndarray, theirs: np.ndarray, sims: np.ndarray, axis: int, flag: np.ndarray) -> None:
            over = lambda: np.greater_equal(sims, np.expand_dims(bound[mine], axis), out=flag)
            n = np.count_nonzero(over())
            if n > 4 * k * len(mine) and len(theirs) > k:  # a first bound: k of the tile that are under the band's end for sure
                under = np.where(sims < most - 3 * self.slack, sims, NONE) if high < 2 * SCALE else sims
                kth = np.partition(under if axis else np.ascontiguousarray(under.T), len(theirs) - k, axis=1)[:, len(theirs) - k]
                bound[mine] = np.maximum(bound[mine], kth - 2 * self.slack)
                n = np.count_nonzero(over())
            if n > 64 * k * len(mine):  # very many tie
                for found in self.best(mine[asks[mine]], theirs, low, high, k):
                    merge(*found)
            elif n:
                r, c = where(flag)
                x, y = (mine[r], theirs[c]) if axis else (mine[c], theirs[r])
                s = self.sims(x, y)
                keep = (s >= low) & (s < high)
                merge(x[keep], y[keep], s[keep])

        left, right = self.single[self.left], self.single[self.right]
        room, flags = np.empty(ROWS * COLUMNS, np.float32), np.empty(ROWS * COLUMNS, bool)
        for c in range(0, len(right), COLUMNS):
            columns = self.right[c : c + COLUMNS]
            for r in range(0, len(left), ROWS):
                rows = self.left[r : r + ROWS]
                size, shape = len(rows) * len(columns), (len(rows), len(columns))
                sims, flag = room[:size].reshape(shape), flags[:size].reshape(shape)
                np.matmul(left[r : r + ROWS], right[c : c + COLUMNS].T, out=sims)
                if self.same:
                    _, x, y = np.intersect1d(rows, columns, assume_unique=True, return_indices=True)
                    sims[x, y] = NONE
                if high < 2 * SCALE:
                    sims[where(np.greater_equal(sims, most, out=flag))] = NONE
                look(rows, columns, sims, 1, flag)
                if not self.same:
                    look(columns, rows, sims, 0, flag)
        x, n = np.nonzero(top < none)
        yield x, top[x, n] & ((1 << PLACE) - 1), WORST - (top[x, n] >> PLACE)

    def best(self, asks: np.ndarray, hosts: np.ndarray, low: int, high: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(position, position, millionths): for each of asks the k hosts most alike in the band, then by id; an id counts once, by its best vector, and never for itself."""
        if not len(asks) or not len(hosts):
            return
        group = self.group[hosts]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))  # where an id begins
        starts = first[:: max(1, len(first) // max(64, 8 * k))]  # pieces of whole ids: their maxima are of different ids
        repeats = int(np.diff(np.append(first, len(hosts))).max())
        least, most = np.float32(low / SCALE) - self.slack, np.float32(high / SCALE) + self.slack
        host = np.ascontiguousarray(self.single[hosts].T)
        step = int(min(ROWS, max(16, (1 << 20) // len(hosts))))
        room, flags = np.empty((step, len(hosts)), np.float32), np.empty((step, len(hosts)), bool)
        for r in range(0, len(asks), step):
            rows = asks[r : r + step]
            sims, flag = room[: len(rows)], flags[: len(rows)]
            np.matmul(self.single[rows], host, out=sims)
            if self.same:
                lo, hi = np.searchsorted(group, self.group[rows]), np.searchsorted(group, self.group[rows], "right")
                for a, (b, c) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
                    sims[a, b:c] = NONE
            if high < 2 * SCALE:  # what may lie above the band once double precision decides bounds nothing, but stays in the choice
                x, y = where(np.greater_equal(sims, most - 3 * self.slack, out=flag))
                above = sims[x, y]
                sims[x, y] = NONE
            top = np.maximum.reduceat(sims, starts, axis=1)
            bound = np.partition(top, top.shape[1] - k, axis=1)[:, top.shape[1] - k] - 2 * self.slack if top.shape[1] >= k else np.full(len(rows), NONE)
            if high < 2 * SCALE:
                sims[x, y] = np.where(above < most, above, NONE)
            x, y = where(np.greater_equal(sims, np.maximum(bound, max(least, NONE / 2))[:, None], out=flag))
            if len(x) > max(1 << 18, 64 * k * len(rows)):
                x, y = self.crowded(rows, hosts, group, sims, low, high, k * repeats)
            s = self.sims(rows[x], hosts[y])
            keep = (s >= low) & (s < high)
            x, y, s = x[keep], y[keep], s[keep]
            if repeats > 1:
                order = np.lexsort((-s, group[y], x))
                x, y, s = x[order], y[order], s[order]
                keep = np.concatenate([[True], (x[1:] != x[:-1]) | (group[y[1:]] != group[y[:-1]])])[: len(x)]
                x, y, s = x[keep], y[keep], s[keep]
            order = np.lexsort((group[y], -s, x))
            x, y, s = x[order], y[order], s[order]
            keep = np.arange(len(x)) - np.searchsorted(x, x) < k
            yield rows[x[keep]], hosts[y[keep]], s[keep]

    def crowded(self, rows: np.ndarray, hosts: np.ndarray, group: np.ndarray, sims: np.ndarray, low: int, high: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Where very many tie: the `most` best of each row, by similarity and id in one number."""
        xs, ys, wide = [], [], self.m[hosts]
        for r, row in enumerate(rows.tolist()):
            s = np.rint(wide @ self.m[row] * SCALE).astype(np.int64)
            y = np.flatnonzero((sims[r] > NONE / 2) & (s >= low) & (s < high))
            if len(y) > most:
                rank = (s[y] << 31) - group[y]
                y = y[np.argpartition(rank, len(y) - most)[len(y) - most :]]
            xs.append(np.full(len(y), r))
            ys.append(y)
        return np.concatenate(xs), np.concatenate(ys)

    def joined(self, label: np.ndarray, low: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """(label of each label, the links that were needed): labels of both blocks joined by the pairs at low or more. Where all rows of a tile have one label already, nothing is multiplied."""
        parent = np.arange(int(label.max()) + 1)
        used = []

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = int(parent[x])
            return x

        def link(rows: np.ndarray, columns: np.ndarray) -> None:
            nonlocal parent
            a, b = parent[label[rows]], parent[label[columns]]
            sims = self.single[rows] @ self.single[columns].T
            open_ = (sims >= np.float32(low / SCALE) - self.slack) & (a[:, None] != b)
            x, y = where(open_)
            if not len(x):
                return
            sure = sims[x, y] >= np.float32(low / SCALE) + self.slack
            sure[~sure] = self.sims(rows[x[~sure]], columns[y[~sure]]) >= low
            for code in np.unique(a[x[sure]] * len(parent) + b[y[sure]]).tolist():
                p, q = divmod(code, len(parent))
                rp, rq = find(p), find(q)
                if rp != rq:
                    parent[max(rp, rq)] = min(rp, rq)
                    used.append((p, q))
            while (parent[parent] != parent).any():
                parent = parent[parent]

        for r in range(0, len(self.left), ROWS):
            rows = self.left[r : r + ROWS]
            for c in range(0, len(self.right), COLUMNS):
                columns = self.right[c : c + COLUMNS]
                if self.same and columns[-1] < rows[0]:
                    continue
                a, b = parent[label[rows]], parent[label[columns]]
                values, counts = np.unique(np.concatenate([a, b]), return_counts=True)
                usual = values[counts.argmax()]
                odd, others = rows[a != usual], columns[b != usual]
                if len(odd):
                    link(odd, columns)
                if len(others) and len(odd) < len(rows):
                    link(rows[a == usual], others)
        return parent, used


def where(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a contiguous matrix of flags: eight at a time, then those of the words that have any."""
    if mask.size % 8:
        return np.divmod(np.flatnonzero(mask), mask.shape[1])
    words = np.flatnonzero(mask.reshape(-1).view(np.uint64))
    word, at = np.nonzero(mask.reshape(-1, 8)[words])
    return np.divmod(words[word] * 8 + at, mask.shape[1])


def table_of(chunks: list[dict], schema: pa.Schema) -> pa.Table:
    """Columns tile by tile as one table, a batch each."""
    return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array(c[n]).cast(schema.field(n).type) for n in schema.names], schema=schema) for c in chunks], schema)
