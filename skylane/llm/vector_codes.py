"""Compression of vectors to codes of codebook entries, one for each part, found by vantage-point trees.

Vectors are scaled to integers and cut into equal parts; every part position has a codebook, trained by rounds of
assignment and averaging. The nearest entry comes from a vantage-point tree over a position's entries: squared distances
are exact integers, the radii and bounds drawn from them are rounded outwards, and a subtree is left out only if its
bound lies strictly above the best distance so far, so that ties are met and go to the lower index.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Rows whose parts are assigned at once in a worker.
ROWS = 4096
#: Relative room for the rounding of a square root or a product.
ROOM = 2.0**-49


class VantageTrees:
    """A tree for each part position over codebooks of shape (parts, entries, components), whole numbers.

    A node above leaves has a vantage entry and two children, with the range of distances that the child's entries
    have from it; a leaf has up to ``leaf`` entries, and two at least. Trees of all positions lie in the same arrays.
    """

    def __init__(self, codebooks: np.ndarray, leaf: int = 4):
        self.parts, self.entries, self.width = codebooks.shape
        self.points = np.ascontiguousarray(codebooks, dtype=np.int64).reshape(-1, self.width)
        self.vantage: list[int] = []  # -1: a leaf
        self.members: list[list[int]] = []
        self.children: list[tuple[int, int]] = []
        self.low: list[tuple[float, float]] = []
        self.high: list[tuple[float, float]] = []
        self.leaf, self.depth = max(2, leaf), 1
        self.roots = np.array([self._grow(list(range(p * self.entries, (p + 1) * self.entries)), 1) for p in range(self.parts)], dtype=np.int64)
        self.vantage, self.children = np.array(self.vantage), np.array(self.children)
        self.members, self.low, self.high = np.array(self.members), np.array(self.low), np.array(self.high)

    def _squared(self, at: list[int], to: int) -> np.ndarray:
        gap = self.points[at] - self.points[to]
        return (gap * gap).sum(axis=1)

    def _grow(self, at: list[int], depth: int) -> int:
        node, self.depth = len(self.vantage), max(self.depth, depth)
        for column, empty in ((self.vantage, -1), (self.members, [at[-1]] * self.leaf), (self.children, (0, 0)), (self.low, (0.0, 0.0)), (self.high, (0.0, 0.0))):
            column.append(empty)
        if len(at) <= self.leaf:
            self.members[node] = (at + [at[-1]] * self.leaf)[: self.leaf]  # repeated entries change nothing
            return node
        middle = self.points[at].astype(float).mean(axis=0)
        vantage = at[int(((self.points[at] - middle) ** 2).sum(axis=1).argmax())]
        rest = [x for x in at if x != vantage]
        squared = self._squared(rest, vantage)
        order = np.argsort(squared, kind="stable")
        halves = [order[: len(order) // 2], order[len(order) // 2 :]]
        self.vantage[node] = vantage
        self.low[node] = tuple(math.sqrt(float(squared[h].min())) * (1 - ROOM) for h in halves)
        self.high[node] = tuple(math.sqrt(float(squared[h].max())) * (1 + ROOM) for h in halves)
        self.children[node] = tuple(self._grow([rest[i] for i in h], depth + 1) for h in halves)
        return node

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and its squared distance for x of shape (rows, parts, components), each (rows, parts)."""
        flat = np.ascontiguousarray(x, dtype=np.int64).reshape(-1, self.width)
        n = len(flat)
        best, entry = np.full(n, np.iinfo(np.int64).max), np.zeros(n, dtype=np.int64)
        waiting, bounds = np.zeros((n, self.depth + 1), dtype=np.int64), np.zeros((n, self.depth + 1))
        waiting[:, 0] = np.tile(self.roots, n // self.parts)
        left = np.ones(n, dtype=np.int64)  # nodes that wait for each row's part

        def meet(rows: np.ndarray, at: np.ndarray, squared: np.ndarray) -> None:
            nearer = (squared < best[rows]) | ((squared == best[rows]) & (at < entry[rows]))
            best[rows[nearer]], entry[rows[nearer]] = squared[nearer], at[nearer]

        rows = np.arange(n)
        while len(rows):
            left[rows] -= 1
            node, bound = waiting[rows, left[rows]], bounds[rows, left[rows]]
            open_ = bound * bound * (1 - ROOM) <= best[rows].astype(float) * (1 + ROOM)
            node, on = node[open_], rows[open_]
            vantage = self.vantage[node]
            leaf = vantage < 0
            if leaf.any():
                at, who = self.members[node[leaf]], on[leaf]
                gap = flat[who][:, None, :] - self.points[at]
                squared = np.einsum("ijk,ijk->ij", gap, gap)
                for j in range(self.leaf):
                    meet(who, at[:, j], squared[:, j])
            inner = ~leaf
            if inner.any():
                at, who, node = vantage[inner], on[inner], node[inner]
                gap = flat[who] - self.points[at]
                squared = np.einsum("ij,ij->i", gap, gap)
                meet(who, at, squared)
                way = np.sqrt(squared.astype(float))[:, None]
                lower = np.maximum(np.maximum(way * (1 - ROOM) - self.high[node], self.low[node] - way * (1 + ROOM)), 0.0)
                first = (lower[:, 1] < lower[:, 0]).astype(np.int64)  # the child to be met first is pushed last
                for child in (1 - first, first):
                    waiting[who, left[who]] = self.children[node, child]
                    bounds[who, left[who]] = lower[np.arange(len(who)), child]
                    left[who] += 1
            rows = rows[left[rows] > 0]
        return (entry % self.entries).reshape(-1, self.parts), best.reshape(-1, self.parts)


def _whole(batch: pa.RecordBatch, column: int, parts: int) -> np.ndarray:
    data = np.frombuffer(b"".join(batch.column(column).to_pylist()), dtype="<i4")
    return data.reshape(batch.num_rows, parts, -1)


def prepare(rows: DataFrame, vec_id: str, vector: str, parts: int, scale: int, keep: tuple[str, ...]) -> tuple[DataFrame, int]:
    """(vec_id, *keep, whole) of the rows that can be coded, and their number of components: ``whole`` has floor(scale * x) as int32.

    Left out are rows whose vector is null, empty, holds a null or a component that isn't finite, isn't as long as that of
    the smallest vec_id or can't be cut into equal parts. A component too large for exact distances raises a ValueError.
    """
    usable = F.col("whole").isNotNull() & F.forall("whole", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & (F.size("whole") > 0) & (F.size("whole") % parts == 0)
    found = rows.select(F.col(vec_id).alias("vec_id"), *keep, F.col(vector).cast("array<double>").alias("whole")).filter(usable)
    first = found.orderBy(F.col("vec_id").asc_nulls_last(), "whole").select(F.size("whole").alias("n")).first()
    if first is None:
        return rows.sparkSession.createDataFrame([], found.drop("whole").schema).withColumn("whole", F.lit(b"")), 0
    dim = first.n
    most = math.isqrt((2**63 - 1) // dim) // 2  # so that squared distances over all parts fit in a long
    schema = found.select("vec_id", *keep, F.lit(b"").alias("whole")).schema

    def to_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(np.asarray(batch.column(batch.num_columns - 1).flatten(), dtype=np.float64).reshape(-1, dim) * scale)
            if (np.abs(x) > most).any():
                raise ValueError(f"scaled components beyond {most} can't be coded exactly")
            data = x.astype("<i4").tobytes()
            packed = pa.array([data[4 * dim * i : 4 * dim * (i + 1)] for i in range(len(x))], type=pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], names=schema.names)

    coded = found.filter(F.size("whole") == dim).select("vec_id", *keep, "whole").mapInArrow(to_whole, schema)
    return stage(coded, "vectors"), dim


def first_entries(whole: DataFrame, entries: int, parts: int) -> np.ndarray:
    """The codebooks to begin with: the parts of the rows with the smallest ids; nulls come last, repeated ids by their vectors."""
    rows = whole.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(entries).select("whole").collect()
    return np.stack([np.frombuffer(r.whole, dtype="<i4").reshape(parts, -1).astype(np.int64) for r in rows], axis=1)


def train(whole: DataFrame, codebooks: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks after some rounds of assignment and averaging over all rows (componentwise floor of the mean; unused entries stay).

    Each task sends its sums for each entry, as many as the codebooks have components; the totals, no more than that, go to the driver.
    """
    parts, entries, width = codebooks.shape
    for _ in range(rounds):
        trees = VantageTrees(codebooks)

        def tally(batches: Iterator[pa.RecordBatch], trees: VantageTrees = trees) -> Iterator[pa.RecordBatch]:
            n, totals = np.zeros(parts * entries, dtype=np.int64), np.zeros((width, parts * entries), dtype=np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    x = _whole(batch.slice(at, ROWS), 0, parts)
                    code = (trees.nearest(x)[0] + np.arange(parts) * entries).ravel()
                    n += np.bincount(code, minlength=len(n))
                    for j in range(width):  # below 2**53, so exact
                        totals[j] += np.bincount(code, weights=x[:, :, j].ravel(), minlength=len(n)).astype(np.int64)
            slot, j = np.repeat(np.flatnonzero(n), width), np.tile(np.arange(width), np.count_nonzero(n))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (slot, j, totals[j, slot], n[slot])], names=["slot", "j", "total", "n"])

        sums = whole.select("whole").mapInArrow(tally, "slot long, j long, total long, n long")
        codebooks = codebooks.copy()
        for r in sums.groupBy("slot", "j").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
            codebooks[r.slot // entries, r.slot % entries, r.j] = int(r.total) // r.n
    return codebooks


def encode(whole: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """Instead of ``whole``, code (two hex digits for each part's entry) and error (squared distances summed over parts)."""
    trees = VantageTrees(codebooks)
    digits = np.array([f"{i:02x}" for i in range(trees.entries)])
    schema = whole.drop("whole").withColumns({"code": F.lit(""), "error": F.lit(0).cast("long")}).schema

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, ROWS):
                batch = big.slice(at, ROWS)
                entry, squared = trees.nearest(_whole(batch, batch.num_columns - 1, trees.parts))
                text = np.ascontiguousarray(digits[entry]).view(f"U{2 * trees.parts}").ravel()
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(text.tolist(), type=pa.string()), pa.array(squared.sum(axis=1))], names=schema.names)

    return whole.mapInArrow(code, schema)


def compress(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, keep: tuple[str, ...] = ()) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors, (vec_id, *keep, code, error), and the codebooks, of shape (parts, entries, components).

    For rows left out see prepare(). Rows that share an id are coded each; with fewer rows than entries codebooks have as
    many entries as there are rows. An empty table gives no rows and empty codebooks. Only the named columns are read.
    Rows are spread as they are read, whatever their ids or labels; what goes to the driver is as large as the codebooks.
    """
    if not 0 < entries <= 256:
        raise ValueError("two hex digits name up to 256 entries")
    whole, dim = prepare(rows, vec_id, vector, parts, scale, keep)
    if not dim:
        return whole.drop("whole").withColumns({"code": F.lit(""), "error": F.lit(0).cast("long")}), np.zeros((parts, 0, 0), dtype=np.int64)
    codebooks = train(whole, first_entries(whole, entries, parts), rounds)
    return stage(encode(whole, codebooks), "codes"), codebooks


def decode(coded: DataFrame, codebooks: np.ndarray, scale: int = 4096, code: str = "code") -> DataFrame:
    """coded with ``vector``, the entries that its codes name, as array<double>; a null code gives null."""
    table = F.lit(codebooks.reshape(-1, codebooks.shape[2]).tolist()) if codebooks.size else F.array().cast("array<array<long>>")
    entries = codebooks.shape[1]
    named = F.transform(F.sequence(F.lit(0), F.lit(codebooks.shape[0] - 1)), lambda p: F.element_at(table, (p * entries + F.conv(F.substring(F.col(code), 2 * p + 1, F.lit(2)), 16, 10).cast("int") + 1).cast("int")))
    return coded.withColumn("vector", F.when(F.col(code).isNotNull(), F.transform(F.flatten(named), lambda x: x / F.lit(float(scale)))))


def digest(codebooks: np.ndarray) -> str:
    """sha256 of all components by part, entry and position, as decimals joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame, label: str = "label", salts: int = 16) -> DataFrame:
    """coded with label_error, error summed over the rows of an equal label, nulls together; a frequent label's rows are dealt to several tasks."""
    totals = coded.groupBy(label).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    totals = totals.select(F.col(label).alias("_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    own = F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)).cast("int")
    return coded.join(totals, F.col(label).eqNullSafe(F.col("_label")) & (own == F.col("_salt"))).drop("_label", "_salt")
