"""Packing of tokenized documents into fixed windows by non-negative least squares over length combinations.

Each document becomes full windows and one rest. Lengths fall into bins: one for each length up to ``exact`` tokens, then
one for each further ``window / units`` tokens, so that there are some hundred bins however many documents there are.
Shallow combinations, of up to three different bins, that fill a window or nearly so are enumerated once; non-negative
least squares finds how often each is to be used so that together they consume the histogram; the counts are rounded
down, cut back where a bin would be overdrawn, and what remains is packed greedily on the histogram alone. The resulting
plan (a bounded table) says which ranks of a bin go to which sequences, so Spark assigns every piece by its rank among
the pieces of its bin: counts by partition, an offset for each partition, and a running number inside it. No bin's pieces
meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, crc, encoder, slices, stage

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bin int, part int, own long"


def bin_sizes(window: int, units: int, exact: int) -> np.ndarray:
    """The longest length of each bin."""
    exact = min(exact, window)
    return np.array([*range(1, exact + 1), *(min(window, exact + k) for k in range(window // units, window - exact + window // units, window // units))])


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, window: int, sizes: np.ndarray, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most window tokens of every document, with their bin, input partition and number among the pieces of their bin in it.

    A null text is empty, so its only id is end_id. Repeated rows are packed each on its own.
    """
    bins = np.searchsorted(sizes, np.arange(window + 1)).tolist()  # of each length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, end = TaskContext.get().partitionId(), [0] * len(sizes), np.array([end_id], dtype="<u4").tobytes()
        for batch in slices(batches):
            found, lengths = encoder(tokenizer, spaced=False).encode(batch.column(1))
            data, at, out = memoryview(found).cast("B"), 0, []
            for doc_id, n in zip(batch.column(0).to_pylist(), lengths.tolist(), strict=True):
                ids = bytes(data[4 * at : 4 * (at + n)]) + end
                at += n
                for start in range(0, n + 1, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    length = len(piece) // 4
                    bin_ = bins[length]
                    out.append((doc_id, start, length, crc(piece), n + 1, bin_, part, seen[bin_], *([piece] if keep_ids else [])))
                    seen[bin_] += 1
            columns = list(zip(*out, strict=True)) or [[]] * (8 + keep_ids)
            types = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64()] + [pa.binary()] * keep_ids
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", "part", "own"] + ["ids"] * keep_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)

    return bounded(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(cut, PIECES + (", ids binary" if keep_ids else ""))


def combinations(sizes: np.ndarray, window: int, times: int = 16, fill: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Bins and multiplicities (three for each combination, unused ones 0 times) of combinations that fill a window or nearly so.

    m pieces of a bin, n of the largest that fits so often into the rest, and of the largest that still fits as many as
    do, for m up to ``times`` or as many as fit and n up to ``fill``; and a piece each of two long bins and of the largest
    that fits beside them. sizes: those of the bins that have pieces.
    """
    fitting = np.searchsorted(sizes, np.arange(window + 1), side="right") - 1  # the largest bin for so many tokens
    found = set()
    for i, a in enumerate(sizes.tolist()):
        found.add(((i, window // a),))
        for m in {*range(1, min(times, window // a) + 1), window // a}:
            rest = window - m * a
            for n in range(1, fill + 1):
                j = int(fitting[rest // n])
                if 0 <= j < i:
                    found.add(((i, m), (j, n)))
                    left = rest - n * int(sizes[j])
                    if 0 <= (k := int(fitting[left])) < j:
                        found.add(((i, m), (j, n), (k, left // int(sizes[k]))))
    long_ = [i for i, a in enumerate(sizes.tolist()) if times * a >= window]
    for i in long_:
        for j in long_:
            if j < i and 0 <= (k := int(fitting[max(0, window - int(sizes[i] + sizes[j]))])) < j:
                found.add(((i, 1), (j, 1), (k, 1)))
    padded = np.array([[*x, *[(0, 0)] * (3 - len(x))] for x in sorted(found)], dtype=np.int64)
    return padded[:, :, 0], padded[:, :, 1]


def nonnegative_least_squares(index: np.ndarray, values: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 that makes |a x - b| small, column j of a holding values[j] in rows index[j]: active sets, steepest column first."""
    x, active = np.zeros(len(index)), []
    norms, scale = np.sqrt((values**2).sum(axis=1)), max(1.0, float(np.abs(b).max(initial=0)))

    def dense(j: int) -> np.ndarray:
        out = np.zeros(len(b))
        np.add.at(out, index[j], values[j])
        return out

    columns = np.empty((len(b), 0))
    for _ in range(min(rounds, 3 * len(b)) if len(index) else 0):
        rest = b - columns @ x[active]
        gradient = (values * rest[index]).sum(axis=1) / norms
        gradient[active] = -np.inf
        best = int(np.argmax(gradient))
        if gradient[best] <= 1e-9 * scale:
            break
        active.append(best)
        columns = np.column_stack((columns, dense(best)))
        while True:
            gram = columns.T @ columns
            part = np.linalg.solve(gram + 1e-10 * np.trace(gram) / len(gram) * np.eye(len(gram)), columns.T @ b)
            if part.min() > -1e-9:
                x[:] = 0
                x[active] = np.maximum(part, 0)
                break
            now = x[active]
            low = part < 0
            step = np.min(now[low] / np.maximum(now[low] - part[low], 1e-30))
            moved = now + step * (part - now)
            x[active] = np.maximum(moved, 0)
            keep = moved > 1e-9
            active, columns = [j for j, good in zip(active, keep, strict=True) if good], columns[:, keep]
            if not active:
                break
    return x


def plan(histogram: np.ndarray, sizes: np.ndarray, window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (bin, first rank, end rank, first sequence, first slot, places) that assign every rank of each bin.

    Rank r of a bin, with f = first rank, goes to sequence first + (r - f) // places at slot + (r - f) % places.
    """
    left = histogram.astype(np.int64).copy()
    runs: list[tuple[list[tuple[int, int]], int]] = [([(len(sizes) - 1, 1)], int(left[-1]))] if left[-1] else []
    left[-1] = 0
    if left.any():
        some = np.flatnonzero(left)
        index, times = combinations(sizes[some], window)
        index = some[index]
        tokens = sizes[index] * times  # tokens, not pieces, are to be consumed; padding is one more row, and none is wanted
        rows = np.column_stack((index, np.full(len(index), len(sizes))))
        values = np.column_stack((tokens, window - tokens.sum(axis=1))).astype(float)
        counts = np.floor(nonnegative_least_squares(rows, values, np.append(sizes * left, 0.0)) + 1e-6).astype(np.int64)
        for j in np.argsort(-counts, kind="stable"):
            if counts[j] <= 0:
                break
            need = [(int(i), int(n)) for i, n in zip(index[j], times[j], strict=True) if n]
            often = min(int(counts[j]), *(int(left[i]) // n for i, n in need))
            if often:
                for i, n in need:
                    left[i] -= often * n
                runs.append((need, often))
    while left.any():  # each turn empties a bin or packs a last window
        room, taken = window, {}
        for i in np.flatnonzero(left)[::-1].tolist():
            n = min(int(left[i]), room // int(sizes[i]))
            if n:
                taken[i] = n
                room -= n * int(sizes[i])
        often = min(int(left[i]) // n for i, n in taken.items())
        for i, n in taken.items():
            left[i] -= often * n
        runs.append((list(taken.items()), often))
    rows, rank, sequence = [], [0] * len(sizes), 0
    for combination, often in runs:
        slot = 0
        for i, n in combination:
            rows.append((i, rank[i], rank[i] + n * often, sequence, slot, n))
            rank[i] += n * often
            slot += n
        sequence += often
    return rows


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096, units: int = 256, exact: int = 256, keep_ids: bool = False) -> DataFrame:
    """Packs all documents (doc_id, text) into sequences of window tokens; one row for each piece.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, with keep_ids). Offsets in a
    sequence run from 0 without gaps; what is left of the window is padding. Sequence numbers run from 0 without gaps.
    Empty and null texts are pieces of one id; an empty table gives no rows; other columns are ignored.
    """
    spark, sizes = docs.sparkSession, bin_sizes(window, units, exact)
    pieces = stage(cut_documents(docs, tokenizer, end_id, window, sizes, keep_ids), "pieces")
    counts = stage(pieces.groupBy("bin", "part").agg(F.count("*").alias("n")), "counts")
    histogram = np.zeros(len(sizes), dtype=np.int64)
    for row in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect():  # a row for each bin at most
        histogram[row.bin] = row.n
    # Rank of a piece among those of its bin: all of earlier parts, and its own place among those of this part and bin.
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = (
        pieces.join(before.select("bin", "part", F.coalesce("before", F.lit(0)).alias("before")), ["bin", "part"])
        .withColumn("rank", F.col("own") + F.col("before"))
    )
    table = spark.createDataFrame(plan(histogram, sizes, window), "of int, low long, high long, first long, slot int, places int")
    placed = ranked.join(
        F.broadcast(table),  # bounded by the number of bins, not by the documents
        (F.col("bin") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")),
    ).select(
        *[c for c in pieces.columns if c not in ("bin", "part", "own")],
        (F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("places"))).cast("long").alias("sequence_id"),
        (F.col("slot") + (F.col("rank") - F.col("low")) % F.col("places")).alias("at"),
    )
    earlier = Window.partitionBy("sequence_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long")).drop("at")
