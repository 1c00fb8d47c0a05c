"""Exact top-k inner-product search with a pivot-distance index.

Vectors get one more component so that all have the same length; then the largest inner products are the smallest
Euclidean distances. Every vector is keyed by its nearest pivot and its distance to it, and sorted by both; blocks of
that order are annuli around pivots. An annulus [low, high] around pivot p can't hold anything nearer to a query q than
max(0, d(q, p) - high, low - d(q, p)), by the triangle inequality. A query first scans the annulus in which it lies
itself, which gives it a k-th best score; then it meets the other annuli in the order of their bounds, and from the first that can't
reach that score on none is scored any more. Queries travel in blocks, too: a query block's bound is the best of its
queries'. Which query blocks have to meet which annuli is found first, from bounds alone: for each pivot, a query block
meets the annuli in a range of distances. Only then are vectors sent, of query blocks to the shards of the index in
which annuli are left for them; bounds for each query decide inside a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, partitions, slices, stage

BLOCK = "block string, pivot int, low double, high double, n int, ids binary, vectors binary"
RESULT = "query_row long, query_id long, vec_id long, score long"


def fit_pivots(vectors: DataFrame, pivots: int, sample: int, rounds: int = 5, seed: int = 7) -> np.ndarray:
    """Centres of at most sample rows, those with the least hashed ids, by k-means; an empty table has one zero pivot."""
    rows = vectors.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample).select("vector").collect()
    if not rows:
        return np.zeros((1, 1))
    x = np.array([r.vector for r in rows])
    rng = np.random.default_rng(seed)
    centres = np.unique(x[rng.permutation(len(x))[:pivots]], axis=0)
    for _ in range(rounds):
        nearest = _distances(x, centres).argmin(axis=1)
        centres = np.array([x[nearest == i].mean(axis=0) if (nearest == i).any() else c for i, c in enumerate(centres)])
    return centres


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(ids))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, pivots: int = 64, sample: int = 20_000, block: int = 2048, blocks_per_shard: int = 8) -> DataFrame:
    """The k highest inner products of every query row with every other row: query_id, rank, vec_id, score.

    vectors: vec_id long, vector array<double> of whole numbers (inner products are exact below 2**53). Null ids,
    null vectors and those with null or non-finite components take no part. Shorter vectors count as ending in zeros;
    of rows that share an id each is a candidate, and each a query with results of its own, if is_query holds: only a
    query's own row is left out for it. Ties go to the smaller vec_id. Pivots are fitted on at most
    sample rows; every row is indexed, and results are exact whatever the pivots.
    """
    spark = vectors.sparkSession
    usable = F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("vector").cast("array<double>").alias("vector"), is_query.alias("query"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable).withColumn("row", F.monotonically_increasing_id())  # kept, as rows are written next
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    rows = stage(rows.withColumn("norm", norm), "vectors")
    size = rows.agg(F.count("*").alias("n"), F.max("norm").alias("norm"), F.max(F.size("vector")).alias("dim")).first()
    if not size.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, longest = size.dim, size.norm
    pad = F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("vector")))
    rows = rows.select("vec_id", "query", "row", F.concat(pad, F.array(F.sqrt(F.greatest(F.lit(longest) - F.col("norm"), F.lit(0.0))))).alias("vector"))
    centres = fit_pivots(rows, pivots, sample)

    def matrix(column: pa.Array) -> np.ndarray:
        return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim + 1)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(3))
                d = _distances(x, centres)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, type=pa.int32()), pa.array(d[np.arange(len(x)), near])], names=["vec_id", "query", "row", "vector", "pivot", "distance"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chops sorted rows into annuli, and scores an annulus's own queries against it."""

        def flush(part: pa.Table) -> pa.RecordBatch:
            part = part.combine_chunks()
            ids, row_ids, is_q, x = np.asarray(part["vec_id"]), np.asarray(part["row"]), np.asarray(part["query"].fill_null(False)), matrix(part["vector"].chunk(0))[:, :dim]
            pivot, d = int(part["pivot"][0].as_py()), np.asarray(part["distance"])
            q = np.flatnonzero(is_q)
            own = [[], [], [], []]
            floor = np.full(len(q), -np.inf)
            scores = x[q] @ x.T
            for i, row in enumerate(q):
                others = np.delete(np.arange(len(ids)), row)
                best = others[_best(ids[others], scores[i, others], k)]
                own[0] += [ids[row]] * len(best)
                own[1] += ids[best].tolist()
                own[2] += scores[i, best].astype(np.int64).tolist()
                own[3] += [row_ids[row]] * len(best)
                if len(best) == k:
                    floor[i] = scores[i, best[-1]]
            flat = np.concatenate([x[q], np.zeros((len(q), 1))], axis=1)
            to = _distances(flat, centres) if len(q) else np.zeros((1, len(centres)))
            near, far = to.min(axis=0), to.max(axis=0)
            row = {"block": f"{pivot}:{d[0]!r}:{ids[0]}:{row_ids[0]}", "pivot": pivot, "low": d.min(), "high": d.max(), "n": len(ids), "ids": ids.astype("<i8").tobytes(), "vectors": x.astype("<f8").tobytes(), "q_ids": ids[q].astype("<i8").tobytes(), "q_rows": row_ids[q].astype("<i8").tobytes(), "q_vectors": x[q].astype("<f8").tobytes(), "q_floor": floor.astype("<f8").tobytes(), "q_n": len(q), "q_norm": float((x[q] ** 2).sum(1).max(initial=0)), "q_least": float(floor.min(initial=np.inf)), "q_near": near.tolist(), "q_far": far.tolist(), "own_q": own[0], "own_id": own[1], "own_score": own[2], "own_row": own[3]}
            return pa.RecordBatch.from_pylist([row], schema=out)

        out = pa.schema([("block", pa.string()), ("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("n", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("q_ids", pa.binary()), ("q_rows", pa.binary()), ("q_vectors", pa.binary()), ("q_floor", pa.binary()), ("q_n", pa.int32()), ("q_norm", pa.float64()), ("q_least", pa.float64()), ("q_near", pa.list_(pa.float64())), ("q_far", pa.list_(pa.float64())), ("own_q", pa.list_(pa.int64())), ("own_id", pa.list_(pa.int64())), ("own_score", pa.list_(pa.int64())), ("own_row", pa.list_(pa.int64()))])
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            while held.num_rows:
                pivot = np.asarray(held["pivot"])
                same = int(np.argmax(pivot != pivot[0])) or len(pivot)
                if same == len(pivot) and same < block:
                    break  # more of this annulus may follow
                take = min(same, block)
                yield flush(held.slice(0, take))
                held = held.slice(take)
        if held is not None and held.num_rows:
            yield flush(held)

    keyed = rows.mapInArrow(key, "vec_id long, query boolean, row long, vector array<double>, pivot int, distance double")
    order = ["pivot", "distance", "vec_id", "row"]
    n_ranges = max(1, min(partitions(rows), -(-size.n // block)))
    index = stage(
        keyed.repartitionByRange(n_ranges, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(blocks, BLOCK + ", q_ids binary, q_rows binary, q_vectors binary, q_floor binary, q_n int, q_norm double, q_least double, q_near array<double>, q_far array<double>, own_q array<long>, own_id array<long>, own_score array<long>, own_row array<long>"),
        "index",
    )
    shards = max(1, index.count() // blocks_per_shard)
    shard = F.pmod(F.xxhash64("block"), F.lit(shards))
    slack = 1e-6 * (1 + longest)
    # From bounds alone: a query block can gain from the annuli of a pivot whose distances come within ``reach`` of its queries'.
    asking = index.filter("q_n > 0").select(F.col("block").alias("home"), "q_norm", "q_least", F.posexplode(F.arrays_zip("q_near", "q_far")).alias("pivot", "to"))
    reach = F.sqrt(F.greatest(F.lit(0.0), F.col("q_norm") + longest + 2 * slack - 2 * F.col("q_least")))
    asking = asking.select("home", "pivot", (F.col("to.q_near") - reach).alias("from"), (F.col("to.q_far") + reach).alias("until"))
    meets = index.select("block", "pivot", "low", "high", shard.alias("shard")).join(asking, "pivot").filter("high >= from and low <= until and block <> home")
    meets = meets.select("home", "shard").distinct()
    # Each annulus is in one shard; of a query block one copy goes to every shard in which it meets any.
    queries = index.select(F.col("block").alias("home"), "q_ids", "q_rows", "q_vectors", "q_floor", "q_norm", "q_least", "q_near", "q_far").join(meets, "home")
    annuli = index.select("block", "pivot", "low", "high", "ids", "vectors", shard.alias("shard"))
    near, far = (F.element_at(c, F.col("pivot") + 1) for c in ("q_near", "q_far"))
    gap = F.greatest(F.lit(0.0), near - F.col("high"), F.col("low") - far)
    bound = (F.col("q_norm") + longest - gap * gap) / 2 + slack
    pairs = annuli.join(queries, "shard").filter(F.col("block") != F.col("home")).withColumn("bound", bound).filter(F.col("bound") >= F.col("q_least"))
    pairs = pairs.sortWithinPartitions("home", F.desc("bound"), "block").select("home", "bound", "pivot", "low", "high", "ids", "vectors", "q_ids", "q_rows", "q_vectors", "q_floor")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"home": None}

        def result() -> pa.RecordBatch:
            found = [(np.full(len(i), r), np.full(len(i), q), i, s) for r, q, (i, s) in zip(state["rows"], state["ids"], state["found"], strict=True) if len(i)]
            columns = [np.concatenate(c).astype(np.int64) for c in zip(*found, strict=True)] if found else [np.empty(0, dtype=np.int64)] * 4
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_row", "query_id", "vec_id", "score"])

        for batch in slices(batches, 5):
            for row in batch.to_pylist():
                if row["home"] != state["home"]:
                    if state["home"] is not None:
                        yield result()
                    q = np.frombuffer(row["q_vectors"], dtype="<f8").reshape(-1, dim)
                    flat = np.concatenate([q, np.zeros((len(q), 1))], axis=1)
                    state = {"home": row["home"], "ids": np.frombuffer(row["q_ids"], dtype="<i8"), "rows": np.frombuffer(row["q_rows"], dtype="<i8"), "q": q, "norm": (q * q).sum(1), "to": _distances(flat, centres), "floor": np.frombuffer(row["q_floor"], dtype="<f8").copy(), "found": [(np.empty(0, dtype=np.int64), np.empty(0))] * len(q)}
                if row["bound"] < state["floor"].min(initial=np.inf):
                    continue  # nor can it from those that follow: they have lower bounds
                to = state["to"][:, row["pivot"]]
                least = np.maximum(0, np.maximum(to - row["high"], row["low"] - to))
                open_ = np.flatnonzero((state["norm"] + longest - least * least) / 2 + slack >= state["floor"])
                if not len(open_):
                    continue  # no query of the block can gain from this annulus
                ids = np.frombuffer(row["ids"], dtype="<i8")
                scores = state["q"][open_] @ np.frombuffer(row["vectors"], dtype="<f8").reshape(-1, dim).T
                for at, i in enumerate(open_):
                    good = np.flatnonzero(scores[at] >= state["floor"][i])
                    if len(good):
                        both = np.concatenate([state["found"][i][0], ids[good]]), np.concatenate([state["found"][i][1], scores[at][good]])
                        best = _best(*both, k)
                        state["found"][i] = both[0][best], both[1][best]
                        if len(best) == k:
                            state["floor"][i] = max(state["floor"][i], both[1][best[-1]])
        if state["home"] is not None:
            yield result()

    others = bounded(pairs).mapInArrow(expand, RESULT)
    own = index.select(F.explode(F.arrays_zip("own_row", "own_q", "own_id", "own_score")).alias("x")).select(F.col("x.own_row").alias("query_row"), F.col("x.own_q").alias("query_id"), F.col("x.own_id").alias("vec_id"), F.col("x.own_score").alias("score"))
    # At most k candidates of each shard meet here: they are merged as sorted arrays, so a query's group stays small.
    best = F.slice(F.sort_array(F.collect_list(F.struct("score", (-F.col("vec_id")).alias("minus"))), asc=False), 1, k)
    merged = own.unionByName(others).groupBy("query_row", "query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("at", "x"))
    return merged.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), (-F.col("x.minus")).alias("vec_id"), F.col("x.score").alias("score"))
