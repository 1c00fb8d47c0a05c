"""Near-duplicate documents by HyperMinHash sketches, banding, corrected estimates and exact verification.

A document's set holds its distinct word shingles. Its sketch has ``registers`` buckets, each with its own hash
function; of a bucket's minimum hash only the count of leading zeros and some mantissa bits are stored (16 bits in all).
Documents of equal sets form one class. The registers of class representatives are banded. A band's bucket links its
members to a few centres, not all members to each other; a pair is dropped if its estimated similarity, corrected for
registers that agree by chance, is five standard deviations below the threshold; the rest are confirmed on full sets.
Buckets whose members are still in different components afterwards are taken up again with other centres, and more of
them each round, until every pair of a bucket is in one component or has been compared. So nothing is capped, and a
group of n copies costs about n comparisons.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded, partitions, slices, stage
from .components import connected_components

ROWS, BANDS = 5, 25
REGISTERS = ROWS * BANDS
MANTISSA = 10
#: Owners up to which a shingle counts as rare: the pairs that share it are few, and taken from it.
RARE = 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Keys of the hashes of sketches, and of those that confirm links.
KEYS = ("0123456789123456", "9876543210987654")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = _mix(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * _BASE)
_MULTIPLIERS, _OFFSETS = (_SEEDS[:REGISTERS] | np.uint64(1))[:, None], _SEEDS[REGISTERS:][:, None]


def shingles(text: str | None, size: int = 5, key: str = KEYS[0]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles (A-Z lower-cased, words between ASCII white space).

    A text of fewer words has its whole word sequence as one shingle; a null text or one without words has none. Words
    are hashed with a keyed function, and their hashes mixed in order; another key gives unrelated hashes.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashed = hash_array(np.array(words, dtype=object), hash_key=key, categorize=False)
    k = min(size, len(words))
    n = len(words) - k + 1
    out = hashed[:n]
    for i in range(1, k):
        out = (out ^ (out >> np.uint64(29))) * _BASE + hashed[i : n + i]
    return np.unique(_mix(out + np.uint64(k)))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a non-empty set: leading zeros of each bucket's minimum hash, then its next mantissa bits."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(least, ((hashes[at : at + 2048] ^ _OFFSETS) * _MULTIPLIERS).min(axis=1), out=least)
    zeros = 63 - np.minimum(63, np.floor(np.log2(np.maximum(least, 1).astype(np.float64)))).astype(np.uint64)
    mantissa = np.where(zeros < 63, (least << np.minimum(zeros + np.uint64(1), np.uint64(63))) >> np.uint64(64 - MANTISSA), np.uint64(0))
    return (zeros << np.uint64(MANTISSA) | mantissa).astype("<u2")


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    rows, key = registers.reshape(BANDS, ROWS).astype(np.uint64), np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = _mix(key * _BASE + rows[:, i])
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of pairs of sketches, without the registers expected to agree by chance."""
    chance = 1 / (3 << MANTISSA)  # sum over leading zeros of the squared probability, times that of the mantissa
    return np.maximum(0, ((a == b).mean(axis=1) - chance) / (1 - chance))


def _sketches(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, prints, sketches, keys = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, size)
                n.append(len(found))
                if len(found):
                    registers = sketch(found)
                    prints.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    sketches.append(registers.tobytes())
                    keys.append(band_keys(registers))
                else:
                    prints.append(None), sketches.append(None), keys.append(None)
            arrays = [batch.column(0), pa.array(n, type=pa.int64()), pa.array(prints, type=pa.binary()), pa.array(sketches, type=pa.binary()), pa.array(keys, type=pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "print", "sketch", "keys"])

    return bounded(docs).mapInArrow(run, "doc_id long, n_shingles long, print binary, sketch binary, keys array<long>")


def _likely(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose corrected estimate isn't far below the threshold."""
    least = threshold - 5 * math.sqrt(threshold * (1 - threshold) / REGISTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype="<u2").reshape(-1, REGISTERS) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array(estimate(a, b) >= least))

    of = lambda c: sketches.select(F.col("id").alias(c), F.col("sketch").alias(f"sketch_{c}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "sketch_a", "sketch_b")
    return bounded(both).mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union on full sets, which are built for the documents in pairs only.

    The sets are of other hashes than those of the sketches, so texts that collide there don't link here.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = pa.array([shingles(x, size, KEYS[1]).tobytes() for x in batch.column(1).to_pylist()], type=pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["id", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, type=pa.bool_()))

    need = stage(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "need")
    few = need.count() <= BROADCAST_ROWS
    texts = docs.join(F.broadcast(need) if few else need, "doc_id", "left_semi")
    full = stage(bounded(texts).mapInArrow(sets, "id long, hashes binary"), "sets")
    of = lambda c: full.select(F.col("id").alias(c), F.col("hashes").alias(f"hashes_{c}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "hashes_a", "hashes_b")
    return bounded(both).mapInArrow(run, "a long, b long").distinct()


def _owned(ids: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(id, print, hashes, component): the shingle sets of the rows of ids (doc_id, component).

    Documents of a bucket often lie together in the input, so their sets are dealt anew before shingles become rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingles(x, size) for x in batch.column(1).to_pylist()]
            prints = pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in found], type=pa.binary())
            hashes = pa.array([x.view(np.int64) for x in found], type=pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), prints, hashes, *batch.columns[2:]], names=["id", "print", "hashes", "component"])

    texts = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc_id").select("doc_id", "text", "component")
    sets = bounded(texts).mapInArrow(run, "id long, print binary, hashes array<long>, component long").repartition(partitions(docs))
    return stage(sets, "owned")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 85) -> DataFrame:
    """Links documents (doc_id, text) whose shingle sets have a Jaccard similarity of at least percent / 100.

    Returns a row for each row: doc_id, n_shingles, component_id (smallest doc_id reachable over links, itself
    included), kept (doc_id = component_id). Documents without words are linked with nothing. Rows that share a doc_id
    count as one document that has each of their texts. A null doc_id isn't linked: its component_id is null and it is
    kept. An empty table gives no rows; other columns are ignored. The chance to miss a link is smaller
    the more similar it is: at the threshold below one in a million for percent = 85, about 5 in 100,000 for 80.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    all_docs = stage(_sketches(rows, size), "sketches")
    sets = all_docs.filter("doc_id is not null and n_shingles > 0")
    # Only sets of two or more documents are looked up; their table is written first, so that adaptive execution can split the documents of a frequent one.
    copies = stage(sets.groupBy("print").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most"), "copies")
    looked_up = sets.join(F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies, "print", "left").withColumn("rep", F.coalesce("least", "doc_id"))
    own = [F.when(F.col("doc_id") == F.col("rep"), F.col(c)).alias(c) for c in ("sketch", "keys")]
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("rep", "long"), ("sketch", "binary"), ("keys", "array<long>"))]
    without = all_docs.filter("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", *nothing)
    member = stage(looked_up.select("doc_id", "n_shingles", "rep", *own).unionByName(without), "classes")
    reps = member.filter("sketch is not null")
    sketches = reps.select(F.col("doc_id").alias("id"), "sketch")
    # Buckets of two or more representatives, each row with the bucket's first centre.
    banded = reps.select(F.explode("keys").alias("key"), F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"))
    first = banded.groupBy("key").agg(F.min("id").alias("centre"), F.max("id").alias("other")).filter("centre < other").drop("other")
    bucket = stage(banded.join(first, "key"), "buckets")
    ids = member.filter("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("most")).filter("b < most").select("doc_id", "b")
    same_id = member.join(ids, "doc_id").filter("rep <> b").select(F.col("rep").alias("a"), "b")

    def fits(most: Column, n_a: Column, n_b: Column) -> Column:
        """Whether sets of these sizes that share at most so many shingles can be similar enough."""
        return 100 * most >= percent * (n_a + n_b - most)

    def links(pairs: DataFrame) -> DataFrame:
        """Confirmed links among candidate pairs (a, b, n_a, n_b)."""
        fit = pairs.filter(fits(F.least("n_a", "n_b"), F.col("n_a"), F.col("n_b"))).select("a", "b").distinct()
        return stage(_confirmed(stage(_likely(fit, sketches, percent / 100), "likely"), rows, size, percent), "links")

    def bounded(left: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members with cap, the most shingles they can share with another, without those that can't link; and the pairs that share a rare shingle.

        A shingle that no other candidate has is shared with none. Shingles of few owners count as not shared either, and
        all pairs that share one of them are taken from the shingles themselves: few for each.
        Rows that repeat an id's text list its shingles again, so owners are told apart by id and shingles counted once;
        an id with different texts keeps its size as cap, since its shingles aren't told apart by text.
        """
        ids = stage(left.groupBy(F.col("id").alias("doc_id")).agg(F.min("component").alias("component")), "ids")
        owned = _owned(ids, rows, size)
        several = owned.groupBy("id").agg((F.min("print") < F.max("print")).alias("several")).filter("several")
        each = owned.select("id", F.explode("hashes").alias("h"), F.size("hashes").cast("long").alias("n"), "component")
        owners = stage(each.groupBy("h").agg(F.count("*").alias("owners"), F.min("id").alias("id"), F.max("id").alias("other")).filter(F.col("owners") <= RARE), "owners")
        lone = owners.filter("id = other").groupBy("id").agg(F.count("*").alias("lone"))
        rare = stage(each.join(owners.filter("id < other").select("h"), "h").distinct(), "rare")
        few = rare.groupBy("id").agg(F.count("*").alias("rare"))
        left = left.join(lone, "id", "left").join(few, "id", "left").join(several, "id", "left")
        out = F.coalesce("lone", F.lit(0)) + F.coalesce("rare", F.lit(0))
        cap = F.col("n") - F.when(F.col("several"), 0).otherwise(out)
        left = left.withColumn("cap", cap).drop("lone", "rare", "several").filter(fits(F.col("cap"), F.col("n"), F.col("least")))
        a, b = (rare.select("h", F.col("id").alias(i), F.col("n").alias(f"n_{i}"), F.col("component").alias(f"c_{i}")) for i in ("a", "b"))
        return stage(left, "buckets"), a.join(b, "h").filter("a < b and c_a <> c_b").select("a", "b", "n_a", "n_b")

    sizes = reps.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n_a")).distinct()
    star = bucket.filter("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b"), F.col("n").alias("n_b")).distinct()
    found = links(star.join(sizes, "a")).union(same_id)
    components = stage(connected_components(found), "components")
    left = bucket.withColumn("done", F.col("id") == F.col("centre")).drop("centre")
    first_round, spread = True, 64
    while True:
        # Members that haven't been a centre yet, in buckets where two of them are in different components.
        label = left.filter(~F.col("done")).drop("done", "component").join(components.withColumnRenamed("node", "id"), "id", "left")
        label = label.withColumn("component", F.coalesce("component", "id"))
        mixed = label.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("n").alias("least")).filter("x < y").drop("x", "y")
        left = stage(label.join(mixed, "key"), "buckets")
        if left.isEmpty():
            break
        rare_pairs = None
        if first_round:
            left, rare_pairs = bounded(left)
            first_round = False
        left = left.drop("least")
        centres = left.groupBy("key", F.pmod(F.xxhash64("id", F.lit(spread)), F.lit(spread)).alias("salt")).agg(F.min(F.struct("id", "n", "cap", "component")).alias("c")).select("key", "c")
        centres = stage(centres, "centres")
        one, two = F.struct("id", "n"), F.struct("c.id", "c.n")
        pairs = left.join(centres, "key").filter((F.col("component") != F.col("c.component")) & fits(F.least("cap", "c.cap"), F.col("n"), F.col("c.n"))).select(F.least(one, two).alias("one"), F.greatest(one, two).alias("two"))
        pairs = pairs.select(F.col("one.id").alias("a"), F.col("two.id").alias("b"), F.col("one.n").alias("n_a"), F.col("two.n").alias("n_b"))
        pairs = stage((pairs if rare_pairs is None else pairs.union(rare_pairs)).distinct(), "pairs")
        was = centres.select("key", F.col("c.id").alias("id"), F.col("c.n").alias("n"), F.lit(True).alias("done"))
        left = left.join(was, ["key", "id", "n"], "left").withColumn("done", F.coalesce("done", F.lit(False)))
        if not pairs.isEmpty():
            more = links(pairs)
            if not more.isEmpty():
                found = found.union(more)
                components = stage(connected_components(found), "components")
        spread *= 16
    moved = stage(components.filter("node <> component").withColumnRenamed("node", "rep"), "moved")  # those whose class isn't its own component
    out = member.select("doc_id", "n_shingles", "rep").join(F.broadcast(moved) if moved.count() <= BROADCAST_ROWS else moved, "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
