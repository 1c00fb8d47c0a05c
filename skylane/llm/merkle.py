"""A Merkle manifest of a dataset: a tree of sha256 digests over each group's rows, and one over the groups' roots.

Rows are numbered within their group by a range sort. Blocks of a fixed number of consecutive leaves are reduced in one task each, whatever
their group's size; where their roots are still many, blocks of those are reduced in the same way. What is left is a small
top tree: the driver builds it and broadcasts what each of its leaves lacks to the root, and executors finish the proofs of
all rows and fold them.

A path is a binary: for each level the number of siblings before and after, a byte each, then their digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, stage

FAN = 8
#: Levels that one task reduces: blocks of 512 nodes.
BLOCK_LEVELS = 3
#: Nodes of the top tree, at most; a suffix path has some 230 bytes a level, so a few megabytes are broadcast.
TOP = 4096


def digest(parts: Iterable[bytes]) -> bytes:
    """sha256 of digests as lowercase hex text, one after another."""
    return hashlib.sha256(b"".join(parts).hex().encode()).digest()


def leaf(columns: list[str | Column]) -> Column:
    """Lowercase hex sha256 of columns one after another: each ``-`` if null, else its UTF-8 byte count, ``:`` and itself as text."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def reduce_run(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """The nodes and those of that many levels above; every run of FAN, the last perhaps shorter, becomes one digest."""
    found = [nodes]
    for _ in range(levels):
        below = found[-1]
        found.append([digest(below[i : i + FAN]) for i in range(0, len(below), FAN)])
    return found


def height(size: int) -> int:
    """Levels above size nodes until one remains."""
    found = 0
    while size > 1:
        size, found = -(-size // FAN), found + 1
    return found


def path_of(levels: list[list[bytes]], at: int) -> bytes:
    """The siblings of node ``at`` of the lowest level on its way through all levels but the last."""
    found = []
    for level in levels[:-1]:
        start = at - at % FAN
        before, after = level[start:at], level[at + 1 : start + FAN]
        found += [bytes((len(before), len(after))), *before, *after]
        at //= FAN
    return b"".join(found)


def siblings(path: bytes) -> Iterator[tuple[list[bytes], list[bytes]]]:
    at = 0
    while at < len(path):
        before, after = path[at], path[at + 1]
        parts = [path[at + 2 + 32 * i : at + 34 + 32 * i] for i in range(before + after)]
        yield parts[:before], parts[before:]
        at += 2 + 32 * (before + after)


def fold(node: bytes, path: bytes) -> bytes:
    """The root that a node and its path give."""
    for before, after in siblings(path):
        node = digest([*before, node, *after])
    return node


def proof_digest(path: bytes) -> bytes:
    """sha256 of all siblings of a path, as hex text, from the lowest level to the root and from left to right."""
    return digest(x for before, after in siblings(path) for x in [*before, *after])


def number(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows with ``pos``, the place from 0 within the tree in the order of columns (nulls first), and ``size``, the tree's rows.

    rows is a written table; those equal in all columns are told apart by where they were read, so that a range holds no more of them
    than of others. Counts for each range and tree give the places, so no tree is ever in one task.
    """
    columns = rows.columns
    by = [F.col(c).asc_nulls_first() for c in [tree, *order, "_row"]]
    ranged = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(partitions(rows), *by).sortWithinPartitions(*by)
    ranged = stage(ranged.select(*columns, F.monotonically_increasing_id().alias("_n")), "ranged")
    part = F.shiftright("_n", 33)
    runs = ranged.groupBy(part.alias("_part"), F.col(tree).alias("_tree")).agg(F.min("_n").alias("_first"), F.count("*").alias("_count"))
    whole = runs.groupBy("_tree").agg(F.sort_array(F.collect_list(F.struct("_part", "_first", "_count"))).alias("runs"), F.sum("_count").alias("size"))  # as many as there are ranges
    ahead = F.transform("runs", lambda r: F.struct(r["_part"].alias("part"), r["_first"].alias("first"), F.aggregate(F.filter("runs", lambda x: x["_part"] < r["_part"]), F.lit(0).cast("long"), lambda a, x: a + x["_count"]).alias("ahead")))
    places = whole.select("_tree", "size", F.explode(ahead).alias("r")).select("_tree", "size", "r.*")
    return ranged.join(places, (part == F.col("part")) & F.col(tree).eqNullSafe(F.col("_tree"))).select(*columns, (F.col("_n") - F.col("first") + F.col("ahead")).alias("pos"), "size")


def pack(nodes: DataFrame, carried: dict[str, str], fan_levels: int) -> DataFrame:
    """A row for each block of FAN ** fan_levels consecutive nodes: tree, block, size (its nodes' tree's), root, and arrays of digests and of carried columns.

    nodes: tree, pos, size, digest and the carried columns (name: type).
    """
    span = FAN**fan_levels
    tree_type = dict(nodes.dtypes)["tree"]
    schema = f"tree {tree_type}, block long, size long, root binary, digests array<binary>" + "".join(f", {n} array<{t}>" for n, t in carried.items())

    def reduce(block: pa.Table) -> pa.Table:
        block = block.combine_chunks().sort_by("pos")
        size, first = block["size"][0].as_py(), block["pos"][0].as_py()
        root = reduce_run(block["digest"].to_pylist(), min(fan_levels, height(size)))[-1][0]
        row = {"tree": block["tree"].chunk(0)[:1], "block": [first // span], "size": [size], "root": [root]}
        lists = {n: pa.ListArray.from_arrays(pa.array([0, len(block)], type=pa.int32()), block[c].chunk(0)) for n, c in [("digests", "digest"), *zip(carried, carried, strict=True)]}
        return pa.table(row | lists)

    blocks = nodes.withColumn("_block", F.floor(F.col("pos") / span)).groupBy("tree", "_block")
    return blocks.applyInArrow(lambda t: reduce(t), schema)


def _top(nodes: list, spark, tree_type: str) -> tuple[DataFrame, bytes]:
    """Paths of the top tree's leaves, built on the driver, and the root."""
    trees: dict = {}
    for r in nodes:
        trees.setdefault(r.tree, []).append(r)
    levels = {}
    for tree, members in trees.items():
        members.sort(key=lambda r: r.pos)
        levels[tree] = reduce_run([bytes(r.digest) for r in members], height(len(members)))
    names = sorted(trees, key=lambda t: (t is not None, t.encode() if isinstance(t, str) else t))
    above = reduce_run([levels[t][-1][0] for t in names], height(len(names)))
    rows = [(t, at, levels[t][-1][0], path_of(levels[t], at) + path_of(above, i)) for i, t in enumerate(names) for at in range(len(levels[t][0]))]
    schema = f"tree {tree_type}, block long, subroot binary, path binary"
    return F.broadcast(spark.createDataFrame(rows, schema)), above[-1][0] if names else digest([])


def _paths(nodes: DataFrame, fan_levels: int, top: int) -> tuple[DataFrame, bytes]:
    """(tree, block, subroot, path) for each node, block being its pos, and the root. nodes: a written table of tree, pos, size, digest."""
    tree_type = dict(nodes.dtypes)["tree"]
    state = nodes.agg(F.count("*").alias("n"), F.max("size").alias("size")).first()
    if state.n <= top:
        return _top(nodes.collect(), nodes.sparkSession, tree_type)
    if state.size == 1:  # many trees of one node each: they are the nodes of a tree of their own
        ranked = stage(number(nodes.select("tree", "digest"), "tree", []).drop("pos", "size"), "roots")
        one = stage(number(ranked.select(F.lit(0).alias("one"), F.col("tree").alias("name"), "digest"), "one", ["name"]), "roots")
        upper, root = _paths(stage(one.select(F.lit("").alias("tree"), "pos", "size", "digest"), "roots"), fan_levels, top)
        named = one.join(upper.drop("tree", "subroot"), F.col("pos") == F.col("block"))
        return named.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("block"), F.col("digest").alias("subroot"), "path"), root
    packed = stage(pack(nodes, {"pos": "long"}, fan_levels), "blocks")
    upper, root = _paths(heads(packed, fan_levels), fan_levels, top)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, r in enumerate(batch.to_pylist()):
                levels = reduce_run(r["digests"], min(fan_levels, height(r["size"])))
                n = len(r["digests"])
                columns = [pa.concat_arrays([batch.column(0)[i : i + 1]] * n), pa.array(r["pos"]), pa.array([r["subroot"]] * n), pa.array([path_of(levels, at) + r["path"] for at in range(n)])]
                yield pa.RecordBatch.from_arrays(columns, names=["tree", "block", "subroot", "path"])

    found = with_paths(packed, upper).select("tree", "size", "digests", "pos", "subroot", "path").mapInArrow(members, f"tree {tree_type}, block long, subroot binary, path binary")
    return stage(found, "paths"), root


def heads(packed: DataFrame, fan_levels: int) -> DataFrame:
    """The blocks as nodes of the next reduction."""
    return packed.select("tree", F.col("block").alias("pos"), F.ceil(F.col("size") / FAN**fan_levels).alias("size"), F.col("root").alias("digest"))


def with_paths(packed: DataFrame, upper: DataFrame) -> DataFrame:
    upper = upper.withColumnRenamed("tree", "_tree").withColumnRenamed("block", "_block")
    return packed.join(upper, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_block"))).drop("_tree", "_block")


def prove(leaves: DataFrame, tree: str, order: str, fan_levels: int = BLOCK_LEVELS, top: int = TOP) -> DataFrame:
    """Proofs of all leaves: id, leaf, subroot, root, proof_sha256, folded_root, verified; digests as lowercase hex.

    leaves: the columns ``tree`` and ``order``, leaf (hex) and tampered (hex or null: the leaf itself); others are ignored. Within a tree
    leaves ascend by order, then by themselves, nulls first; trees ascend by name, in UTF-8 bytes, null first. A tree of one leaf is that
    leaf; repeated rows are leaves each, an empty table gives no rows. folded_root is what the tampered leaf and the siblings of the original
    give, verified whether that is the root. No task has more than a block; the driver has the top tree, of at most ``top`` nodes.
    """
    spark = leaves.sparkSession
    id_type = dict(leaves.dtypes)[order]
    rows = leaves.select(F.col(tree).cast("string").alias("tree"), F.col(order).alias("id"), F.unhex("leaf").alias("digest"), F.unhex("tampered").alias("other"))
    nodes = number(stage(rows, "leaves"), "tree", ["id", "digest"])
    packed = stage(pack(nodes, {"id": id_type, "other": "binary"}, fan_levels), "blocks")
    upper, root = _paths(heads(packed, fan_levels), fan_levels, top)
    schema = f"id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, r in enumerate(batch.drop_columns(["id"]).to_pylist()):
                levels = reduce_run(r["digests"], min(fan_levels, height(r["size"])))
                found = []
                for at, (own, other) in enumerate(zip(r["digests"], r["other"], strict=True)):
                    path = path_of(levels, at) + r["path"]
                    folded = fold(own if other is None else other, path)
                    found.append((own.hex(), r["subroot"].hex(), root.hex(), proof_digest(path).hex(), folded.hex(), folded == root))
                yield pa.RecordBatch.from_arrays([ids[i].values, *map(pa.array, zip(*found, strict=True))], names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return with_paths(packed, upper).select("id", "size", "digests", "other", "subroot", "path").mapInArrow(finish, schema).withColumnRenamed("id", order)


def manifest(rows: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tree: str = "lang", order: str = "doc_id", changed: Column | None = None, fan_levels: int = BLOCK_LEVELS, top: int = TOP) -> DataFrame:
    """Proofs of all rows, of whose fields a leaf is made; ``changed`` gives another last field for rows whose proof is to be tried with it, null for others.

    See prove(). Nulls in any field are told apart from empty texts; columns that aren't fields don't count.
    """
    own = leaf(list(fields))
    tampered = F.lit(None).cast("string") if changed is None else F.when(changed.isNotNull(), leaf([*fields[:-1], changed]))
    return prove(rows.select(F.col(tree), F.col(order), own.alias("leaf"), tampered.alias("tampered")), tree, order, fan_levels, top)
