"""Token ids in bit-plane shuffled, zstandard-compressed segments.

File format: a segment holds whole documents in ascending doc_id order. Its payload is a sequence of blocks of ``block``
ids (the last one shorter). A block is transposed into planes, 32 bit planes or 4 byte planes of the little-endian
unsigned 32-bit ids; planes of zeros are left out, every other plane is one zstandard frame. Integers are little-endian:

    "IDP1" | u8 bits per plane (1 or 8) | u32 ids per block | u32 blocks
    then the chunk index: for each block u32 ids, u32 mask of stored planes, u32 bytes for each stored plane
    then the planes in the order of the index

Segments are rows of a Parquet dataset (shard, seq, ids before it in its shard, document ids and lengths, payload), so
Spark writes and reads them on any store, and a lost executor's shard is simply written again.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, crc, encoder, partitions, slices

MAGIC = b"IDP1"
SEGMENT = "shard int, seq long, before long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


def _planes(block: np.ndarray, bits: int) -> list[bytes]:
    if bits == 8:
        as_bytes = block.view(np.uint8).reshape(-1, 4)
        return [as_bytes[:, i].tobytes() for i in range(4)]
    # rows of 32 bits, least significant first, turned into 32 rows of packed bits
    as_bits = np.unpackbits(block.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return [np.packbits(as_bits[:, i], bitorder="little").tobytes() for i in range(32)]


def encode_ids(ids: np.ndarray, block: int = 16384, bits: int = 8, level: int = 3) -> bytes:
    """One segment's payload."""
    if bits not in (1, 8):
        raise ValueError("bits is 1 or 8")
    ids = np.ascontiguousarray(ids, dtype="<u4")
    compress = zstandard.ZstdCompressor(level=level).compress
    index, body, blocks = [], [], 0
    for at in range(0, len(ids), block):
        part, mask, sizes = ids[at : at + block], 0, []
        for i, plane in enumerate(_planes(part, bits)):
            if plane.count(0) != len(plane):
                body.append(compress(plane))
                sizes.append(len(body[-1]))
                mask |= 1 << i
        index.append(struct.pack(f"<{2 + len(sizes)}I", len(part), mask, *sizes))
        blocks += 1
    return b"".join([MAGIC, struct.pack("<BII", bits, block, blocks), *index, *body])


def block_index(payload: bytes) -> tuple[int, list[tuple[int, int, list[int], int]]]:
    """Bits per plane, and for each block (ids, mask of stored planes, their bytes, offset of the first)."""
    if payload[:4] != MAGIC:
        raise ValueError("not an id segment")
    bits, _, blocks = struct.unpack_from("<BII", payload, 4)
    at, index = 13, []
    for _ in range(blocks):
        n, mask = struct.unpack_from("<II", payload, at)
        stored = mask.bit_count()
        index.append((n, mask, list(struct.unpack_from(f"<{stored}I", payload, at + 8))))
        at += 8 + 4 * stored
    out = []
    for n, mask, sizes in index:
        out.append((n, mask, sizes, at))
        at += sum(sizes)
    return bits, out


def decode_ids(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first to last (exclusive) of a segment; other blocks aren't touched."""
    decompress = zstandard.ZstdDecompressor().decompress
    bits, blocks = block_index(payload)
    out = [np.empty(0, dtype="<u4")]
    for n, mask, sizes, at in blocks[first:last]:
        planes, sizes = np.zeros((4, n) if bits == 8 else (32, -(-n // 8)), dtype=np.uint8), iter(sizes)
        for i in range(len(planes)):
            if mask >> i & 1:
                size = next(sizes)
                planes[i] = np.frombuffer(decompress(payload[at : at + size]), dtype=np.uint8)
                at += size
        if bits == 8:
            out.append(np.ascontiguousarray(planes.T).view("<u4").reshape(-1))
        else:
            as_bits = np.unpackbits(planes, axis=1, count=n, bitorder="little")
            out.append(np.packbits(np.ascontiguousarray(as_bits.T), axis=1, bitorder="little").view("<u4").reshape(-1))
    return np.concatenate(out)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, segment: int = 1 << 18, block: int = 16384, bits: int = 8, shards: int | None = None) -> None:
    """Encodes every document (doc_id, text), appends end_id, and writes segments in ascending doc_id order to path.

    A null text is empty. A null doc_id comes first; rows that share a doc_id follow each other, ordered by a hash of their
    texts, and equal ones by where they were read, so that a doc_id of very many rows is split over shards, too.
    A document longer than a segment makes a segment of its own. Texts are sorted and then encoded where they are
    written, as compressed texts are smaller than their ids.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, seq, before, end = TaskContext.get().partitionId(), 0, 0, np.array([end_id], dtype="<u4").tobytes()
        doc_ids: list[int | None] = []
        parts: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, before, held, doc_ids, parts
            payload = encode_ids(np.frombuffer(b"".join(parts), dtype="<u4"), block, bits)
            row = [[shard], [seq], [before], [held], [doc_ids], [[len(x) // 4 for x in parts]], [payload]]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            seq, before, held, doc_ids, parts = seq + 1, before + held, 0, [], []
            return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(row, types, strict=True)], names=["shard", "seq", "before", "n_ids", "doc_ids", "lengths", "payload"])

        for batch in slices(batches):
            ids, lengths = encoder(tokenizer, spaced=True, remembered=400_000).encode(batch.column(1))
            data, at = memoryview(ids).cast("B"), 0
            for doc_id, n in zip(batch.column(0).to_pylist(), lengths.tolist(), strict=True):
                if held and held + n + 1 > segment:
                    yield flush()
                doc_ids.append(doc_id)
                parts.append(bytes(data[4 * at : 4 * (at + n)]) + end)
                at += n
                held += n + 1
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows, order = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()}), ("doc_id", "tie", "row")
    ordered = rows.repartitionByRange(shards or partitions(docs), *order).sortWithinPartitions(*order)
    bounded(ordered.select("doc_id", "text")).mapInArrow(pack, SEGMENT).write.parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments with first_id, the number of ids in all segments before. Only a number for each shard is sent to them; payloads stay put."""
    rows = spark.read.schema(SEGMENT).parquet(path)
    shard = rows.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # as many rows as shards, which write_ids was given
    shard = shard.withColumn("shard_start", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(F.broadcast(shard.drop("n")), "shard").withColumn("first_id", F.col("shard_start") + F.col("before")).drop("shard_start")


def read_documents(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """Decodes the files: doc_id, start, n_tokens (end id included), ids_crc32 for each document (and ids, with keep_ids)."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            for doc_ids, lengths, payload, start in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                data, at = memoryview(decode_ids(payload).tobytes()), 0
                starts, crcs, ids = [], [], []
                for n in lengths:
                    piece = data[4 * at : 4 * (at + n)]
                    starts.append(start + at)
                    crcs.append(crc(piece))
                    if keep_ids:
                        ids.append(np.frombuffer(piece, dtype="<u4").astype(np.int64))
                    at += n
                arrays = [pa.array(x, type=pa.int64()) for x in (doc_ids, starts, lengths, crcs)]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if keep_ids:
                    arrays, names = [*arrays, pa.array(ids, type=pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = read_segments(spark, path).select("doc_ids", "lengths", "payload", "first_id")
    return bounded(rows).mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if keep_ids else ""))
