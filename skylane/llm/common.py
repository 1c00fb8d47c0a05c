"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import itertools
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker works on at once; a longer text makes a slice of its own.
SLICE_BYTES = 2_500_000
#: Rows up to which a key list is broadcast (8 bytes a row); beyond it a shuffled join is used.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Only in local mode (one machine, as in tests) one of our own is made where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="skylane-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stage(df: DataFrame, name: str = "stage", compression: str | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, which cuts its lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Deletes what stage() wrote for df, when nothing reads it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def bounded(rows: DataFrame) -> DataFrame:
    """rows, for a function over Arrow batches of whole texts: at most SLICE_BYTES go into a batch, or one row.

    This lowers the session's limit of bytes, the same for all operators and never below that; results don't depend on it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = rows.sparkSession.conf.get(name)
    if not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= SLICE_BYTES:
        rows.sparkSession.conf.set(name, str(SLICE_BYTES))
    return rows


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that a slice holds at most that many bytes of a text column, or one row."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, until - at)
            at = until


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo modulus; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus, F.lit(-1))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


class ChunkEncoder:
    """Encodes texts with a tokenizers file, one distinct chunk at a time.

    A text is cut where no token of the tokenizer can cross, distinct chunks are encoded by the tokenizers library and
    remembered, and the ids of a text are the joined ids of its chunks. ``spaced`` tells where: True for byte-level
    tokenizers whose pre-tokens take one leading space (cut before a single space between two other characters),
    False for those that drop white space (cut at white space). Texts that hold an added token's content, which the
    library finds before it cuts, are encoded by it as a whole.
    """

    _AT_SPACE = re.compile(r"(?<=\S)(?= \S)")
    #: A space beside other white space or at an end of the text, where cutting before each space isn't right.
    _ODD_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] | [\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\A | \z"

    def __init__(self, path: str, spaced: bool, remembered: int = 300_000):
        """remembered: distinct chunks in a generation, of some 200 bytes each; two generations are kept, so that frequent chunks stay.

        Chunks that follow a space and those at the start of a text, or in one that is cut otherwise, are remembered apart: the same characters may have other ids there.
        """
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced, self.remembered = spaced, remembered
        if spaced:  # a byte-level token has a character for each of its bytes
            import numpy as np

            self.bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())], dtype=np.int64)
        self.lower = not spaced and '"Lowercase"' in self.tokenizer.to_str()[:100_000].split('"vocab"')[0]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}

    def _learn(self, new: list[str], joined: bool, known: dict[str, bytes]) -> None:
        """Remembers the ids of chunks in ``known``; with joined, of such as can stand one after another in a text, where spaced chunks have a space before them."""
        import numpy as np

        for at in range(0, len(new), 256):
            chunks, starts = new[at : at + 256], [None]
            part = [" " + x for x in chunks] if joined and self.spaced else chunks
            if joined and self.spaced:  # one text of all of them, parted where as many bytes have passed
                got = self.tokenizer.encode("".join(part), add_special_tokens=False)
                passed = np.concatenate(([0], np.cumsum(self.bytes[got.ids])))
                begins = np.cumsum([0] + [len(x.encode()) for x in part[:-1]])
                found = np.searchsorted(passed, begins)
                starts = found.tolist() if (passed[np.minimum(found, len(passed) - 1)] == begins).all() else [None]
            elif joined:  # one text of all of them, parted at the token of each one's first character
                got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
                starts = list(map(got.char_to_token, itertools.accumulate((len(x) + 1 for x in part[:-1]), initial=0)))
            if None in starts:
                got = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
                starts = np.searchsorted(np.array(got.word_ids, dtype=np.int64), np.arange(len(part)), side="left").tolist()
            data = np.array(got.ids, dtype="<u4").tobytes()
            for chunk, start, end in zip(chunks, starts, [*starts[1:], len(got.ids)], strict=True):
                known[chunk] = data[4 * start : 4 * end]

    def _ids(self, chunks: list[str], joined: bool = False) -> list[bytes]:
        """Ids of each chunk; those not met before are encoded together. With joined, chunks are distinct and, where spaced, follow a space."""
        known, older = (self.known, self.older) if joined else (self.first, {})
        found = list(map(known.get, chunks))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            lost = [chunks[i] for i in missing]
            seen = list(map(older.get, lost))
            known.update((x, ids) for x, ids in zip(lost, seen, strict=True) if ids is not None)
            self._learn(list(dict.fromkeys(x for x, ids in zip(lost, seen, strict=True) if ids is None)), joined, known)
            for i, x in zip(missing, lost, strict=True):
                found[i] = known[x]
        return found

    def encode(self, texts: pa.Array) -> tuple:
        """The ids of all texts one after another (uint32) and their number for each text (int64); a null text is empty."""
        import numpy as np
        import pyarrow.compute as pc

        if len(self.known) > self.remembered:
            self.known, self.older = {}, self.known
        if len(self.first) > self.remembered // 8:
            self.first = {}
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        texts = pa.concat_arrays([texts, texts.slice(0, 0)])  # a copy of its own: ascii_lower reads slices wrongly
        whole = np.zeros(len(texts), dtype=bool)
        for content in self.added:
            whole |= np.asarray(pc.match_substring(texts, content, ignore_case=self.lower))
        odd = np.asarray(pc.match_substring_regex(texts, self._ODD_SPACE)) & ~whole if self.spaced else np.zeros_like(whole)
        own = []  # texts that aren't cut at each space: each is one chunk
        for i in np.flatnonzero(whole | odd).tolist():
            text = texts[i].as_py()
            own.append(b"".join(self._ids(self._AT_SPACE.split(text))) if odd[i] else np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes())
        if own:
            texts = pc.if_else(pa.array(whole | odd), "", texts)
        if self.lower:
            texts = pc.ascii_lower(texts)
        words = pc.split_pattern(texts, " ") if self.spaced else pc.ascii_split_whitespace(texts)
        offsets = np.asarray(words.offsets)
        distinct = words.values.dictionary_encode()
        index, chunks = np.asarray(distinct.indices).astype(np.int64), distinct.dictionary.to_numpy(zero_copy_only=False).tolist()
        parts = self._ids([x for x in chunks if x], joined=True)
        if "" in chunks:
            parts.insert(chunks.index(""), b"")
        if self.spaced:  # a text's first chunk is the only one without a leading space
            first = pc.list_element(words, 0).to_pylist()
            index[offsets[:-1]] = np.arange(len(parts), len(parts) + len(first))
            parts += self._ids(first)
        if own:
            index[offsets[:-1][whole | odd]] = len(parts) + np.arange(len(own))
            parts += own
        table, sizes = np.frombuffer(b"".join(parts), dtype="<u4"), np.array([len(x) // 4 for x in parts], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        counts = sizes[index]
        ends = np.cumsum(counts)
        lengths = np.diff(np.concatenate(([0], ends))[offsets])
        place = np.repeat(starts[index] - ends + counts, counts)
        place += np.arange(len(place))
        return table[place], lengths


_encoders: dict[tuple[str, bool], ChunkEncoder] = {}


def encoder(path: str, spaced: bool, remembered: int = 300_000) -> ChunkEncoder:
    """The worker's encoder for this file; workers are reused, so chunks stay known between tasks."""
    if (path, spaced) not in _encoders:
        _encoders[path, spaced] = ChunkEncoder(path, spaced, remembered)
    return _encoders[path, spaced]
