"""SentencePiece encoding and decoding by suffix-array matching.

For a byte-pair model with byte fallback, whose pieces never hold a blank after another character: a text falls into
chunks (blanks, then other characters) that are encoded independently, so every distinct chunk of a batch is encoded
once. The distinct chunks are concatenated; a suffix array of the concatenation is built by prefix doubling; each
piece's occurrences are a range of it, found by binary search; and these edges, sorted by position, are relaxed from left
to right. A position's last piece is the one edge that starts at a settled position and is compatible with the piece
that ends there: two pieces are compatible if merging their text by rank gives just these two. By induction that yields
the segmentation that merging pair by pair yields.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, crc, slices

BLANK = "▁"
_CHUNK = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


def suffix_array(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of codes by their first depth entries, and the rank of each; by prefix doubling."""
    _, rank = np.unique(codes, return_inverse=True)
    rank, width = rank.astype(np.int64) + 1, 1
    while width < depth:
        key = rank * (len(codes) + 2)
        key[:-width] += rank[width:]
        _, rank = np.unique(key, return_inverse=True)
        rank, width = rank.astype(np.int64) + 1, 2 * width
    return np.argsort(rank, kind="stable"), rank


class PieceEncoder:
    """Encodes and decodes with one model file; chunks it has met stay known, up to a bound."""

    #: Distinct chunks in a generation; two generations are kept, so that frequent chunks stay.
    REMEMBERED = 500_000
    #: Characters of a chunk up to which all chunks advance together.
    TOGETHER = 64

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.vocab_size()
        self.pieces = [self.model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i))]
        self.rank = {self.pieces[i]: -self.model.get_score(i) for i in plain}
        self.id = {self.pieces[i]: i for i in plain}
        if any(BLANK in p.lstrip(BLANK) for p in self.id):
            raise ValueError("a piece holds a blank after another character")
        self.bytes = [self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.id))
        # Pieces by their code points, padded with 0, in suffix order.
        self.vocabulary = sorted(self.id)
        table = np.zeros((len(self.vocabulary), self.longest), dtype=np.uint32)
        for i, p in enumerate(self.vocabulary):
            table[i, : len(p)] = [ord(c) for c in p]
        self.table, self.lengths = table, np.array([len(p) for p in self.vocabulary])
        self.fits: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Merging pair by pair, best rank first, leftmost on ties."""
        parts = list(text)
        while True:
            best = min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank), default=None)
            if best is None:
                return parts
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def _fits(self, pair: int) -> bool:
        known = self.fits.get(pair)
        if known is None:
            a, b = self.vocabulary[pair // len(self.vocabulary)], self.vocabulary[pair % len(self.vocabulary)]
            known = self.merged(a + b) == [a, b]
            if len(self.fits) < 2_000_000:
                self.fits[pair] = known
        return known

    def _fit(self, pairs: np.ndarray) -> np.ndarray:
        """Whether pieces (a, b), given as a * size + b in vocabulary order, stay apart as they are."""
        distinct, inverse = np.unique(pairs, return_inverse=True)
        return np.fromiter(map(self._fits, distinct.tolist()), dtype=bool, count=len(distinct))[inverse]

    def _edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece) of every occurrence of a piece, by start: ranges of the suffix array from binary search."""
        order, _ = suffix_array(text, self.longest)
        padded = np.concatenate((text, np.zeros(self.longest, dtype=np.uint32)))
        low, high = np.zeros(len(self.table), dtype=np.int64), np.full(len(self.table), len(order), dtype=np.int64)
        for at in range(self.longest):  # narrow the ranges of all pieces by one more character
            live = np.flatnonzero((self.lengths > at) & (low < high))
            want = self.table[live, at]
            for side, bound in (("left", low), ("right", high)):
                a, b = low[live].copy(), high[live].copy()
                if side == "right":
                    a, b = start, high[live].copy()
                else:
                    start = None
                while True:
                    open_ = a < b
                    if not open_.any():
                        break
                    mid = (a + b) // 2
                    code = padded[order[np.minimum(mid, len(order) - 1)] + at]
                    right = open_ & ((code < want) if side == "left" else (code <= want))
                    a = np.where(right, mid + 1, a)
                    b = np.where(open_ & ~right, mid, b)
                if side == "left":
                    start = a
                else:
                    low[live], high[live] = start, a
        counts = np.maximum(high - low, 0)
        piece = np.repeat(np.arange(len(counts)), counts)
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = order[np.repeat(low, counts) + within]
        by = np.lexsort((piece, starts))
        return starts[by], piece[by]

    def _learn(self, chunks: list[str]) -> None:
        joined = "\0".join(chunks) + "\0"
        text = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
        gaps = np.cumsum([len(c) + 1 for c in chunks]) - 1
        text[gaps] = 0x110000  # no character, so no piece crosses chunks
        starts, piece = self._edges(text)
        ends, n, size = starts + self.lengths[piece], len(text), len(self.vocabulary)
        sizes = np.array([len(c) for c in chunks])
        firsts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        first_of = np.repeat(firsts, sizes + 1)
        UNSET, OPEN, OTHER = -1, -2, -3  # noqa: N806  not settled; a chunk's start; a character without a piece
        last, came = np.full(n + 1, UNSET, dtype=np.int64), np.full(n + 1, UNSET, dtype=np.int64)
        last[firsts] = OPEN
        covered = np.zeros(n + 1, dtype=bool)
        covered[starts[self.lengths[piece] == 1]] = True
        # Positions of all chunks advance together: at step k, edges that end k characters into their chunk. The few
        # chunks longer than that advance on their own, edge by edge.
        steps = min(self.TOGETHER, int(sizes.max(initial=0)))
        depth = ends - first_of[starts]
        by = np.argsort(depth, kind="stable")
        starts, piece, ends, depth = starts[by], piece[by], ends[by], depth[by]
        cuts = np.searchsorted(depth, np.arange(1, steps + 2))
        others = np.flatnonzero(~covered[:n] & (text != 0x110000))
        other_depth = others - first_of[others] + 1
        for k in range(1, steps + 1):
            s, p, e = (x[cuts[k - 1] : cuts[k]] for x in (starts, piece, ends))
            before = last[s]
            good = (before == OPEN) | (before == OTHER)
            pair = np.flatnonzero(before >= 0)
            good[pair] = self._fit(before[pair] * size + p[pair])
            last[e[good]], came[e[good]] = p[good], s[good]
            o = others[other_depth == k]
            last[o + 1], came[o + 1] = OTHER, o
        rest, alone = slice(cuts[steps], None), others[other_depth > steps]
        by = np.lexsort((np.concatenate((starts[rest], alone)), np.concatenate((ends[rest], alone + 1))))
        s, p, e = (np.concatenate(x)[by].tolist() for x in ((starts[rest], alone), (piece[rest], np.full(len(alone), OTHER)), (ends[rest], alone + 1)))
        if s:
            found, origin = last.tolist(), came.tolist()
            for at, now, end in zip(s, p, e, strict=True):
                before = found[at]
                if now == OTHER or before == OPEN or before == OTHER or (before >= 0 and self._fits(before * size + now)):
                    found[end], origin[end] = now, at
            last, came = np.array(found), np.array(origin)
        ids = np.array([self.id[p] for p in self.vocabulary], dtype="<u4")
        for chunk, first, length in zip(chunks, firsts.tolist(), sizes.tolist(), strict=True):
            out, at = [], first + length
            while at > first:
                if last[at] == OTHER:
                    out += [self.bytes[b] for b in reversed(joined[at - 1].encode("utf-8", "replace"))]
                else:
                    out.append(ids[last[at]])
                at = came[at]
            self.known[chunk] = np.array(out[::-1], dtype="<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; a null text is empty."""
        if len(self.known) > self.REMEMBERED:
            self.known, self.older = {}, self.known
        cut = [_CHUNK.findall(self.model.normalize(x)) if x else [] for x in texts]
        new = []
        for x in sorted(set().union(*cut).difference(self.known)):
            if x in self.older:
                self.known[x] = self.older[x]
            else:
                new.append(x)
        for at in range(0, len(new), 20_000):
            self._learn(new[at : at + 20_000])
        return [b"".join(map(self.known.__getitem__, chunks)) for chunks in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces, bytes joined to characters, blanks as spaces, without the leading one."""
        out, held = [], bytearray()
        first_byte = self.bytes[0]
        for i in ids.tolist():
            if first_byte <= i < first_byte + 256:
                held.append(i - first_byte)
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = bytearray()
            out.append(self.pieces[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        text = "".join(out).replace(BLANK, " ")
        return text[1:] if text.startswith(" ") else text


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 and round_trip (decoding gives the text) for every row of docs (doc_id, text).

    With keep_ids also ids. A null text has no ids and round_trip null; an empty one no ids and round_trip true.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, pieces = batch.column(1).to_pylist(), encoder(path)
            found = pieces.encode(texts)
            ids = [np.frombuffer(x, dtype="<u4") for x in found]
            same = [None if t is None else pieces.decode(i) == t for t, i in zip(texts, ids, strict=True)]
            arrays = [batch.column(0), pa.array([len(i) for i in ids], type=pa.int64()), pa.array([crc(x) for x in found], type=pa.int64()), pa.array(same, type=pa.bool_())]
            names = ["doc_id", "n_pieces", "ids_crc32", "round_trip"]
            if keep_ids:
                arrays, names = [*arrays, pa.array([i.astype(np.int32) for i in ids], type=pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean" + (", ids array<int>" if keep_ids else "")
    return bounded(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, schema)
