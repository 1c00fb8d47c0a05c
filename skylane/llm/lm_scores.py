"""Log-probabilities of texts under an n-gram model by deleted interpolation.

The estimate of a token mixes maximum-likelihood estimates of every order, down to a uniform one:
q_k = w_k * count(n-gram) / count(context) + (1 - w_k) * q_(k-1), where w_k depends on how frequent the context is (a bucket for
each power of two; 0 for a context never seen). Weights are learned by expectation-maximisation on documents that were
held out of the counts; then all training documents are counted.

Texts are cut into slices, whose tokens are written as numbers. A slice asks for each distinct n-gram in it once: n-grams
are keyed by 64-bit hashes and dealt into buckets, which sum the slices' counts and send each slice the totals of what it
asked for. So only distinct n-grams travel, in packed arrays, and all that is gathered grows with the input. A
frequent n-gram has one entry for each slice, whatever its count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, slices, stage

#: Bytes of text for each bucket of n-grams: about a million tokens.
BUCKET_BYTES = 8_000_000
#: Context-frequency buckets: 0, then one for each power of two.
FREQUENCIES = 65
ROUNDS = 12
#: Weights stay below one, so that no token gets a probability of zero.
MOST = 0.9999
SLICES = "slice long, held boolean, ids array<{}>, lengths binary, counted binary, tokens binary, hashes binary, n_train long, n_kept long, d_train long, d_kept long"


class Sizes(NamedTuple):
    """Tokens and documents that are counted."""

    tokens: int
    documents: int


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def grams(tokens: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order from 1: the place of every token's n-gram among the distinct ones, and their keys.

    n-grams end in the token and begin before the document where it is too short.
    """
    found = [(tokens.astype(np.int64), hashes)]
    first = np.zeros(len(tokens), dtype=bool)
    first[np.cumsum(lengths) - lengths] = True
    for k in range(2, order + 1):
        place, keys = found[-1]
        before = np.concatenate(([0], place[:-1]))
        before[first] = len(keys)
        codes, at = np.unique(before * len(hashes) + tokens, return_inverse=True)
        context = np.append(keys, np.uint64(k))[codes // len(hashes)]
        found.append((at, _mixed(_mixed(context) + np.uint64(k)) ^ hashes[codes % len(hashes)]))
        found[-1] = (at, _mixed(found[-1][1]))
    return found


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs, with that number of bytes in front."""
    kind = np.min_scalar_type(int(numbers.max(initial=0)))
    return bytes([kind.itemsize]) + numbers.astype(kind).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1).astype(np.int64)


def _squeezed(tokens: np.ndarray) -> bytes:
    """Tokens' bytes by place, which compresses better than one token after another, with zstandard."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(tokens.astype("<u4").view("u1").reshape(-1, 4).T).tobytes())


def _spread(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype="u1").reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def tokenized(docs: DataFrame, id_type: str) -> DataFrame:
    """A row for each slice of docs (id, text, train, held): tokens as places in the slice's words, whose hashes follow; the last word is the end."""
    schema = SLICES.format(id_type)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches, 1):
            texts = pc.fill_null(batch.column(1), "").cast(pa.large_string())
            texts = pa.concat_arrays([texts, texts.slice(0, 0)])  # a copy of its own: ascii_lower reads slices wrongly
            words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
            offsets = np.asarray(words.offsets)
            distinct = words.values.dictionary_encode()
            vocabulary = distinct.dictionary.to_pylist()
            index = np.asarray(distinct.indices).astype(np.int64)
            real = index != (vocabulary.index("") if "" in vocabulary else -1)
            counts = np.diff(np.concatenate(([0], np.cumsum(real)))[offsets])
            tokens = np.insert(index[real], np.cumsum(counts), len(vocabulary)).astype("<u4")
            hashes = np.array([*map(xxhash.xxh3_64_intdigest, vocabulary), xxhash.xxh3_64_intdigest("\n")], dtype=np.uint64)  # no word has a line feed
            lengths, train, held = counts + 1, np.asarray(batch.column(2)).astype(bool), np.asarray(batch.column(3)).astype(bool)
            row = {
                "slice": number, "held": bool(held.any()), "ids": None, "lengths": lengths.astype("<u4").tobytes(), "counted": train.astype("u1").tobytes(), "tokens": _squeezed(tokens), "hashes": hashes.tobytes(),
                "n_train": int(lengths[train].sum()), "n_kept": int(lengths[train & ~held].sum()), "d_train": int(train.sum()), "d_kept": int((train & ~held).sum()),
            }
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], type=pa.int32()), batch.column(0))
            kinds = {"slice": pa.int64(), "held": pa.bool_(), "n_train": pa.int64(), "n_kept": pa.int64(), "d_train": pa.int64(), "d_kept": pa.int64()}
            yield pa.RecordBatch.from_arrays([ids if n == "ids" else pa.array([v], type=kinds.get(n, pa.binary())) for n, v in row.items()], names=list(row))
            number += 1

    # Documents held out for the weights get slices of their own, so that these alone are read to learn them.
    return bounded(docs.filter("not held")).mapInArrow(cut, schema).union(bounded(docs.filter("held")).mapInArrow(cut, schema).withColumn("slice", -1 - F.col("slice")))


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _spread(row["tokens"]), np.frombuffer(row["lengths"], dtype="<u4").astype(np.int64), np.frombuffer(row["hashes"], dtype=np.uint64)


def _dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys' places in the order of their buckets, the buckets that have any, and where each begins."""
    bucket = ((keys >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    some, begin = np.unique(bucket[order], return_index=True)
    return order, some, begin


def requests(parts: DataFrame, order: int, buckets: int) -> DataFrame:
    """For each slice, order and bucket: the keys of distinct n-grams and how often documents to be counted have them."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens, lengths, hashes = _read(row)
                counted = np.repeat(np.frombuffer(row["counted"], dtype="u1"), lengths).astype(bool)
                for k, (place, keys) in enumerate(grams(tokens, lengths, hashes, order), 1):
                    n = np.bincount(place[counted], minlength=len(keys))
                    at, some, begin = _dealt(keys, buckets)
                    ends = [*begin[1:], len(keys)]
                    columns = {"slice": [row["slice"]] * len(some), "held": [row["held"]] * len(some), "k": [k] * len(some), "bucket": some}
                    data = {"keys": [keys[at[a:b]].tobytes() for a, b in zip(begin, ends, strict=True)], "counts": [_packed(n[at[a:b]]) for a, b in zip(begin, ends, strict=True)]}
                    yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip([*columns.values(), *data.values()], (pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=[*columns, *data])

    columns = ("slice", "held", "counted", "lengths", "tokens", "hashes")
    return parts.select(*columns).mapInArrow(ask, "slice long, held boolean, k int, bucket long, keys binary, counts binary")


def totals(asked: DataFrame) -> DataFrame:
    """For each request its n-grams' counts in all training documents (``train``) and, for slices held out, in those not held out (``kept``).

    A row without a slice has the number of a bucket's distinct n-grams in training documents.
    """

    def count(part: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, dtype=np.uint64) for x in part["keys"].to_pylist()]
        n = np.concatenate([_unpacked(x) for x in part["counts"].to_pylist()]).astype(float)  # whole numbers below 2**53
        held = np.asarray(part["held"].combine_chunks()).astype(bool)
        sizes = np.array([len(x) for x in keys])
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        train = np.bincount(at, weights=n, minlength=len(distinct)).astype(np.int64)
        out = np.repeat(held, sizes)
        kept = train - np.bincount(at[out], weights=n[out], minlength=len(distinct)).astype(np.int64)
        ends = np.cumsum(sizes)
        rows = zip(ends - sizes, ends, held, strict=True)
        answers = [(_packed(train[at[a:b]]), _packed(kept[at[a:b]]) if h else None) for a, b, h in rows]
        known = [None] * len(answers) + [int(np.count_nonzero(train))]
        none = pa.nulls(1)
        columns = [pa.chunked_array([*part["slice"].chunks, none.cast(pa.int64())]), pa.array(part["k"].to_pylist() + [part["k"][0].as_py()], type=pa.int32()), pa.array(part["bucket"].to_pylist() + [part["bucket"][0].as_py()], type=pa.int64())]
        return pa.table([*columns, pa.array([a for a, _ in answers] + [None], type=pa.binary()), pa.array([b for _, b in answers] + [None], type=pa.binary()), pa.array(known, type=pa.int64())], names=["slice", "k", "bucket", "train", "kept", "known"])

    return asked.groupBy("k", "bucket").applyInArrow(lambda t: count(t), "slice long, k int, bucket long, train binary, kept binary, known long")


def _counts(row: dict, answers: pa.Table, column: str, order: int, documents: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For every token of a slice the counts of its n-grams and of their contexts, for each order (the first has no context), and the documents' lengths."""
    tokens, lengths, hashes = _read(row)
    answers = answers.sort_by([("k", "ascending"), ("bucket", "ascending")])
    kinds = np.asarray(answers["k"].combine_chunks())
    first = np.zeros(len(tokens), dtype=bool)
    first[np.cumsum(lengths) - lengths] = True
    counts, contexts = [], []
    buckets = row["buckets"]
    for k, (place, keys) in enumerate(grams(tokens, lengths, hashes, order), 1):
        total = np.zeros(len(keys), dtype=np.int64)
        total[_dealt(keys, buckets)[0]] = np.concatenate([_unpacked(x) for x in answers[column].filter(pa.array(kinds == k)).to_pylist()])
        contexts.append(np.where(first, documents, np.concatenate(([0], counts[-1][:-1]))) if counts else None)
        counts.append(total[place])
    return counts, contexts, lengths


def frequency(contexts: np.ndarray) -> np.ndarray:
    """The bucket of a context by its count."""
    return np.where(contexts > 0, np.frexp(contexts.astype(float))[1], 0)


def _estimates(counts: list[np.ndarray], contexts: list[np.ndarray], tokens: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each order the maximum-likelihood estimate of every token (0 where the context was never seen) and its context's bucket."""
    found, buckets = [], []
    for n, context in zip(counts, contexts, strict=True):
        found.append(n / np.maximum(tokens if context is None else context, 1))
        buckets.append(np.full(len(n), min(tokens, 1)) if context is None else frequency(context))  # words alone have one weight, whatever their number
    return found, buckets


def mixture(estimates: list[np.ndarray], buckets: list[np.ndarray], weights: np.ndarray, uniform: float) -> list[np.ndarray]:
    """What each order's estimate adds to the probability, from the uniform one (order 0) upwards."""
    rest = np.ones(len(estimates[0]))
    found = []
    for k in range(len(estimates), 0, -1):
        w = weights[k - 1][buckets[k - 1]]
        found.append(rest * w * estimates[k - 1])
        rest = rest * (1 - w)
    return [rest * uniform, *found[::-1]]


def learn_weights(features: DataFrame, order: int, uniform: float, rounds: int) -> np.ndarray:
    """Weights for each order and context bucket by expectation-maximisation; buckets that no held-out token has keep one half.

    Each task sends its sums for each bucket; the driver adds as many numbers as there are weights for each task's row.
    """
    weights = np.full((order, FREQUENCIES), 0.5)
    weights[:, 0] = 0.0  # no context, no estimate

    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], weights: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            won, reached = np.zeros((order, FREQUENCIES)), np.zeros((order, FREQUENCIES))
            for batch in batches:
                for row in batch.to_pylist():
                    estimates = list(np.frombuffer(row["estimates"], dtype="<f8").reshape(order, -1))
                    buckets = list(np.frombuffer(row["buckets"], dtype="u1").reshape(order, -1))
                    shares = mixture(estimates, buckets, weights, uniform)
                    whole = sum(shares)
                    below = np.zeros(len(whole))
                    for k in range(order + 1):
                        share = shares[k] / whole
                        below = below + share
                        if k:
                            won[k - 1] += np.bincount(buckets[k - 1], weights=share, minlength=FREQUENCIES)
                            reached[k - 1] += np.bincount(buckets[k - 1], weights=below, minlength=FREQUENCIES)
            slot = np.flatnonzero(reached.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(won.ravel()[slot]), pa.array(reached.ravel()[slot])], names=["slot", "won", "reached"])

        weights = weights.copy()
        sums = features.mapInArrow(expect, "slot long, won double, reached double").groupBy("slot").agg(F.sum("won").alias("won"), F.sum("reached").alias("reached"))
        for r in sums.collect():
            k, b = divmod(r.slot, FREQUENCIES)
            if b:
                weights[k, b] = min(r.won / r.reached, MOST)
    return weights


def score(docs: DataFrame, train: Column, held: Column, order: int = 2, rounds: int = ROUNDS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score for every row of docs (doc_id, text; others are ignored).

    train says which rows are counted, held which of those are held out while weights are learned; a null is no. Tokens are the words of the text in
    lower case (A-Z), between blanks, and one end; a null text is empty, and so has the end alone. base_score takes every count plus one, score is the
    interpolated model's; both are sums of log10. Rows that share an id are scored, and counted, each. Without training rows all
    tokens are unknown, with a probability of one (the only word is the unknown one); without held-out rows weights are one half. An empty table gives no rows.
    n-grams are told apart by 64-bit hashes: among a billion different ones two are likely to share theirs with a chance of three in a hundred.
    """
    id_type = dict(docs.dtypes)["doc_id"]
    counted = F.coalesce(train, F.lit(False))
    rows = docs.select("doc_id", "text", counted.alias("train"), (counted & F.coalesce(held, F.lit(False))).alias("held"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    buckets = max(1, -(-size // bucket_bytes))
    parts = stage(tokenized(rows, id_type), "tokens", "zstd")
    sizes = parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_train", "n_kept", "d_train", "d_kept")]).first()
    answers = stage(totals(requests(parts, order, buckets)), "counts", "zstd")
    known = answers.filter("slice is null and k = 1").agg(F.coalesce(F.sum("known"), F.lit(0)).alias("n")).first().n
    uniform = 1.0 / (known + 1)
    answers = answers.filter("slice is not null")
    needed = ("slice", "lengths", "tokens", "hashes")

    def each(slices_: DataFrame, column: str, schema: str, work: Callable[[dict, pa.Table], pa.Table]) -> DataFrame:
        left = slices_.groupBy("slice")
        right = answers.filter(F.col(column).isNotNull()).select("slice", "k", "bucket", column).groupBy("slice")
        return left.cogroup(right).applyInArrow(lambda a, b: work(a, b), schema)

    def features(part: pa.Table, found: pa.Table) -> pa.Table:
        if not part.num_rows:
            return pa.table({"estimates": pa.array([], pa.binary()), "buckets": pa.array([], pa.binary())})
        counts, contexts, _ = _counts(part.to_pylist()[0] | {"buckets": buckets}, found, "kept", order, sizes.d_kept)
        estimates, kinds = _estimates(counts, contexts, sizes.n_kept)
        return pa.table({"estimates": [np.concatenate(estimates).astype("<f8").tobytes()], "buckets": [np.concatenate(kinds).astype("u1").tobytes()]})

    learned = stage(each(parts.filter("held").select(*needed), "kept", "estimates binary, buckets binary", features), "features", "zstd")
    weights = learn_weights(learned, order, uniform, rounds)

    def scored(part: pa.Table, found: pa.Table) -> pa.Table:
        row = part.drop_columns(["ids"]).to_pylist()[0] | {"buckets": buckets}
        counts, contexts, lengths = _counts(row, found, "train", order, sizes.d_train)
        estimates, kinds = _estimates(counts, contexts, sizes.n_train)
        starts = np.cumsum(lengths) - lengths
        total = lambda x: np.add.reduceat(x, starts)
        base = total(np.log10((counts[0] + 1) / (sizes.n_train + known + 1)))
        own = total(np.log10(sum(mixture(estimates, kinds, weights, uniform))))
        return pa.table([part["ids"].combine_chunks().values if isinstance(part["ids"], pa.ChunkedArray) else part["ids"].values, pa.array(lengths), pa.array(total((counts[0] > 0).astype(np.int64))), pa.array(np.full(len(lengths), sizes.n_train)), pa.array(base), pa.array(own)], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return each(parts.select("ids", *needed), "train", f"doc_id {id_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double", scored)
