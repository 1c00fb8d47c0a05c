"""Toxicity by compression distance.

Two zstandard dictionaries are made, one trained on windows of ordinary text and one of the words of toxic windows. From
the toxic one every word goes that ordinary windows hold about as often, since toxic texts are ordinary text for the most
part; the rest is put in front of the ordinary dictionary, so that both explain ordinary text alike and differ in toxic segments
only. A window is compressed with both; the bytes that the toxic dictionary saves are its evidence. Thresholds on the
savings are calibrated on labelled documents that taught neither dictionary: how many windows of a document save at least 1, 2, ... bytes, and how many
windows it has, are weighed by a logistic regression whose value is the document's score.

Two dictionaries straight from zstandard's trainer, one on each class, don't tell the classes apart here: toxic documents
share nearly all windows' words with ordinary ones, so the trainer fills both with the same frequent words. Measured on
held-out rows of sf0.1, such a pair found 0.01 to 0.23 of toxic documents at 0.01 to 0.05 false alarms (windows of 32 to
128 bytes, dictionaries of 8 to 64 kB), and a toxic dictionary trained on the contrasted words alone 0.30 to 0.68, since
the trainer drops rare segments; the one made here finds 0.79 at 0.025.
"""

from __future__ import annotations

import math
import os.path
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, slices, stage

WINDOW, MOST = 128, 8


#: ASCII marks and digits part words.
_BLANKS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """The whole lower-cased text in windows of whole words, each of size bytes or a word more; the last may be shorter."""
    out, held, n = [], [], 0
    for word in (text or "").lower().encode("utf-8", "replace").translate(_BLANKS).split():
        held.append(word)
        n += len(word) + 1
        if n >= size:
            out.append(b" ".join([b"", *held, b""]))
            held, n = [], 0
    return [*out, b" ".join([b"", *held, b""])] if held else out


def _trained(size: int, samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: they are their own dictionary
        return b" ".join(samples)[-size:]


class ToxicityModel:
    """Two dictionaries (some 20 kB) and the weights of a document's features."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = ordinary, toxic
        self.weights = np.zeros(MOST + 2)

    def savings(self) -> "SavingCounter":
        return SavingCounter(self.ordinary, self.toxic)


class SavingCounter:
    """Bytes that the toxic dictionary saves in each window of a text, up to MOST."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        how = zstandard.ZstdCompressionParameters(window_log=17, chain_log=14, hash_log=14, search_log=6, min_match=3, target_length=32, strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        of = lambda content: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how).compress
        self.plain, self.both = of(ordinary), of(toxic + ordinary)

    def __call__(self, text: str | None) -> list[int]:
        return [min(MOST, max(0, len(self.plain(x)) - len(self.both(x)))) for x in windows(text)]


def _contexts(samples: list[bytes], shortest: int) -> Counter:
    """Beginnings of words (of at least shortest bytes) by the number of different word pairs they stand in as second; copies count once."""
    pairs: set[tuple[bytes, bytes]] = set()
    for x in samples:
        words = x.split()
        pairs.update(zip(words, words[1:], strict=False))
    return Counter(w[:n] for _, w in pairs for n in range(shortest, len(w) + 1))


def _by_chance(n: int, m: int, rate: float) -> float:
    """Probability that n or more of n + m contexts are toxic ones for a beginning as frequent in rate times as many ordinary windows."""
    q, every = rate / (1 + rate), n + m
    return sum(math.exp(math.lgamma(every + 1) - math.lgamma(k + 1) - math.lgamma(every - k + 1) + k * math.log(q) - (every - k) * math.log1p(rate)) for k in range(m + 1))


def dictionaries(ordinary: list[bytes], toxic: list[bytes], size: int = 16384, ratio: float = 10, least: int = 5, chance: float = 1e-5, shortest: int = 4) -> ToxicityModel:
    """Trains the ordinary dictionary and makes the toxic one of the words of toxic windows.

    Of these words those stay that have a beginning which stands in at least ``least`` contexts in toxic windows and in
    ratio times as many as in ordinary ones, given their numbers, which a beginning equally frequent in both would reach with a probability of at
    most ``chance``. So each is judged by its own contexts, however frequent others are. Words that share their shortest such beginning are cut
    to what they have in common, so that no ordinary ending is left in the toxic dictionary.
    """
    plain = _trained(size, ordinary) if ordinary else b""
    in_toxic, in_plain = _contexts(toxic, shortest), _contexts(ordinary, shortest)
    rate = len(ordinary) / max(1, len(toxic))
    marked = lambda x: in_toxic[x] >= least and in_toxic[x] * rate >= ratio * (in_plain[x] + 0.1) and _by_chance(in_toxic[x], in_plain[x], rate) <= chance
    alike: dict[bytes, list[bytes]] = {}
    for w in {w for x in toxic for w in x.split()}:  # all of them: a trainer would leave rare ones out beside frequent ones
        if (of := next((w[:n] for n in range(shortest, len(w) + 1) if marked(w[:n])), None)) and marked(w):
            alike.setdefault(of, []).append(w)
    segments = {os.path.commonprefix(words): in_toxic[of] for of, words in alike.items()}
    return ToxicityModel(plain[-3 * size // 4 :] or b" ", b" ".join([b"", *sorted(segments, key=lambda w: (segments[w], w)), b""]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 30_000, toxic_windows: int = 50_000, ordinary_windows: int = 60_000) -> ToxicityModel:
    """Learns from docs (doc_id, text) and labels (doc_id, toxic); null ids, texts and labels are left out, of repeated labels the greatest counts.

    About ``sample`` labels are taken by a hash of the id, all if there are fewer, so their list is small enough to be
    sent to the documents. A hash of the id deals them to two parts: two thirds teach the dictionaries, of which at most
    the given numbers of distinct windows are used, again taken by a hash; the rest calibrate the thresholds, so that no
    weight is fitted on windows that the dictionaries hold. Where that part has one class only (very small tables), all
    rows calibrate. Without labelled rows every score is 0.5.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).filter("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, sample / max(1, known.count()))
    ids = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(19)), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("text is not null")
    taken = stage(rows.join(F.broadcast(ids), "doc_id").select("text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(3)) == 0).alias("weighs")), "taught")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            found = [(w, t) for x, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in windows(x)]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], type=pa.binary()), pa.array([t for _, t in found], type=pa.int32())], names=["window", "toxic"])

    cuts = bounded(taken.filter("not weighs")).mapInArrow(cut, "window binary, toxic int").distinct()
    some = lambda toxic, n: [bytes(r.window) for r in cuts.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("window"), "window").limit(n).collect()]
    model = dictionaries(some(0, ordinary_windows), some(1, toxic_windows))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = model.savings()
        for batch in slices(batches, 0):
            rows = [features(count(text)).tolist() for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(rows, type=pa.list_(pa.float64()))], names=["toxic", "weighs", "features"])

    rows = bounded(taken).mapInArrow(weigh, "toxic int, weighs boolean, features array<double>").toArrow()  # about sample rows of ten numbers
    if len(rows):
        x, y, use = np.array(rows["features"].to_pylist()), np.asarray(rows["toxic"]) == 1, np.asarray(rows["weighs"])
        if len(set(y[use])) < 2:
            use[:] = True
        model.weights = _regression(x[use], y[use])
    return model


def features(saved: list[int]) -> np.ndarray:
    """1, the log of the number of windows, and of those that save at least 1 to MOST bytes."""
    at_least = np.bincount(saved, minlength=MOST + 1)[::-1].cumsum()[::-1]
    return np.concatenate(([1.0], np.log1p(at_least)))


def _regression(x: np.ndarray, y: np.ndarray, rounds: int = 30, shrink: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method, all weights but the first shrunk.

    A row of the rarer class weighs the root of the ratio of the classes, so that misses count for more than their share.
    """
    if 0 < y.sum() < len(y):
        heavy = np.where(y, math.sqrt(max(1.0, (~y).sum() / y.sum())), math.sqrt(max(1.0, y.sum() / (~y).sum())))
    else:
        heavy = np.ones(len(y))
    w, ridge = np.zeros(x.shape[1]), shrink * np.eye(x.shape[1])
    ridge[0, 0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (heavy * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (heavy * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, predicted (1 if score >= 0.5), windows, hits (windows that save more than two bytes) for every row of docs.

    A null or empty text has no windows, so its score is that of an ordinary short text. Nothing but the text is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = model.savings()
        for batch in slices(batches):
            scores, n, hits = [], [], []
            for text in batch.column(1).to_pylist():
                saved = count(text)
                total = float(features(saved) @ model.weights)
                scores.append(1 / (1 + math.exp(-min(700.0, max(-700.0, total)))))
                n.append(len(saved))
                hits.append(sum(x > 2 for x in saved))
            arrays = [batch.column(0), pa.array(scores, type=pa.float64()), pa.array([int(x >= 0.5) for x in scores], type=pa.int32()), pa.array(n, type=pa.int64()), pa.array(hits, type=pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "score", "predicted", "windows", "hits"])

    return bounded(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, "doc_id long, score double, predicted int, windows long, hits long")
