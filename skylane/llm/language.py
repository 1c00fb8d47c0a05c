"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, slices

#: Bytes of text whose n-grams are held at once.
SLICE = 500_000
_LETTER: list[np.ndarray] = []


def _buckets(*codes: np.ndarray) -> np.ndarray:
    """Hashes of n-grams, given as arrays of their first, second, ... characters."""
    a, b = np.uint32(0x01000193), np.uint32(0x85EBCA6B)
    out = codes[0] * b ^ np.uint32(len(codes) * 0x68E31DA4 & 0xFFFFFFFF)
    for c in codes[1:]:
        out = (out ^ out >> np.uint32(13)) * a ^ c * b
    out = out * np.uint32(0x9E3779B1)
    return (out ^ out >> np.uint32(15)) * np.uint32(0x2C1B3C6D)


def ngrams(texts: Sequence[str | None], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hash buckets of the 1-, 2- and 3-grams of the lower-cased texts, with the number of the text each is from, ascending.

    A text counts as its runs of letters with one blank before, between and after them; a null text or one without a
    letter has none. All texts of the batch are hashed at once.
    """
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    lower = [(x or "").lower() + "\n" for x in texts]
    codes = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
    letter = _LETTER[0][codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    text = np.repeat(np.arange(len(lower), dtype=np.int64), np.fromiter(map(len, lower), dtype=np.int64, count=len(lower)))[keep]
    c = np.concatenate(([32], np.where(letter, codes, 32)[keep])).astype(np.uint32)  # the blank after a text's last word is also that before the next text's first
    yield _buckets(c[1:]) >> np.uint32(32 - bits), text
    yield _buckets(c[:-1], c[1:]) >> np.uint32(32 - bits), text
    same = text[1:] == text[:-1]
    yield (_buckets(c[:-2], c[1:-1], c[2:]) >> np.uint32(32 - bits))[same], text[1:][same]


class LanguageModel:
    """Log probabilities, languages by buckets (languages * 2**bits floats, which are broadcast)."""

    def __init__(self, languages: list[str], log_p: np.ndarray, prior: np.ndarray, bits: int):
        self.languages, self.log_p, self.prior, self.bits = languages, log_p, prior, bits


def fit(labelled: DataFrame, bits: int = 14, sample: int = 20_000) -> LanguageModel:
    """Learns from (doc_id, text, lang) rows; null texts and languages are left out.

    About ``sample`` rows are taken by a hash of the id, all if there are fewer; counts are summed by Spark.
    """
    known = labelled.select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string")).filter("text is not null and lang is not null")
    share = min(1.0, sample / max(1, known.select("doc_id").count()))
    taken = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < int(share * 1_000_000)).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, 0, SLICE):
            langs = batch.column(1).to_pylist()
            names = sorted(set(langs))
            of = np.array([names.index(x) for x in langs], dtype=np.int64)
            for i, lang in enumerate(names):
                sums.setdefault(lang, np.zeros((1 << bits) + 1, dtype=np.int64))[-1] += int((of == i).sum())
            for buckets, text in ngrams(batch.column(0).to_pylist(), bits):
                found = np.bincount(of[text] << bits | buckets, minlength=len(names) << bits)
                for i, lang in enumerate(names):
                    sums[lang][:-1] += found[i << bits : (i + 1) << bits]
        for lang, found in sums.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), type=pa.string()), pa.array(at, type=pa.int32()), pa.array(found[at])], names=["lang", "bucket", "n"])

    rows = bounded(taken).mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r.lang for r in rows})
    counts = np.zeros((len(languages), (1 << bits) + 1))
    for r in rows:
        counts[languages.index(r.lang), r.bucket] = r.n
    grams, docs = counts[:, :-1] + 0.5, counts[:, -1]
    log_p = np.log(grams / grams.sum(axis=1, keepdims=True)).astype(np.float32)
    return LanguageModel(languages, log_p, np.log(np.maximum(docs, 1) / max(1, docs.sum())), bits)


def score_texts(texts: Sequence[str | None], log_p: np.ndarray, prior: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Log scores, texts by languages, and whether each text has a letter; log_p has languages in its last axis."""
    totals, some = np.tile(prior, (len(texts), 1)).astype(np.float64), np.zeros(len(texts), dtype=bool)
    for buckets, text in ngrams(texts, bits):
        ends = np.searchsorted(text, np.arange(len(texts) + 1))
        some |= ends[1:] > ends[:-1]
        full = np.flatnonzero(ends[1:] > ends[:-1])  # texts that have n-grams; each one's sum runs to the next one's first
        if len(full):
            totals[full] += np.add.reduceat(log_p[buckets].astype(np.float64), ends[full], axis=0)
    return totals, some


def predict(docs: DataFrame, model: LanguageModel, keep: Sequence[str] = (), temper: float = 3.0) -> DataFrame:
    """doc_id, lang_pred, score and the columns to keep for every row of docs (doc_id, text).

    score is the posterior of that language, with log odds divided by ``temper``: every letter is in about three n-grams,
    which naive Bayes takes for independent. A null text, one without a letter, or a model without languages gives und
    and 0. Ties go to the first language. Repeated rows are judged alike; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, np.ascontiguousarray(model.log_p.T), model.prior, model.bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, table, prior, bits = sent.value
        for batch in slices(batches, 1, SLICE):
            langs, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            if languages:
                totals, some = score_texts(batch.column(1).to_pylist(), table, prior, bits)
                best = totals.argmax(axis=1)
                odds = np.exp((totals - totals.max(axis=1, keepdims=True)) / temper).sum(axis=1)
                scores = np.where(some, 1 / odds, 0.0)
                langs = [languages[i] if s else "und" for i, s in zip(best.tolist(), some.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, type=pa.string()), pa.array(scores, type=pa.float64()), *batch.columns[2:]], names=["doc_id", "lang_pred", "score", *keep])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)])
    schema = ", ".join(["doc_id long, lang_pred string, score double", *[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]])
    return bounded(rows).mapInArrow(run, schema)
