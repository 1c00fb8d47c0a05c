"""Quality rules as a learned decision list.

Sequential covering learns ordered rules for rejecting: a rule is a conjunction of thresholds on text statistics, grown
on two thirds of the labelled rows by information gain and pruned on the rest, condition by condition, while that
doesn't lower its value there. Covered rows are set aside and the next rule is learned. The list becomes a chain of
Spark conditional expressions over statistics columns.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, slices, stage

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower", "n_digits", "n_marks", "n_pipes", "n_lines", "n_stops")
FEATURES = {
    "word_length": ("word_chars", "n_words"), "symbol_share": ("n_symbols", "word_chars"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"), "digit_share": ("n_digits", "word_chars"), "mark_share": ("n_marks", "n_words"), "pipe_share": ("n_pipes", "n_words"), "stop_share": ("n_stops", "n_words"),
}
Condition = tuple[str, str, float]

#: Words are split at space and \t to \r only; bytes.split() does just that on UTF-8.
_SYMBOLS = b"#*$%&|<>"


def count_repeats(words: list[bytes], size: int = 5) -> int:
    """Words in windows of size words that are found twice or more in the text, first occurrence included."""
    windows = list(zip(*[words[i:] for i in range(size)], strict=False))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    total, until = 0, 0
    for at, window in enumerate(windows):
        if seen[window] > 1:
            total += at + size - max(at, until)
            until = at + size
    return total


def text_counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of a whole text; zeros for a null or empty one."""
    if not text:
        return (0,) * len(COUNTS)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    seen: set[str] = set()
    lines = dups = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            lines += 1
            dups += line in seen
            seen.add(line)
    codes = np.frombuffer(data, dtype=np.uint8)
    by = np.bincount(codes, minlength=256)
    spaces = int(by[32] + by[9:14].sum())
    continued = int(by[0x80:0xC0].sum())
    return (len(words), len(data) - continued - spaces, int(sum(by[c] for c in _SYMBOLS)), dups, count_repeats(words), int(by[65:91].sum()), int(by[97:123].sum()), int(by[48:58].sum()), int(by[33] + by[63]), int(by[124]), lines, int(by[46]))


def statistics(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, COUNTS and the columns to keep for every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = list(zip(*map(text_counts, batch.column(1).to_pylist()), strict=True)) or [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, type=pa.int64()) for c in columns], *batch.columns[2:]], names=["doc_id", *COUNTS, *keep])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)])
    schema = ", ".join(["doc_id long", *[f"{c} long" for c in COUNTS], *[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]])
    return bounded(rows).mapInArrow(run, schema)


def with_features(stats: DataFrame) -> DataFrame:
    return stats.withColumns({f: F.col(a) / F.greatest(F.col(b), F.lit(1)) for f, (a, b) in FEATURES.items()})


def _covers(x: dict[str, np.ndarray], rule: list[Condition]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), dtype=bool)
    for name, op, value in rule:
        out &= x[name] >= value if op == ">=" else x[name] <= value
    return out


def _grow(x: dict[str, np.ndarray], y: np.ndarray, most: int) -> list[Condition]:
    rule: list[Condition] = []
    inside = np.ones(len(y), dtype=bool)
    while len(rule) < most:
        p0, n0 = y[inside].sum(), (~y[inside]).sum()
        if not p0 or not n0:
            break
        base, best, chosen = math.log2(p0 / (p0 + n0)), 1e-9, None
        for name in FEATURES:
            values = x[name][inside]
            for value in np.unique(np.quantile(values, np.linspace(0, 1, 65))):
                for op in (">=", "<="):
                    hit = values >= value if op == ">=" else values <= value
                    p = (y[inside] & hit).sum()
                    gain = p * (math.log2(p / hit.sum()) - base) if p else 0
                    if gain > best:
                        best, chosen = gain, (name, op, float(value))
        if chosen is None:
            break
        rule.append(chosen)
        inside &= _covers(x, [chosen])
    return rule


def _value(x: dict[str, np.ndarray], y: np.ndarray, rule: list[Condition]) -> float:
    hit = _covers(x, rule)
    return (int(y[hit].sum()) - int((~y[hit]).sum())) / max(1, int(hit.sum()))


def learn(labelled: DataFrame, sample: int = 20_000, precision: float = 0.9, rules: int = 12, most: int = 4) -> list[list[Condition]]:
    """Ordered rules for rejecting, from rows with FEATURES, doc_id and quality (0: bad).

    About ``sample`` rows are taken by a hash of the id, all if there are fewer. Learning ends when a pruned rule isn't
    right for the given share of the pruning rows it covers. No bad or no good row gives no rules.
    """
    known = labelled.filter("quality is not null")
    share = min(1.0, sample / max(1, known.select("doc_id").count()))
    mark = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1_000_000))
    rows = known.filter(mark < int(share * 1_000_000)).select("doc_id", "quality", (F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(3)) == 0).alias("prune"), *FEATURES).orderBy("doc_id").toArrow()
    x = {f: np.asarray(rows[f], dtype=float) for f in FEATURES}
    y, prune = np.asarray(rows["quality"]) == 0, np.asarray(rows["prune"])
    out: list[list[Condition]] = []
    left = np.ones(len(y), dtype=bool)
    while len(out) < rules:
        grow, held = left & ~prune, left & prune
        if not y[grow].any() or y[grow].all() or not held.any():
            break
        part = {f: v[held] for f, v in x.items()}
        rule = _grow({f: v[grow] for f, v in x.items()}, y[grow], most)
        while len(rule) > 1:
            shorter = max(([c for c in rule if c != gone] for gone in rule), key=lambda r: _value(part, y[held], r))
            if _value(part, y[held], shorter) < _value(part, y[held], rule):
                break
            rule = shorter
        hit = _covers(part, rule) if rule else np.zeros(1, dtype=bool)
        if not rule or hit.sum() < 3 or y[held][hit].mean() < precision:
            break
        out.append(rule)
        left &= ~_covers(x, rule)
    return out


def verdict(rules: list[list[Condition]]) -> Column:
    """The decision list as ordered conditional expressions: false where a rule rejects, else true."""
    out = F.lit(True)
    for rule in reversed(rules):
        test = F.lit(True)
        for name, op, value in rule:
            test &= F.col(name) >= value if op == ">=" else F.col(name) <= value
        out = F.when(test, F.lit(False)).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame, keep: Sequence[str] = (), **learning: float) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept and the columns to keep for every row of docs (doc_id, text); labels (doc_id, quality) teach the rules.

    base_failed: fewer than 10 words, or more than a fifth of them in repeated windows. A null text has no words, so it
    fails. Repeated rows are judged alike; of contrary labels of a doc_id the lowest counts; an empty table gives no rows;
    without labels only the base test rejects.
    """
    taught = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).filter("doc_id is not null and quality is not null")
    taught = taught.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = min(1.0, learning.get("sample", 20_000) / max(1, taught.count()))
    taught = taught.filter(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(taught), "doc_id")  # about sample ids
    known = stage(with_features(statistics(rows, ["quality"])).select("doc_id", "quality", *FEATURES), "taught")
    rules = learn(known, **learning)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = with_features(statistics(docs, keep)).withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & verdict(rules)).select("doc_id", *COUNTS, "base_failed", "kept", *keep)
