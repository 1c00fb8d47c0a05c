"""Vector codes, the Merkle manifest and language-model scores against plain Python, and their edges."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from skylane.llm import entries, lm_scores, merkle, vector_codes
from skylane.llm.common import id_remainder

SF = "/root/testdata/sf0.001"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# Vector codes


def plain_codes(vectors, parts, entries_, rounds, scale=4096):
    """vectors in the order of their ids."""
    x = np.array([[math.floor(scale * float(v)) for v in row] for row in vectors]).reshape(len(vectors), parts, -1)
    books = x[:entries_].transpose(1, 0, 2).copy()
    nearest = lambda: ((x[:, :, None, :] - books[None]) ** 2).sum(3)
    for _ in range(rounds):
        code = nearest().argmin(2)
        for p in range(parts):
            for e in range(books.shape[1]):
                own = x[code[:, p] == e, p]
                if len(own):
                    books[p, e] = own.sum(0) // len(own)
    d = nearest()
    return ["".join(f"{i:02x}" for i in row) for row in d.argmin(2)], d.min(2).sum(1).tolist(), books


def test_codes_equal_a_plain_search(spark):
    rows = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    codes, errors, books = plain_codes([r.embedding for r in rows], 8, 16, 6)
    by_label = Counter()
    for r, e in zip(rows, errors, strict=True):
        by_label[r.label] += e
    got = sorted(entries.op11_vector_codes(spark, SF).collect(), key=lambda r: r.vec_id)
    want = hashlib.sha256(",".join(str(v) for v in books.ravel()).encode()).hexdigest()
    assert [(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got] == [(r.vec_id, c, e, by_label[r.label], want) for r, c, e in zip(rows, codes, errors, strict=True)]


@pytest.mark.parametrize("entries_,leaf", [(1, 4), (2, 1), (5, 4), (16, 1), (16, 4), (200, 4)])
def test_trees_visit_ties(entries_, leaf):
    """Small whole numbers give many equal distances and equal entries; the lowest index has to win."""
    rng = np.random.default_rng(entries_)
    books, x = rng.integers(-3, 4, (3, entries_, 2)), rng.integers(-4, 5, (500, 3, 2))
    entry, squared = vector_codes.VantageTrees(books, leaf).nearest(x)
    d = ((x[:, :, None, :] - books[None]) ** 2).sum(3)
    assert (entry == d.argmin(2)).all() and (squared == d.min(2)).all()


def test_trees_are_exact_for_large_numbers():
    rng = np.random.default_rng(3)
    books = rng.integers(-(2**27), 2**27, (2, 40, 8))
    x = np.concatenate([books.transpose(1, 0, 2) + rng.integers(-1, 2, (40, 2, 8)), rng.integers(-(2**27), 2**27, (200, 2, 8))])
    d = ((x[:, :, None, :] - books[None]) ** 2).sum(3)
    entry, squared = vector_codes.VantageTrees(books).nearest(x)
    assert (entry == d.argmin(2)).all() and (squared == d.min(2)).all()


def test_trees_leave_entries_out():
    """Far groups of entries: most are never measured."""
    rng = np.random.default_rng(5)
    books = (rng.integers(0, 16, (1, 256, 1)) * 100_000 + rng.integers(0, 50, (1, 256, 4))).astype(np.int64)
    trees, met = vector_codes.VantageTrees(books), []
    squared = np.einsum

    def counting(how, a, b):
        met.append(a.size // a.shape[-1])
        return squared(how, a, b)

    vector_codes.np.einsum = counting
    try:
        trees.nearest(books[0][:, None, :])
    finally:
        vector_codes.np.einsum = squared
    assert sum(met) < 256 * 256 / 4


def test_codes_of_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int, code string, whole string, error int"
    good = [(i, [float((i * 7 + j * 3) % 11) - 5 for j in range(4)], i % 2 if i % 5 else None) for i in range(40)]
    odd = [(100, None, 1), (101, [1.0, None, 0.0, 0.0], 1), (102, [float("nan"), 0.0, 0.0, 0.0], 1), (103, [float("inf"), 0.0, 0.0, 0.0], 1), (104, [], 1), (105, [1.0, 2.0], 1), (106, [1.0, 2.0, 3.0], 1)]
    again = [good[3], (None, [1.0, 1.0, 1.0, 1.0], 0)]
    df = spark.createDataFrame([(*r, "x", "y", 0) for r in good + odd + again], schema)
    coded, books = vector_codes.compress(df, parts=2, entries=4, rounds=3, keep=("label",))
    got = sorted((r.vec_id if r.vec_id is not None else 10**6, r.code, r.error) for r in coded.collect())
    ordered = sorted(good + again, key=lambda r: (r[0] is None, r[0] or 0))
    codes, errors, want = plain_codes([r[1] for r in ordered], 2, 4, 3)
    assert (books == want).all()
    assert got == sorted((r[0] if r[0] is not None else 10**6, c, e) for r, c, e in zip(ordered, codes, errors, strict=True))
    label = Counter()
    for r, e in zip(ordered, errors, strict=True):
        label[r[2]] += e
    assert all(r.label_error == label[r.label] for r in vector_codes.with_label_error(coded).collect())
    back = vector_codes.decode(coded, books).collect()
    assert all(sum((math.floor(4096 * a) - round(4096 * b)) ** 2 for a, b in zip(dict((r[0], r[1]) for r in ordered)[x.vec_id], x.vector, strict=True)) == x.error for x in back)


def test_codes_of_few_or_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    coded, books = vector_codes.compress(spark.createDataFrame([], schema), parts=2)
    assert coded.collect() == [] and coded.columns == ["vec_id", "code", "error"] and books.size == 0
    coded, books = vector_codes.compress(spark.createDataFrame([(1, [0.5, 1.0])], schema), parts=2)
    assert [tuple(r) for r in coded.collect()] == [(1, "0000", 0)] and books.tolist() == [[[2048]], [[4096]]]
    with pytest.raises(Exception, match="exactly"):
        vector_codes.compress(spark.createDataFrame([(1, [3e38, 1.0])], schema), parts=2)


# Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(map(field, (r.doc_id, r.source, r.lang, r.n_chars, text))))
    leaves = [leaf(r, r.text) for r in rows]
    tried = [leaf(r, r.text and lower(r.text)) if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 else own for r, own in zip(rows, leaves, strict=True)]
    around = {i: [] for i in range(len(rows))}

    def climb(nodes, members):
        while len(nodes) > 1:
            runs = range(0, len(nodes), 8)
            for at in runs:
                for k, own in enumerate(members[at : at + 8]):
                    for i in own:
                        around[i].append((nodes[at : at + k], nodes[at + k + 1 : at + 8]))
            nodes, members = [sha("".join(nodes[a : a + 8])) for a in runs], [sum(members[a : a + 8], []) for a in runs]
        return nodes[0]

    trees = {}
    for i, r in enumerate(rows):
        trees.setdefault(r.lang, []).append(i)
    for own in trees.values():
        own.sort(key=lambda i: (rows[i].doc_id is not None, rows[i].doc_id or 0, leaves[i]))
    sub = {t: climb([leaves[i] for i in own], [[i] for i in own]) for t, own in trees.items()}
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    root = climb([sub[t] for t in names], [trees[t] for t in names])
    found = []
    for i, r in enumerate(rows):
        node = tried[i]
        for before, after in around[i]:
            node = sha("".join([*before, node, *after]))
        found.append((r.doc_id, leaves[i], sub[r.lang], root, sha("".join(x for b, a in around[i] for x in b + a)), node, node == root))
    return sorted(found, key=repr)


def manifest(df, **how):
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return sorted((tuple(r) for r in merkle.manifest(df, changed=F.when(id_remainder("doc_id", 3) == 0, low), **how).collect()), key=repr)


ODD = "doc_id long, text string, lang string, source string, n_chars long, leaf string, size int, block int"


def odd_rows(n, langs):
    for i in range(n):
        yield (None if i % 13 == 0 else i // 2, None if i % 7 == 0 else "" if i % 7 == 1 else "Ä" * (i % 5) + "aB", None if i % 11 == 0 else f"{'é' * (i % 3)}{i % langs}", None if i % 5 == 0 else "web", None if i % 3 == 0 else i, "x", 1, 2)
    yield from [(5, "same", "same", "s", 1, "x", 1, 2)] * 20


@pytest.mark.parametrize("n,langs,how", [(90, 3, {}), (90, 3, {"fan_levels": 1, "top": 3}), (120, 60, {"fan_levels": 1, "top": 4}), (120, 60, {"fan_levels": 2, "top": 7})])
def test_manifest_equals_a_plain_one(spark, n, langs, how):
    """Also with several distributed reductions, and with more trees than the top tree may have nodes."""
    df = spark.createDataFrame(list(odd_rows(n, langs)), ODD)
    assert manifest(df.repartition(5), **how) == plain_manifest(df.collect())


def test_manifest_of_small_tables(spark):
    assert manifest(spark.createDataFrame([], ODD)) == []
    one = spark.createDataFrame([(1, "A", "en", "s", 1, "x", 1, 2)], ODD)
    (row,) = manifest(one)
    assert row == plain_manifest(one.collect())[0] and row[1] == row[2] == row[3] and row[4] == sha("")


def test_manifest_of_a_long_text(spark):
    df = spark.createDataFrame([(i, "Wört " * 400_000 if i == 3 else "x", "en", "s", 1, "x", 1, 2) for i in range(10)], ODD)
    assert manifest(df) == plain_manifest(df.collect())


def test_paths_find_any_change(spark):
    levels = merkle.reduce_run([hashlib.sha256(bytes([i])).digest() for i in range(100)], merkle.height(100))
    for at in (0, 7, 8, 63, 64, 99):
        path = merkle.path_of(levels, at)
        assert merkle.fold(levels[0][at], path) == levels[-1][0] != merkle.fold(levels[0][(at + 1) % 100], path)


# Language-model scores


def plain_scores(rows, order, counted, held):
    """By (doc_id, text): tokens, known, counted tokens, base and model score."""
    words = re.compile(r"[^\x20\x09-\x0D]+")
    tokens = [[*words.findall(lower(r.text or "")), "\n"] for r in rows]

    def count(which):
        n, contexts = Counter(), Counter()
        for i in which:
            padded = ["\n^"] * (order - 1) + tokens[i]
            for t in range(order - 1, len(padded)):
                for k in range(1, order + 1):
                    gram = tuple(padded[t - k + 1 : t + 1])
                    n[gram] += 1
                    contexts[gram[:-1]] += 1
        return n, contexts

    def features(i, n, contexts):
        padded = ["\n^"] * (order - 1) + tokens[i]
        for t in range(order - 1, len(padded)):
            some = [tuple(padded[t - k + 1 : t + 1]) for k in range(1, order + 1)]
            yield [(n[g] / max(1, contexts[g[:-1]]), contexts[g[:-1]].bit_length() if len(g) > 1 else min(1, contexts[()])) for g in some]

    train = [i for i, r in enumerate(rows) if counted(r)]
    apart = [i for i in train if held(rows[i])]
    n, contexts = count(train)
    kept = count([i for i in train if i not in set(apart)])
    vocabulary, total = sum(len(g) == 1 for g in n), contexts[()]
    weights = {}

    def shares(feature):
        rest, found = 1.0, []
        for k in range(order, 0, -1):
            estimate, bucket = feature[k - 1]
            w = weights.get((k, bucket), 0.5) if bucket else 0.0
            found.append(rest * w * estimate)
            rest *= 1 - w
        return [rest / (vocabulary + 1), *found[::-1]]

    tuning = [f for i in apart for f in features(i, *kept)]
    for _ in range(lm_scores.ROUNDS):
        won, reached = Counter(), Counter()
        for f in tuning:
            s = shares(f)
            for k in range(1, order + 1):
                won[k, f[k - 1][1]] += s[k] / sum(s)
                reached[k, f[k - 1][1]] += sum(s[: k + 1]) / sum(s)
        weights = {x: min(won[x] / reached[x], lm_scores.MOST) for x in reached if x[1]}
    out = []
    for i, own in enumerate(tokens):
        base = sum(math.log10((n[(t,)] + 1) / (total + vocabulary + 1)) for t in own)
        out.append((rows[i].doc_id, len(own), sum(n[(t,)] > 0 for t in own), total, base, sum(math.log10(sum(shares(f))) for f in features(i, n, contexts))))
    return out


def close(got, want):
    key = lambda r: (str(r[:4]), round(r[4], 4), round(r[5], 4))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4:] for r in got], [r[4:] for r in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_a_plain_count(spark, order):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = df.collect()
    crc = lambda r: zlib.crc32(str(r.doc_id).encode())
    tuning = F.floor(F.crc32(F.col("doc_id").cast("string")) / 7) % 16 == 0
    got = lm_scores.score(df, id_remainder("doc_id", 7) != 2, tuning, order=order, bucket_bytes=50_000)
    close(got.collect(), plain_scores(rows, order, lambda r: crc(r) % 7 != 2, lambda r: crc(r) // 7 % 16 == 0))


def test_score_query_predicts_unseen_texts(spark):
    rows = entries.op13_lm_scores(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.n_known <= r.n_tokens for r in rows)
    unseen = [r for r in rows if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_probabilities_of_a_context_sum_to_one():
    """Over all known tokens and the unknown one."""
    rng = np.random.default_rng(1)
    counts, weights = rng.integers(0, 5, (2, 50)), rng.random((2, lm_scores.FREQUENCIES))
    estimates = [c / c.sum() for c in counts]
    buckets = [np.full(50, lm_scores.frequency(np.array([c.sum()]))[0]) for c in counts]
    seen = sum(lm_scores.mixture(estimates, buckets, weights, 1 / 51)).sum()
    unknown = sum(lm_scores.mixture([np.zeros(1)] * 2, [b[:1] for b in buckets], weights, 1 / 51))[0]
    assert abs(seen + unknown - 1) < 1e-12


def test_scores_of_odd_rows(spark):
    schema = "doc_id long, text string, score string, train int, held int, slice int, k int"
    texts = [None, "", "  \t\n ", "A b a B", "a b c d e f g", "a b c d e f g", "Ä ä é", " x y", "a\x0bb\x0cc\rd", "w" * 5000, " ".join(f"w{i % 700}" for i in range(60_000)), "<s> ^ \\n"]
    rows = [(i if i != 4 else None, t, "x", 1, 1, 1, 1) for i, t in enumerate(texts)] + [(3, "A b a B", "x", 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, schema)
    train, held = F.coalesce(F.col("doc_id"), F.lit(0)) != 8, F.col("doc_id") % 5 == 3
    got = lm_scores.score(df.repartition(3), train, held).collect()
    plain = plain_scores(df.collect(), 2, lambda r: r.doc_id != 8, lambda r: r.doc_id is not None and r.doc_id % 5 == 3)
    close(got, plain)
    assert len(got) == len(rows)


def test_scores_without_training_or_rows(spark):
    df = spark.createDataFrame([Row(doc_id=1, text="a b"), Row(doc_id=2, text=None)])
    got = sorted(lm_scores.score(df, F.lit(False), F.lit(False)).collect())
    assert [tuple(r) for r in got] == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
    assert lm_scores.score(df.limit(0), F.lit(True), F.lit(True)).collect() == []
    alone = lm_scores.score(df, F.lit(True), F.lit(None).cast("boolean")).collect()  # no held-out rows: weights of one half
    close(alone, plain_scores(df.collect(), 2, lambda r: True, lambda r: False))
