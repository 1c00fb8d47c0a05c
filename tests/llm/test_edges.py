"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from skylane.llm import bitplanes, language, near_dups, packing, pii, pivot_search, quality, sentence_pieces, toxicity, url_blocks
from skylane.llm.common import ChunkEncoder, shared_dir, slices
from skylane.llm.components import connected_components

LONG = "word " * 20_000
ROWS = [(1, None), (2, ""), (3, " \n\t"), (4, "short text"), (4, "short text"), (None, "no id here"), (5, LONG), (6, "Größe ✓ \x00 " * 40)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 0, 0.5, [1]) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, unit int, score double, ids array<int>")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_packing(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(docs, path, window=64, units=16).collect()
    assert {r.doc_id for r in rows} == {i for i, _ in ROWS}
    assert sum(r.length for r in rows if r.doc_id == 4) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 4)
    assert [r.length for r in rows if r.doc_id == 1] == [1]
    assert packing.pack(empty, path).count() == 0


@pytest.mark.parametrize(("name", "spaced"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_added_tokens_in_texts(name, spaced):
    from tokenizers import Tokenizer

    texts = ["one two <|endoftext|> three", "a<|startoftext|>b  c<|endoftext|>", "<|ENDOFTEXT|> <| endoftext |>", "plain words", None, "<|endoftext|>"]
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    want = [whole.encode(x or "", add_special_tokens=False).ids for x in texts]
    ids, lengths = ChunkEncoder(public_tokenizers.path(name), spaced).encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, lengths.cumsum())[:-1]] == want


@pytest.mark.parametrize(("name", "spaced"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_ids_of_random_texts(name, spaced):
    """Any mix of blanks, marks, letters and added tokens, against the library; slices of a batch, and chunks met before."""
    from tokenizers import Tokenizer

    rng = np.random.default_rng(3)
    bits = [" ", "  ", "\n", " \n", "\t", "a", "B", "é", "don't", "123", "<|endoftext|>", "<|startoftext|>", "\u00a0", "\u3000", "x.y", "\x1c", "ß", "\u0301", "...", "word", "İ"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 12))) for _ in range(1500)] + ["", None, " ", "a " * 3000, "b" * 5000]
    whole, ours = Tokenizer.from_file(public_tokenizers.path(name)), ChunkEncoder(public_tokenizers.path(name), spaced)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, type=pa.string())], names=["i", "text"])
    for part in [*slices([batch], most=4000), batch]:
        ids, lengths = ours.encode(part.column(1))
        want = [whole.encode(x or "", add_special_tokens=False).ids for x in part.column(1).to_pylist()]
        assert [x.tolist() for x in np.split(ids, lengths.cumsum())[:-1]] == want


@pytest.mark.parametrize("words", [(0,), (3, 60), (0, 3, 40, 300, 900)])
def test_packing_has_little_padding(spark, words):
    """Empty, short and mixed corpora need at most 3 % more sequences than their ids fill."""
    rows = [(i, "word " * words[i % len(words)]) for i in range(20_000 if words == (0,) else 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(df, public_tokenizers.path("word_bpe_49k.json")).toPandas()
    used = got.groupby("sequence_id").agg(ids=("length", "sum"), ends=("offset", lambda x: x.nunique()), n=("length", "size"))
    assert (used.ids <= 4096).all() and (used.ends == used.n).all() and sorted(used.index) == list(range(len(used)))
    assert ((got.offset + got.length).groupby(got.sequence_id).max() == used.ids).all()
    total = sum(words[i % len(words)] + 1 for i in range(len(rows)))
    assert used.ids.sum() == total and len(used) <= np.ceil(total / 4096 * 1.03)


def test_bit_planes_format():
    for ids in (np.array([], dtype="<u4"), np.array([0, 0], dtype="<u4"), np.random.default_rng(1).integers(0, 2**32, 1001, dtype="<u4")):
        for bits in (1, 8):
            payload = bitplanes.encode_ids(ids, block=64, bits=bits)
            assert (bitplanes.decode_ids(payload) == ids).all()
            assert (bitplanes.decode_ids(payload, 1, 2) == ids[64:128]).all()


def test_bit_planes(spark, docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    for rows, n in ((docs, len(ROWS)), (empty, 0)):
        out = f"{shared_dir(spark)}/edges-{n}"
        bitplanes.write_ids(rows, out, path, segment=100, bits=1)
        got = bitplanes.read_documents(spark, out).collect()
        assert len(got) == n
        at = 0
        for r in sorted(got, key=lambda r: r.start):
            assert r.start == at
            at += r.n_tokens


def test_sentence_pieces(docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = {r.doc_id: r for r in sentence_pieces.encode_documents(docs, path).collect()}
    assert got[1].round_trip is None and got[2].n_pieces == 0 and got[5].round_trip and got[6].round_trip
    assert sentence_pieces.encode_documents(empty, path).count() == 0


def test_language(spark, docs, empty):
    taught = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "x", None)], "doc_id long, text string, lang string")
    model = language.fit(taught)
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[4].lang_pred in ("en", "de") and got[1].score == 0
    assert language.predict(empty, model).count() == 0
    assert {r.lang_pred for r in language.predict(docs, language.fit(taught.limit(0))).collect()} == {"und"}


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert got[1].n_words == 0 and got[1].base_failed and not got[1].kept and got[5].n_repeat_words == 20_000
    assert got[6].n_words == got[6].n_repeat_words == 120 and got[6].base_failed and not got[6].kept  # three words, 40 times
    clean = spark.createDataFrame([(7, " ".join(f"word{i}" for i in range(30)))], "doc_id long, text string")
    assert quality.judge(clean, labels.limit(0)).first().kept
    assert quality.judge(empty, labels.limit(0)).count() == 0


def test_toxicity(spark, docs, empty):
    taught = spark.createDataFrame([(i, f"calm words number {i} go by", 0) for i in range(40)] + [(i, f"awful {i} gremlin {i * 7} words", 1) for i in range(40, 80)] + [(90, None, 1), (91, "x", None)], "doc_id long, text string, toxic int")
    model = toxicity.fit(taught, taught)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert got[1].score == got[2].score and 0 <= got[5].score <= 1 and got[1].windows == 0
    assert toxicity.score(empty, toxicity.fit(taught.limit(0), taught.limit(0))).count() == 0


def test_toxicity_keeps_rare_words_beside_a_frequent_one():
    """A marker in 3,000 contexts leaves words of 40 contexts in the dictionary; words as frequent in ordinary windows stay out."""
    ordinary = [f" calm{i} plain{i % 50} talk{i % 90} goes{i} on ".encode() for i in range(4000)]
    often = [f" calm{i} gremlin plain{i % 50} goes{i} on ".encode() for i in range(3000)]
    rare = [f" calm{i} {w} talk{i % 90} goes{i} on ".encode() for w in ("wretched", "vermin") for i in range(40)]
    model = toxicity.dictionaries(ordinary, often + rare)
    assert {b"gremlin", b"wretched", b"vermin"} <= set(model.toxic.split()) and b"plain" not in model.toxic
    assert all(sum(model.savings()(f"calm words {w} go by")) > 0 for w in ("gremlin", "wretched", "vermin"))


def test_pii(docs, empty):
    assert {r.doc_id: len(r.spans) for r in pii.find_pii(docs).collect()}[1] == 0
    assert pii.find_pii(empty).count() == 0


def test_long_chunks_without_a_blank():
    import time

    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    ours, model = sentence_pieces.PieceEncoder(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = np.random.default_rng(6)
    for n in (63, 64, 65, 66, 3000, 200_000):
        text = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzé漢☃"), n))
        began = time.time()
        assert np.frombuffer(ours.encode([text])[0], dtype="<u4").tolist() == model.encode(text)
        assert time.time() - began < 10


def test_links_are_resolved(spark):
    links = {1: "//bad.net/x", 2: "/x", 3: "sub/x?a=1&amp;b=2", 4: "mailto:a@b.net", 5: "https://bad.net/x", 6: "?q=1"}
    rows = [(i, f"http://one{i}.io/d/p", f'<link rel="canonical" href="{x}">') for i, x in links.items()] + [(10, "https://bad.net/x", "<p>" * 100_000), (11, "http://one2.io/x", None), (12, "http://one3.io/d/sub/x?b=2&a=1", None), (1, "http://one1.io/d/p", None), (13, "http://x.io/" + "y" * 50_000, "")]
    moved = spark.createDataFrame([("http://one3.io/d/sub/x?a=1&b=2", "http://bad.net/x"), ("http://one2.io/x", "http://bad.net/")], "source string, target string")
    got = {(r.page_id, r.host): r.verdict for r in url_blocks.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES, moved).collect()}
    assert {k[0]: v for k, v in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "allow", 10: "block", 11: "block", 12: "block", 13: "allow"}


def test_pii_spans_and_redaction(spark):
    text = "é a@b.c_x@d.ee 1.2.3.4.5 999.1.1.1; +49 (30) 1234567; 4111 1111 1111 1111"
    row = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string"), keep=["text"])
    got = row.withColumn("clean", pii.redact(F.col("text"), F.filter("spans", lambda s: s["base"]))).first()
    base = [(s.kind, text[s.start : s.end]) for s in got.spans if s.base]
    assert base == [("email", "a@b.c"), ("email", "_x@d.ee"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+49 (30) 1234567")]
    assert got.clean.startswith("é [EMAIL][EMAIL] [IP].5 999.1.1.1")


def test_pii_base_of_random_texts(spark):
    """Texts rich in zero parts, runs of digits and adjacent matches, against the contract's patterns."""
    from .test_contracts import base_spans

    rng = np.random.default_rng(4)
    bits = ["0", "00", "10", "127", "255", "256", ".", ".", "1.2.3.4", "0.0.0.0", " ", "-", "+", "+49 30", "(", ")", "4111 1111 1111 1111", "4111111111111111", "a@b.c", "@", "x", "é", "\n", "7", "1234567"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 25))) for _ in range(1200)] + ["10.0.0.1 127.0.0.1", "8.8.8.8,8.8.8.8", "001.002.003.004", None, ""]
    rows = pii.find_pii(spark.createDataFrame(list(enumerate(texts)) * 2, "doc_id long, text string")).collect()
    assert len(rows) == 2 * len(texts)
    for r in rows:
        assert [f"{x.kind}:{x.start}:{x.end}" for x in r.spans if x.base] == base_spans(texts[r.doc_id])


def test_long_runs_do_not_overflow(spark):
    text = "1 " * 50_000 + "a" * 200_000 + "@" + "x." * 50_000
    assert pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans is not None


def test_near_duplicates(spark, docs, empty):
    got = near_dups.near_duplicates(docs).collect()
    assert len(got) == len(ROWS) and all(r.kept for r in got)
    assert {r.doc_id: r.n_shingles for r in got} == {1: 0, 2: 0, 3: 0, 4: 1, None: 1, 5: 1, 6: 3}
    assert near_dups.near_duplicates(empty).count() == 0


def test_near_duplicates_of_a_large_group(spark):
    """A base, copies with one to four changed words, and a chain, against all pairs."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        words = list(base)
        for at in rng.integers(0, 120, 1 + i % 4):
            words[at] = f"x{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(words)))
    chain = [f"c{i}" for i in range(100)]
    for i in range(150, 170):
        chain[(i * 6) % 100] = f"d{i}"
        rows.append((i, " ".join(chain)))
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert got == {i: find(i) for i in sets}


def test_near_duplicates_of_repeated_rows(spark):
    """Copies alike to a base only, which isn't the first centre: every row twice, or every id with a further text; against all pairs."""
    rows = []
    for g, further in enumerate((False, True)):
        words = [f"g{g}w{i}" for i in range(200)]
        for k in range(90):
            changed = [f"g{g}x{k}y{i}" if i in (6 + k % 60, 70 + (k + k // 60 * 13) % 60, 134 + k % 60) else w for i, w in enumerate(words)]
            rows.append((100 * g + k, " ".join(changed)))
            rows.append((100 * g + k, " ".join(f"g{g}o{k}y{i}" for i in range(24)) if further else rows[-1][1]))
        rows += [(100 * g + 95, " ".join(words))] * 2
    sets = {}
    for i, t in rows:
        w = t.split()
        sets.setdefault(i, set()).add(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)))
    linked = {(a, b) for a in sets for b in sets if a < b and any(100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b])}
    assert linked == {(100 * g + k, 100 * g + 95) for g in range(2) for k in range(90)}
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == {i: i // 100 * 100 for i in sets}


def test_pipeline_removes_copies_above_four_fifths(spark):
    """Bases of 200 words, copies with four scattered changed words (Jaccard 0.81) and with six (0.73), against all pairs."""
    import corpus_pipeline

    rows = []
    for g in range(8):
        words = [f"g{g}w{i}" for i in range(200)]
        for k, n in enumerate((0, 4, 6)):
            changed = [f"g{g}x{k}y{i}" if i % 33 == 10 and i // 33 < n else w for i, w in enumerate(words)]
            rows.append((10 * g + k, " ".join(changed), "en", "x", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sets = {r[0]: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for r in rows for w in [r[1].split()]}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(0.80 < alike(10 * g, 10 * g + 1) < 0.85 for g in range(8))
    want = {b for b in sets if not any(a < b and alike(a, b) >= 0.8 for a in sets)}
    assert {r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()} == want


def test_near_duplicates_whatever_counts_as_rare(spark, monkeypatch):
    """How many owners make a shingle rare changes the way pairs are found, not which are linked."""
    rng = np.random.default_rng(8)
    rows = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(80)]
        for i in range(70):
            words = list(base)
            for at in rng.integers(0, 80, i % 6):
                words[at] = f"g{g}x{rng.integers(0, 30)}"
            rows.append((100 * g + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for rare in (0, 2, 16, 1000):
        monkeypatch.setattr(near_dups, "RARE", rare)
        found.append({r.doc_id: r.component_id for r in near_dups.near_duplicates(df).collect()})
    assert all(x == found[0] for x in found)


def test_pipeline_edges(spark):
    """Nulls, repeated ids and an empty table through the stages that filter and change documents."""
    import corpus_pipeline

    texts = [None, "", "word " * 30, *[" ".join(f"w{i}n{k}" for i in range(40)) for k in range(12)]]
    rows = [(i, t, "en" if i % 3 else None, None, 1) for i, t in enumerate(texts)] + [(None, texts[5] + " more", "en", "x", 1), (7, texts[7], "en", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{shared_dir(spark)}/edge/labels.parquet")
    sf = f"{shared_dir(spark)}/edge"
    for part, n in ((docs, None), (docs.limit(0), 0)):
        for name, step in corpus_pipeline.STAGES:
            part = step(spark, part, sf)
            assert n is None or part.count() == n
            if name != "packing":
                assert part.columns == list(corpus_pipeline.COLUMNS)
        assert n is not None or {r.doc_id for r in part.collect()} >= {3, 4, 7}


def test_components(spark):
    rows = [(3, 2), (2, 1), (9, 8), (7, 8), (5, 5), (1, 3), (None, 4)] + [(i, i + 1) for i in range(20, 60)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {i: 20 for i in range(20, 61)}
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-20, 20, (300, 8)).astype(float)
    x[100:140] = x[100]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist()), (900, None), (901, [None] * 8), (902, [float("nan")] * 8), (903, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>").withColumn("score", F.lit("x"))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in pivot_search.top_k(df, F.col("vec_id") % 20 == 0, k=5, pivots=6, block=32, blocks_per_shard=2).collect())
    x = np.vstack([x, x[0], [1.0] + [0.0] * 7])
    ids = np.array([*range(300), 0, 903])  # id 0 twice: each is a query and the other one's candidate
    want = []
    for q in [*range(0, 300, 20), 300]:
        s = x @ x[q]
        best = [i for i in np.lexsort((ids, -s)) if i != q][:5]
        want += [(ids[q], k + 1, ids[i], s[i]) for k, i in enumerate(best)]
    assert got == sorted(want)
    assert pivot_search.top_k(df.limit(0), F.lit(True)).count() == 0


RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def test_urls(spark):
    link = '<html><link rel="canonical" href="https://bad.net/x"></html>'
    rows = [(1, None, None), (2, "nothing", None), (3, "http://a.b.NET/x", None), (4, "http://www.example.net/en/1?q#f", None), (5, "http://net", None), (6, "http://xnet/", None), (7, "https://clean.io/p", link), (8, "http://www.clean.io/p/#top", None), (9, "https://q.org/fr/1", link), (10, "://h?x/y", None)]
    df = spark.createDataFrame([(*r, "z") for r in rows] + [(11, "https://bad.net/x", "", "z")], "page_id long, url string, html string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_blocks.judge_urls(df, RULES).collect()}
    assert got[1] == ("", "", None, "allow") and got[2] == ("", "", None, "allow")
    assert got[3] == ("a.b.net", "/x", "net/", "block") and got[4] == ("www.example.net", "/en/1", "example.net/en/", "allow")
    assert got[5] == ("net", "", None, "allow") and got[6][2] is None and got[10] == ("h", "", None, "allow")
    assert got[7][3] == "block" and got[8][3] == "block" and got[9][3] == "allow"
    assert url_blocks.judge_urls(df.limit(0), RULES).count() == 0
    moved = spark.createDataFrame([("http://one.io/", "http://two.io/"), ("http://two.io/", "http://bad.net/")], "source string, target string")
    pages = spark.createDataFrame([(1, "http://one.io", ""), (2, "http://bad.net/", "")], "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in url_blocks.judge_urls(pages, RULES, moved).collect()} == {1: "block", 2: "block"}


@pytest.mark.parametrize("html,base,targets", [
    ('<link rel="alternate canonical" href="x">', None, ["x"]),
    ("<LINK href='../y' REL = canonical >", None, ["../y"]),
    ("<link rel=canonicals href=z><link data-rel='canonical' href=no>", None, []),
    ("<base target=_top><base href='/q/'><base href='/r/'><link rel='canonical' href='a>b'>", "/q/", ["a>b"]),
    ('<meta http-equiv="Refresh" content="0; url=\'/n\'"><meta http-equiv=refresh content=5;URL=m>', None, ["/n", "m"]),
    ("", None, []),
])
def test_links_of_pages(spark, html, base, targets):
    row = spark.createDataFrame([(html,)], "h string").select(url_blocks.links_of(F.col("h")).alias("l")).first().l
    assert (row.base, row.targets) == (base, targets)


@pytest.mark.parametrize("page,link,want", [
    ("http://one.io/a/b/c", "../x", "http://one.io/a/x"), ("http://one.io/a/b/c", "../../../x", "http://one.io/x"), ("http://one.io/a/b/c", "./x/./y/..", "http://one.io/a/b/x/"),
    ("http://one.io", "x", "http://one.io/x"), ("http://one.io/a/b/", "..", "http://one.io/a/"), ("http://one.io/a/b/", "../..", "http://one.io/"),
    ("http://u:p@one.io:8080/a/b", "/c/../d?q=../z#../y", "http://u:p@one.io:8080/d?q=../z#../y"), ("https://one.io/a", "//two.io/b/../c", "https://two.io/c"),
    ("http://one.io/a", "mailto:x", None), ("http://one.io/a?x=/../y", "z", "http://one.io/z"), ("http://one.io/a/.hidden/b", "c..d", "http://one.io/a/.hidden/c..d"),
])
def test_addresses_are_resolved(spark, page, link, want):
    assert spark.createDataFrame([(page, link)], "p string, l string").select(url_blocks.resolve(F.col("p"), F.col("l")).alias("r")).first().r == want


def test_blocks_follow_every_kind_of_link(spark):
    """Pages whose canonical address lies in a blocked folder, by each way of naming it."""
    rules = {"one.io/a/bad/": "block", "one.io/ok/": "allow"}
    pages = [
        (1, "http://one.io/a/b/c", "<link rel='alternate canonical' href='../bad/x'>"), (2, "http://one.io/z", "<base href='http://one.io/a/b/'><link rel=canonical href='../bad/y'>"),
        (3, "http://one.io/y", "<link rel='canonical' href='/a/q/../bad/z'><link rel=stylesheet href='/s'>"), (4, "http://one.io/w", "<meta http-equiv=refresh content='0; url=/a/./bad/w'>"),
        (5, "http://one.io/v", "<link rel=canonical href='/a/bad/../v2'>"), (6, "http://one.io/ok/1", "<link rel=canonical href='/a/bad/1'>"), (7, "http://one.io/s", None),
    ]
    got = {r.page_id: r.verdict for r in url_blocks.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow"}
