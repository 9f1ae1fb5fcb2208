"""Whitening, spelling variants and word BPE against brute force and the library."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from waymark.llm import queries, spelling, whitening, word_bpe

SMALL = "/root/testdata/sf0.001"

# whitening


def test_scatter_is_exact():
    rng = np.random.default_rng(1)
    for low, high, shape in ((-50, 50, (1000, 17)), (0, 1, (3, 4)), (-(2**46), 2**46, (130, 5)), (7, 8, (65, 2))):
        x = rng.integers(low, high, shape)
        sums, cross = whitening.scatter(x)
        exact = x.astype(object)
        assert (sums == exact.sum(0)).all() and (cross == exact.T @ exact).all()


def exact_model(vectors):
    """Covariance of the integers, from a matrix product of Python integers."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], object)
    n, total = len(x), x.sum(0)
    centred = n * (x.T @ x) - np.multiply.outer(total, total)
    return x, n, total, (centred / (n * n)).astype(float)


def check_components(got, vectors, components):
    x, n, total, covariance = exact_model(vectors)
    values, axes = np.linalg.eigh(covariance)
    by_row = {}
    for r in got:
        by_row.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(by_row) == list(range(len(vectors)))
    for i, rows in by_row.items():
        assert sorted(rows) == list(range(1, components + 1))
        deviation = n * x[i] - total
        for c, r in rows.items():
            want = float((deviation / n).astype(float) @ axes[:, -c]) / values[-c] ** 0.5
            assert r.n == n and r.deviation == sum(deviation**2)
            assert abs(abs(r.whitened) - abs(want)) < 1e-8
            assert abs(r.explained - values[-c] / np.trace(covariance)) < 1e-9 and r.identity_error < 1e-6


def component_rows(df, components=32):
    model = whitening.fit_whitening(df, components=components)
    return whitening.component_rows(whitening.whiten(df, model), model, "vec_id").collect()


def test_components_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(300, 6)) * [1, 2, 3, 4, 5, 6]).astype(np.float32).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<float>").repartition(5)
    check_components(component_rows(df, 4), vectors, 4)


def test_whole_embedding_table(spark):
    got = queries.op11(spark, SMALL).collect()
    table = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    check_components(got, [table[i] for i in sorted(table)], 32)


def test_broken_vectors_and_other_lengths_go(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 9.0), (1, None, 9.0), (2, [1.0, None], None), (3, [nan, 1.0], 1.0), (4, [1.0, -inf], 1.0), (5, [], 1.0)]
    rows += [(6, [3.0, 1.0], 1.0), (6, [3.0, 1.0], 1.0), (None, [2.0, 5.0], 1.0), (7, [1.0, 2.0, 3.0], 1.0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, whitened double")
    model = whitening.fit_whitening(df)
    assert model.n == 4 and len(model.values) == 2
    got = whitening.whiten(df, model).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == [(False, 0), (False, 6), (False, 6), (True, 0)]
    cov = np.cov(np.array([r.whitened for r in got]).T, bias=True)
    assert np.abs(cov - np.eye(2)).max() < 1e-9


def test_equal_vectors_and_no_vectors(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], "vec_id bigint, embedding array<float>")
    assert [(r.whitened, r.explained, r.identity_error, r.deviation) for r in component_rows(same)] == [(None, None, None, 0)] * 6
    # a dimension that never changes has a component without variance
    flat = spark.createDataFrame([(i, [float(i), 2.0]) for i in range(4)], "vec_id bigint, embedding array<float>")
    assert {(r.component, r.whitened is None) for r in component_rows(flat)} == {(1, False), (2, True)}
    assert component_rows(same.limit(0)) == []


def test_large_entries_stay_exact_or_fail(spark):
    rows = [(0, [2.0**30, 0.0]), (1, [-(2.0**30), 1.0]), (2, [5.0, 2.0])]
    with pytest.raises(Exception, match="does not fit"):
        component_rows(spark.createDataFrame([(i, [c * 4 for c in v]) for i, v in rows], "vec_id bigint, embedding array<double>"))
    small = [[c / 512 for c in v] for _, v in rows]
    df = spark.createDataFrame(list(enumerate(small)), "vec_id bigint, embedding array<double>")
    _, n, total, _ = exact_model(small)
    x = exact_model(small)[0]
    assert {r.vec_id: r.deviation for r in component_rows(df)} == {i: sum((n * x[i] - total) ** 2) for i in range(3)}


# spelling variants


def brute_variants(words):
    letters = sorted({c for w in words for c in w})
    form = {}
    for w in words:
        near = {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in ["", *letters]}
        near = (near & words.keys()) - {w}
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form[w] = (best if best is not None and words[best] >= 10 * words[w] else None, len(near))
    found = []
    for w, (f, near) in form.items():
        root = w
        while form[root][0] is not None:
            root = form[root][0]
        found.append((w, f, root, words[w], near, words.get(f)))
    return sorted(found, key=str)


def brute_words(rows):
    words = Counter()
    for doc_id, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            words[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in words.items() if len(w) >= 7 and n >= 2}


@pytest.fixture()
def several_parts(spark):
    """Sorted words spread over several parts, so that tries meet at the ends of parts."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_variants_equal_brute_force(spark, several_parts):
    rng = random.Random(7)
    words = Counter()
    for _ in range(2500):
        words["".join(rng.choice("aabéz") for _ in range(rng.randrange(1, 8)))] += rng.choice([1, 1, 30, 900])
    words |= {"a" * 200: 4, "a" * 199: 50, "z" * 199 + "a": 3, "z" * 200: 700, "z" * 198 + "b": 1}
    df = spark.createDataFrame([(w, n, "x") for w, n in words.items()] + [(None, 5, "x")], "word string, n int, root string")
    got = sorted((tuple(r) for r in spelling.spelling_variants(df).collect()), key=str)
    want = brute_variants(dict(words))
    assert got == want
    assert any(r[2] not in (r[0], r[1]) for r in want)  # chains of two forms are met


def test_whole_documents_table_of_words(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op12(spark, SMALL).collect()), key=str)
    assert got == brute_variants(brute_words(docs))


def test_words_of_odd_texts(spark):
    rows = [(1, "ÀBCDEFG Àbcdefg"), (1, "ÀBCDEFG Àbcdefg"), (None, "Strasse×÷ strasse"), (2, None), (3, ""), (4, " \n1"), (5, "short"), (6, "é" * 50_000), (7, "é" * 50_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, n string")
    got = {r.word: r.n for r in spelling.varied_words(df).collect()}
    assert got == brute_words(rows) and max(map(len, got)) >= 49_999
    assert spelling.spelling_variants(spelling.varied_words(df.limit(0))).collect() == []


def test_no_group_of_the_dictionary_exceeds_the_alphabet(spark):
    words = [(f"wort{chr(97 + a)}{chr(97 + b)}ende", 2) for a in range(26) for b in range(26)]
    df = spark.createDataFrame(words, "word string, n bigint")
    ahead = spelling.numbered(df, "word").withColumnRenamed("nodes", "ahead")
    back = spelling.numbered(df.selectExpr("reverse(word) word"), "word").selectExpr("reverse(word) word", "nodes back")
    pairs = spelling.dictionary(df.join(ahead, "word").join(back, "word"))
    assert pairs.groupBy("prefix", "suffix").count().agg({"count": "max"}).first()[0] == 26
    near = spelling.neighbours(pairs).collect()
    assert len(near) == 676 and {r.n_near for r in near} == {50}


# word BPE


@pytest.fixture(scope="module")
def vocabulary():
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    return path, tokenizers.Tokenizer.from_file(path)


def test_ids_equal_the_library(vocabulary):
    path, library = vocabulary
    rng = random.Random(3)
    texts = ["", "'s 'LL x'd !'s I'm", "<|startoftext|>A<|endoftext|>b<|ENDOFTEXT|>", "ΑΣ ΑΣ. ΣΑΣ", "\x1c a\x85b\xa0 İÀ", "ȺȾ µ", "é É"]
    pools = [range(32, 127), range(0x20, 0x300), range(0x300, 0xD7FF), range(0xE000, 0x1FFFF), [10, 39, 9, 0x2028, 0x3A3, 0x130, 0x301]]
    for _ in range(2000):
        pool = rng.choice([pools, pools[:2], pools[:1]])
        texts.append("".join(chr(rng.choice(rng.choice(pool))) for _ in range(rng.randrange(1, 60))))
    encode = word_bpe.text_encoder(word_bpe.load_vocabulary(path), path)
    assert [encode(t) for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_scan_and_heap_merge_alike(vocabulary):
    spec = word_bpe.load_vocabulary(vocabulary[0])
    rng = random.Random(4)
    for _ in range(1500):
        parts = [spec["inner"][ord(rng.choice("aeinrst"))] for _ in range(rng.randrange(1, 70))]
        assert word_bpe.merge_scanned(parts[:], spec["ranks"], spec["merged"]) == word_bpe.merge_queued(parts[:], spec["ranks"], spec["merged"])


def test_a_megabyte_without_blanks(vocabulary):
    path, library = vocabulary
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(1 << 20))
    encode = word_bpe.text_encoder(word_bpe.load_vocabulary(path), path)
    started = time.monotonic()
    assert encode(text) == library.encode(text, add_special_tokens=False).ids
    assert time.monotonic() - started < 60


def test_round_trip_table(spark, vocabulary, monkeypatch):
    path, library = vocabulary
    monkeypatch.setattr(word_bpe, "SPELLED", 3)
    rows = [(1, "Hello, World's 123", "x"), (1, "Hello, World's 123", "x"), (2, None, None), (3, "", None), (None, " \t", None), (4, "tie " * 20_000, None), (5, "日本 été", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, decoded string")
    coded = word_bpe.encode_texts(df, path)
    got = word_bpe.decode_ids(coded, path).collect()
    want = [library.encode(t or "", add_special_tokens=False).ids for _, t, _ in rows]
    assert [(r.doc_id, r.ids) for r in got] == [(i, w) for (i, _, _), w in zip(rows, want)]
    assert [r.decoded for r in got] == [library.decode(w, skip_special_tokens=False) for w in want]
    assert word_bpe.decode_ids(word_bpe.encode_texts(df.limit(0), path), path).collect() == []
    odd = spark.createDataFrame([(1, [320, None, -1, 10**9, 49407]), (2, None), (3, [])], "doc_id bigint, ids array<int>")
    assert [r.decoded for r in word_bpe.decode_ids(odd, path).collect()] == ["a</w> <|endoftext|>", None, ""]


def test_whole_documents_table_of_ids(spark, vocabulary):
    _, library = vocabulary
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13(spark, SMALL).collect()}
    for doc_id, text in docs.items():
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in (" ".join(map(str, ids)), decoded)]
        assert got[doc_id] == (len(ids), *digests)
    assert len(got) == len(docs)
