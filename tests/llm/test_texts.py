"""Operators that look at one text at a time: token counts, quality, toxicity, decontamination, pages."""

import hashlib
import random
import re
import time
import zlib
from pathlib import Path

import pytest

from waymark.llm import decontaminate, html_extraction, learning, quality, token_counts, toxicity

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
DOCS = "doc_id bigint, text string, score string, n_words string, items string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, columns with clashing names."""
    rows = [
        (1, "an idiot wrote this stupid text", "x", "y", "z"),
        (1, "an idiot wrote this stupid text", "x", "y", "z"),
        (2, None, None, None, None),
        (3, "", None, None, None),
        (None, "no id here", None, None, None),
        (4, LONG, None, None, None),
        (5, " \t\n ", None, None, None),
        (6, "tie", None, None, None),
        (7, "tie", None, None, None),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2, "extra") for i in range(1, 40)] + [(None, 1, 1, None), (3, None, None, None), (4, 7, 7, "")]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int, text string")


# token counts


@pytest.fixture(scope="module")
def vocabulary():
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    return path, tokenizers.Tokenizer.from_file(path)


def test_counts_equal_the_library_on_odd_texts(vocabulary):
    path, library = vocabulary
    rng = random.Random(3)
    texts = ["", "a" * 5000, "aaa aaaa", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "\x1c a\x85b\xa0 c", "  \n\n  x", "I'LL we've 's ''s", LONG[:20000]]
    pools = [range(32, 127), range(0x20, 0x300), range(0x300, 0xD7FF), range(0xE000, 0x1FFFF), [10, 32, 39, 9, 0x2028, 0x3000]]
    for _ in range(1500):
        texts.append("".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.randrange(1, 40))))
    count = token_counts.text_counter(token_counts.load_merges(path))
    assert count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_long_pretokens_in_time(vocabulary):
    """Runs without a blank, cut or not, are counted as the library does, and a megabyte in seconds."""
    path, library = vocabulary
    draw = random.Random(3)
    texts = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)), "a" * 100_001, "-=" * 40_000, "the" * 30_000]
    texts += ["".join(draw.choices(letters, k=draw.randrange(500, 1500))) for letters in ("ab", "etao", "=-*", "éa", "日本x") * 60]
    count = token_counts.text_counter(token_counts.load_merges(path))
    start = time.process_time()
    found = count(texts)
    assert time.process_time() - start < 20
    assert found == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_token_table(vocabulary, odd, none):
    path, library = vocabulary
    got = token_counts.count_tokens(odd.select("doc_id", "text"), path, limit=5).collect()
    texts = [r["text"] or "" for r in odd.collect()]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [(r.n_bytes, r.n_tokens, r.over_limit) for r in got] == [(len(t.encode()), n, n > 5) for t, n in zip(texts, want)]
    assert token_counts.count_tokens(none, path).collect() == []


def test_overlapping_pairs_merge_from_the_left():
    merges = {"keys": [0], "ranks": [0], "merged": [256], "width": 1000}
    import numpy as np

    code = ord("a")
    first = np.full(65536, token_counts.NO_RANK, np.int32)
    first[code * 256 + code] = 0
    merges = {"keys": np.array([code * 1000 + code]), "ranks": np.array([0], np.int32), "merged": np.array([300], np.int32),
              "bytes": np.arange(256), "first": first, "width": 1000}
    assert token_counts.count_symbols([b"a", b"aa", b"aaa", b"aaaaa", b"ba", b""], merges).tolist() == [1, 1, 2, 3, 2, 0]


# quality and toxicity


def _prose(rng, words):
    return " ".join(rng.choice(words) for _ in range(120))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    good = [f"{a}{b}ing" for a in "river mountain light garden paper window".split() for b in "abcdef"]
    bad = [f"{a}{b}!!!" for a in "CLICK BUY NOW WIN".split() for b in "ABCDEF"]
    docs, labels = [], []
    for i in range(300):
        text = _prose(rng, good if i % 2 else bad)
        if i % 3 == 0:
            words = text.split()
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vequine", "vequard", "vequlot"]))
            text = " ".join(words)
        docs.append((i, text))
        labels.append((i, i % 2, int(i % 3 == 0)))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_quality_of_held_out_texts(labelled):
    docs, labels = labelled
    scored = quality.score_quality(docs, quality.train_quality(docs, labels))
    rows = scored.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_stems_are_learned(labelled):
    docs, labels = labelled
    model = toxicity.train_toxicity(docs, labels)
    assert any(e.startswith(" vequ") for e in model["lexicon"])
    rows = toxicity.score_toxicity(docs, model).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert [r.doc_id for r in held if r.predicted != r.toxic] == []


def test_labels_of_the_held_out_fold_are_not_read(spark, labelled):
    docs, labels = labelled
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(learning.fold() == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train_toxicity(docs, labels)["lexicon"] == toxicity.train_toxicity(docs, turned)["lexicon"]


def test_folding_and_exceptions():
    match = toxicity.matcher({" idio": 2.0, " scum ": 1.0, " clow": 3.0}, ["clown fish"])
    for text in ("IDIOT", "1d1ot", "іdіоt", "i​diot", "ｉｄｉｏｔ", "an-idiot."):
        assert match(toxicity.folded(text))[0] == 2.0, text
    assert match(toxicity.folded("a clown fish"))[0] == 0
    assert match(toxicity.folded("a clown fished"))[0] == 3.0
    assert match(toxicity.folded("scumming"))[0] == 0
    assert toxicity.folded("") == "  "


@pytest.mark.parametrize("kind", ["quality", "toxicity"])
def test_scores_of_odd_tables(kind, odd, none, labels):
    train, score = (quality.train_quality, quality.score_quality) if kind == "quality" else (toxicity.train_toxicity, toxicity.score_toxicity)
    for model in (train(odd, labels), train(odd, labels.limit(0)), train(none, labels)):
        rows = score(odd.select("doc_id", "text"), model).collect()
        assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
        by = [r.score for r in rows]
        assert by[0] == by[1] and by[2] == by[3] and by[7] == by[8]
        assert score(none.select("doc_id", "text"), model).collect() == []


def test_clean_documents_keep_their_columns(odd, labels):
    kept = toxicity.keep_clean(odd, toxicity.train_toxicity(odd, labels.limit(0)))
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["2", "3", "None", "4", "5", "6", "7"])


# decontamination


def _brute(text, items, window=13):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = find(text), set(), set()
    for item, body in items:
        w = find(body)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add("null" if item is None else str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("pass_bytes", [1 << 20, 200])
def test_decontamination_equals_brute_force(spark, pass_bytes):
    rng = random.Random(11)
    vocabulary = ["a", "bé", "c3", "DE", "of", "the", "x"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 7, 13, 14, 20])))) for i in range(25)]
    items += [(3, "the same item again"), (None, "an item without id here"), (26, None), (27, "...")]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(40)]
    docs += [(90, f"start {items[8][1]} end, " * 2), (91, None), (92, ""), (93, "An Item; without id HERE"), (93, "An Item; without id HERE")]
    docs += [(94, LONG + " the same item again " + LONG)]
    got = decontaminate.decontaminate(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), pass_bytes=pass_bytes
    )
    rows = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect())
    assert rows == sorted((i, *_brute(t, items)) for i, t in docs)


def test_decontamination_of_odd_tables(spark, odd, none):
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert [r.contaminated for r in decontaminate.decontaminate(odd.select("doc_id", "text"), empty).collect()] == [False] * 9
    item = spark.createDataFrame([(1, "an idiot wrote this stupid text")], "item_id bigint, text string")
    assert decontaminate.decontaminate(none.select("doc_id", "text"), item).collect() == []
    kept = decontaminate.keep_uncontaminated(odd, item)
    assert kept.columns == odd.columns and kept.count() == 7


# pages

ARTICLE = "<h1>A title</h1><p>The first paragraph is long enough, with <b>bold</b> &amp; more.</p><p>The second\n one <a href=x>links</a> once.<p>Short."
TEXT = "A title\nThe first paragraph is long enough, with bold & more.\nThe second one links once.\nShort."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li><a>x</a><li>y</ul></nav><article>{ARTICLE}</article><footer>f</footer></body></html>",
        f"<body><div class='cookie-notice'><p>We use cookies on this long and dense notice, a lot.</p></div><div id=main-content>{ARTICLE}</div><div class=comments><p>{'A very long comment. ' * 40}</p></div>",
        f"<BODY><MAIN><header>{ARTICLE.split('<p>', 1)[0]}</header><p>{ARTICLE.split('<p>', 1)[1]}</MAIN><ASIDE><p>Side</ASIDE><form><p>Mail</form>",
        f"<div role=navigation><p>menu</p></div><div><script>var a='<p>no</p>'</script>{ARTICLE}<!-- <p>not this</p> --><div class='ad-slot'>Buy it</div></div>",
        f"<article class='post has-sidebar'>{ARTICLE}<div hidden>hidden</div>",
    ],
)
def test_pages(page):
    assert html_extraction.main_text(page) == TEXT


def test_sections_side_by_side_all_count():
    part = "<div>" + "".join(f"<p>Paragraph {i} of this part says some things about it.</p>" for i in range(3)) + "</div>"
    page = f"<body><div class=links><a href=1>one</a> <a href=2>two</a></div><div>{part}<h2>Between</h2>{part}</div></body>"
    assert html_extraction.main_text(page).count("Paragraph") == 6
    assert "Between" in html_extraction.main_text(page) and "one" not in html_extraction.main_text(page)


def test_odd_pages(spark):
    pages = [
        (1, "u", None, "k"), (2, None, "", None), (None, "u", "plain text, no tag", None), (3, "u", "a < b &copy c", None), (3, "u", "a < b &copy c", None),
        (4, "u", "<p>" * 5000 + "deep", None), (5, "u", "<div>" * 5000 + "deep", None), (6, "u", "<p>cut <a href=", None), (7, "u", "<script>", None),
        (8, "u", "<p>" + LONG + "</p>", None), (9, "u", "<p> &nbsp;</p>", None),
    ]
    got = html_extraction.extract_pages(spark.createDataFrame(pages, "page_id bigint, url string, html string, text string")).collect()
    want = ["", "", "plain text, no tag", "a < b © c", "a < b © c", "deep", "deep", "cut", "", LONG, ""]
    assert [r.text for r in got] == want and [r.n_chars for r in got] == [len(w) for w in want]
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert html_extraction.extract_pages(empty).collect() == []


def test_given_pages_follow_their_template(spark):
    path = Path("/root/testdata/sf0.01/pages.parquet")
    if not path.exists():
        pytest.skip("test tables absent")
    import html

    pages = spark.read.parquet(str(path))
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html_extraction.extract_pages(pages).collect():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", source[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", p)).split()) for p in re.split(r"</?(?:h1|p)>", body)]
        assert r.text == "\n".join(p for p in parts if p)
