"""Operators that look at all documents together: fingerprints, near duplicates, shards, mixing, lines, pipeline."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from run_checks import compare, database
from waymark.llm import common, components, fingerprints, line_dedup, mixing, near_dedup, queries, sharding, shingles

DOCS = "doc_id bigint, text string, source string, size string, shard string, _key string"
LONG = " ".join(f"word{i % 9973}" for i in range(40_000))


def _words(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (5, "one two three four five six", "a", "1", "2", "k"),
        (5, "one two three four five six", "a", "1", "2", "k"),
        (5, "another text under the same id", "b", None, None, None),
        (1, None, None, None, None, None),
        (2, "", "b", None, None, None),
        (None, "no id at all", "a", None, None, None),
        (None, None, None, None, None, None),
        (-3, LONG, "a", None, None, None),
        (9, " \n\t ", "", None, None, None),
        (10, "one two three four five six", "c", None, None, None),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# shingles and fingerprints


def test_shingles_are_weighted_runs_of_five_words():
    rng = random.Random(1)
    for n in (0, 1, 4, 5, 6, 200, shingles.SEGMENT + 3, 2 * shingles.SEGMENT + 9):
        words = [rng.choice("abcd") * rng.randrange(1, 3) for _ in range(n)]
        size = min(5, n)
        want = collections.Counter(tuple(words[i : i + size]) for i in range(n - size + 1)) if n else {}
        hashes, counts = shingles.shingles(" \n".join(words))
        assert len(hashes) == len(want) and sorted(counts.tolist()) == sorted(want.values())
    assert shingles.similarity(shingles.shingles("a b c d e f"), shingles.shingles("a b c d e f")) == 1.0
    assert shingles.similarity(shingles.shingles(None), shingles.shingles("")) == 1.0


def test_consistent_weighted_samples_estimate_similarity(spark):
    rng = random.Random(2)
    base = _words(rng, 60) * 2 + _words(rng, 200)
    texts = [" ".join(base), " ".join(base[:240] + _words(rng, 80)), " ".join(base[60:] + base[60:120])]
    frame = spark.createDataFrame([(i, t, texts[0]) for i, t in enumerate(texts)], "id int, body string, other string")
    rows = fingerprints.signatures(frame, ["id"], "body", "other", 256).collect()
    sig = {r.id: np.array(r.s) for r in rows}
    assert all((np.array(r.e) == sig[0]).all() for r in rows)
    for a, b in ((0, 1), (0, 2), (1, 2)):
        true = shingles.similarity(shingles.shingles(texts[a]), shingles.shingles(texts[b]))
        assert abs((sig[a] == sig[b]).mean() - true) < 4 * (true * (1 - true) / 256) ** 0.5 + 0.01


def test_edited_texts_and_hashes(spark):
    rng = random.Random(4)
    texts = {i: " ".join(_words(rng, rng.randrange(0, 90))) for i in range(0, 60, 3)} | {7: "é" * 9, 8: "", 100: None, 101: "abc"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(frame).collect()}
    ids = sorted(texts)
    for i, j in zip(ids, ids[1:] + ids[:1]):
        text, after = texts[i] or "", texts[j] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        assert (got[i].near_next == 1) if text == after else True
    assert got[8].fingerprint == got[100].fingerprint != got[101].fingerprint


def test_fingerprints_of_odd_tables(spark, odd, none):
    rows = fingerprints.fingerprint_documents(odd).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in odd.collect())
    same = {r.fingerprint for r in rows if r.doc_id == 10} | {r.fingerprint for r in rows if r.doc_id == 5}
    assert len(same) == 2
    assert fingerprints.fingerprint_documents(none).collect() == []
    one = fingerprints.fingerprint_documents(spark.createDataFrame([(1, "only one here")], "doc_id bigint, text string")).collect()
    assert one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"only one honl").hexdigest()


def test_fingerprints_run_in_the_jvm(odd):
    plan = fingerprints.fingerprint_documents(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# near duplicates


def _classes(texts, threshold=0.8):
    ids = list(texts)
    sets = {i: shingles.shingles(texts[i]) for i in ids}
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (texts[i] or "") == (texts[j] or "") or len(sets[i][0]) and shingles.similarity(sets[i], sets[j]) >= threshold:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in ids}


def test_dart_signatures_estimate_similarity():
    rng = random.Random(6)
    base = _words(rng, 40) * 3 + _words(rng, 300)
    errors = []
    for cut in (5, 20, 60, 150):
        a, b = shingles.shingles(" ".join(base)), shingles.shingles(" ".join(base[cut:] + _words(rng, cut)))
        k = 2000
        agree = (near_dedup.signature(a, k) == near_dedup.signature(b, k)).mean()
        errors.append(abs(agree - shingles.similarity(a, b)))
    assert max(errors) < 0.045


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(8)
    texts = {}
    for family in range(12):
        base = _words(rng, rng.choice([3, 30, 150, 600]))
        for copy in range(rng.choice([1, 2, 6, 15])):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 5])):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            texts[len(texts) * 7 + 3] = " ".join(words)
        if len(base) > 100:  # a chain: each differs a little from the one before
            for _ in range(6):
                at = rng.randrange(len(base) - 4)
                base[at : at + 3] = [f"c{rng.randrange(10**6)}" for _ in range(3)]
                texts[len(texts) * 7 + 3] = " ".join(base)
    texts |= {1: None, 2: "", 4: "same", 5: "same", 6: "  "}
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(frame).collect()}
    assert got == _classes(texts)


def test_near_duplicates_of_odd_tables(odd, none):
    rows = near_dedup.near_duplicates(odd).collect()
    assert len(rows) == 10
    classes = collections.defaultdict(set)
    for r in rows:
        classes[r.class_id].add(r.doc_id)
    assert {5, 10} in classes.values() and {1, 2, None} in classes.values()
    assert near_dedup.near_duplicates(none).collect() == []
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(classes)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 60)] + [(70, 70), (71, 72), (72, 71)]
    got = dict(components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(1, 60)} == {1} and got[72] == 71


# shards


def _jump(key, shards):
    key %= 1 << 64
    at, after = -1, 0
    while after < shards:
        at = after
        key = (key * sharding.MULTIPLIER + 1) % (1 << 64)
        after = int(float(at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def test_jump_hash_equals_its_definition(spark):
    keys = [0, 1, 2, -1, 2**63 - 1, -(2**63), *random.Random(9).sample(range(2**62), 500)]
    frame = spark.createDataFrame([(k,) for k in keys], "k bigint")
    for n in (1, 2, 16, 17, 100):
        got = {r.k: r.s for r in frame.select("k", sharding.jump_shard(F.col("k"), n).alias("s")).collect()}
        assert got == {k: _jump(k, n) for k in keys}


def test_shards_of_odd_tables(odd, none, spark):
    import zlib

    rows = sharding.shard_documents(odd).collect()
    assert len(rows) == 10
    for r in rows:
        assert r.shard == _jump(r.doc_id or 0, 16) and r.grown_shard in (r.shard, 16)
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted(
        (len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd.collect()
    )
    many = sharding.shard_documents(spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")))
    slots = collections.defaultdict(list)
    for r in many.collect():
        slots[r.shard].append(r.slot)
    assert len(slots) == 16 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(none).collect() == []


def test_positions_in_a_hot_group(spark):
    frame = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").alias("g"), (F.col("id") % 5).alias("v"))
    got = common.placed(frame, ["g"], ["doc_id"], F.col("v"), "before", 1, blocks=16).collect()
    for group in ("hot", None):
        rows = sorted((r for r in got if r.g == group), key=lambda r: (r.before, r.v == 0))
        total = 0
        for r in sorted(rows, key=lambda r: hashlib.md5(f"1:{r.doc_id}".encode()).hexdigest()):
            assert r.before == total
            total += r.v


# mixing


def _targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(2 * sizes[s] for s in capped)
        target = {s: 2.0 * sizes[s] if s in capped else rest * weight[s] / sum(weight[f] for f in free) for s in names}
        above = {s for s in free if target[s] > 2 * sizes[s]}
        if not above:
            return target
        capped |= above


def _highest_quotients(targets, blocks):
    seats = dict.fromkeys(targets, 0)
    for _ in range(blocks):
        best = max(targets, key=lambda s: targets[s] / (2 * seats[s] + 1))
        seats[best] += 1
    return seats


@pytest.fixture(scope="module")
def sources(spark):
    rng = random.Random(12)
    rows = []
    for i in range(900):
        source = rng.choice(["a", "a", "a", "b", "c", "Z", "é", None, "tiny"] if i % 50 else ["tiny"])
        rows.append((i, " ".join(_words(rng, rng.randrange(0, 60))), source))
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)


def test_mix_meets_the_targets(sources):
    rows = mixing.mix_sources(sources).collect()
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    want = _targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(want[s], 1)
        assert abs(taken[s] - target[s]) <= mixing.BLOCK_WORDS
    again = mixing.mix_sources(sources.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_small_mixes_stay_near_their_targets(spark, tmp_path):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(60, "a"), (40, "a"), (10, "b")])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    taken = collections.Counter()
    for r in mixing.mix_sources(docs).collect():
        taken[r.source] += r.taken
    assert abs(taken["a"] - 145) <= 10 and abs(taken["b"] - 20) <= 10
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = database(str(tmp_path))
    assert compare(queries.op7(spark, str(tmp_path)), con, queries.OP7_SQL).startswith("ok")


def test_quotas_are_those_of_the_highest_quotients(spark):
    targets = {"a": 5000.0, "b": 1234.5, "c": 77.0, "d": 3.0, None: 900.0, "e": 0.0}
    frame = spark.createDataFrame([(s, 1000, t) for s, t in targets.items()], "source string, source_size bigint, target double")
    got = mixing.block_quotas(frame, shards=4, block_words=16).collect()
    blocks = round(sum(targets.values()) / 16)
    held = collections.Counter()
    for k in range(4):
        for r in got:
            if r.shard == k:
                assert r.quota >= 0
                held[r.source] += r.quota
        want = _highest_quotients({s: t for s, t in targets.items() if t}, (k + 1) * blocks // 4)
        assert {s: n for s, n in held.items() if n} == {s: n for s, n in want.items() if n}


def test_mixed_documents_are_whole(sources):
    docs = sources.withColumn("n_chars", F.length("text").cast("long"))
    plan = mixing.mix_sources(docs).collect()
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    whole = {tuple(r) for r in docs.collect()}
    got = mixed.collect()
    assert all(tuple(r) in whole for r in got)
    times = collections.Counter(r.doc_id for r in got)
    assert times == collections.Counter({r.doc_id: n for r in plan if r.size and (n := int(r.taken / r.size + 0.5))})
    assert sorted(mixing.mixed_documents(docs.repartition(5)).collect()) == sorted(got)
    for source in {r.source for r in plan}:
        own = [r for r in plan if r.source == source]
        assert sum(0 < r.taken % r.size for r in own if r.size) <= 1
        assert abs(sum(r.size * times[r.doc_id] for r in own) - sum(r.taken for r in own)) <= max(r.size for r in own) / 2


def test_mixed_documents_move_no_text(spark, sources, monkeypatch):
    written = []

    def noted(df, label, *by):
        written.extend(df.columns)
        return landed(df, label, *by)

    landed = mixing.landed
    monkeypatch.setattr(mixing, "landed", noted)
    mixed = mixing.mixed_documents(sources)
    assert "text" not in written
    assert "hashpartitioning" not in mixed._jdf.queryExecution().executedPlan().toString()


def test_mixed_documents_count_equal_rows(spark):
    # the quota of each source ends among rows that are alike in all columns
    cells = [(1, "a b c", "x")] * 40 + [(None, "d e", "y")] * 30 + [(2, "a b c", "z"), (2, "c b a", "z"), (2, None, "z")] * 9
    docs = spark.createDataFrame(cells, "doc_id long, text string, source string")
    plan, got = mixing.mix_sources(docs).collect(), mixing.mixed_documents(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed_documents(docs.repartition(7)).collect()))
    for source in "xyz":
        want = sum(int(r.taken / r.size + 0.5) for r in plan if r.source == source and r.size)
        assert sum(r.source == source for r in got) == want
    whole = collections.Counter(map(tuple, docs.collect()))
    assert all(n <= 2 * whole[r] for r, n in collections.Counter(map(tuple, got)).items())


def test_mixing_odd_tables(odd, none):
    rows = mixing.mix_sources(odd).collect()
    assert len(rows) == 10 and sum(r.size for r in rows) == sum(len((r.text or "").split()) for r in odd.collect())
    assert mixing.mix_sources(none).collect() == []
    assert mixing.mixed_documents(none).collect() == []
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    got, whole = collections.Counter(map(str, mixed.collect())), collections.Counter(map(str, odd.collect()))
    assert all(n <= 2 * whole[r] for r, n in got.items())
    for source in {r.source for r in rows}:
        words = sum(len(r.text.split()) for r in mixed.collect() if r.source == source)
        own = [r for r in rows if r.source == source]
        assert abs(words - sum(r.taken for r in own)) <= max(r.size for r in own) / 2


# lines


def _kept(docs, least=3, chars=20):
    """docs: (id, text) rows."""
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line))

    holders = collections.defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            holders[key(line)].add(-(2**63) if i is None else i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        gone = lambda l: len(key(l)) >= chars and len(holders[key(l)]) >= least and (i is None or i < max(holders[key(l)]))  # noqa: E731, B023
        stay = [l for l in lines if not gone(l)]
        out.append((str(i), len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out)


@pytest.mark.parametrize("batches, fanout", [(1, 2), (5, 2), (4, 4)])
def test_lines_equal_brute_force(spark, batches, fanout):
    rng = random.Random(13)
    pool = [f"  Line number {i} ÀÉ of the POOL " + "x" * (i % 3) for i in range(12)] + ["short", "", "\tnineteen characters"]
    docs = [(i, "\n".join(rng.choice(pool) + rng.choice(["", " ", "\r"]) for _ in range(rng.randrange(12)))) for i in range(40)]
    docs += [(50, None), (51, ""), (None, pool[0] + "\n" + pool[1]), (None, pool[0]), (7, pool[0]), (7, pool[0]), (60, "\n".join(pool) + "\n" + LONG)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = line_dedup.dedup_lines(frame, batches=batches, fanout=fanout).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept) for r in got) == _kept(docs)


def test_runs_are_compacted_and_new_lines_found(spark):
    runs = line_dedup.LevelledRuns(spark, fanout=2)
    seen = set()
    for batch in range(5):
        lines = [(f"line {i}".encode(), batch * 10 + i % 3) for i in range(batch, batch + 6)]
        frame = spark.createDataFrame(lines, "line binary, doc bigint")
        new = {bytes(r.line) for r in runs.add_new(frame).collect()}
        assert new == {l for l, _ in lines} - seen
        seen |= {l for l, _ in lines}
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    digest = {bytes(r.line): r.n_docs for r in runs.digest().collect()}
    assert digest[b"line 4"] == 5 and digest[b"line 0"] == 1
    assert line_dedup.LevelledRuns(spark).digest().collect() == []


def test_lines_of_odd_tables(odd, none):
    rows = line_dedup.dedup_lines(odd).collect()
    assert len(rows) == 10 and sum(r.n_dropped for r in rows) == 0
    assert line_dedup.dedup_lines(none).collect() == []
