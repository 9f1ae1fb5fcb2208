import random

from pyspark.sql import functions as F

from waymark.llm.near_dedup import near_duplicates, prefix_pairs
from waymark.llm.shingles import shingles, similarity


def test_near_duplicates_behind_a_template(spark):
    rng = random.Random(11)
    template = [f"t{i}" for i in range(174)]
    tails = [[f"u{p}x{i}" for i in range(24)] for p in range(500)]
    for p in range(0, 60, 2):  # pages 0 and 1, 2 and 3, ... share a few of their own words
        tails[p + 1] = tails[p][:3] + tails[p + 1][3:]
    texts = [" ".join(template + tail) for tail in tails]
    order = list(range(500))
    rng.shuffle(order)
    held = [shingles(t) for t in texts]
    assert 0.77 < similarity(held[0], held[70]) < 0.79 and 0.8 < similarity(held[0], held[1]) < 0.81
    linked = {(a, b) for a in range(500) for b in range(a + 1, 500) if similarity(held[a], held[b]) >= 0.8}
    assert linked == {(p, p + 1) for p in range(0, 60, 2)}
    docs = spark.createDataFrame([(i, texts[i]) for i in order], "doc_id bigint, text string")
    found = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    assert found == {i: i - 1 if i < 60 and i % 2 else i for i in range(500)}


def test_prefix_pairs_hold_all_similar_pairs(spark):
    rng = random.Random(12)
    texts = []
    for _ in range(12):
        base = [rng.choice("abcdefgh") + str(rng.randrange(60)) for _ in range(rng.randrange(20, 90))]
        for _ in range(8):
            new = list(base)
            for _ in range(rng.randrange(0, 4)):
                new[rng.randrange(len(new))] = f"n{rng.randrange(50)}"
            texts.append(" ".join(new[: len(new) - rng.randrange(0, 8)] + base[:6] * rng.randrange(0, 3)))
    held = [shingles(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "key bigint, text string")
    for parts in (1, 3):  # every text its own part, and parts of several texts
        labels = docs.select(F.col("key").alias("node"), F.floor(F.col("key") / parts).alias("label"))
        found = {(r.a, r.b) for r in prefix_pairs(docs, labels, 0.8).collect()}
        pairs = [(a, b) for a in range(96) for b in range(a + 1, 96) if a // parts != b // parts]
        similar = {(a, b) for a, b in pairs if similarity(held[a], held[b]) >= 0.8}
        assert len(similar) > 15 and similar <= found <= set(pairs)
        assert len(found) < len(pairs) / 2
