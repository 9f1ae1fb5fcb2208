"""Near duplicates: DartMinHash signatures of weighted shingles, joined by bands and checked exactly.

Every unit of weight of a shingle is a region that hashed darts fall into, at a rate of one per unit of rank. A dart has
a rank and one of ``k`` coordinates; the earliest dart of a coordinate is its minimum hash, so two texts agree in
a coordinate with the probability of their generalised Jaccard similarity. Only darts up to the rank where all
coordinates are likely filled are thrown: about ``k (ln k + 2)`` per text, however many shingles it has.

Texts that share a band are candidates. A bucket is never expanded into pairs: its members meet the member that meets
most texts over all its bands (in a group of near copies, the text they come from). The texts of buckets that are still
mixed then meet by an exact join of their rarest shingles (``prefix_pairs``), so no link between them is left to
chance.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import bucketed, landed, map_texts, shuffled_joins, slices
from waymark.llm.components import components
from waymark.llm.shingles import WORDS, mix, shingles, similarity

BANDS, ROWS = 24, 5
THRESHOLD = 0.8
#: Width of the rank cells in which darts are counted.
CELL = 0.25
#: Hash ranges in which the texts that hold a shingle are counted, to order shingles by rarity (a power of 2).
COUNTERS = 1 << 20
#: Guards the bounds on whole weights against rounding.
_EPSILON = 1e-6

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1B54A32D192ED03)


def _poisson_levels(rate: float, most: int = 12) -> np.ndarray:
    """Cumulative probabilities of a Poisson count, as thresholds on 64-bit hashes."""
    p = [math.exp(-rate) * rate**i / math.factorial(i) for i in range(most)]
    return np.array([min(int(c * 2.0**64), 2**64 - 1) for c in np.cumsum(p)], np.uint64)


_LEVELS = _poisson_levels(CELL)


def throw_darts(regions: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and ranks of the darts in rank cells ``first`` to ``last`` - 1 of the regions."""
    cells = np.arange(first, last, dtype=np.uint64)
    at = mix((regions[:, None] + (cells + np.uint64(1))[None, :] * _GOLDEN).ravel())
    counts = np.searchsorted(_LEVELS, at, side="right")
    some = np.flatnonzero(counts)
    many = counts[some]
    turn = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    darts = mix(np.repeat(at[some], many) + (turn.astype(np.uint64) + np.uint64(1)) * _STEP)
    place = mix(darts + _GOLDEN)
    cell = np.repeat(some % len(cells) + first, many)
    return darts, (cell + (place >> np.uint64(11)) * 2.0**-53) * CELL


def signature(weighted: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """The earliest dart of each of ``k`` coordinates, for sorted hashes with whole weights (not empty)."""
    hashes, weights = weighted
    unit = np.arange(weights.sum()) - np.repeat(np.cumsum(weights) - weights, weights)
    regions = mix(np.repeat(hashes, weights) + unit.astype(np.uint64) * _STEP)
    cells = max(1, math.ceil(k * (math.log(k) + 2) / len(regions) / CELL))
    out, filled = np.zeros(k, np.uint64), np.zeros(k, bool)
    first, last = 0, cells
    # regions in slices: a long text has many regions but few cells
    while not filled.all():
        parts = [throw_darts(regions[i : i + 65536], first, last) for i in range(0, len(regions), 65536)]
        darts = np.concatenate([p[0] for p in parts])
        ranks = np.concatenate([p[1] for p in parts])
        order = np.argsort(-ranks, kind="stable")  # the earliest is written last and stays
        coordinate = (darts[order] % np.uint64(k)).astype(np.int64)
        found, hit = np.zeros(k, np.uint64), np.zeros(k, bool)
        found[coordinate], hit[coordinate] = darts[order], True
        out = np.where(filled, out, found)
        filled |= hit
        first, last = last, last + cells
    return out


def band_keys(values: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One key per band of a signature, different between bands."""
    place = np.arange(1, rows + 1, dtype=np.uint64) * _STEP
    inner = mix(values.reshape(bands, rows) + place[None, :]).sum(axis=1, dtype=np.uint64)
    return mix(inner + np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN).view(np.int64)


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = WORDS) -> DataFrame:
    """``doc_id``, ``key``, ``digest`` of the text, ``bands`` (empty for texts without words) and ``weight`` of every row."""

    def columns(texts):
        out = {"bands": [], "weight": []}
        for t in texts:
            s = shingles(t, size)
            out["bands"].append(band_keys(signature(s, bands * rows), bands, rows) if len(s[0]) else [])
            out["weight"].append(int(s[1].sum()))
        return out

    text = F.coalesce(F.col("text"), F.lit(""))
    rows_in = docs.select("doc_id", doc_key().alias("key"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), "text")
    return map_texts(rows_in, columns, "bands array<bigint>, weight bigint")


def doc_key():
    """The document id; a row without one gets a negative number made of its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text).bitwiseOR(F.lit(-(2**63))))


def similar_pairs(pairs: DataFrame, texts: DataFrame, threshold: float, size: int = WORDS) -> DataFrame:
    """The pairs (``a``, ``b``) whose whole texts (``key``, ``text``) reach the threshold.

    The texts lie in buckets by key (``bucketed``) and are never broadcast. The end of a pair that is in more pairs is its
    hub: the texts of hubs are joined first, by a shuffle whose hot keys adaptive execution can split, and what comes of
    that meets the other end's text in its bucket. So per round only hub texts move, and one text a pair.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    ends = landed(ends, "ends")
    sized = pairs.join(ends.withColumnsRenamed({"key": "a", "n": "_m"}), "a").join(ends.withColumnsRenamed({"key": "b", "n": "_n"}), "b")
    first = F.col("_m") >= F.col("_n")
    hub, other = F.when(first, F.col("a")).otherwise(F.col("b")), F.when(first, F.col("b")).otherwise(F.col("a"))
    sized = landed(sized.select("a", "b", hub.alias("_hub"), other.alias("_other")), "pairs")
    hubs = texts.join(sized.select(F.col("_hub").alias("key")).distinct(), "key", "left_semi")
    # a changed key hides the buckets, so that this join shuffles and can be split
    hidden = F.lit(1).cast("long")
    hubs = hubs.select(F.col("key").bitwiseXOR(hidden).alias("_at"), F.col("text").alias("text_a")).hint("merge")
    one = sized.join(hubs, F.col("_hub").bitwiseXOR(hidden) == F.col("_at")).drop("_hub", "_at")
    two = one.join(texts.withColumnRenamed("text", "text_b").hint("merge"), F.col("_other") == F.col("key")).drop("key", "_other")

    def run(batches):
        known: tuple[str | None, object] = (None, None)
        for part in slices(batches, "text_a"):
            good = []
            for a, b in zip(part.column("text_a").to_pylist(), part.column("text_b").to_pylist()):
                if known[0] != a:
                    known = (a, shingles(a, size))
                good.append(similarity(known[1], shingles(b, size)) >= threshold)
            yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return two.mapInArrow(run, "a bigint, b bigint").distinct()


def _fit(a: str, b: str, threshold: float):
    """Can texts of these weights be similar enough? The smaller weight over the larger bounds their similarity."""
    return F.least(a, b) >= F.lit(threshold) * F.greatest(a, b)


def _place():
    """Rank of a text as leader: by the number of texts it meets, ties by a hash."""
    return F.col("met") * 1024 + F.pmod(F.xxhash64("node"), F.lit(1024))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("_a", "node").alias("a"), F.greatest("_a", "node").alias("b"))


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(65 - COUNTERS.bit_length())).astype(np.int64)


def shingle_counts(texts: DataFrame, size: int = WORDS) -> np.ndarray:
    """How many texts (``text``) hold the shingles of each hash range; its size does not depend on the table."""

    def run(batches):
        seen = np.zeros(COUNTERS, np.int64)
        for part in slices(batches, "text"):
            for t in part.column("text").to_pylist():
                np.add.at(seen, _counter(shingles(t, size)[0]), 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["at", "n"])

    summed = texts.select("text").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int32)
    out[summed.column("at").to_numpy()] = summed.column("n").to_numpy()
    return out


def prefix_pairs(texts: DataFrame, labels: DataFrame, threshold: float, size: int = WORDS) -> DataFrame:
    """Pairs (``a``, ``b``) of texts (``key``, ``text``) with different labels, among them all that reach the threshold.

    All texts list their shingles in one order, rare ones first. Two similar texts of weights v <= w have at least
    threshold / (1 + threshold) * (v + w) in common, all of it from their first common shingle on. So that shingle
    stands so early in both lists that as much is left, and in the first 1 - 2 * threshold / (1 + threshold) of the
    lighter one. What many texts share stands late: texts that have only a template in common don't meet. The order
    decides how many pairs are made, never which similar ones are found.
    """
    counts = shingle_counts(texts, size)

    def columns(rows):
        out = {"weight": [], "token": [], "before": []}
        for t in rows:
            hashes, n = shingles(t, size)
            order = np.lexsort((hashes, counts[_counter(hashes)]))
            before = np.cumsum(n[order]) - n[order]
            weight = int(n.sum())
            early = before <= weight * (1 - threshold) + _EPSILON
            out["weight"].append(weight)
            out["token"].append(hashes[order][early].view(np.int64))
            out["before"].append(before[early])
        return out

    listed = map_texts(texts.select("key", "text"), columns, "weight bigint, token array<bigint>, before array<bigint>")
    rows = listed.select("key", "weight", F.explode(F.arrays_zip("token", "before")).alias("_s"))
    rows = rows.select("key", "weight", "_s.token", "_s.before").join(labels.withColumnRenamed("node", "key"), "key")
    common = F.lit(threshold / (1 + threshold))
    rest = F.col("weight") - F.col("before")
    rows = landed(rows.withColumn("light", rest >= common * 2 * F.col("weight") - _EPSILON), "prefixes")
    # a token of one part joins nothing; of a token's largest part no member meets another
    parts = rows.groupBy("token", "label").agg(F.count("*").alias("_n"), F.max("light").alias("_light"))
    lead = parts.groupBy("token").agg(
        F.max_by("label", F.struct("_n", "label")).alias("_most"), F.count("*").alias("_n"), F.max("_light").alias("_light")
    )
    lead = landed(lead.filter("_n > 1 and _light").select("token", "_most"), "lead")
    mixed = landed(rows.join(lead, "token"), "prefixes")
    light = mixed.filter("light").drop("light").withColumnsRenamed(
        {"key": "_a", "weight": "_v", "before": "_p", "label": "_l"}
    )

    def met(one: DataFrame, two: DataFrame) -> DataFrame:
        left = F.least(F.col("_v") - F.col("_p"), F.col("weight") - F.col("before"))
        enough = left >= common * (F.col("_v") + F.col("weight")) - _EPSILON
        found = one.drop("_most").join(two.drop("_most", "light"), "token")
        return found.filter("_l <> label").filter("_v <= weight").filter(enough).select("_a", F.col("key").alias("node"))

    few = met(light.filter("_l <> _most"), mixed)
    many = met(light.filter("_l = _most"), mixed.filter("label <> _most"))
    return _ordered(few.unionByName(many)).distinct()


def _relabelled(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels after the edges have joined their components; only the graph of the labels is searched."""
    one = edges.join(labels.select(F.col("node").alias("a"), F.col("label").alias("_la")), "a")
    two = one.join(labels.select(F.col("node").alias("b"), F.col("label").alias("_lb")), "b")
    merged = components(two.filter("_la <> _lb").select(F.col("_la").alias("a"), F.col("_lb").alias("b")))
    merged = merged.select(F.col("node").alias("label"), F.col("label").alias("_to"))
    joined = labels.join(merged, "label", "left").select("node", F.coalesce("_to", "label").alias("label"))
    return landed(joined, "labels")


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, size: int = WORDS
) -> DataFrame:
    """``doc_id`` and ``class_id`` (least id of the class) of every row of documents.

    Documents are linked when their weighted shingle sets are similar to at least ``threshold``; classes are the
    connected components. Equal texts are always one class, as are rows with the same id; null and empty texts are
    equal. Texts without words are alike only when equal. A row without id gets a negative ``class_id`` unless its class
    has a document with one. A table without rows gives none. Runs its jobs at once, with the same plans at every size:
    no join broadcasts.
    """
    with shuffled_joins(docs.sparkSession):
        return _classes(docs, threshold, bands, rows, size)


def _classes(docs: DataFrame, threshold: float, bands: int, rows: int, size: int) -> DataFrame:
    sketched = landed(sketch(docs, bands, rows, size), "sketches")
    # the groups of equal texts stand in a table of their own, so that the join can split a large one
    same = sketched.groupBy("digest").agg(F.min("key").alias("node"), F.count("*").alias("_n")).filter("_n > 1")
    same = landed(same.drop("_n"), "same")
    member = sketched.join(same, "digest", "left").withColumn("node", F.coalesce("node", "key")).drop("digest")
    member = landed(member, "members")
    buckets = member.filter("key = node").select("node", "weight", F.explode("bands").alias("band"))
    # rows with one id and several texts: their texts are linked from the start
    several = member.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("_b")).filter("a <> _b")
    links = landed(member.join(several, "key").select("a", F.col("node").alias("b")).filter("a <> b").distinct(), "links")
    # buckets of one text never meet anything; the texts in the others are all that is compared
    crowd = buckets.groupBy("band").agg(F.count("*").alias("_n")).filter("_n > 1")
    crowded = landed(buckets.join(landed(crowd, "lead"), "band"), "buckets")
    # how many texts a text meets over all its bands: the source of a group of near copies meets most
    met = crowded.groupBy("node").agg(F.sum("_n").alias("met"))
    shared = landed(crowded.drop("_n").join(landed(met, "met"), "node"), "buckets")
    alive = shared.select("node").distinct()
    keyed = docs.select(doc_key().alias("key"), "text")
    texts = bucketed(keyed.join(alive.withColumnRenamed("node", "key"), "key", "left_semi"), "key")
    place = _place()
    lead = shared.groupBy("band").agg(F.max_by("node", place).alias("_a"), F.max_by("weight", place).alias("_w"))
    first = shared.join(landed(lead, "lead"), "band").filter("_a <> node").filter(_fit("weight", "_w", threshold))
    pairs = landed(_ordered(first).distinct(), "pairs")
    nodes = alive.unionByName(links.select(F.col("a").alias("node"))).unionByName(links.select(F.col("b").alias("node")))
    labels = nodes.distinct().select("node", F.col("node").alias("label"))
    found = landed(similar_pairs(pairs, texts, threshold, size), "found")
    labels = _relabelled(labels, found.unionByName(links))
    named = shared.join(labels, "node")
    # two texts alone in a bucket have met by now; any others that are still apart meet exactly
    mixed = named.groupBy("band").agg(F.min("label").alias("_x"), F.max("label").alias("_y"), F.count("*").alias("_n"))
    mixed = landed(mixed.filter("_x <> _y and _n > 2").select("band"), "mixed")
    apart = landed(named.join(mixed, "band", "left_semi").select("node", "label").distinct(), "apart")
    if not apart.isEmpty():
        left = landed(texts.join(apart.select(F.col("node").alias("key")), "key", "left_semi"), "texts")
        rest = prefix_pairs(left, apart, threshold, size).join(pairs, ["a", "b"], "left_anti")
        found = landed(similar_pairs(landed(rest, "pairs"), texts, threshold, size), "found")
        labels = _relabelled(labels, found)
    return landed(member.join(labels, "node", "left").select("doc_id", F.coalesce("label", "node").alias("class_id")), "classes")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, the one with the least id, with its columns as they were."""
    classes = near_duplicates(docs.select("doc_id", "text"), threshold)
    keyed = docs.withColumn("_key", doc_key())
    chosen = classes.select(F.col("class_id").alias("_key")).distinct()
    return keyed.join(chosen, "_key", "left_semi").dropDuplicates(["_key"]).select(*docs.columns)
