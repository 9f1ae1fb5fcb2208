"""Spelling variants: words one inserted, deleted or replaced letter apart, by a dictionary of trie-node pairs.

The words are sorted, and the nodes of their trie are numbered along the sorted runs; the same is done with the reversed
words. What stands before and after a place in a word is then a pair of integers (prefix node, suffix node). A word puts
into the dictionary one pair for every letter it can skip and one for every place where a letter can be inserted:

* two words that skip a letter at the same pair differ by that letter alone;
* a word that skips a letter at a pair where another can insert one is that other word with the letter inserted.

A pair holds at most one word that inserts and one skipping word per letter of the alphabet, so no group grows with the
data, and counts and best neighbours are window functions over it; no list of neighbours is built. Of a run of equal
letters only the first counts as skipped towards a shorter word, so that two words meet once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import landed, slices

LETTERS = "A-Za-zÀ-ÿ"
#: Node numbers carry the part of the sorted words in their upper bits, a counter of the part's nodes in the lower ones.
COUNTER_BITS = 40
ROOT = 0
INSERTS, SKIPS_LATER, SKIPS_FIRST = 0, 1, 2
#: Rows of one Arrow batch that leaves a Python step.
BATCH = 1 << 16


def varied(doc_id, run: str, every: int = 31) -> str:
    """The run, without one letter if ``every`` divides the CRC-32 of ``<doc_id>:<run>``."""
    h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    place = h % len(run)
    return run[:place] + run[place + 1 :]


def varied_words(docs: DataFrame, least: int = 7, twice: int = 2, every: int = 31) -> DataFrame:
    """``word``, ``n``: words of at least ``least`` letters that occur at least ``twice`` in the texts.

    A word is a run of letters, A-Z lower-cased, without the letter that ``varied`` takes from it. Null and empty texts
    have none; a null id counts as ``null``; a repeated row counts each time. Texts are counted a slice at a time, so a
    frequent word leaves each slice once.
    """
    runs = re.compile(f"[{LETTERS}]{{{least},}}").findall

    def count(batches):
        for part in slices(batches, "text"):
            total: Counter = Counter()
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                # bytes have only the letters A-Z to lower
                found = Counter(runs((text or "").encode().lower().decode()))
                for run, n in found.items():
                    total[varied(doc_id, run, every)] += n
            words = [w for w in total if len(w) >= least]
            counts = pa.array([total[w] for w in words], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), counts], names=["word", "n"])

    counted = docs.select("doc_id", "text").mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= twice)


def shared_start(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n - 1  # the first difference lies in low..high
    while low < high:
        middle = (low + high) // 2
        if a[low : middle + 1] == b[low : middle + 1]:
            low = middle + 1
        else:
            high = middle
    return low


def number_run(part: int, words, stack: list[int], last: str, made: int):
    """Nodes of each word of a sorted run: those it shares with the word before, then new ones. Returns the end state too."""
    base = part << COUNTER_BITS
    nodes = []
    for word in words:
        stack = stack[: shared_start(last, word) + 1]
        new = len(word) + 1 - len(stack)
        stack.extend(range(base + made + 1, base + made + new + 1))
        made += new
        last = word
        nodes.append(stack)
    return nodes, stack, last, made


def long_lists(rows: list) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate([np.asarray(r, np.int64) for r in rows]) if rows else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def numbered(words: DataFrame, word: str) -> DataFrame:
    """``word``, ``nodes``: the trie nodes of all prefixes of each distinct word, from the root's 0 to the word's own.

    The words are range-partitioned and sorted. Each part numbers its nodes alone; the prefixes that a part shares with
    the end of the part before take the numbers from there, known from the first and last word of each part. Numbers of
    whole words grow in code-point order. Runs a job at once.
    """

    def number(batches):
        part = TaskContext.get().partitionId()
        stack, last, made = [ROOT], "", 0
        for batch in batches:
            values = batch.column(0).to_pylist()
            for at in range(0, len(values), 4096):
                some = values[at : at + 4096]
                nodes, stack, last, made = number_run(part, some, stack, last, made)
                parts = pa.array(np.full(len(some), part), pa.int32())
                yield pa.RecordBatch.from_arrays([parts, pa.array(some, pa.string()), long_lists(nodes)], names=["part", "word", "nodes"])

    by_range = words.select(F.col(word).alias("word")).repartitionByRange("word").sortWithinPartitions("word")
    local = landed(by_range.mapInArrow(number, "part int, word string, nodes array<bigint>"), "trie")
    # the ends of each part: one row per part, whatever the number of words
    ends = local.groupBy("part").agg(F.min("word").alias("first"), F.max(F.struct("word", "nodes")).alias("last")).collect()
    carried = carried_nodes(sorted((e.part, e.first, e["last"].word, list(e["last"].nodes)) for e in ends))

    def settle(batches):
        for batch in batches:
            parts, nodes = batch.column(0).to_pylist(), batch.column(2)
            starts, flat = nodes.offsets.to_numpy(), nodes.values.to_numpy().copy()
            for row, part in enumerate(parts):
                carry = carried.get(part)
                if carry is not None:
                    mine = flat[starts[row] : starts[row + 1]][: len(carry)]
                    # on the path of the part's first word the numbers are 0, base + 1, base + 2, ...
                    path = np.arange(len(mine)) + (part << COUNTER_BITS)
                    path[0] = ROOT
                    np.copyto(mine, carry[: len(mine)], where=mine == path)
            settled = pa.ListArray.from_arrays(nodes.offsets, pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(1), settled], names=["word", "nodes"])

    return local.mapInArrow(settle, "word string, nodes array<bigint>")


def carried_nodes(ends: list[tuple]) -> dict[int, np.ndarray]:
    """For each part, the numbers of the prefixes that its first word shares with the last word of the part before.

    ``ends`` holds part, first word, last word and the last word's own nodes, in order of the parts.
    """
    carried, before = {}, None
    for part, first, last, nodes in ends:
        if before is not None:
            shared = shared_start(before[0], first)
            carried[part] = np.array(before[1][: shared + 1], np.int64)
            # what the last word has in common with the first one takes the carried numbers too
            both = min(shared, shared_start(first, last))
            nodes = [*carried[part][: both + 1].tolist(), *nodes[both + 1 :]]
        before = (last, nodes)
    return carried


def dictionary(words: DataFrame) -> DataFrame:
    """``prefix``, ``suffix``, ``kind``, ``id``, ``n``: every pair of nodes at which a word skips or inserts a letter."""

    def pairs(batches):
        for batch in batches:
            held, size = [], 0
            for word, n, ahead, back in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "ahead", "back"))):
                letters = len(word)
                ahead, back = np.array(ahead, np.int64), np.array(back, np.int64)[::-1]
                code = np.array([0, *map(ord, word)])
                kind = np.where(code[1:] != code[:-1], SKIPS_FIRST, SKIPS_LATER)
                rows = np.empty((2 * letters + 1, 5), np.int64)
                rows[:, 3], rows[:, 4] = ahead[letters], n
                rows[:letters, 0], rows[:letters, 1], rows[:letters, 2] = ahead[:-1], back[1:], kind
                rows[letters:, 0], rows[letters:, 1], rows[letters:, 2] = ahead, back, INSERTS
                held.append(rows)
                size += len(rows)
                if size >= BATCH:
                    yield as_batch(held)
                    held, size = [], 0
            if held:
                yield as_batch(held)

    def as_batch(held):
        columns = np.concatenate(held).T
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["prefix", "suffix", "kind", "id", "n"])

    return words.mapInArrow(pairs, "prefix bigint, suffix bigint, kind bigint, id bigint, n bigint")


def neighbours(pairs: DataFrame) -> DataFrame:
    """``id``, ``n_near`` and ``best`` (n, minus id) of every word that has a near word."""
    cell = Window.partitionBy("prefix", "suffix")
    skips, inserts, first = F.col("kind") != INSERTS, F.col("kind") == INSERTS, F.col("kind") == SKIPS_FIRST
    me = F.struct("n", (-F.col("id")).alias("minus_id"))
    # skipping words first, the most frequent of them foremost
    ranked = cell.orderBy(inserts, F.desc("n"), "id")
    whole = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = pairs.select(
        "id",
        skips.alias("skips"),
        first.alias("first"),
        F.count("*").over(cell).alias("all"),
        F.count(F.when(skips, 1)).over(cell).alias("n_skips"),
        F.count(F.when(first, 1)).over(cell).alias("n_first"),
        F.max(F.when(inserts, me)).over(cell).alias("inserting"),
        F.max(F.when(first, me)).over(cell).alias("top_first"),
        F.row_number().over(ranked).alias("place"),
        F.first(F.when(skips, me)).over(whole).alias("top"),
        F.lead(F.when(skips, me)).over(ranked).alias("next"),
    ).filter("all > 1")
    other = F.when(F.col("place") == 1, F.col("next")).otherwise(F.col("top"))
    longer = F.col("first") & F.col("inserting").isNotNull()
    near = F.when(F.col("skips"), F.col("n_skips") - 1 + F.when(longer, 1).otherwise(0)).otherwise(F.col("n_first"))
    best = F.when(F.col("skips"), F.greatest(other, F.when(longer, F.col("inserting")))).otherwise(F.col("top_first"))
    found = seen.select("id", near.alias("near"), best.alias("best")).filter("near > 0")
    return found.groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``id``, ``root``: the end of each word's chain of forms, by pointers that double their reach.

    A form is at least ``ratio`` times as frequent as its word, so chains are short (its length is a logarithm of the
    largest count) and have no circle. Runs a job a round.
    """
    reach = forms.select("id", F.col("form_id").alias("root"))
    while True:
        ahead = reach.select(F.col("id").alias("_id"), F.col("root").alias("_root"))
        moved = reach.join(ahead, F.col("root") == F.col("_id"), "left")
        reach = landed(moved.select("id", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "roots")
        if reach.filter("moved").isEmpty():
            return reach.select("id", "root")
        reach = reach.select("id", "root")


def spelling_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """Each word with its near words counted and the frequent one that it is a variant of.

    ``words`` holds distinct ``word`` and their counts ``n``. Near words differ by exactly one inserted, deleted or
    replaced code point. Returned per word: ``form`` (its near word of largest n, the smallest in code-point order among
    equals, if that n is at least ``ratio`` times the word's, else null), ``root`` (the end of the chain of forms, the
    word itself without one), ``n``, ``n_near`` and ``form_n``. ``ratio`` must exceed 1. Other columns go; null words are
    left out; an empty table gives an empty one. Runs jobs at once.
    """
    words = landed(words.select("word", F.col("n").cast("long").alias("n")).filter("word is not null"), "words")
    ahead = numbered(words, "word").withColumnRenamed("nodes", "ahead")
    turned = numbered(words.select(F.reverse("word").alias("turned")), "turned")
    back = turned.select(F.reverse("word").alias("word"), F.col("nodes").alias("back"))
    both = landed(words.join(ahead, "word").join(back, "word"), "nodes")
    ids = both.select("word", "n", F.element_at("ahead", -1).alias("id"))
    near = neighbours(dictionary(both.select("word", "n", "ahead", "back")))
    judged = ids.join(near, "id", "left").select(
        "id",
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("best.n") >= ratio * F.col("n"), F.col("best")).alias("best"),
    )
    judged = landed(judged.select("*", (-F.col("best.minus_id")).alias("form_id"), F.col("best.n").alias("form_n")).drop("best"), "judged")
    ends = roots(judged.filter("form_id is not null").select("id", "form_id"))
    spelled = judged.select(F.col("id").alias("_id"), F.col("word").alias("_word"))
    named = judged.join(ends, "id", "left")
    named = named.join(spelled.select(F.col("_id").alias("form_id"), F.col("_word").alias("form")), "form_id", "left")
    named = named.join(spelled.select(F.col("_id").alias("root"), F.col("_word").alias("root_word")), "root", "left")
    return named.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
