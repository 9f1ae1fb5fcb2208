"""Token counts of a byte-level BPE, by rank-synchronous merging of ragged arrays.

The pre-tokens of a batch lie end to end in one array. In each step every sequence finds its own lowest-ranked
adjacent pair, and all sequences apply theirs at once; what is left of a sequence when no pair has a rank are its
tokens. Distinct pre-tokens are merged once per batch and remembered by the worker (a bounded table).
"""

from __future__ import annotations

import json
import re
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import map_texts, per_task

# The pre-token pattern of byte-level BPE vocabularies, with Unicode's white space written out. The
# alternatives start with different characters but for the apostrophe, so letters, the usual case, are tried first.
WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def pretoken_pattern(letter: str, number: str) -> str:
    return (
        f" ?[{letter}]+|'(?:[stmd]|re|ve|ll)| ?[{number}]+| ?[^{WS}{letter}{number}]+"
        f"|[{WS}]+(?![^{WS}])|[{WS}]+"
    )


PRETOKEN = pretoken_pattern(r"\p{L}", r"\p{N}")
#: The same for texts whose characters all lie below U+0250, in classes that the faster built-in engine knows.
LATIN_PRETOKEN = pretoken_pattern("A-Za-zªµºÀ-ÖØ-öø-\u024f", "0-9²³¹¼½¾")

NO_RANK = np.iinfo(np.int32).max
#: Distinct pre-tokens that a worker remembers; beyond it the table starts anew.
REMEMBERED = 1 << 19
#: Byte sequences beyond this length merge on their own, and a worker does not remember them.
LONG = 512


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def load_merges(path: str) -> dict:
    """Arrays of a vocabulary file: pair keys in order, the rank and merged id of each, id per byte, special strings."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    ids = spec["model"]["vocab"]
    width = max(ids.values()) + 1
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    keys = np.array([ids[a] * width + ids[b] for a, b in pairs], np.int64)
    order = np.argsort(keys, kind="stable")
    symbols = np.array([ids[c] for c in byte_symbols()], np.int64)
    rank_of = dict(zip(keys.tolist(), range(len(keys))))
    byte_of = {c: b for b, c in enumerate(byte_symbols())}
    together = np.zeros((256, 256), bool)
    for a, b in pairs:  # every symbol of two bytes or more is the result of a merge
        together[byte_of[a[-1]], byte_of[b[0]]] = True
    return {
        "keys": keys[order],
        "ranks": order.astype(np.int32),
        "merged": np.array([ids[a + b] for a, b in pairs], np.int32),
        "bytes": symbols,
        # ranks of pairs of single bytes, the pairs of the first and largest step
        "first": np.array([rank_of.get(k, NO_RANK) for k in np.add.outer(symbols * width, symbols).ravel().tolist()], np.int32),
        "together": together,
        "width": width,
        "special": [t["content"] for t in spec["added_tokens"]],
    }


def count_symbols(sequences: list[bytes], merges: dict) -> np.ndarray:
    """Symbols left of each byte sequence after all merges.

    A sequence of more than ``LONG`` bytes is cut where two neighbouring bytes stand together in no symbol, as no merge
    crosses such a place; parts that are still long are counted one by one.
    """
    parts, owner, counts = [], [], np.zeros(len(sequences), np.int64)
    for i, sequence in enumerate(sequences):
        if len(sequence) <= LONG:
            parts.append(sequence)
            owner.append(i)
            continue
        raw = np.frombuffer(sequence, np.uint8)
        cuts = [0, *(np.flatnonzero(~merges["together"][raw[:-1], raw[1:]]) + 1).tolist(), len(sequence)]
        for start, end in zip(cuts, cuts[1:]):
            if end - start > LONG:
                counts[i] += count_long(sequence[start:end], merges)
            else:
                parts.append(sequence[start:end])
                owner.append(i)
    np.add.at(counts, np.array(owner, np.int64), count_side_by_side(parts, merges))
    return counts


def count_long(sequence: bytes, merges: dict) -> int:
    """The same for one long sequence: places are queued by rank, and a step looks only at those of the lowest rank.

    Each step applies that pair everywhere at once and ranks anew only the pairs beside a merge.
    """
    keys, ranks, merged, width = merges["keys"], merges["ranks"], merges["merged"], merges["width"]
    n = len(sequence)
    # linked symbols; a place n stands for the end
    symbols = np.append(merges["bytes"][np.frombuffer(sequence, np.uint8)], 0)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    rank = np.full(n + 1, NO_RANK, np.int64)  # of the pair that starts at a place
    queue: list[int] = []
    places: dict[int, list[np.ndarray]] = {}

    def rank_again(at: np.ndarray) -> None:
        pair = symbols[at] * width + symbols[after[at]]
        found = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        rank[at] = np.where((keys[found] == pair) & (after[at] < n), ranks[found], NO_RANK)
        at = at[rank[at] < NO_RANK]
        at = at[np.argsort(rank[at], kind="stable")]
        first = np.flatnonzero(np.diff(rank[at], prepend=-1))
        for r, same in zip(rank[at[first]].tolist(), np.split(at, first[1:])):
            if r not in places:
                places[r] = []
                heappush(queue, r)
            places[r].append(same)

    rank_again(np.arange(n))
    left = n
    while queue:
        lowest = heappop(queue)
        at = np.unique(np.concatenate(places.pop(lowest)))
        at = at[rank[at] == lowest]  # others have been merged away meanwhile
        if not len(at):
            continue
        joint = after[at[:-1]] == at[1:]
        if joint.any():  # overlapping pairs of a run, every second one counts
            order = np.arange(len(at))
            run = np.maximum.accumulate(np.where(np.append(True, ~joint), order, 0))
            at = at[(order - run) % 2 == 0]
        gone = after[at]
        symbols[at], after[at] = merged[lowest], after[gone]
        before[after[at]] = at
        rank[gone] = NO_RANK
        left -= len(at)
        earlier = before[at]
        rank_again(np.unique(np.append(at, earlier[earlier >= 0])))
    return left


def count_side_by_side(sequences: list[bytes], merges: dict) -> np.ndarray:
    """Symbols left of each of many short sequences, which lie end to end and merge in common steps."""
    keys, ranks, merged, width = merges["keys"], merges["ranks"], merges["merged"], merges["width"]
    counts = np.array([len(s) for s in sequences], np.int64)
    who = np.flatnonzero(counts > 1)  # sequences still merging
    raw = np.frombuffer(b"".join([sequences[i] for i in who.tolist()]), np.uint8)
    flat, fresh = merges["bytes"][raw], merges["first"][raw[:-1].astype(np.int64) * 256 + raw[1:]]
    lengths = counts[who]
    while len(who):
        ends = np.cumsum(lengths)
        starts = ends - lengths
        rank = np.full(len(flat), NO_RANK, np.int32)
        if fresh is None:
            pair = flat[:-1] * width + flat[1:]
            at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
            fresh = np.where(keys[at] == pair, ranks[at], NO_RANK)
        rank[:-1], fresh = fresh, None
        rank[ends - 1] = NO_RANK  # a pair must not span two sequences
        best = np.minimum.reduceat(rank, starts)
        going = best < NO_RANK
        counts[who] = lengths
        if not going.all():
            keep = np.repeat(going, lengths)
            flat, rank = flat[keep], rank[keep]
            who, lengths, best = who[going], lengths[going], best[going]
            if not len(who):
                break
        hit = rank == np.repeat(best, lengths)
        if (hit[1:] & hit[:-1]).any():  # "aaa": the pairs of a run overlap, every second one counts
            place = np.arange(len(hit))
            first = hit.copy()
            first[1:] &= ~hit[:-1]
            run = np.maximum.accumulate(np.where(first, place, 0))
            hit &= (place - run) % 2 == 0
        where = np.flatnonzero(hit)
        flat[where] = merged[rank[where]]
        stay = np.ones(len(flat), bool)
        stay[where + 1] = False
        lengths = np.add.reduceat(stay, np.cumsum(lengths) - lengths, dtype=np.int64)
        flat = flat[stay]
    return counts


def text_counter(merges: dict):
    """A function from texts to their token counts; one per task."""
    import regex

    wide, latin = regex.compile(PRETOKEN).findall, re.compile(LATIN_PRETOKEN).findall
    beyond_latin = re.compile("[^\x00-\u024f]").search
    special = regex.compile("|".join(map(regex.escape, sorted(merges["special"], key=len, reverse=True))) or r"(?!)")
    known: dict[str, int] = {}

    def count(texts: list[str]) -> list[int]:
        fixed, found = [], []
        for text in texts:
            parts = special.split(text)
            fixed.append(len(parts) - 1)  # each special string is one token
            pretokens = wide if beyond_latin(text) else latin
            found.append([p for part in parts for p in pretokens(part)])
        if len(known) > REMEMBERED:
            known.clear()
        new = list(set().union(*found) - known.keys())
        known.update(zip(new, count_symbols([p.encode() for p in new], merges).tolist()))
        totals = [n + sum(map(known.__getitem__, words)) for n, words in zip(fixed, found)]
        for p in new:
            if len(p) > LONG:
                del known[p]
        return totals

    return count


def count_tokens(df: DataFrame, path: str, limit: int = 512, text: str = "text") -> DataFrame:
    """Replace the text by ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    The file at ``path`` is a byte-level BPE in the tokenizers' JSON form; special strings inside a text are one token
    each, as that library does by default. Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted
    each; a table without rows gives none.
    """
    merges = load_merges(path)

    @per_task
    def counter():
        count = text_counter(merges)

        def columns(texts):
            tokens = count(texts)
            return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": tokens}

        return columns

    counted = map_texts(df, counter, "n_bytes bigint, n_tokens bigint", text)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
