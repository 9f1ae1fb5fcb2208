"""Encoding and decoding with a word-level BPE: part boundaries and adjacent ranks of one word in contiguous arrays.

A word starts with one part per byte. The ranks of its adjacent parts lie in one array; the least of them is found by a
scan, the boundary between its two parts is deleted, and the ranks to the left and right of the new part are looked up
anew. Words longer than ``SCANNED`` bytes find the least rank by a heap instead, with the same merges in the same order.
Each worker remembers the words it has met (a bounded table).

Texts of characters below U+0250 are cut into words here; for others the library's own normaliser and splitter find the
words, since its Unicode tables are newer than Python's.
"""

from __future__ import annotations

import heapq
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from waymark.llm.common import map_texts, per_task
from waymark.llm.token_counts import WS, byte_symbols

# The word pattern of the vocabulary file for characters below U+0250.
LETTER, NUMBER = "a-zªµºß-öø-\u024f", "0-9²³¹¼½¾"
WORDS = f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{WS}{LETTER}{NUMBER}]+"
NO_RANK = 1 << 60
#: Words up to so many bytes are scanned for their least rank, longer ones keep a heap.
SCANNED = 256
#: Distinct words that a worker remembers (longer ones than ``SCANNED`` are not); beyond it the table starts anew.
REMEMBERED = 1 << 18
#: Ids that are spelled out at once, in whole rows.
SPELLED = 1 << 18


def load_vocabulary(path: str) -> dict:
    """Ids of the bytes inside and at the end of a word, ranks and merged ids of pairs, token strings, special strings."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    ids, end = model["vocab"], model["end_of_word_suffix"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = {i: t for t, i in (ids | special).items()}
    return {
        "inner": [ids[c] for c in byte_symbols()],
        "last": [ids[c + end] for c in byte_symbols()],
        "ranks": {(ids[a], ids[b]): rank for rank, (a, b) in enumerate(pairs)},
        "merged": [ids[a + b] for a, b in pairs],
        "tokens": [tokens.get(i) for i in range(max(tokens) + 1)],
        "special": special,
    }


def merge_scanned(parts: list[int], ranks: dict, merged: list[int]) -> list[int]:
    """Merge the least-ranked adjacent parts until none has a rank; the leftmost of equal ranks goes first."""
    rank_of = ranks.get
    beside = [rank_of(pair, NO_RANK) for pair in zip(parts, parts[1:])]
    while beside:
        least = min(beside)
        if least == NO_RANK:
            break
        i = beside.index(least)
        parts[i] = merged[least]
        del parts[i + 1], beside[i]
        if i:
            beside[i - 1] = rank_of((parts[i - 1], parts[i]), NO_RANK)
        if i < len(beside):
            beside[i] = rank_of((parts[i], parts[i + 1]), NO_RANK)
    return parts


def merge_queued(parts: list[int], ranks: dict, merged: list[int]) -> list[int]:
    """The same merges for a long word: pairs wait in a heap by rank and place, parts are linked to their neighbours."""
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank_of = ranks.get
    heap = [(r, i) for i, pair in enumerate(zip(parts, parts[1:])) if (r := rank_of(pair)) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        # the pair that was queued here may be gone: its parts merged with others since
        if parts[i] < 0 or j == n or rank_of((parts[i], parts[j])) != rank:
            continue
        parts[i], parts[j] = merged[rank], -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := rank_of((parts[i], parts[k]))) is not None:
                heapq.heappush(heap, (r, i))
        if (h := before[i]) >= 0 and (r := rank_of((parts[h], parts[i]))) is not None:
            heapq.heappush(heap, (r, h))
    return [p for p in parts if p >= 0]


def word_encoder(vocabulary: dict):
    """A function from a word to its token ids."""
    inner, last, ranks, merged = (vocabulary[k] for k in ("inner", "last", "ranks", "merged"))

    def encode(word: str) -> list[int]:
        raw = word.encode()
        parts = [inner[b] for b in raw[:-1]]
        parts.append(last[raw[-1]])
        return (merge_scanned if len(parts) <= SCANNED else merge_queued)(parts, ranks, merged)

    return encode


def word_splitter(path: str):
    """A function from a text to its words, lower-cased and normalised as the file says."""
    from tokenizers import Regex, Tokenizer, pre_tokenizers

    with open(path, encoding="utf-8") as file:
        pattern = json.load(file)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    normal = Tokenizer.from_file(path).normalizer.normalize_str
    split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str
    latin, beyond_latin = re.compile(WORDS).findall, re.compile("[^\x00-\u024f]").search

    def words(text: str) -> list[str]:
        low = text.lower()
        if beyond_latin(low):
            return [word for word, _ in split(normal(text))]
        return latin(low)  # composed already: no combining mark lies below U+0250

    return words


def text_encoder(vocabulary: dict, path: str):
    """A function from texts to lists of token ids; one per task."""
    words = word_splitter(path)
    special = vocabulary["special"]
    marks = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
    encode_word = word_encoder(vocabulary)
    known: dict[str, list[int]] = {}

    def word_ids(word: str) -> list[int]:
        found = known.get(word)
        if found is None:
            found = encode_word(word)
            if len(word) <= SCANNED:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[word] = found
        return found

    def plain(text: str):
        return chain.from_iterable(map(word_ids, words(text)))

    def encode(text: str) -> list[int]:
        if marks is None:
            return list(plain(text))
        ids: list[int] = []
        for part in marks.split(text):
            if part in special:
                ids.append(special[part])
            else:
                ids.extend(plain(part))
        return ids

    return encode


def encode_texts(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Replace the text by its token ids (``array<int>``) under the word-level BPE file at ``path``.

    No begin or end token is added; a special string inside a text is one token, as the tokenizers library does by
    default. Null, empty and blank texts have an empty list; repeated rows are encoded each; a table without rows gives
    none. A column of ``df`` that has the name ``ids`` is replaced.
    """
    vocabulary = load_vocabulary(path)

    @per_task
    def encoder():
        encode = text_encoder(vocabulary, path)
        return lambda texts: {ids: [np.array(encode(t), np.int32) for t in texts]}

    return map_texts(df.drop(ids) if ids != text else df, encoder, f"`{ids}` array<int>", text)


def decode_ids(df: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Add the decoded text of a column of token ids: their strings, joined by single blanks.

    The file declares no decoder, so ends of words stay visible. Null ids and ids outside the vocabulary are left out,
    as the library does; a null list gives null, an empty one the empty text. A column named ``name`` is replaced.
    """
    tokens = pa.array(load_vocabulary(path)["tokens"], pa.string())
    df = df.drop(name)
    full = StructType([*df.schema.fields, *StructType.fromDDL(f"`{name}` string").fields])

    def row_ranges(batches):
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(ids)), 0).to_numpy(zero_copy_only=False))
            start = 0
            while start < len(ends):
                held = int(ends[start - 1]) if start else 0
                stop = max(int(np.searchsorted(ends, held + SPELLED, "right")), start + 1)
                yield batch.slice(start, stop - start)
                start = stop

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(full)
        for batch in row_ranges(batches):
            lists = batch.column(ids)
            flat = lists.flatten()
            inside = pc.fill_null(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(tokens))), False)
            strings = tokens.take(pc.if_else(inside, flat, pa.scalar(None, flat.type)))
            starts = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0))])
            spelled = pa.LargeListArray.from_arrays(pa.array(starts, pa.int64()), pc.cast(strings, pa.large_string()))
            if strings.null_count:
                joined = pa.array([" ".join(t for t in row if t is not None) for row in spelled.to_pylist()], pa.string())
            else:
                joined = pc.cast(pc.binary_join(spelled, pa.scalar(" ", pa.large_string())), pa.string())
            joined = pc.if_else(pc.is_valid(lists), joined, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, joined], schema=schema)

    return df.mapInArrow(run, full)
