"""Benchmark passages in documents, by Wu-Manber search over words.

Patterns are the windows of the benchmark items. For patterns of one length the shift table tells, for the block of
two words under the search position, how far the search may move because no pattern has that block nearer to its end;
a block that ends a pattern has shift 0, and its bucket of patterns is compared directly.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import landed, map_texts

WINDOW = 13
#: Benchmark text that one pass holds in each task; a larger benchmark is searched in several passes.
PASS_BYTES = 2 << 20

# on UTF-8 bytes this is [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return _WORDS.findall((text or "").encode().lower())


class WuManber:
    """Search tables for word windows of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set[str]]):
        self.length = length
        self.block = min(2, length)
        self.farthest = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                key = self.key(pattern, end - 1)
                self.shift[key] = min(self.shift.get(key, self.farthest), length - end)
            self.buckets.setdefault(self.key(pattern, length - 1), {})[pattern] = items

    def key(self, words, last: int):
        return words[last] if self.block == 1 else (words[last - 1], words[last])

    def search(self, words: list[bytes]):
        """(last position, items) of every occurrence."""
        at, n = self.length - 1, len(words)
        shift, farthest, length, pairs = self.shift.get, self.farthest, self.length, self.block == 2
        while at < n:
            key = (words[at - 1], words[at]) if pairs else words[at]
            step = shift(key, farthest)
            if step:
                at += step
                continue
            items = self.buckets[key].get(tuple(words[at - length + 1 : at + 1]))
            if items:
                yield at, items
            at += 1


def item_windows(items: list[tuple[str, str | None]], window: int = WINDOW) -> list[WuManber]:
    """One search table for each pattern length; an item shorter than the window is one pattern itself."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, text in items:
        words = tuple(words_of(text))
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            by_length.setdefault(size, {}).setdefault(words[i : i + size], set()).add(item)
    return [WuManber(n, patterns) for n, patterns in sorted(by_length.items())]


def hits_of(words: list[bytes], tables: list[WuManber]) -> tuple[bytearray, set[str]]:
    """A mark for every word inside an occurrence (empty if there is none), and the items found."""
    marks, found = bytearray(), set()
    for table in tables:
        for last, items in table.search(words):
            if not marks:
                marks = bytearray(len(words))
            marks[last - table.length + 1 : last + 1] = b"\x01" * table.length
            found |= items
    return marks, found


def _item_slices(benchmark: DataFrame, pass_bytes: int) -> list[DataFrame]:
    size = F.octet_length(F.coalesce("text", F.lit("")))
    total = benchmark.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    n = max(1, -(-total // pass_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [benchmark.filter(part == k) if n > 1 else benchmark for k in range(n)]


def find_hits(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES, keep_text: bool = False
) -> DataFrame:
    """Add ``n_words``, ``n_hit`` and ``items`` (sorted texts of item ids) to the documents.

    The benchmark is split into slices of about ``pass_bytes`` of text, and each slice is one pass over the documents. With
    more than one, every row gets a number, the places hit in each pass meet on it, and the text, if kept, joins again.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")
    parts = _item_slices(items, pass_bytes)
    one = len(parts) == 1

    def search(part: DataFrame, frame: DataFrame, keep: bool) -> DataFrame:
        tables = item_windows([(r["item_id"], r["text"]) for r in part.collect()], window)  # at most a slice

        def columns(texts):
            out = {"n_words": [], "n_hit": [], "items": [], "hits": []}
            for t in texts:
                words = words_of(t)
                marks, found = hits_of(words, tables)
                out["n_words"].append(len(words))
                out["n_hit"].append(sum(marks))
                out["items"].append(sorted(found))
                out["hits"].append(None if one else [i for i, m in enumerate(marks) if m])
            return out

        schema = "n_words bigint, n_hit bigint, items array<string>, hits array<int>"
        return map_texts(frame, columns, schema, keep_text=keep)

    if one:
        return search(parts[0], docs, keep_text).drop("hits")
    numbered = landed(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    both = None
    for part in parts:
        found = landed(search(part, numbered.select("_row", "text"), False), "pass")
        both = found if both is None else both.unionByName(found)
    merged = both.groupBy("_row").agg(
        F.max("n_words").alias("n_words"),
        F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).cast("bigint").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    kept = numbered if keep_text else numbered.drop("text")
    return kept.join(merged, "_row").drop("_row")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, pass_bytes: int = PASS_BYTES,
    keep_text: bool = False,
) -> DataFrame:
    """Overlap of each document with the benchmark; ``contaminated`` from one word hit in ``share``.

    Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. Null and empty texts have no words
    and are clean; an item without words has no window; items with the same id count once; an empty benchmark leaves
    all documents clean. Repeated rows give repeated results.
    """
    found = find_hits(docs, benchmark, window, pass_bytes, keep_text)
    return found.withColumns(
        {
            "n_items": F.size("items").cast("bigint"),
            "items_sha256": F.sha2(F.array_join("items", ",").cast("binary"), 256),
            "contaminated": (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")),
        }
    )


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their columns as they were."""
    names = [f"_c{i}" for i in range(len(docs.columns))]  # a column of docs may be called items
    plain = docs.toDF(*names).withColumnRenamed(names[docs.columns.index("text")], "text")
    kept = decontaminate(plain, benchmark, keep_text=True).filter(~F.col("contaminated"))
    return kept.select(*plain.columns).toDF(*docs.columns)
