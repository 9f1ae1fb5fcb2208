"""Document fingerprints by consistent weighted sampling, in DataFrame expressions alone.

A document is the weighted set of its five-word shingles, each weighing as often as it occurs. For sample k every
shingle draws r and c from a gamma(2, 1) and b from a uniform distribution, all from hashes of the shingle and k. With
t = floor(ln w / r + b), the shingle with the least ln a = ln c - r (t - b + 1) is the sample. Two documents have the
same sample with the probability of their generalised Jaccard similarity. As ln a is drawn from (shingle, t, k) alone,
the least value itself identifies the sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import landed

SAMPLES = 32
WORDS = 5
#: Stands for a missing document id: such rows come first, as one document.
NO_ID = -(2**63)

_HALF = 2.0**-32


def _two_uniforms(term: Column, salt: int) -> tuple[Column, Column]:
    h = F.xxhash64(term, F.lit(salt))
    low = h.bitwiseAND(F.lit(0xFFFFFFFF))
    return (F.shiftrightunsigned(h, 32) + 0.5) * _HALF, (low + 0.5) * _HALF


def draws(term: Column, k: int) -> tuple[Column, Column, Column]:
    """ln c, r and b of a term for sample ``k``."""
    u1, u2 = _two_uniforms(term, 3 * k)
    u3, u4 = _two_uniforms(term, 3 * k + 1)
    return F.log(-F.log(u3 * u4)), -F.log(u1 * u2), _two_uniforms(term, 3 * k + 2)[0]


def sample(drawn: tuple[Column, Column, Column], log_weight: Column) -> Column:
    """ln a of a weighted term; null for a null weight."""
    log_c, r, b = drawn
    return log_c - r * (F.floor(log_weight / r + b) - b + 1)


def _shingles(body: str, words: int, tag: int) -> Column:
    """Hashes of the runs of ``words`` words of a split text, with ``tag`` as lowest bit."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(body) - words, F.lit(0)))
    # get() gives null past the end, which the hash skips: a short text is hashed whole
    return F.transform(
        starts, lambda i: F.xxhash64(*[F.get(body, i + j) for j in range(words)]).bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(tag))
    )


def with_terms(df: DataFrame, first: str, second: str, words: int = WORDS) -> DataFrame:
    """One row per distinct shingle of two texts: ``term`` (hash), its number in each text, ``w0`` and ``w1``, or null.

    A text with fewer words is one shingle; one without words has the shingle of the empty text. The shingles of both texts
    are hashed, sorted together and counted inside the row, so the texts are not shuffled again and what both share
    is drawn once. ``lead`` is 1 in one row for each row of ``df``.
    """
    split = {n: F.split(F.btrim(F.col(c), F.lit(" \t\n\x0b\x0c\r")), "[ \\t-\\r]+") for n, c in (("_a", first), ("_b", second))}
    rows = df.withColumns(split).drop(first, second)
    hashed = F.concat(_shingles("_a", words, 0), _shingles("_b", words, 1))
    ordered = rows.withColumn("_h", F.sort_array(hashed)).drop("_a", "_b")
    places = F.sequence(F.lit(0), F.size("_h") - 1)
    runs = ordered.withColumn(
        "_s", F.filter(places, lambda i: (i == 0) | (F.get("_h", i) != F.get("_h", F.greatest(i - 1, F.lit(0)))))
    )
    each = runs.withColumn("_j", F.explode(F.sequence(F.lit(0), F.size("_s") - 1)))
    j, none = F.col("_j"), F.lit(None).cast("int")
    start = F.get("_s", j)
    after = F.coalesce(F.get("_s", j + 1), F.size("_h"))
    last = F.coalesce(F.get("_s", j + 2), F.size("_h"))
    here, nxt = F.get("_h", start), F.get("_h", after)
    before = F.when(start > 0, F.get("_h", start - 1))
    tagged = here.bitwiseAND(F.lit(1)) == 1
    same_next = ~tagged & F.coalesce(nxt == here.bitwiseOR(F.lit(1)), F.lit(False))
    done = tagged & F.coalesce(before == here.bitwiseAND(F.lit(-2)), F.lit(False))  # counted with the run before it
    return each.select(
        *[c for c in df.columns if c not in (first, second)],
        here.bitwiseAND(F.lit(-2)).alias("term"),
        F.when(~tagged, after - start).alias("w0"),
        F.when(tagged, after - start).when(same_next, last - after).otherwise(none).alias("w1"),
        (j == 0).cast("int").alias("lead"),
        done.alias("_done"),
    ).filter(~F.col("_done")).drop("_done")


def signatures(df: DataFrame, keys: list[str], first: str, second: str, samples: int = SAMPLES) -> DataFrame:
    """``keys``, ``s`` and ``e`` (the signatures of two texts, arrays of ``samples`` doubles) and ``rows`` (rows with these keys).

    Rows with equal keys must have equal texts.
    """
    terms = with_terms(df.select(*keys, first, second), first, second)
    logs = terms.select(*keys, "term", "lead", *[F.log(F.col(w).cast("double")).alias(w) for w in ("w0", "w1")])
    least = []
    for k in range(samples):
        drawn = draws(F.col("term"), k)
        least += [F.min(sample(drawn, F.col(w))).alias(f"_{w}_{k}") for w in ("w0", "w1")]
    found = logs.groupBy(*keys).agg(*least, F.sum("lead").alias("rows"))
    arrays = [F.array(*[f"_{w}_{k}" for k in range(samples)]).alias(n) for w, n in (("w0", "s"), ("w1", "e"))]
    return found.select(*keys, *arrays, "rows")


def fingerprint(signature: str) -> Column:
    """Hexadecimal text of a signature, 32 bits for each sample."""
    part = F.transform(F.col(signature), lambda v: F.substring(F.lpad(F.lower(F.hex(F.xxhash64(v))), 16, "0"), 1, 8))
    return F.array_join(part, "")


def likeness(a: str, b: str, samples: int = SAMPLES) -> Column:
    """Share of equal samples: an unbiased estimate of generalised Jaccard similarity."""
    same = F.filter(F.zip_with(F.col(a), F.col(b), lambda x, y: x == y), lambda e: e)
    return F.size(same).cast("double") / samples


def next_documents(docs: DataFrame) -> DataFrame:
    """``id``, ``next_id`` (ascending, the first after the last) and ``need``: a quarter of the longest text of the id.

    Ids are dealt by ranges and follow each other inside a range; one row per range carries over.
    """
    quarter = F.floor(F.length("text") / 4).cast("int")
    ids = docs.groupBy("id").agg(F.max(quarter).alias("need"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = landed(ids.repartitionByRange(parts, "id").withColumn("part", F.spark_partition_id()), "ids")
    firsts = ranged.groupBy("part").agg(F.min("id").alias("first"))  # one row per range
    after = firsts.select("part", F.lead("first").over(Window.orderBy("part")).alias("_after"))
    first = firsts.agg(F.min("first")).first()[0]
    inside = F.lead("id").over(Window.partitionBy("part").orderBy("id"))
    linked = ranged.withColumn("_next", inside).join(after, "part")
    following = F.coalesce("_next", "_after", F.lit(first).cast("long"))
    return linked.select("id", following.alias("next_id"), "need")


def edited_documents(docs: DataFrame) -> DataFrame:
    """``id``, ``text``, ``edited`` and ``next_id`` of rows (``id``, ``text``): the last quarter from the next document."""
    links = landed(next_documents(docs), "next")
    # both joins read the same shuffle of the texts
    heads = docs.join(links.select(F.col("id").alias("_to"), F.col("next_id"), "need"), F.col("id") == F.col("next_id"))
    head = heads.groupBy("_to").agg(F.min(F.substr("text", F.lit(1), F.col("need"))).alias("head"))
    rows = docs.join(head, F.col("id") == F.col("_to")).join(links.select("id", "next_id"), "id")
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(
        F.substr("text", F.lit(1), F.length("text") - quarter), F.substr("head", F.lit(1), quarter)
    )
    return rows.select("id", "next_id", "text", edited.alias("edited"))


def fingerprint_documents(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of whole texts and of their edited forms, with the likeness to those and to the next document.

    Returns ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and
    ``near_next`` per row. Null texts are empty, and empty texts are all alike (likeness 1). A single document follows
    itself. Rows with one id are one document in the order: each row is fingerprinted, and as next document counts the
    head of the least of their texts, and the least of their signatures. Rows without an id come first, as one.
    """
    plain = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text")
    )
    both = edited_documents(plain).select(
        "id",
        "next_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("text").cast("binary"), 256).alias("own"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "text",
        "edited",
    )
    keys = ["id", "next_id", "n_chars", "own", "edited_sha256"]
    paired = landed(signatures(both, keys, "text", "edited", samples), "signatures")
    following = paired.groupBy(F.col("id").alias("next_id")).agg(F.min("s").alias("n"))
    joined = paired.join(following, "next_id")
    rows = joined.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return rows.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        fingerprint("s").alias("fingerprint"),
        fingerprint("e").alias("edited_fingerprint"),
        likeness("s", "e", samples).alias("near_edited"),
        likeness("s", "n", samples).alias("near_next"),
    )
