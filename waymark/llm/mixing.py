"""Mixing sources to target weights, by Sainte-Lague apportionment of equal-token blocks.

The documents of a source lie end to end in a seeded order, as often as the source may be repeated, and that line of
words is cut into blocks of equal length. The mix is a number of blocks, dealt to the sources one after another to the
highest quotient target / (2 * seats + 1). A source's quota is taken from the start of its line, so the seed alone
selects the blocks. A quota ends inside one document; the mixed table holds whole documents only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import SPACE, landed, placed, seeded, word_count

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 64


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, limit: int = 2) -> DataFrame:
    """``source``, ``source_size``, ``weight`` and ``target`` for rows of (``source``, ``size``).

    Weights repeat over the sources in code-point order, the null source last. The sources share ``share`` times all
    sizes by weight; a target stops at ``limit`` times its source, and the excess is shared again until none is above.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row per source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    table = landed(totals.select("source", "source_size", weight.alias("weight")), "sources")
    cap, level, capped = F.col("source_size") * limit, 0.0, -1
    whole = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    while True:
        above = cap < F.col("weight") * level
        row = table.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0)).alias("taken"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("weight"),
            F.count(F.when(above, 1)).alias("capped"),
        ).first()
        if row["capped"] == capped or not row["weight"]:
            break
        level, capped = (whole - row["taken"]) / row["weight"], row["capped"]
    target = F.least(cap.cast("double"), F.col("weight") * F.lit(level))
    return table.withColumn("target", target)


def block_length(words: float, shards: int = 16, block_words: int = BLOCK_WORDS) -> int:
    """Words of a block: shorter than ``block_words`` only where the mix has fewer words than a block for each shard."""
    return max(1, min(block_words, math.floor(words / shards + 1e-6)))


def block_quotas(targets: DataFrame, shards: int = 16, block_words: int = BLOCK_WORDS, limit: int = 2) -> DataFrame:
    """``source``, ``shard``, ``quota``: blocks of each source in each shard of the mix.

    Shards 1, 2, ... of the mix end at evenly spaced numbers of blocks. For each end the apportionment by highest
    quotients is made, and since more seats never take a seat away from a source, the difference of two ends is the
    quota of a shard. Near the divisor ``words / blocks`` the seats below are certain, so only a few quotients per source
    are ranked.
    """
    sums = targets.agg(F.sum("target"), F.count("*")).first()
    words, sources = float(sums[0] or 0.0), int(sums[1])
    blocks = math.floor(words / block_length(words, shards, block_words) + 0.5)
    ends = targets.select("source", "source_size", "target").withColumn(
        "end", F.explode(F.sequence(F.lit(1), F.lit(shards)))
    )
    house = F.floor(F.col("end") * blocks / shards).cast("long")
    fair = F.col("target") * house / F.lit(words or 1.0)
    # a divisor that gives all seats moves a source by at most its part of 1.5 * sources seats, and one for rounding
    slack = F.ceil(F.col("target") / F.lit(words or 1.0) * 1.5 * sources).cast("long") + 2
    near = ends.withColumns({"house": house, "sure": F.greatest(F.floor(fair).cast("long") - slack, F.lit(0).cast("long"))})
    near = near.withColumn("slack", slack)
    seats = near.withColumn("seat", F.explode(F.sequence(F.col("sure"), F.col("sure") + 2 * F.col("slack") + 2)))
    seats = seats.withColumn("quotient", F.col("target") / (2 * F.col("seat") + 1)).filter(F.col("target") > 0)
    certain = near.groupBy("end").agg((F.max("house") - F.sum("sure")).alias("open"))
    ranked = seats.withColumn(
        "rank",
        F.row_number().over(Window.partitionBy("end").orderBy(F.desc("quotient"), "seat", F.col("source").asc_nulls_last())),
    )
    won = ranked.join(certain, "end").filter(F.col("rank") <= F.col("open"))
    more = won.groupBy("end", "source").agg(F.count("*").alias("won"))
    same = (F.col("n.end") == F.col("m.end")) & F.col("n.source").eqNullSafe(F.col("m.source"))
    held = near.alias("n").join(more.alias("m"), same, "left").select(
        "n.source", "n.end", (F.col("n.sure") + F.coalesce("m.won", F.lit(0))).alias("seats")
    )
    before = F.lag("seats", 1, 0).over(Window.partitionBy("source").orderBy("end"))
    return held.select("source", (F.col("end") - 1).alias("shard"), (F.col("seats") - before).alias("quota"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    limit: int = 2,
    block_words: int = BLOCK_WORDS,
    shards: int = 16,
    seed: int = 7,
) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken`` and ``first_shard`` of each row of documents.

    ``taken`` is the number of the document's words in the mix, repeats counted: at most ``limit`` times its size. A
    source's taken words differ from its target by half a block, and by what its last block lacks. Null and empty
    texts have size 0 and are never taken; repeated rows are documents of their own; a mix of nothing takes nothing.
    ``first_shard`` is the shard of the mix that the document's first taken word belongs to.
    """
    sized = landed(docs.select("doc_id", "source", word_count("text").alias("size")), "sizes")
    return _mix(sized, weights, share, limit, block_words, shards, seed)


def _mix(sized: DataFrame, weights=WEIGHTS, share=1.5, limit=2, block_words=BLOCK_WORDS, shards=16, seed=7, keep=()) -> DataFrame:
    """``mix_sources`` of landed sizes (``doc_id``, ``source``, ``size``); columns ``keep`` come besides, and order what is alike."""
    targets = source_targets(sized, weights, share, limit)
    quotas = block_quotas(targets, shards, block_words, limit)
    ends = Window.partitionBy("source").orderBy("shard")
    length = block_length(float(targets.agg(F.sum("target")).first()[0] or 0.0), shards, block_words)
    run = quotas.withColumn("_end", F.sum("quota").over(ends) * length)
    own = run.groupBy("source").agg(F.max("_end").alias("_quota"), F.array_sort(F.collect_list("_end")).alias("_ends"))
    same = F.col("t.source").eqNullSafe(F.col("q.source"))
    plan = targets.alias("t").join(own.alias("q"), same).select("t.source", "t.source_size", "t.target", "q._quota", "q._ends")
    plan = landed(plan, "plan")  # its known size decides whether the join below is a broadcast
    lines = placed(sized, ["source"], ["doc_id", "size", *keep], F.col("size"), "_start", seed)
    rows = lines.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    zero = F.lit(0).cast("long")
    taken = zero
    for turn in range(limit):
        left = F.col("_quota") - F.col("_start") - turn * F.col("source_size")
        taken = taken + F.least(F.greatest(left.cast("long"), zero), F.col("size"))
    first = F.size(F.filter("_ends", lambda e: e <= F.col("_start")))
    return rows.select(*keep, "d.doc_id", "d.source", "size", "source_size", "target", taken.alias("taken"),
                       F.when(taken > 0, first).alias("first_shard"))


def _digest(df: DataFrame) -> Column:
    """A hash of all columns of a row; nulls count, and nested values as JSON."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct", "variant")}
    each = [F.to_json(F.struct(c)) if c in nested else F.col(c) for c in df.columns]
    return F.xxhash64(*[v for c in each for v in (c, c.isNull())])


def mixed_documents(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """The mix itself, with the columns of the documents: a row for each time that a document is taken, always whole.

    A source's quota ends inside one document at most, which is taken once more if at least half of its words lie in the
    quota; so the words of a source differ from those of ``mix_sources`` by half a document at most. Options are those
    of ``mix_sources``. Rows without an id are told apart by their texts.

    In the seeded order the documents of a source are taken once more up to some document, and no more behind it. So one
    row per source (that document's place, the times before and behind it) decides for every row by itself, and texts
    are neither moved nor written. ``docs`` is read twice: land it first if it is costly or differs between reads.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]  # docs may have a column called size
    used = {c: names[docs.columns.index(c)] for c in ("doc_id", "text", "source")}
    plain = docs.toDF(*names).withColumnsRenamed({v: k for k, v in used.items()})
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    size, digest = word_count("text"), _digest(plain)
    sized = landed(plain.select(key.alias("doc_id"), "source", size.alias("size"), digest.alias("_digest")), "sizes")
    mixed = _mix(sized, seed=seed, keep=["_digest"], **options).filter("size > 0")
    spot = F.struct(seeded("doc_id", seed).alias("key"), "doc_id", "size", "_digest")
    counted = mixed.select("source", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("times"), spot.alias("spot"))
    runs = counted.groupBy("source", "times").agg(F.min("spot").alias("first"), F.max("spot").alias("last"))
    cuts = runs.groupBy("source").agg(
        F.min("times").alias("low"),
        F.max("times").alias("high"),
        F.max_by("last", "times").alias("cut"),
        ((F.count("*") > 1) & (F.max_by("last", "times") == F.min_by("first", "times"))).alias("tied"),
    )
    cuts = landed(cuts, "cuts")  # its known size decides whether the joins below are broadcasts
    rows = plain.withColumn("_id", key).filter(F.col("text").rlike(f"[^{SPACE}]"))
    rows = rows.alias("d").join(cuts.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")))
    rows = rows.select("d.*", "low", "high", "cut", "tied").withColumn("_key", seeded("_id", seed))
    here = F.struct(F.col("_key"), F.col("_id"), size, digest)  # made only where the first hash is that of the cut
    same = F.col("_key") == F.col("cut.key")
    early = F.when(~same, F.col("_key") < F.col("cut.key")).when(F.col("tied"), here < F.col("cut")).otherwise(here <= F.col("cut"))
    times = F.when(early, F.col("high")).otherwise(F.col("low"))
    out = rows.withColumn("_time", F.explode(F.array_repeat(F.lit(1), times))).select(*plain.columns)
    tied = cuts.filter("tied")
    if not tied.isEmpty():
        # equal rows at the cut, of which some are taken once more: as many times comes one of them
        both = counted.alias("r").join(tied.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")))
        open_rows = both.filter("r.times = c.high AND r.spot = c.cut").groupBy("c.source").agg(F.sum(F.col("c.high") - F.col("c.low")).cast("int").alias("more"))
        open_rows = landed(open_rows, "ties")
        equal = rows.filter(F.col("tied") & same).filter(here == F.col("cut"))
        one = equal.groupBy("source").agg(F.any_value(F.struct(*plain.columns)).alias("row"))
        more = one.alias("o").join(open_rows.alias("m"), F.col("o.source").eqNullSafe(F.col("m.source")))
        out = out.unionByName(more.withColumn("_time", F.explode(F.array_repeat(F.lit(1), F.col("more")))).select("row.*"))
    return out.toDF(*docs.columns)
