"""The registered queries of this folder, each over its whole table, with SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import (
    decontaminate,
    fingerprints,
    html_extraction,
    line_dedup,
    mixing,
    near_dedup,
    quality,
    sharding,
    spelling,
    token_counts,
    toxicity,
    whitening,
    word_bpe,
)
from waymark.llm.common import table

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1(spark: SparkSession, d: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, d, "documents").select("doc_id", "text"))


def op2(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op3(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = quality.train_quality(docs, table(spark, d, "labels"))
    return quality.score_quality(docs, model).select("doc_id", "held_out", "score", "predicted")


def op4(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = toxicity.train_toxicity(docs, table(spark, d, "labels"))
    return toxicity.score_toxicity(docs, model).select("doc_id", "held_out", "score", "predicted", "n_hits")


def op5(spark: SparkSession, d: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, d, "documents").select("doc_id", "text"))


def op6(spark: SparkSession, d: str) -> DataFrame:
    return sharding.shard_documents(table(spark, d, "documents").select("doc_id", "text"))


def op7(spark: SparkSession, d: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, d, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3)::INT + 1]::DOUBLE AS weight
  FROM d GROUP BY source),
levels AS (SELECT 0 AS turn, 0.0::DOUBLE AS level
  UNION ALL SELECT turn + 1, (SELECT (1.5 * sum(source_size) - coalesce(sum(2 * source_size) FILTER (2 * source_size < weight * level), 0))
      / sum(weight) FILTER (NOT 2 * source_size < weight * level) FROM s) FROM levels WHERE turn < 60),
t AS (SELECT source, source_size, least(2.0 * source_size, weight * (SELECT level FROM levels ORDER BY turn DESC LIMIT 1))::DOUBLE AS target FROM s),
unit AS (SELECT greatest(1, least(64, floor(sum(target) / 16 + 1e-6)))::BIGINT AS words FROM t),
house AS (SELECT floor((SELECT sum(target) FROM t) / words + 0.5)::BIGINT AS blocks FROM unit),
seats AS (SELECT source, unnest(range(0, (target / (SELECT words FROM unit))::BIGINT + (SELECT count(*) FROM t)::BIGINT * 2 + 4)) AS seat, target FROM t WHERE target > 0),
won AS (SELECT source, count(*) * (SELECT words FROM unit) AS quota FROM
  (SELECT source, row_number() OVER (ORDER BY target / (2 * seat + 1) DESC, seat, encode(source) NULLS LAST) AS rank FROM seats) WHERE rank <= (SELECT blocks FROM house) GROUP BY source),
placed AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('7:' || coalesce(doc_id::VARCHAR, 'null')), doc_id, size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d)
SELECT doc_id, size, source_size, target,
  (least(greatest(coalesce(quota, 0) - start, 0), size) + least(greatest(coalesce(quota, 0) - start - source_size, 0), size))::BIGINT AS taken
FROM placed JOIN t ON placed.source IS NOT DISTINCT FROM t.source LEFT JOIN won ON placed.source IS NOT DISTINCT FROM won.source
"""


def op8(spark: SparkSession, d: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, d, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
repeated AS (SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT keyed.*, coalesce(doc_id < last_doc, false) AS gone FROM keyed LEFT JOIN repeated USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op9(spark: SparkSession, d: str) -> DataFrame:
    return html_extraction.extract_pages(table(spark, d, "pages"))


def op10(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, table(spark, d, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP10_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM
  (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
found AS (SELECT doc_id, i, s.n, array_to_string(w[i:i + s.n - 1], ' ') AS p FROM
  (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n) s),
occurs AS (SELECT doc_id, i, found.n, item_id FROM found JOIN windows USING (p, n)),
marks AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM occurs) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM
  (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM occurs) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN marks USING (doc_id) LEFT JOIN items USING (doc_id)
"""



def op11(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    model = whitening.fit_whitening(vectors, components=32)
    return whitening.component_rows(whitening.whiten(vectors, model), model, "vec_id")


def op12(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return spelling.spelling_variants(spelling.varied_words(docs))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op13(spark: SparkSession, d: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = word_bpe.encode_texts(table(spark, d, "documents").select("doc_id", "text"), path)
    both = word_bpe.decode_ids(coded, path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        digest(F.col("decoded")).alias("decoded_sha256"),
    )


QUERIES = {
    "op1_fingerprints": op1,
    "op2_token_counts": op2,
    "op3_quality": op3,
    "op4_toxicity": op4,
    "op5_near_dedup": op5,
    "op6_sharding": op6,
    "op7_mixing": op7,
    "op8_line_dedup": op8,
    "op9_html_extraction": op9,
    "op10_decontamination": op10,
    "op11_whitening": op11,
    "op12_spelling": op12,
    "op13_word_bpe": op13,
}
ORACLES = {"op7_mixing": OP7_SQL, "op8_line_dedup": OP8_SQL, "op10_decontamination": OP10_SQL}
