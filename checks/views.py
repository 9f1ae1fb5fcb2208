"""Views over the test tables, as DataFrames and as SQL of the same content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NEWER, OLDER = "2001-07-01", "2001-06-01"
CURRENT = 2001
HOST = "NATION_1"
NCA = ["NATION_2", "NATION_3", "NATION_4"]
CHNV = ["NATION_5", "NATION_6", "NATION_7", "NATION_8"]
MEXICO = "NATION_9"
NATIONS = [f"NATION_{i}" for i in range(25)]
GROUPS = {"NCA": NCA, "CHNV": CHNV, "MEXICO": [MEXICO]}

SQL_VIEWS = {
    "enc": """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, n_name AS citizenship,
       l_returnflag AS component, c_mktsegment AS demographic, r_name AS land_border_region,
       CAST(l_quantity AS BIGINT) AS encounter_count
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "ship": """
SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, n_name AS citizenship,
       CAST(l_quantity AS BIGINT) AS encounter_count
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "flow": """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, cn.n_name AS coo_iso, sn.n_name AS coa_iso,
       CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS BIGINT) AS refugees,
       CAST(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS BIGINT) AS asylum_seekers,
       CAST(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS BIGINT) AS oip
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation sn ON s_nationkey = sn.n_nationkey GROUP BY 1, 2, 3""",
    "pop": """
SELECT n_name AS citizenship, r_name AS region, CAST(1000 * count(c_custkey) AS BIGINT) AS pop
FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey
GROUP BY n_name, r_name""",
    "country": """
SELECT n_name AS iso_code, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey""",
    # internal displacement of a country: what its own customers ordered
    "internal": """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, n_name AS iso3,
       CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice) AS BIGINT) ELSE 0 END) AS BIGINT) AS conflict_internal_displacements,
       CAST(sum(CASE WHEN o_orderstatus = 'O' THEN CAST(floor(o_totalprice) AS BIGINT) ELSE 0 END) AS BIGINT) AS disaster_internal_displacements
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
}


SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One test table; its schema is read from the file footer once, not by a job per query."""
    path = f"{folder}/{name}.parquet"
    if path not in SCHEMAS:
        SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(SCHEMAS[path]).parquet(path)


def _month(c: str):
    return F.trunc(F.col(c), "month")


def enc(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda n: table(spark, folder, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    j = j.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(
        _month("o_orderdate").alias("date"),
        F.col("n_name").alias("citizenship"),
        F.col("l_returnflag").alias("component"),
        F.col("c_mktsegment").alias("demographic"),
        F.col("r_name").alias("land_border_region"),
        F.col("l_quantity").cast("bigint").alias("encounter_count"),
    )


def ship(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda n: table(spark, folder, n)
    j = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    j = j.join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.select(
        _month("l_shipdate").alias("date"),
        F.col("n_name").alias("citizenship"),
        F.col("l_quantity").cast("bigint").alias("encounter_count"),
    )


def flow(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda n: table(spark, folder, n)
    origin = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    host = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(origin.select("c_custkey", F.col("n_name").alias("coo_iso")), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(host.select("s_suppkey", F.col("n_name").alias("coa_iso")), F.col("l_suppkey") == F.col("s_suppkey"))
    flag = lambda f: F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))).cast("bigint")
    return j.groupBy(F.year("o_orderdate").alias("year"), "coo_iso", "coa_iso").agg(
        flag("R").alias("refugees"), flag("A").alias("asylum_seekers"), flag("N").alias("oip")
    )


def pop(spark: SparkSession, folder: str) -> DataFrame:
    counts = table(spark, folder, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    j = table(spark, folder, "nation").join(counts, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    j = j.join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    people = (F.lit(1000) * F.coalesce("n", F.lit(0))).cast("bigint")
    return j.select(F.col("n_name").alias("citizenship"), F.col("r_name").alias("region"), people.alias("pop"))


def country(spark: SparkSession, folder: str) -> DataFrame:
    j = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(F.col("n_name").alias("iso_code"), F.col("r_name").alias("region"))


def internal(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda n: table(spark, folder, n)
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    status = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, F.floor("o_totalprice")).otherwise(0))
    return j.groupBy(F.year("o_orderdate").alias("year"), F.col("n_name").alias("iso3")).agg(
        status("F").cast("bigint").alias("conflict_internal_displacements"),
        status("O").cast("bigint").alias("disaster_internal_displacements"),
    )


def oracle(views: str, body: str) -> str:
    """SQL text with the named views in front."""
    parts = ", ".join(f"{v} AS ({SQL_VIEWS[v]})" for v in views.split())
    body = body.strip()
    if not parts:
        return body
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(start):
            return f"{start}{parts}, {body[len(start):]}"
    return f"WITH {parts} {body}"


def check(name: str, views: str = "", sql: str | None = None):
    """Register a query under a name, with its SQL statement."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = oracle(views, sql)
        return fn

    return add


def months(df: DataFrame, *by: str) -> DataFrame:
    """Month grain totals of a fact view."""
    return df.groupBy("date", *by).agg(F.sum("encounter_count").alias("encounter_count"))


def r6(column, name: str | None = None):
    c = F.round(F.col(column) if isinstance(column, str) else column, 6)
    return c.alias(name or column) if isinstance(column, str) or name else c


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Round ratio columns for the comparison."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def date_text(df: DataFrame, column: str = "date") -> DataFrame:
    return df.withColumn(column, F.date_format(column, "yyyy-MM-dd"))
