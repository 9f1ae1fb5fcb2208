"""Sources, sinks, ledger and dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from checks.views import MEXICO, NEWER, check, enc, flow, months, pop, ship
from waymark.functions.calendar import fiscal_year, month_number
from waymark.functions.numbers import amount
from waymark.operators.joins import lookup
from waymark.operators.splice import append_projection
from waymark.session import landed, scratch_dir
from waymark.sources import delimited, dimensions, snapshots
from waymark.sources.delimited import inline_table


def _land_csv(df, folder: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(folder)
    return folder


@check(
    "s1_read_table",
    "enc",
    """SELECT CAST(year(date) AS INTEGER) AS year_of_date, citizenship,
              CASE WHEN year(date) % 2 = 0 THEN land_border_region END AS land_border_region,
              CAST(sum(encounter_count) AS BIGINT) AS count_of_encounters
       FROM enc GROUP BY 1, 2, 3""",
)
def s1(spark, d):
    e = enc(spark, d).withColumn("Year of Date", F.year("date")).groupBy("Year of Date", "citizenship", "land_border_region")
    rows = e.agg(F.sum("encounter_count").alias("Count of Encounters"))
    path = scratch_dir(spark, "table")
    even, odd = rows.filter(F.col("Year of Date") % 2 == 0), rows.filter(F.col("Year of Date") % 2 == 1)
    # two sheets: another order of columns, one column missing, a byte order mark
    _land_csv(even.select("citizenship", "Count of Encounters", "land_border_region", "Year of Date"), f"{path}/even")
    marked = odd.select(F.col("Year of Date").alias("\ufeffYear of Date"), F.col("citizenship").alias("CITIZENSHIP"), "Count of Encounters")
    _land_csv(marked, f"{path}/odd")
    wanted = "year_of_date int, citizenship string, land_border_region string, count_of_encounters bigint"
    return delimited.read_table(spark, [f"{path}/even", f"{path}/odd"], StructType.fromDDL(wanted))


@check(
    "s2_read_with_preamble",
    "flow",
    "SELECT year, CASE WHEN coo_iso = 'NATION_3' THEN 'NATION' || chr(10) || '3' ELSE coo_iso END AS coo_iso, coa_iso, refugees FROM flow",
)
def s2(spark, d):
    f = flow(spark, d)
    # one download per year: notes, the header, data with grouped years, quoted line breaks and short records, a footer
    origin = F.when(F.col("coo_iso") == "NATION_3", F.lit('"NATION\n3"')).otherwise(F.col("coo_iso"))
    record = F.concat_ws(",", F.concat(F.lit('"'), F.format_number("year", 0), F.lit('"')), origin, "coa_iso", F.col("refugees").cast("string"))
    notes = F.concat(F.lit("Extracted for "), F.col("year").cast("string"), F.lit("\n\n2001,is not data\nYear,Origin,Asylum,Refugees\n"))
    sheets = f.groupBy("year").agg(F.concat_ws("\n", F.collect_list(record)).alias("body"))
    path = scratch_dir(spark, "notes")
    whole = sheets.select(F.col("year").alias("sheet"), F.concat(notes, "body", F.lit("\nSource: registers")).alias("value"))
    whole.write.partitionBy("sheet").text(path)
    read = delimited.read_with_preamble(
        spark, path, ["year", "coo_iso", "coa_iso", "refugees"], "year", ["Year", "Origin", "Asylum", "Refugees"]
    )
    return read.select(
        amount("year").cast("int").alias("year"), "coo_iso", "coa_iso", F.col("refugees").try_cast("bigint").alias("refugees")
    )


@check(
    "s3_read_tagged",
    "enc",
    """SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, citizenship,
              CASE WHEN month(date) <> 7 THEN component END AS component, CAST(sum(encounter_count) AS BIGINT) AS encounter_count
       FROM enc GROUP BY 1, 2, 3, 4""",
)
def s3(spark, d):
    m = months(enc(spark, d), "citizenship", "component")
    path = scratch_dir(spark, "tagged")
    # the landing names carry the month, like one downloaded file per month; their columns differ
    named = m.withColumn("file", F.date_format("date", "MMMM-yyyy"))
    parts = [
        named.filter(F.month("date") < 7).select("file", "citizenship", "component", "encounter_count"),
        named.filter(F.month("date") > 7).select("file", "encounter_count", "component", "citizenship"),
        named.filter(F.month("date") == 7).groupBy("file", "citizenship").agg(F.sum("encounter_count").alias("Encounter count")),
    ]
    for i, part in enumerate(parts):
        part.repartition("file").write.partitionBy("file").option("header", True).csv(f"{path}/{i}")
    read = delimited.read_tagged(spark, path, {"year": r"file=[A-Za-z]+-(\d{4})", "month": r"file=([A-Za-z]+)-"})
    return read.select(
        F.col("year").try_cast("int").alias("year"),
        month_number("month").alias("month"),
        "citizenship",
        "component",
        F.col("encounter_count").try_cast("bigint").alias("encounter_count"),
    )


#: Cells that a landed file should not have: a count in words, a cell too many, a cell too few.
WORDS, MORE, FEWER = "NATION_3", "NATION_5", "NATION_7"

REJECT_SQL = """m AS (SELECT CAST(year(date) AS INTEGER) AS year, citizenship, CAST(month(date) AS INTEGER) AS month, CAST(sum(encounter_count) AS BIGINT) AS encounter_count
  FROM enc GROUP BY 1, 2, 3),
r AS (SELECT *, CASE WHEN citizenship = 'NATION_3' THEN 'encounter_count' WHEN citizenship IN ('NATION_5', 'NATION_7') THEN 'cells' END AS reason FROM m)"""


def _dirty(spark, d):
    m = enc(spark, d).groupBy(F.year("date").alias("year"), "citizenship", F.month("date").alias("month")).agg(F.sum("encounter_count").alias("n"))
    path = scratch_dir(spark, "dirty")
    name = F.col("citizenship")
    count = F.when(name == WORDS, F.concat_ws(" ", F.lit("about"), "n")).otherwise(F.col("n").cast("string"))
    extra = F.when(name == MORE, F.lit("7"))
    line = F.when(name == FEWER, F.concat_ws(",", name, "month")).otherwise(F.concat_ws(",", name, "month", count, extra))
    text = m.groupBy("year").agg(F.concat_ws("\n", F.lit("Citizenship,Month,Encounter count"), F.concat_ws("\n", F.collect_list(line))).alias("value"))
    text.write.partitionBy("year").text(path)
    kinds = StructType.fromDDL("citizenship string, month int, encounter_count bigint")
    return delimited.checked_table(spark, path, kinds, {"year": r"year=(\d{4})"})


@check(
    "s1_accepted_rows",
    "enc",
    f"WITH {REJECT_SQL} SELECT citizenship, month, encounter_count, CAST(year AS VARCHAR) AS year FROM r WHERE reason IS NULL",
)
def s1_accepted(spark, d):
    return delimited.accepted(_dirty(spark, d))


@check(
    "s3_reject_counts",
    "enc",
    f"""WITH {REJECT_SQL}, k AS (SELECT year, count(*) FILTER (reason IS NULL) AS kept, count(*) FILTER (reason IS NOT NULL) AS rejected FROM r GROUP BY 1),
    n AS (SELECT year, reason, count(*) AS records FROM r WHERE reason IS NOT NULL GROUP BY 1, 2)
    SELECT CAST(year AS VARCHAR) AS year, kept, rejected, reason, coalesce(records, 0) AS records FROM k LEFT JOIN n USING (year)""",
)
def s3_rejects(spark, d):
    return delimited.reject_counts(_dirty(spark, d), ["year"])


@check(
    "s4_unfold_pairs",
    "enc",
    """SELECT CAST(year(date) + CASE WHEN month(date) > 9 THEN 1 ELSE 0 END AS BIGINT) AS fiscal_year,
              CAST(sum(encounter_count) AS BIGINT) AS apps FROM enc GROUP BY 1""",
)
def s4(spark, d):
    years = enc(spark, d).groupBy(fiscal_year("date").alias("fy")).agg(F.sum("encounter_count").alias("n"))
    cell = F.concat(F.col("fy").cast("string"), F.lit(',"'), F.format_number("n", 0), F.lit('"'))
    line = years.agg(F.array_join(F.collect_list(cell), ",").alias("text"))
    return delimited.unfold_pairs(line, "text", ("fiscal_year", "apps"))


@check(
    "s5_inline_table",
    "enc",
    """WITH extra(fiscal_year, cat, value) AS (
         VALUES (1999, 'quota', 233650), (2000, 'quota', 297350), (2000, 'appointments', 276000))
       SELECT CAST(fiscal_year AS INTEGER) AS fiscal_year, cat, CAST(value AS BIGINT) AS value FROM extra
       UNION ALL
       SELECT CAST(year(date) + CASE WHEN month(date) > 9 THEN 1 ELSE 0 END AS INTEGER), 'component ' || component,
              CAST(sum(encounter_count) AS BIGINT) FROM enc GROUP BY 1, 2""",
)
def s5(spark, d):
    rows = [(1999, "quota", 233650), (2000, "quota", 297350), (2000, "appointments", 276000)]
    extra = inline_table(spark, rows, "fiscal_year int, cat string, value bigint")
    data = enc(spark, d).groupBy(
        fiscal_year("date").alias("fiscal_year"), F.concat(F.lit("component "), "component").alias("cat")
    )
    return extra.unionByName(data.agg(F.sum("encounter_count").alias("value")))


@check(
    "s6_write_table",
    "enc",
    """SELECT date, citizenship, CAST(sum(encounter_count) AS BIGINT) AS encounter_count FROM enc GROUP BY 1, 2""",
)
def s6(spark, d):
    m = months(enc(spark, d), "citizenship")
    path, text = scratch_dir(spark, "snapshot"), scratch_dir(spark, "snapshot-csv")
    snapshots.write_table(m, path, date="date")
    late = spark.read.parquet(path).filter(F.col("snapshot_year") >= 2000).drop("snapshot_year")
    # the CSV round trip serves the earlier years
    snapshots.write_table(m, text, date="date", fmt="csv")
    kinds = "date date, citizenship string, encounter_count bigint, snapshot_year int"
    early = spark.read.schema(kinds).option("header", True).csv(text).filter(F.col("snapshot_year") < 2000)
    return late.unionByName(early.drop("snapshot_year"))


LEDGER_SQL = """
ledger AS (SELECT 'enc' AS dataset, date '2001-06-01' AS latest_date
           UNION ALL SELECT 'ship', date '2002-01-01' UNION ALL SELECT 'old', NULL),
fresh AS (SELECT 'enc' AS dataset, max(date) AS latest_date FROM enc
          UNION ALL SELECT 'ship', max(date) FROM ship
          UNION ALL SELECT 'old', min(date) FROM ship
          UNION ALL SELECT 'new', min(date) FROM enc)"""


def _ledger(spark, d):
    e, s = enc(spark, d), ship(spark, d)
    ledger = inline_table(
        spark,
        [("enc", "2001-06-01"), ("ship", "2002-01-01"), ("old", None)], "dataset string, latest_date string"
    ).withColumn("latest_date", F.col("latest_date").cast("date"))
    first = snapshots.latest_dates({"enc": e, "ship": s})
    rest = s.agg(F.min("date").alias("latest_date")).select(F.lit("old").alias("dataset"), "latest_date")
    new = e.agg(F.min("date").alias("latest_date")).select(F.lit("new").alias("dataset"), "latest_date")
    return ledger, first.unionByName(rest).unionByName(new)


@check(
    "s7_refresh_gate",
    "enc ship",
    f"""WITH {LEDGER_SQL}
    SELECT f.dataset, f.latest_date AS new_date, l.latest_date,
           (l.latest_date IS NULL OR f.latest_date > l.latest_date) AS refresh
    FROM fresh f LEFT JOIN ledger l ON f.dataset = l.dataset""",
)
def s7(spark, d):
    ledger, fresh = _ledger(spark, d)
    return snapshots.refresh_gate(ledger, fresh.withColumnRenamed("latest_date", "new_date"))


@check(
    "s8_ledger_update",
    "enc ship",
    f"""WITH {LEDGER_SQL}
    SELECT coalesce(l.dataset, f.dataset) AS dataset, coalesce(f.latest_date, l.latest_date) AS latest_date
    FROM ledger l FULL JOIN (SELECT * FROM fresh WHERE dataset <> 'ship') f ON f.dataset = l.dataset""",
)
def s8(spark, d):
    ledger, fresh = _ledger(spark, d)
    return snapshots.ledger_update(ledger, fresh.filter(F.col("dataset") != "ship"))


@check(
    "s9_latest_good_snapshot",
    "enc ship",
    """SELECT 'enc' AS dataset, date '2001-08-01' AS snapshot_date, date,
              CAST(sum(encounter_count) AS BIGINT) AS encounter_count FROM enc GROUP BY date
       UNION ALL
       SELECT 'ship', date '2001-06-01', date, CAST(sum(encounter_count) AS BIGINT) FROM ship
       WHERE date <= date '2001-06-01' GROUP BY date""",
)
def s9(spark, d):
    def land(df, name, day):
        snapshots.land_snapshot(df.withColumns({"dataset": F.lit(name), "snapshot_date": F.lit(day).cast("date")}), path)

    path = scratch_dir(spark, "snapshots")
    e, s = landed(months(enc(spark, d)), "enc"), landed(months(ship(spark, d)), "ship")
    land(e.filter("date <= date'2001-05-01'"), "enc", "2001-05-01")
    for day in ("2001-05-01", "2001-06-01"):
        land(s.filter(F.col("date") <= F.lit(day).cast("date")), "ship", day)
    land(e, "enc", "2001-08-01")  # the refresh of ship failed
    return snapshots.newest_landed(spark, path)


@check(
    "s9_committed_snapshot",
    "enc ship",
    """SELECT 'enc' AS dataset, date '2001-08-01' AS snapshot_date, date,
              CAST(sum(encounter_count) AS BIGINT) AS encounter_count FROM enc GROUP BY date
       UNION ALL
       SELECT 'ship', date '2001-05-01', date, CAST(sum(encounter_count) AS BIGINT) FROM ship
       WHERE date <= date '2001-05-01' GROUP BY date""",
)
def s9_committed(spark, d):
    path = scratch_dir(spark, "commits")
    e, s = landed(months(enc(spark, d)), "enc"), landed(months(ship(spark, d)), "ship")
    snapshots.commit_snapshot(e.filter("date <= date'2001-05-01'"), path, "enc", "2001-05-01")
    snapshots.commit_snapshot(e, path, "enc", "2001-08-01")
    snapshots.commit_snapshot(s.filter("date <= date'2001-05-01'"), path, "ship", "2001-05-01")
    # two refreshes that went wrong: one was interrupted before its manifest, one changed after it
    s.write.parquet(f"{path}/ship-2001-06-01-interrupted")
    snapshots.commit_snapshot(s, path, "ship", "2001-07-01")
    changed = snapshots.manifests(spark, path).filter("snapshot_date = date'2001-07-01'").first()["folder"]
    s.limit(1).write.mode("overwrite").parquet(f"{path}/{changed}")
    return snapshots.newest_committed(spark, path)


@check(
    "s8_commit_ledger",
    "enc ship",
    """SELECT 'enc' AS dataset, max(date) AS latest_date FROM enc
       UNION ALL SELECT 'ship', max(date) FROM ship UNION ALL SELECT 'first', min(date) FROM enc""",
)
def s8_commit(spark, d):
    path = scratch_dir(spark, "ledger")
    e, s = enc(spark, d), ship(spark, d)
    first = e.agg(F.min("date").alias("latest_date"))
    both = first.select(F.lit("first").alias("dataset"), "latest_date").unionByName(first.select(F.lit("enc").alias("dataset"), "latest_date"))
    snapshots.commit_ledger(spark, both, path)
    snapshots.commit_ledger(spark, snapshots.latest_dates({"enc": e, "ship": s}), path)
    # a refresh that is late doesn't take the ledger back
    snapshots.commit_ledger(spark, both.filter("dataset = 'enc'"), path)
    return snapshots.read_ledger(spark, path)


@check(
    "s10_append_projection",
    "enc",
    """SELECT date, encounter_count, date >= date '2001-07-01' AS proj FROM (
         SELECT date, CAST(sum(encounter_count) AS BIGINT) AS encounter_count FROM enc GROUP BY date
         UNION ALL SELECT date '2001-09-01', CAST(61000 AS BIGINT))""",
)
def s10(spark, d):
    row = inline_table(spark, [("2001-09-01", 61000)], "date string, encounter_count bigint")
    return append_projection(months(enc(spark, d)), row.withColumn("date", F.col("date").cast("date")), NEWER)


@check(
    "s11_load_dims",
    "pop",
    f"""SELECT p.citizenship,
               CASE WHEN p.citizenship = '{MEXICO}' THEN 'VENEZUELA' ELSE p.citizenship END AS dim_name,
               p.pop, 'img/' || p.citizenship || '.png' AS img
        FROM pop p
        UNION ALL SELECT 'Other', NULL, NULL, 'other.png'
        UNION ALL SELECT 'Total', NULL, NULL, 'un.png'""",
)
def s11(spark, d):
    p = pop(spark, d)
    code = F.when(F.col("citizenship") == MEXICO, "VE").otherwise(F.upper("citizenship"))
    raw = p.select(F.lower("citizenship").alias("official_name_en"), code.alias("iso3166_1_alpha_2"))
    codes = dimensions.country_codes(raw).select(F.upper("country").alias("citizenship"), F.col("citizenship").alias("dim_name"))
    image = F.concat(F.lit("img/"), "citizenship", F.lit(".png"))
    images = dimensions.flags(p.select(F.col("citizenship").alias("country"), image.alias("image_url")), "un.png", "other.png")
    bank = p.select(
        F.concat("citizenship", F.lit(", Rep.")).alias("country_name"),
        F.explode(F.array(F.lit("SP.POP.TOTL"), F.lit("SP.DYN.LE"))).alias("series_code"),
        F.col("pop").cast("string").alias("x2024_yr2024"),
    )
    people = dimensions.population(bank, "x2024_yr2024")
    return lookup(lookup(images, codes, ["citizenship"]), people, ["citizenship"]).select(
        "citizenship", "dim_name", "pop", "img"
    )

