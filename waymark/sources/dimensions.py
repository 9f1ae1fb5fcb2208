"""Country codes, flags and population."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.text import before_first_comma
from waymark.sources.delimited import inline_table

# Fixed value: the series that holds total population.
POPULATION_SERIES = "SP.POP.TOTL"


def country_codes(raw: DataFrame) -> DataFrame:
    """Lower-case code and upper-case name; the long official name of code ``ve`` is shortened."""
    code = F.lower("iso3166_1_alpha_2")
    name = F.when(code == "ve", F.lit("VENEZUELA")).otherwise(F.upper("official_name_en"))
    return raw.select(F.col("official_name_en").alias("country"), code.alias("fips"), name.alias("citizenship"))


def flags(raw: DataFrame, total_image: str, other_image: str) -> DataFrame:
    """Flag images with the two extra rows for the total and the residual."""
    extra = inline_table(
        raw.sparkSession,
        [("Total", total_image), ("Other", other_image)], "citizenship string, img string"
    )
    return raw.select(F.col("country").alias("citizenship"), F.col("image_url").alias("img")).unionByName(extra)


def population(raw: DataFrame, year_column: str, series: str = POPULATION_SERIES) -> DataFrame:
    """Population of one year per upper-case country name, text after the first comma dropped."""
    return raw.filter(F.col("series_code") == series).select(
        before_first_comma(F.upper("country_name")).alias("citizenship"),
        F.col(year_column).try_cast("bigint").alias("pop"),
    )


def group_population(pop: DataFrame, group, value: str = "pop") -> DataFrame:
    """Population of country groups."""
    return pop.groupBy(group.alias("group")).agg(F.sum(value).alias(value))
