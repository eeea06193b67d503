"""Name lookups, top-N restriction, station rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.names import FEATURE_NAMES, STATION_NAMES
from tidemark.operators.series import with_position
from tidemark.schema import FEATURE_COLUMNS


def feature_names(spark: SparkSession) -> DataFrame:
    """Display names under both the original and the short column names."""
    by_short = {short: FEATURE_NAMES[original] for short, original in FEATURE_COLUMNS.items()}
    rows = list({**FEATURE_NAMES, **by_short}.items())
    return spark.createDataFrame(rows, "name string, english string")


def station_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STATION_NAMES.items()), "name string, english string")


def with_english(df: DataFrame, column: str, names: DataFrame, *, alias: str | None = None) -> DataFrame:
    """Left lookup of ``column`` in (name, english); the original name when absent.

    Spark broadcasts the dimension only if its measured size allows.
    """
    dim = names.select(F.col("name").alias("_name"), F.col("english").alias("_english"))
    return (
        df.join(dim, F.col(column) == F.col("_name"), "left")
        .withColumn(alias or f"{column}_english", F.coalesce("_english", column))
        .drop("_name", "_english")
    )


def station_counts(df: DataFrame, station: str = "station") -> DataFrame:
    """Rows per station, null station excluded."""
    return df.where(F.col(station).isNotNull()).groupBy(station).agg(F.count(F.lit(1)).alias("n"))


def ranked_stations(df: DataFrame, station: str = "station", **kw) -> DataFrame:
    """All stations with their 1-based rank by row count."""
    placed = with_position(
        station_counts(df, station), [], [F.col("n").desc(), F.col(station).asc()],
        pos="_pos", total="_total", **kw)
    return placed.select(station, "n", (F.col("_pos") + 1).alias("rank"))


def top_stations(df: DataFrame, count: int, station: str = "station") -> DataFrame:
    return station_counts(df, station).orderBy(F.desc("n"), F.asc(station)).limit(count)


def keep_stations(df: DataFrame, stations: DataFrame, station: str = "station") -> DataFrame:
    return df.join(stations.select(station), station, "left_semi")


def distinct_series(long: DataFrame, station: str = "station") -> DataFrame:
    """Catalog of (station, feature) pairs."""
    return long.select(station, "feature").distinct()
