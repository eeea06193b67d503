"""Readings derived from the given tables, in Spark and as SQL text (FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.parsing import NA_TOKENS, NUMBER
from tidemark.operators import cleaning, series
from tidemark.schema import Layout
from tidemark.scratch import materialize, spread

FEATURES = ["f_qty", "f_price", "f_disc", "f_tax"]
TIES = ["k1", "k2", "k3", "k4"]
LAYOUT = Layout(features=FEATURES, ties=TIES)
SHORT = Layout(features=["value"], ties=["event_id"])

RAW_COLUMNS = """
  CASE WHEN l_orderkey % 211 = 0 THEN NULL
       ELSE concat('ST/', lpad(CAST(l_suppkey AS {text}), 5, '0')) END AS station,
  CASE WHEN l_orderkey % 307 = 0 THEN 'bad' ELSE CAST(l_shipdate AS {text}) END AS obs_time,
  CASE WHEN l_orderkey % 17 = 0 THEN NULL WHEN l_orderkey % 19 = 0 THEN '--'
       WHEN l_returnflag = 'A' THEN 'Ⅰ' WHEN l_returnflag = 'N' THEN 'Ⅱ' ELSE '劣Ⅴ' END AS category,
  CASE WHEN l_orderkey % 113 = 0 THEN '--' WHEN (l_orderkey*7+l_linenumber) % 23 = 0 THEN '--'
       WHEN (l_orderkey*5+l_linenumber) % 29 = 0 THEN '*'
       WHEN l_orderkey % 101 = 0 THEN CAST(l_quantity*40e0 AS {text})
       ELSE CAST(l_quantity AS {text}) END AS f_qty,
  CASE WHEN l_orderkey % 113 = 0 THEN '' WHEN (l_orderkey*3+l_linenumber) % 19 = 0 THEN NULL
       WHEN l_orderkey % 97 = 0 THEN CAST(l_extendedprice*30e0 AS {text})
       ELSE CAST(l_extendedprice AS {text}) END AS f_price,
  CASE WHEN l_orderkey % 113 = 0 THEN 'NA' WHEN (l_orderkey+l_linenumber) % 13 = 0 THEN '1d'
       ELSE CAST(l_discount AS {text}) END AS f_disc,
  CASE WHEN l_orderkey % 113 = 0 THEN 'nan' WHEN (l_orderkey*11+l_linenumber) % 31 = 0 THEN '*'
       ELSE CAST(l_tax AS {text}) END AS f_tax,
  l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_extendedprice AS k4
"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def raw_readings(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(
        f"SELECT {RAW_COLUMNS.format(text='STRING')} FROM {{lineitem}}", lineitem=spread(table(spark, sf, "lineitem")))


_derived: dict[tuple, DataFrame] = {}


def once(label: str, build):
    """Build a derived table once per application and input folder, as a pipeline would."""
    def get(spark: SparkSession, sf: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, label, sf)
        if key not in _derived:
            _derived[key] = materialize(build(spark, sf), label)
        return _derived[key]

    return get


typed = once("typed", lambda spark, sf: cleaning.type_readings(raw_readings(spark, sf), LAYOUT))
clean = once("clean", lambda spark, sf: cleaning.clean(raw_readings(spark, sf), LAYOUT))
splits = once("splits", lambda spark, sf: series.split_series(clean(spark, sf), LAYOUT))


def long_series(spark: SparkSession, sf: str) -> DataFrame:
    """Long form of the split table; the clean table has no gaps, so positions carry over."""
    return series.to_long(
        splits(spark, sf), ["station", "obs_time", *TIES, "pos", "n", "split"], FEATURES)


def short_readings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("station"), F.col("ts").alias("obs_time"), "event_id", "value")


def name_dimension(spark: SparkSession, sf: str) -> DataFrame:
    """Station names with gaps (fallback) and two stations sharing one name."""
    return table(spark, sf, "supplier").where("s_suppkey % 10 <> 3").select(
        F.expr("concat('ST/', lpad(cast(s_suppkey as string), 5, '0'))").alias("name"),
        F.expr("CASE WHEN s_suppkey = 1 THEN 'Supplier#000000000' ELSE s_name END").alias("english"))


# ---- the same tables as SQL ------------------------------------------------

_na = ", ".join("'" + t + "'" for t in NA_TOKENS)
_order = "obs_time NULLS LAST, k1, k2, k3, k4"


def _num(c: str) -> str:
    return f"CASE WHEN regexp_matches(trim({c}), '{NUMBER}') THEN TRY_CAST(trim({c}) AS DOUBLE) END AS {c}"


def _cols(fmt: str, sep: str = ", ") -> str:
    return sep.join(fmt.format(c=c) for c in FEATURES)


RAW_CTE = f"raw AS (SELECT {RAW_COLUMNS.format(text='VARCHAR')} FROM lineitem)"
TYPED_CTE = f"""{RAW_CTE}, typed AS (
  SELECT CASE WHEN station NOT IN ({_na}) THEN station END AS station,
         TRY_CAST(obs_time AS TIMESTAMP) AS obs_time,
         CASE WHEN category NOT IN ({_na}) THEN category END AS category,
         {', '.join(_num(c) for c in FEATURES)}, k1, k2, k3, k4 FROM raw)"""
KEPT_CTE = f"""{TYPED_CTE}, kept AS (SELECT * FROM typed WHERE {_cols('{c} IS NOT NULL', ' OR ')}),
quart AS (SELECT {_cols('quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}')} FROM kept)"""
FENCED_CTE = f"""{KEPT_CTE}, fenced AS (
  SELECT station, obs_time, category, k1, k2, k3, k4,
  {_cols('''CASE WHEN {c} >= q1_{c} - 2e0 * (q3_{c} - q1_{c}) AND {c} <= q3_{c} + 2e0 * (q3_{c} - q1_{c})
            THEN {c} END AS {c}''')} FROM kept, quart)"""
FILLED_CTE = f"""{FENCED_CTE}, filled AS (
  SELECT station, obs_time, category, k1, k2, k3, k4,
  {_cols('''CASE WHEN station IS NULL THEN {c} ELSE coalesce(
     last_value({c} IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
     first_value({c} IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS {c}''')}
  FROM fenced WINDOW w AS (PARTITION BY station ORDER BY {_order}))"""
CLEAN_CTE = f"""{FILLED_CTE}, med AS (SELECT {_cols('median({c}) AS m_{c}')} FROM filled),
clean AS MATERIALIZED (SELECT station, obs_time, category, k1, k2, k3, k4,
  {_cols('coalesce({c}, m_{c}) AS {c}')} FROM filled, med)"""
SPLIT_CTE = f"""{CLEAN_CTE}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY station ORDER BY {_order}) - 1 AS pos,
         count(*) OVER (PARTITION BY station) AS n FROM clean WHERE station IS NOT NULL),
splits AS MATERIALIZED (SELECT *, CASE WHEN pos < floor(n*0.8e0) THEN 'train'
  WHEN pos < floor(n*0.8e0) + floor(n*0.1e0) THEN 'val' ELSE 'test' END AS split FROM placed)"""
LONG_CTE = f"""{SPLIT_CTE}, long AS MATERIALIZED (
  SELECT * FROM (UNPIVOT (SELECT station, obs_time, k1, k2, k3, k4, pos, n, split, {_cols('{c}')} FROM splits)
  ON {_cols('{c}')} INTO NAME feature VALUE value))"""
DIM_CTE = """dim AS (SELECT concat('ST/', lpad(CAST(s_suppkey AS VARCHAR), 5, '0')) AS name,
  CASE WHEN s_suppkey = 1 THEN 'Supplier#000000000' ELSE s_name END AS english
  FROM supplier WHERE s_suppkey % 10 <> 3)"""
SHORT_CTE = """short AS (SELECT CAST(user_id AS VARCHAR) AS station, ts AS obs_time, event_id, value FROM events)"""
