"""Scores, model comparisons, overlays, and table round trips.

Until a forecaster runs, scores come from two simple predictors of the readings
themselves: the previous value (``persist``, also at 1 to 5 steps) and the mean
of the last three (``ma3``).
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog import fixtures as fx
from catalog import query, r6, s6
from tidemark.functions import parsing
from tidemark.operators import lookup, metrics as m
from tidemark.operators.series import lagged, with_position
from tidemark.plans import reports
from tidemark.schema import METRICS
from tidemark.scratch import scratch_path
from tidemark.sources import tables

KEYS = ["station", "feature"]


def _lags(spark, sf):
    """The last five values beside every reading. The split table has no gaps, so its wide rows are shifted and then made long."""
    rows = fx.splits(spark, sf).select("station", "obs_time", "split", "pos", "n", *[F.col(c).cast("double").alias(c) for c in fx.FEATURES])
    shifts = {f"{c}_{k}": (c, k) for c in fx.FEATURES for k in range(1, 6)}
    wide = lagged(rows, ["station"], shifts, balanced=True)
    each = F.array(*[F.struct(
        F.lit(c).alias("feature"), F.col(c).alias("value"), *[F.col(f"{c}_{k}").alias(f"l{k}") for k in range(1, 6)]) for c in fx.FEATURES])
    long = wide.select("station", "obs_time", "split", "pos", "n", F.inline(each)).where("value is not null")
    return long.select(*KEYS, "obs_time", "split", "pos", "n", "value", *[f"l{k}" for k in range(1, 6)])


lags = fx.once("lags", _lags)


def predictions(spark, sf):
    rows = lags(spark, sf)
    three = [F.col(f"l{k}") for k in (1, 2, 3)]
    total = F.col("l1") + F.coalesce("l2", F.lit(0.0)) + F.coalesce("l3", F.lit(0.0))
    known = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in three), F.lit(0))
    wide = rows.withColumn("persist", F.col("l1")).withColumn(
        "ma3", F.when(F.col("l1").isNotNull(), total / F.nullif(known, F.lit(0))))
    return wide.withColumnRenamed("value", "actual").unpivot(
        [*KEYS, "obs_time", "split", "pos", "n", "actual"], ["persist", "ma3"], "model", "forecast")


def step_predictions(spark, sf):
    rows = lags(spark, sf).withColumnRenamed("value", "actual")
    steps = [f"l{k}" for k in range(1, 6)]
    return rows.unpivot([*KEYS, "pos", "actual"], steps, "step", "forecast").withColumn(
        "step", F.expr("try_cast(substr(step, 2) AS int)"))


def _metrics(spark, sf):
    single = m.forecast_metrics(predictions(spark, sf), [*KEYS, "model"]).withColumn(
        "model_type", F.initcap("model"))
    families = {name: single.where(F.col("model") == name).drop("model") for name in ("persist", "ma3")}
    families["persist_steps"] = m.step_metrics(step_predictions(spark, sf), KEYS, "Persist")
    return m.union_metrics(families)


metrics = fx.once("metrics", _metrics)

_ma3 = """(l1 + coalesce(l2, 0e0) + coalesce(l3, 0e0)) / (1 + CASE WHEN l2 IS NULL THEN 0 ELSE 1 END
  + CASE WHEN l3 IS NULL THEN 0 ELSE 1 END)"""
_scores = """sqrt(avg((actual - forecast) * (actual - forecast))) AS RMSE, avg(abs(actual - forecast)) AS MAE,
  avg(abs(actual - forecast) / abs(nullif(actual, 0))) * 100 AS MAPE,
  1 - sum((actual - forecast) * (actual - forecast)) / nullif(var_pop(actual) * count(*), 0) AS R2"""
METRICS_CTE = f"""{fx.LONG_CTE}, lags AS (SELECT station, feature, obs_time, split, pos, n, value AS actual,
  {', '.join(f'lag(value, {k}) OVER w AS l{k}' for k in range(1, 6))} FROM long
  WINDOW w AS (PARTITION BY station, feature ORDER BY pos)),
  pairs AS (SELECT station, feature, obs_time, split, pos, n, actual, 'persist' AS model, l1 AS forecast FROM lags
    UNION ALL SELECT station, feature, obs_time, split, pos, n, actual, 'ma3', {_ma3} FROM lags),
  step_pairs AS ({' UNION ALL '.join(f'SELECT station, feature, {k} AS step, actual, l{k} AS forecast FROM lags' for k in range(1, 6))}),
  steps AS (SELECT station, feature, step, {_scores} FROM step_pairs WHERE forecast IS NOT NULL GROUP BY ALL),
  metrics AS MATERIALIZED (
    SELECT station, feature, model, upper(model[1]) || model[2:] AS model_type, NULL AS step, {_scores}
      FROM pairs WHERE forecast IS NOT NULL GROUP BY station, feature, model
    UNION ALL SELECT station, feature, 'persist_steps', 'Persist-Step' || step, step, RMSE, MAE, MAPE, R2 FROM steps
    UNION ALL SELECT station, feature, 'persist_steps', 'Persist-Avg', NULL, avg(RMSE), avg(MAE), avg(MAPE), avg(R2)
      FROM steps GROUP BY station, feature)"""
_four = ", ".join(f"{s6(x)} AS {x}" for x in METRICS)
_avg_four = ", ".join(f"{s6(f'avg({x})')} AS {x}" for x in METRICS)


def _round(df):
    return df.withColumns({x: r6(x) for x in METRICS})


@query("score_forecasts", f"""WITH {METRICS_CTE}
  SELECT station, feature, model, {_four} FROM metrics WHERE model <> 'persist_steps'""")
def score_forecasts(spark, sf):
    return _round(m.forecast_metrics(predictions(spark, sf), [*KEYS, "model"]))


@query("score_steps", f"""WITH {METRICS_CTE} SELECT station, feature, model_type, CAST(step AS INTEGER) AS step, {_four}
  FROM metrics WHERE model = 'persist_steps'""")
def score_steps(spark, sf):
    return _round(m.step_metrics(step_predictions(spark, sf), KEYS, "Persist"))


@query("union_metrics", f"""WITH {METRICS_CTE}
  SELECT station, feature, model, model_type, CAST(step AS INTEGER) AS step, {_four} FROM metrics""")
def union_metrics(spark, sf):
    return _round(_metrics(spark, sf))


@query("model_comparison", f"WITH {METRICS_CTE} SELECT model, {_avg_four} FROM metrics GROUP BY model")
def model_comparison(spark, sf):
    return _round(reports.model_comparison(metrics(spark, sf)))


@query("model_comparison_without_steps", f"""WITH {METRICS_CTE} SELECT model, {_avg_four} FROM metrics
  WHERE NOT coalesce(contains(model_type, 'Step'), false) GROUP BY model""")
def model_comparison_without_steps(spark, sf):
    return _round(reports.model_comparison(metrics(spark, sf), exclude_steps=True))


def _rank_sql(keys: str, where: str = "") -> str:
    k = f"{keys}, " if keys else ""
    part = f"{k}metric"
    return f"""WITH {METRICS_CTE}, a AS (SELECT {k}model, avg(RMSE) AS RMSE, avg(MAE) AS MAE, avg(MAPE) AS MAPE,
      avg(R2) AS R2 FROM metrics {where} GROUP BY ALL),
      u AS ({' UNION ALL '.join(f"SELECT {k}model, '{x}' AS metric, {x} AS value FROM a" for x in METRICS)})
      SELECT {k}model, metric, {s6('value')} AS value, CAST(row_number() OVER (PARTITION BY {part} ORDER BY
        CASE WHEN metric = 'R2' THEN -value ELSE value END NULLS LAST, model) AS INTEGER) AS rank FROM u"""


@query("model_ranking", _rank_sql(""))
def model_ranking(spark, sf):
    return m.rank_models(m.mean_metrics(metrics(spark, sf), ["model"])).withColumn("value", r6("value"))


@query("feature_comparison", _rank_sql("feature", "WHERE NOT coalesce(contains(model_type, 'Step'), false)"))
def feature_comparison(spark, sf):
    return reports.feature_comparison(metrics(spark, sf)).withColumn("value", r6("value"))


@query("station_comparison", _rank_sql("station"))
def station_comparison(spark, sf):
    return reports.station_comparison(metrics(spark, sf)).withColumn("value", r6("value"))


@query("step_curves", f"""WITH {METRICS_CTE} SELECT station, feature, model,
  TRY_CAST(nullif(regexp_extract(model_type, 'Step([0-9]+)', 1), '') AS INTEGER) AS step,
  {s6('RMSE')} AS RMSE, {s6('R2')} AS R2 FROM metrics WHERE contains(model_type, 'Step')""")
def step_curves(spark, sf):
    return m.step_curves(metrics(spark, sf)).withColumns({c: r6(c) for c in ("RMSE", "R2")})


@query("model_summary", f"""WITH {METRICS_CTE} SELECT model, {_avg_four}, count(*) AS count FROM metrics
  GROUP BY model HAVING avg(RMSE) IS NOT NULL""")
def model_summary(spark, sf):
    return _round(reports.model_summary(metrics(spark, sf)))


@query("scores_of_type", f"""WITH {METRICS_CTE} SELECT station || '-' || feature AS label, model_type, {_four}
  FROM metrics WHERE model_type = 'Ma3'""")
def scores_of_type(spark, sf):
    return _round(reports.scores_by_type(metrics(spark, sf), "Ma3"))


_text = " || chr(10) || ".join(f"printf('  {x}: %.4f', {x})" for x in METRICS)
_best = """one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station, feature, model
  ORDER BY contains(model_type, 'Step'), model_type DESC) AS r FROM metrics) WHERE r = 1)"""


_models = ("persist", "ma3", "persist_steps")


@query("metrics_lookup", f"""WITH {METRICS_CTE}, {_best} SELECT station, feature, count(*) AS models,
  {', '.join(s6(f"max({x}) FILTER (WHERE model = '{k}')") + f' AS {k}_{x}' for k in _models for x in METRICS)}
  FROM one GROUP BY ALL""")
def metrics_lookup(spark, sf):
    found = reports.metrics_lookup(metrics(spark, sf))
    return found.select(
        *KEYS, F.size("scores").cast("long").alias("models"),
        *[r6(F.col("scores")[k][x]).alias(f"{k}_{x}") for k in _models for x in METRICS])


@query("metrics_text", f"""WITH {METRICS_CTE}, {_best}
  SELECT station, feature, replace(printf('%s', string_agg(model || ':' || chr(10) || {_text}, chr(10) ORDER BY model)),
  '-0.0000', '0.0000') AS text FROM one GROUP BY ALL""")
def metrics_text(spark, sf):
    text = reports.metrics_lookup(metrics(spark, sf)).select(*KEYS, "text")
    return text.withColumn("text", F.replace("text", F.lit("-0.0000"), F.lit("0.0000")))


# The five stations come first: no lag or score is taken of any other.
_overlay_cte = METRICS_CTE.replace(", long AS MATERIALIZED (", """, s AS (SELECT station FROM splits GROUP BY station
    HAVING count(DISTINCT split) = 3 ORDER BY station LIMIT 5), shown AS MATERIALIZED (SELECT * FROM splits SEMI JOIN s USING (station)),
  long AS MATERIALIZED (""").replace("FROM splits)\n  ON", "FROM shown)\n  ON")


@query("train_test_overlay", f"""WITH {_overlay_cte}, {_best},
  o AS MATERIALIZED (SELECT station, feature, {', '.join(s6(f"max({x}) FILTER (WHERE model = '{k}')") + f' AS {k}_{x}' for k in _models for x in METRICS)}
    FROM one GROUP BY ALL)
  SELECT l.station, l.feature, obs_time, pos, split, value, o.* EXCLUDE (station, feature)
  FROM long l LEFT JOIN o ON o.station = l.station AND o.feature = l.feature
  WHERE split IN ('train', 'test')""")
def train_test_overlay(spark, sf):
    out = reports.overlay(fx.splits(spark, sf), metrics(spark, sf), fx.LAYOUT)
    return out.select(
        *KEYS, "obs_time", "pos", "split", "value",
        *[r6(F.col("scores")[k][x]).alias(f"{k}_{x}") for k in _models for x in METRICS])


@query("forecast_by_time", f"""WITH {METRICS_CTE} SELECT station, feature, pos, obs_time, {s6('actual')} AS actual,
  {s6('forecast')} AS forecast FROM pairs WHERE split = 'test' AND model = 'ma3'""")
def forecast_by_time(spark, sf):
    """Forecasts joined to actual test values on the reading."""
    pairs = predictions(spark, sf).where("split = 'test' and model = 'ma3'")
    actual = fx.long_series(spark, sf).where("split = 'test'").select(
        *KEYS, "pos", "obs_time", F.col("value").alias("actual"))
    out = actual.join(pairs.select(*KEYS, "pos", "forecast"), [*KEYS, "pos"])
    return out.select(*KEYS, "pos", "obs_time", r6("actual").alias("actual"), r6("forecast").alias("forecast"))


@query("forecast_by_position", f"""WITH {METRICS_CTE}, t AS (SELECT station, feature, value,
    row_number() OVER (PARTITION BY station, feature ORDER BY pos DESC) AS back FROM long WHERE split = 'test'),
  f AS (SELECT station, feature, forecast, row_number() OVER (PARTITION BY station, feature ORDER BY pos DESC) AS back
    FROM (SELECT *, row_number() OVER (PARTITION BY station, feature ORDER BY pos) AS r FROM pairs
          WHERE split = 'test' AND model = 'ma3') WHERE r > 12)
  SELECT station, feature, back, {s6('value')} AS actual, {s6('forecast')} AS forecast
  FROM t JOIN f USING (station, feature, back)""")
def forecast_by_position(spark, sf):
    """Forecasts without times, matched to the last test points."""
    order = [F.col("pos").asc()]
    test = fx.long_series(spark, sf).where("split = 'test'").select(*KEYS, "pos", "value")
    actual = with_position(test.withColumn("_p", F.col("pos")).drop("pos"), KEYS, [F.col("_p").asc()]).drop("_p")
    mine = predictions(spark, sf).where("split = 'test' and model = 'ma3'").select(*KEYS, "pos", "forecast")
    placed = with_position(mine, KEYS, order, pos="_r", total="_n").where("_r >= 12")
    forecast = placed.select(*KEYS, "forecast", (F.col("_r") - 12).alias("pos"), (F.col("_n") - 12).alias("n"))
    actual = actual.withColumn("back", F.col("n") - F.col("pos"))
    out = m.align_right(actual, forecast, KEYS)
    return out.select(*KEYS, "back", r6("value").alias("actual"), r6("forecast").alias("forecast"))


_one = "station = 'ST/00003' AND feature = 'f_price'"


def _drill(spark, sf):
    return reports.drilldown(
        fx.long_series(spark, sf), predictions(spark, sf).where("split = 'test'"), metrics(spark, sf),
        "ST/00003", "f_price", "ma3")


@query("drilldown_series", f"WITH {fx.LONG_CTE} SELECT obs_time, pos, split, value FROM long WHERE {_one}")
def drilldown_series(spark, sf):
    return _drill(spark, sf)["series"].select("obs_time", "pos", "split", "value")


@query("drilldown_forecast", f"""WITH {METRICS_CTE} SELECT obs_time, pos, {s6('actual')} AS actual,
  {s6('forecast')} AS forecast FROM pairs WHERE {_one} AND split = 'test' AND model = 'ma3'""")
def drilldown_forecast(spark, sf):
    return _drill(spark, sf)["forecast"].select(
        "obs_time", "pos", r6("actual").alias("actual"), r6("forecast").alias("forecast"))


@query("drilldown_scores", f"""WITH {METRICS_CTE} SELECT model, model_type, station || '-' || feature AS label, {_four}
  FROM metrics WHERE {_one}""")
def drilldown_scores(spark, sf):
    return _round(_drill(spark, sf)["scores"])


@query("series_catalog", f"WITH {fx.LONG_CTE} SELECT DISTINCT station, feature FROM long WHERE split = 'train'")
def series_catalog(spark, sf):
    return reports.catalog_lists(fx.long_series(spark, sf), metrics(spark, sf))["series"]


@query("model_catalog", f"WITH {METRICS_CTE} SELECT DISTINCT model FROM metrics")
def model_catalog(spark, sf):
    return reports.catalog_lists(fx.long_series(spark, sf), metrics(spark, sf))["models"]


@query("labels_and_keys", f"""WITH {METRICS_CTE} SELECT translate(station, '/\\:', '___') AS safe,
  station || '_' || feature AS series_key, station || '-' || feature AS series_label,
  TRY_CAST(nullif(regexp_extract(model_type, 'Step([0-9]+)', 1), '') AS INTEGER) AS step,
  contains(model_type, 'Step') AS is_step, printf('%.3f', RMSE) AS rmse_text FROM metrics""")
def labels_and_keys(spark, sf):
    return metrics(spark, sf).select(
        parsing.safe_key(F.col("station")).alias("safe"),
        parsing.series_key(F.col("station"), F.col("feature")).alias("series_key"),
        parsing.series_label(F.col("station"), F.col("feature")).alias("series_label"),
        parsing.step_number(F.col("model_type")).alias("step"),
        parsing.has_step(F.col("model_type")).alias("is_step"),
        parsing.fixed(F.col("RMSE"), 3).alias("rmse_text"))


# ---- round trips through files ---------------------------------------------

@query("read_raw_csv", f"WITH {fx.TYPED_CTE} SELECT station, obs_time, category, {', '.join(fx.FEATURES)}, k1, k2, k3, k4 FROM typed")
def read_raw_csv(spark, sf):
    """Raw readings written as CSV text and scanned back with the missing tokens removed."""
    raw = fx.raw_readings(spark, sf)
    path = scratch_path(spark, "raw-csv")
    tables.write_table(raw, path, fmt="csv")
    strings = T.StructType([T.StructField(c, T.StringType()) for c in raw.columns])
    back = tables.read_readings(spark, path, strings)
    ties = {c: raw.schema[c].dataType for c in fx.TIES}
    back = back.withColumns({c: F.col(c).try_cast(t) for c, t in ties.items()})
    from tidemark.operators.cleaning import type_readings

    return type_readings(back, fx.LAYOUT)


_clean_columns = f"station, obs_time, category, {', '.join(fx.FEATURES)}, k1, k2, k3, k4"


def _clean_round_trip(spark, sf, fmt):
    df = fx.clean(spark, sf)
    path = scratch_path(spark, f"clean-{fmt}")
    tables.write_clean(df, path, fmt)
    schema = tables.clean_schema(fx.LAYOUT, {c: df.schema[c].dataType for c in fx.TIES})
    schema = T.StructType([schema[c] for c in df.columns])
    return tables.read_clean(spark, path, schema, fmt)


@query("clean_round_trip_parquet", f"WITH {fx.CLEAN_CTE} SELECT {_clean_columns} FROM clean")
def clean_round_trip_parquet(spark, sf):
    return _clean_round_trip(spark, sf, "parquet")


@query("clean_round_trip_csv", f"WITH {fx.CLEAN_CTE} SELECT {_clean_columns} FROM clean")
def clean_round_trip_csv(spark, sf):
    return _clean_round_trip(spark, sf, "csv")


@query("splits_round_trip", f"WITH {fx.SPLIT_CTE} SELECT {_clean_columns}, pos, n, split FROM splits")
def splits_round_trip(spark, sf):
    df = fx.splits(spark, sf)
    path = scratch_path(spark, "splits")
    tables.write_splits(df, path)
    return tables.read_splits(spark, path, df.schema).select(df.columns)


_means = ", ".join(f"{s6(f'avg({c})')} AS {c}" for c in fx.FEATURES)


@query("splits_round_trip_by_station", f"""WITH {fx.SPLIT_CTE}
  SELECT station, split, count(*) AS n, min(pos) AS first, max(pos) AS last, {_means} FROM splits GROUP BY ALL""")
def splits_round_trip_by_station(spark, sf):
    """One directory per (split, station); names with a slash survive."""
    df = fx.splits(spark, sf)
    path = scratch_path(spark, "splits-by-station")
    tables.write_splits(df, path, by_station=True)
    back = tables.read_splits(spark, path, df.schema)
    return back.groupBy("station", "split").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"),
        *[r6(F.avg(c)).alias(c) for c in fx.FEATURES])


@query("split_station_files", f"""WITH {fx.SPLIT_CTE}
  SELECT translate(station, '/', '_') AS station, split, pos, n, obs_time, {', '.join(fx.FEATURES)} FROM splits""")
def split_station_files(spark, sf):
    """One file per split and station, columns in another order in one split, read back by header."""
    df = fx.splits(spark, sf)
    columns = ["pos", "n", "obs_time", *fx.FEATURES]
    path = scratch_path(spark, "station-files")
    tables.write_station_files(df.where("split <> 'val'"), path, columns)
    tables.write_station_files(df.where("split = 'val'"), path, columns[::-1])
    return tables.read_station_files(spark, path, T.StructType([df.schema[c] for c in columns]))


_metric_columns = f"station, feature, model, model_type, CAST(step AS INTEGER) AS step, {_four}"


@query("metrics_round_trip", f"WITH {METRICS_CTE} SELECT {_metric_columns} FROM metrics")
def metrics_round_trip(spark, sf):
    path = scratch_path(spark, "metrics")
    tables.write_metrics(metrics(spark, sf), path)
    return _round(tables.read_metrics(spark, path)).drop("params")


@query("metrics_files", f"WITH {METRICS_CTE} SELECT {_metric_columns} FROM metrics")
def metrics_files(spark, sf):
    """One CSV table per model family, columns differing, read back by header name."""
    path = scratch_path(spark, "metrics-files")
    table = metrics(spark, sf)
    steps = F.col("model") == "persist_steps"
    tables.write_metrics_files(table.where(steps), path)
    tables.write_metrics_files(table.where(~steps).select(*[c for c in table.columns[::-1] if c != "step"]), path)
    tables.write_table(reports.model_comparison(metrics(spark, sf)), f"{path}/model_comparison.csv", fmt="csv")
    return _round(tables.read_metrics_files(spark, f"{path}/*.csv")).drop("params")


@query("statistics_round_trip", f"WITH {METRICS_CTE} SELECT model, {_avg_four} FROM metrics GROUP BY model")
def statistics_round_trip(spark, sf):
    path = scratch_path(spark, "stats")
    tables.write_stats({"model_comparison": reports.model_comparison(metrics(spark, sf))}, path)
    return _round(spark.read.parquet(f"{path}/model_comparison"))


@query("station_names_in_metrics", f"""WITH {METRICS_CTE}, {fx.DIM_CTE}
  SELECT coalesce(english, station) AS station_english, model, count(*) AS n, {s6('avg(RMSE)')} AS RMSE
  FROM metrics LEFT JOIN dim ON name = station GROUP BY ALL""")
def station_names_in_metrics(spark, sf):
    named = lookup.with_english(metrics(spark, sf), "station", fx.name_dimension(spark, sf))
    return named.groupBy("station_english", "model").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("RMSE")).alias("RMSE"))
