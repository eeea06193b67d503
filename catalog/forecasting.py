"""Forecasters over every series."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog import query, r6, s6
from catalog.prepare import rows_per_block, short_split
from tidemark.operators import learners, linear, metrics as m
from tidemark.plans import forecast
from tidemark.operators.series import floors
from tidemark.scratch import materialize, scratch_path

KEYS = ["station", "feature"]


def _long(spark, sf):
    return fx.long_series(spark, sf).select(*KEYS, "obs_time", "pos", "n", "split", "value")


def _linear(spark, sf, orders, model="arima", **kw):
    long = _long(spark, sf)
    models = linear.fit_linear(long, KEYS, orders, model=model, **kw)
    return long, models


_ar1 = f"""{fx.LONG_CTE}, c AS (SELECT station, feature, count(*) FILTER (WHERE split <> 'test') AS n_fit FROM long GROUP BY ALL),
  l AS (SELECT station, feature, pos, value AS y, lag(value) OVER w AS x FROM long WHERE split <> 'test'
    WINDOW w AS (PARTITION BY station, feature ORDER BY pos)),
  f AS (SELECT station, feature, regr_slope(y, x) AS phi, regr_intercept(y, x) AS c0,
    (regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / regr_count(y, x) AS s2
    FROM l WHERE x IS NOT NULL GROUP BY ALL),
  e AS (SELECT l.station, l.feature, l.y AS last FROM l JOIN c USING (station, feature) WHERE l.pos = n_fit - 1),
  t AS (SELECT long.*, pos - n_fit + 1 AS step FROM long JOIN c USING (station, feature) WHERE split = 'test'),
  g AS (SELECT t.station, t.feature, t.obs_time, t.step, t.value AS actual,
    c0 / (1 - phi) + pow(phi, step) * (last - c0 / (1 - phi)) AS forecast,
    1.959963984540054 * sqrt(s2 * (1 - pow(phi, 2 * step)) / (1 - phi * phi)) AS half
    FROM t JOIN f USING (station, feature) JOIN e USING (station, feature))"""
_ar1_sql = f"""WITH {_ar1} SELECT station, feature, obs_time, step, actual, {s6('forecast', 4)} AS forecast,
  {s6('forecast - half', 4)} AS lo, {s6('forecast + half', 4)} AS hi FROM g"""


def _ar1_rows(spark, sf, steps_per_row=linear.STEPS_PER_ROW, **kw):
    long, models = _linear(spark, sf, [linear.Order(1, 0, 0)], **kw)
    out = linear.against_actual(long, linear.forecast_linear(models, KEYS, steps_per_row=steps_per_row), KEYS)
    return out.select(*KEYS, "obs_time", "step", "actual", *[r6(c, 4).alias(c) for c in ("forecast", "lo", "hi")])


@query("ar1_forecast", _ar1_sql)
def ar1_forecast(spark, sf):
    """First-order autoregression: fit on train and validation, forecast every test step."""
    return _ar1_rows(spark, sf)


@query("ar1_forecast_segments", _ar1_sql)
def ar1_forecast_segments(spark, sf):
    """The same with series and horizons cut into short pieces."""
    return _ar1_rows(spark, sf, steps_per_row=17, group_rows=rows_per_block(spark, sf))


@query("ar2_coefficients", f"""WITH {fx.LONG_CTE}, l AS (SELECT station, feature, value AS y,
    lag(value, 1) OVER w AS x1, lag(value, 2) OVER w AS x2 FROM long WHERE split <> 'test'
    WINDOW w AS (PARTITION BY station, feature ORDER BY pos)),
  s AS (SELECT station, feature, covar_pop(x1, x1) AS a, covar_pop(x1, x2) AS b, covar_pop(x2, x2) AS d,
    covar_pop(y, x1) AS u, covar_pop(y, x2) AS v FROM l WHERE x2 IS NOT NULL GROUP BY ALL)
  SELECT station, feature, {s6('(u * d - v * b) / (a * d - b * b)')} AS phi1,
    {s6('(a * v - b * u) / (a * d - b * b)')} AS phi2 FROM s""")
def ar2_coefficients(spark, sf):
    _, models = _linear(spark, sf, [linear.Order(2, 0, 0)])
    return models.select(*KEYS, r6(F.col("ar")[0]).alias("phi1"), r6(F.col("ar")[1]).alias("phi2"))


@query("ar1_metrics", f"""WITH {_ar1} SELECT station, feature,
  {s6('sqrt(avg((actual - forecast) * (actual - forecast)))')} AS RMSE,
  {s6('avg(abs(actual - forecast))')} AS MAE FROM g GROUP BY ALL""")
def ar1_metrics(spark, sf):
    long, models = _linear(spark, sf, [linear.Order(1, 0, 0)])
    pairs = linear.against_actual(long, linear.forecast_linear(models, KEYS), KEYS)
    return m.forecast_metrics(pairs, KEYS).select(*KEYS, r6("RMSE").alias("RMSE"), r6("MAE").alias("MAE"))


@query("ar1_one_step", f"""WITH {_ar1}, a AS (SELECT station, feature, pos, value,
    lag(value) OVER (PARTITION BY station, feature ORDER BY pos) AS x FROM long)
  SELECT station, feature, pos, {s6('c0 + phi * x', 3)} AS linear, {s6('value - c0 - phi * x', 3)} AS error
  FROM a JOIN f USING (station, feature) WHERE pos >= 1""")
def ar1_one_step(spark, sf):
    """One-step predictions and residuals of the fitted autoregression on every reading."""
    long, models = _linear(spark, sf, [linear.Order(1, 0, 0)])
    out = linear.one_step_errors(long, models, KEYS).where("linear is not null")
    return out.select(*KEYS, "pos", r6("linear", 3).alias("linear"), r6("error", 3).alias("error"))


arima_models = fx.once(
    "arima-models", lambda spark, sf: _linear(spark, sf, linear.arima_orders())[1])
sarima_models = fx.once(
    "sarima-models", lambda spark, sf: _linear(spark, sf, linear.sarima_orders(12), "sarima")[1])


@query("arima_models")
def arima_models_query(spark, sf):
    """Order search over p 0-3, d 0-1, q 0-2 for every series."""
    return _linear(spark, sf, linear.arima_orders())[1]


@query("arima_forecast")
def arima_forecast(spark, sf):
    models = arima_models(spark, sf)
    return linear.against_actual(_long(spark, sf), linear.forecast_linear(models, KEYS), KEYS)


@query("sarima_forecast")
def sarima_forecast(spark, sf):
    models = sarima_models(spark, sf)
    return linear.against_actual(_long(spark, sf), linear.forecast_linear(models, KEYS), KEYS)


# ---- learned forecasters ---------------------------------------------------

@query("boosted_trees")
def boosted_trees(spark, sf):
    return learners.one_step(_long(spark, sf), KEYS, "xgboost", learners.boosted())[0]


@query("boosted_tree_importances")
def boosted_tree_importances(spark, sf):
    samples = learners.scaled_samples(_long(spark, sf), KEYS, "xgboost", packed=True)
    return learners.importances(spark, learners.fit_features(samples, learners.boosted())["y1"])


@query("sequence_one_step")
def sequence_one_step(spark, sf):
    return learners.one_step(_long(spark, sf), KEYS, "cnn_lstm", learners.forest(), packed=True)[0]


_LAGS, _STEPS = 12, 5
_t, _v, _e = floors("cnn_gru_attention", _STEPS)
_ridge_sql = f"""WITH RECURSIVE {fx.LONG_CTE}, s AS (SELECT station, feature, avg(value) FILTER (WHERE split = 'train') AS center,
    stddev_samp(value) FILTER (WHERE split = 'train') AS scale, count(*) FILTER (WHERE split = 'train') AS n_train,
    count(*) FILTER (WHERE split = 'val') AS n_val, count(*) FILTER (WHERE split = 'test') AS n_test FROM long GROUP BY ALL),
  w AS (SELECT station, feature, split, obs_time, pos, row_number() OVER v - 1 AS sp, count(*) OVER (PARTITION BY station, feature, split) AS sn,
    [{', '.join(f'lag(value, {k}) OVER v' for k in range(1, _LAGS + 1))}] AS x,
    [{', '.join(f'lead(value, {k}) OVER v' for k in range(_STEPS))}] AS y FROM long
    WINDOW v AS (PARTITION BY station, feature, split ORDER BY pos)),
  z AS MATERIALIZED (SELECT station, feature, split, obs_time, pos, center, scale, list_transform(list_concat(x, y), lambda a: (a - center) / scale) AS v, y
    FROM w JOIN s USING (station, feature)
    WHERE sp >= {_LAGS} AND sp + {_STEPS} <= sn AND scale > 0 AND n_train >= {_t} AND n_val >= {_v} AND n_test >= {_e}),
  means AS (SELECT feature, list(a ORDER BY i) AS mean FROM (SELECT feature, i, avg(v[i]) AS a FROM
    (SELECT feature, v, unnest(range(1, {_LAGS + _STEPS + 1})) AS i FROM z WHERE split = 'train') GROUP BY ALL) GROUP BY feature),
  c AS (SELECT feature, i, j, avg((v[i] - mean[i]) * (v[j] - mean[j])) AS c FROM (SELECT feature, v, mean, i, unnest(range(1, {_LAGS + _STEPS + 1})) AS j FROM
    (SELECT feature, v, mean, unnest(range(1, {_LAGS + 1})) AS i FROM z JOIN means USING (feature) WHERE split = 'train')) GROUP BY ALL),
  g AS (SELECT feature, 1 AS k, list(r ORDER BY i) AS m FROM (
      SELECT feature, i, list(CASE WHEN i = j THEN c + {learners.Ridge().penalty} * greatest(c, 1e-12) ELSE c END ORDER BY j) AS r FROM c GROUP BY feature, i)
    GROUP BY feature
    UNION ALL SELECT feature, k + 1, list_transform(m, lambda r, i: list_transform(r, lambda a, j:
      CASE WHEN i = k THEN a / m[k][k] ELSE a - r[k] * m[k][j] / m[k][k] END)) FROM g WHERE k <= {_LAGS}),
  f AS (SELECT feature, step, list_transform(m, lambda r: r[{_LAGS} + step]) AS coef FROM g, (SELECT unnest(range(1, {_STEPS + 1})) AS step) WHERE k = {_LAGS + 1})
  SELECT station, feature, obs_time, pos, CAST(step AS INTEGER) AS step, {s6('y[step]')} AS actual,
    {s6(f"center + scale * (mean[{_LAGS} + step] + list_sum(list_transform(coef, lambda b, i: b * (v[i] - mean[i]))))", 4)} AS forecast
  FROM z JOIN means USING (feature) JOIN f USING (feature) WHERE split = 'test'"""


def _multi_step(spark, sf):
    return learners.ridge_steps(_long(spark, sf), KEYS, "cnn_gru_attention", _STEPS)[0]


@query("sequence_multi_step", _ridge_sql)
def sequence_multi_step(spark, sf):
    """Twelve points to the next five, by pooled ridge regressions; SQL solves the same normal equations."""
    out = _multi_step(spark, sf)
    return out.select(*KEYS, "obs_time", "pos", "step", r6("actual").alias("actual"), r6("forecast", 4).alias("forecast"))


@query("hybrid_forecast")
def hybrid_forecast(spark, sf):
    return learners.hybrid(_long(spark, sf), KEYS, arima_models(spark, sf), learners.forest())[0]


@query("forecast_run_scores")
def forecast_run_scores(spark, sf):
    """All models by name on the three stations with the most rows."""
    run = forecast.forecast(fx.splits(spark, sf), fx.LAYOUT, ["all"], top_n=3, horizon=5)
    return run.all_metrics()


def _status(name: str) -> str:
    t, v, e = floors(name, forecast.DEFAULT_HORIZON)
    return f"""SELECT station, 'value' AS feature, '{name}' AS model,
      CASE WHEN n_train >= {t} AND n_val >= {v} AND n_test >= {e} THEN 'ok' ELSE 'too short' END AS status FROM c"""


@query("forecast_run_status", f"""WITH {short_split}, c AS (
  SELECT station, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'val') AS n_val,
  count(*) FILTER (WHERE split = 'test') AS n_test FROM s WHERE value IS NOT NULL GROUP BY station)
  {_status('arima')} UNION ALL {_status('cnn_gru_attention')}""")
def forecast_run_status(spark, sf):
    """Per-series status over short series, some below the length floors."""
    from tidemark.operators.series import split_series

    splits = split_series(fx.short_readings(spark, sf), fx.SHORT)
    return forecast.forecast(splits, fx.SHORT, ["arima", "cnn_gru_attention"], top_n=None).status


_inputs = [f"x{k}" for k in range(1, 13)]
_samples_cte = f"""{fx.LONG_CTE}, s AS (SELECT station, feature, avg(value) FILTER (WHERE split = 'train') AS center,
    stddev_samp(value) FILTER (WHERE split = 'train') AS scale FROM long GROUP BY ALL),
  w AS (SELECT station, feature, split, pos, value,
    row_number() OVER (PARTITION BY station, feature, split ORDER BY pos) - 1 AS sp,
    {', '.join(f'lag(value, {k}) OVER v AS x{k}' for k in range(1, 13))} FROM long
    WINDOW v AS (PARTITION BY station, feature ORDER BY pos))"""
_scaled = f"""{_samples_cte}
  SELECT station, feature, split, pos, {s6('(value - center) / scale')} AS y1,
    {', '.join(s6(f'({x} - center) / scale') + f' AS {x}' for x in _inputs)}
  FROM w JOIN s USING (station, feature) WHERE sp >= 12"""


@query("scaled_samples", f"WITH {_scaled}")
def scaled_samples(spark, sf):
    out = learners.scaled_samples(_long(spark, sf), KEYS, "xgboost")
    return out.select(*KEYS, "split", "pos", *[r6(c).alias(c) for c in ("y1", *_inputs)])


@query("model_round_trip")
def model_round_trip(spark, sf):
    """Pooled models saved, loaded and applied."""
    samples = learners.scaled_samples(_long(spark, sf), KEYS, "cnn_lstm", packed=True)
    fitted = learners.fit_features(samples, learners.ridge())["y1"]
    path = scratch_path(spark, "pooled-models")
    learners.save_models(fitted, path)
    return learners.predict_features(samples, learners.load_models(list(fitted), path)).select(*KEYS, "pos", "forecast")


@query("tree_roots", f"""WITH {_samples_cte}
  SELECT feature, count(*) AS rows, {s6('avg((value - center) / scale)', 4)} AS value
  FROM w JOIN s USING (station, feature) WHERE sp >= 12 AND split = 'train' GROUP BY feature""")
def tree_roots(spark, sf):
    """Roots of the first boosted trees as node rows: all training samples and their mean."""
    samples = learners.scaled_samples(_long(spark, sf), KEYS, "xgboost", packed=True)
    table = learners.tree_table(samples, learners.fit_features(samples, learners.boosted())["y1"])
    return table.where("tree = 0 AND node = 0").select("feature", "rows", r6("value", 4).alias("value"))


@query("tree_table_forecasts", """SELECT learner, feature, true AS same FROM (VALUES ('boosted_trees'), ('sequence_one_step')) l(learner),
  (VALUES ('f_disc'), ('f_price'), ('f_qty'), ('f_tax')) f(feature)""")
def tree_table_forecasts(spark, sf):
    """Forecasts from node rows alone beside those of the fitted ensembles, for every test sample."""
    out = None
    for name, model, learner in (("boosted_trees", "xgboost", learners.boosted()), ("sequence_one_step", "cnn_lstm", learners.forest())):
        samples = learners.scaled_samples(_long(spark, sf), KEYS, model)
        fitted = learners.fit_features(samples, learner)["y1"]
        walked = learners.predict_trees(samples, learners.tree_table(samples, fitted)).select(*KEYS, "pos", F.col("forecast").alias("walked"))
        both = learners.predict_features(samples, fitted).select(*KEYS, "pos", "forecast").join(walked, [*KEYS, "pos"], "full")
        close = F.coalesce(F.abs(F.col("forecast") - F.col("walked")) <= 1e-9 * (1 + F.abs("forecast")), F.lit(False))
        one = both.groupBy("feature").agg(F.bool_and(close).alias("same")).select(F.lit(name).alias("learner"), "feature", "same")
        out = one if out is None else out.unionByName(one)
    return out


# ---- what SQL can say about the learned and searched forecasters -----------

_cases = f"""{fx.LONG_CTE}, c AS (SELECT station, feature, count(*) FILTER (WHERE split = 'train') AS n_train,
    count(*) FILTER (WHERE split = 'val') AS n_val, count(*) FILTER (WHERE split = 'test') AS n_test FROM long GROUP BY ALL),
  w AS (SELECT station, feature, split, pos, value, row_number() OVER v - 1 AS sp, count(*) OVER (PARTITION BY station, feature, split) AS sn,
    {', '.join(f'lead(value, {k}) OVER v AS a{k}' for k in range(1, 5))} FROM long
    WINDOW v AS (PARTITION BY station, feature, split ORDER BY pos))"""


def _floor(name: str, horizon: int = 5) -> str:
    t, v, e = floors(name, horizon)
    return f"n_train >= {t} AND n_val >= {v} AND n_test >= {e}"


_outputs_sql = f"""WITH {_cases}, e AS (SELECT w.*, n_train, n_val, n_test FROM w JOIN c USING (station, feature) WHERE split = 'test'),
  f AS (SELECT station, feature, pos, sp, n_test, value FROM e),
  o AS (
  SELECT 'boosted_trees' AS learner, station, feature, pos, 1 AS step, value AS actual FROM e WHERE sp >= 12 AND {_floor('xgboost')}
  UNION ALL SELECT 'sequence_one_step', station, feature, pos, 1, value FROM e WHERE sp >= 12 AND {_floor('cnn_lstm')}
  UNION ALL SELECT 'sequence_multi_step', station, feature, pos, step, CASE step WHEN 1 THEN value WHEN 2 THEN a1 WHEN 3 THEN a2 WHEN 4 THEN a3 ELSE a4 END
    FROM e, (SELECT unnest(range(1, 6)) AS step) WHERE sp >= 12 AND sp + 5 <= sn AND {_floor('cnn_gru_attention')}
  UNION ALL SELECT 'arima', station, feature, pos, sp + 1, value FROM e WHERE {_floor('arima')}
  UNION ALL SELECT 'sarima', station, feature, pos, sp + 1, value FROM e WHERE {_floor('sarima')})
  SELECT learner, station, feature, pos, CAST(step AS BIGINT) AS step, {s6('actual')} AS actual FROM o"""


@query("forecast_outputs", _outputs_sql)
def forecast_outputs(spark, sf):
    """Which steps every forecaster gives and the actual value beside each; a missing forecast drops the row."""
    parts = {
        "boosted_trees": boosted_trees(spark, sf),
        "sequence_one_step": sequence_one_step(spark, sf), "sequence_multi_step": _multi_step(spark, sf),
        "arima": arima_forecast(spark, sf), "sarima": sarima_forecast(spark, sf)}
    out = None
    for name, df in parts.items():
        step = F.col("step") if "step" in df.columns else F.lit(1)
        one = df.where("forecast is not null").select(
            F.lit(name).alias("learner"), *KEYS, "pos", step.cast("long").alias("step"), r6("actual").alias("actual"))
        out = one if out is None else out.unionByName(one)
    return out


@query("seasonal_ar1", f"""WITH {fx.LONG_CTE}, l AS (SELECT station, feature, value AS y,
    lag(value, 12) OVER (PARTITION BY station, feature ORDER BY pos) AS x FROM long WHERE split <> 'test')
  SELECT station, feature, {s6('regr_slope(y, x)')} AS phi FROM l WHERE x IS NOT NULL GROUP BY ALL""")
def seasonal_ar1(spark, sf):
    """One seasonal lag of twelve: the coefficient at lag 12, zero in between."""
    _, models = _linear(spark, sf, [linear.Order(0, 0, 0, 1, 0, 12)], "sarima")
    return models.where("status = 'ok'").select(*KEYS, r6(F.col("ar")[11]).alias("phi"))


@query("hybrid_linear_part", f"""WITH {_ar1}, a AS (SELECT station, feature, pos, split, value,
    lag(value) OVER (PARTITION BY station, feature ORDER BY pos) AS x,
    row_number() OVER (PARTITION BY station, feature, split ORDER BY pos) - 1 AS sp FROM long)
  SELECT station, feature, pos, {s6('value')} AS actual, {s6('c0 + phi * x', 3)} AS linear, true AS adds_up
  FROM a JOIN f USING (station, feature) WHERE split = 'test' AND sp >= 12""")
def hybrid_linear_part(spark, sf):
    """Linear part of the hybrid for a first-order autoregression; both parts add up to the forecast."""
    long, models = _linear(spark, sf, [linear.Order(1, 0, 0)], "arima_ann")
    out = learners.hybrid(long, KEYS, materialize(models, "ar1"), learners.forest(), packed=True)[0]
    adds = F.abs(F.col("linear") + F.col("residual") - F.col("forecast")) < 1e-9
    return out.select(*KEYS, "pos", r6("actual").alias("actual"), r6("linear", 3).alias("linear"), adds.alias("adds_up"))


@query("forecast_run_consistency", "SELECT model, true AS same FROM (VALUES ('arima'), ('cnn_gru_attention'), ('cnn_lstm')) t(model)")
def forecast_run_consistency(spark, sf):
    """Scores of a run, worked out again from the run's forecasts."""
    run = forecast.forecast(fx.splits(spark, sf), fx.LAYOUT, ["arima", "cnn_gru_attention", "cnn_lstm"], top_n=3, horizon=5)
    out = None
    for name, rows in run.forecasts.items():
        keys = [*KEYS, "step"] if name == "cnn_gru_attention" else KEYS
        again = rows.groupBy(*keys).agg(F.sqrt(F.avg((F.col("actual") - F.col("forecast")) ** 2)).alias("again"))
        scores = run.metrics[name].withColumn("step", F.regexp_extract("model_type", "Step([0-9]+)", 1).try_cast("int"))
        both = scores.where("step is not null" if name == "cnn_gru_attention" else "true").select(*keys, "RMSE").join(again, keys, "full")
        close = F.coalesce(F.abs(F.col("RMSE") - F.col("again")) <= 1e-9 * (1 + F.col("again")), F.lit(False))
        one = both.agg(F.bool_and(close).alias("same")).select(F.lit(name).alias("model"), "same")
        out = one if out is None else out.unionByName(one)
    return out


@query("saved_models_agree", """SELECT model, true AS same FROM
  (VALUES ('arima'), ('arima_ann'), ('cnn_gru_attention'), ('cnn_lstm'), ('xgboost')) t(model)""")
def saved_models_agree(spark, sf):
    """Every family saved, loaded and applied to all stations and features: the same forecasts as before."""
    names = ["arima", "arima_ann", "cnn_gru_attention", "cnn_lstm", "xgboost"]
    splits = fx.splits(spark, sf)
    run = forecast.forecast(splits, fx.LAYOUT, names, top_n=None, features=fx.FEATURES)
    path, out = scratch_path(spark, "run-models"), None
    forecast.save_fitted(run.fitted, path)
    loaded = forecast.load_fitted(spark, names, fx.FEATURES, path)
    long = materialize(forecast.series_of(splits, fx.LAYOUT, fx.FEATURES), "series")
    for name in names:
        again = forecast.apply_fitted(name, loaded[name], long)
        keys = [*KEYS, "pos", *(["step"] if "step" in again.columns and "step" in run.forecasts[name].columns else [])]
        before = run.forecasts[name].select(*keys, "forecast")
        both = before.join(again.select(*keys, F.col("forecast").alias("again")), keys, "full")
        close = F.coalesce(F.abs(F.col("forecast") - F.col("again")) < 1e-9, F.lit(False))
        one = both.agg(F.bool_and(close).alias("same")).select(F.lit(name).alias("model"), "same")
        out = one if out is None else out.unionByName(one)
    return out


@query("boosted_tree_tuning")
def boosted_tree_tuning(spark, sf):
    """Depth and rate of the boosted trees by error on the validation split, per feature."""
    samples = learners.scaled_samples(_long(spark, sf), KEYS, "xgboost")
    return learners.tuned_boosted(samples)[1]
