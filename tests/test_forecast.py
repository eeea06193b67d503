import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schema
from tidemark.operators import learners, metrics as m
from tidemark.plans import forecast, reports
from tidemark.schema import Layout
from tidemark.scratch import scratch_path
from tidemark.sources import tables
from tests.test_timeseries import KEYS, ar_series, long_rows, noise

LAYOUT = Layout(features=["v"])


def test_scores(spark):
    rows = [("a", 1.0, 2.0), ("a", 0.0, 1.0), ("a", 4.0, 4.0), ("a", 9.0, None),
            ("flat", 3.0, 2.0), ("flat", 3.0, 4.0), ("zero", 0.0, 1.0)]
    got = {r["k"]: r for r in m.forecast_metrics(spark.createDataFrame(rows, "k string, actual double, forecast double"), ["k"]).collect()}
    a = np.array([1.0, 0.0, 4.0])
    assert got["a"]["RMSE"] == pytest.approx(np.sqrt(2 / 3)) and got["a"]["MAE"] == pytest.approx(2 / 3)
    assert got["a"]["MAPE"] == pytest.approx(50.0)
    assert got["a"]["R2"] == pytest.approx(1 - 2 / ((a - a.mean()) ** 2).sum())
    assert got["flat"]["R2"] is None and got["zero"]["MAPE"] is None


def test_step_rows_and_rankings(spark):
    rows = [("s", "f", k, float(i), float(i + k)) for k in (1, 2) for i in range(5)]
    steps = m.step_metrics(spark.createDataFrame(rows, "station string, feature string, step int, actual double, forecast double"),
                           ["station", "feature"], "X")
    by_type = {r["model_type"]: r for r in steps.collect()}
    assert set(by_type) == {"X-Step1", "X-Step2", "X-Avg"}
    assert by_type["X-Avg"]["RMSE"] == pytest.approx(1.5) and by_type["X-Avg"]["step"] is None
    other = spark.createDataFrame([("s", "f", 1.2, 0.9)], "station string, feature string, RMSE double, R2 double")
    table = m.union_metrics({"x": steps, "y": other})
    means = {r["model"]: r for r in reports.model_comparison(table, exclude_steps=True).collect()}
    assert means["x"]["RMSE"] == pytest.approx(1.5) and means["y"]["MAE"] is None
    ranks = {(r["metric"], r["model"]): r["rank"] for r in reports.feature_comparison(table).collect()}
    assert ranks["RMSE", "y"] == 1 and ranks["R2", "y"] == 1 and ranks["MAE", "x"] == 1
    assert [r["step"] for r in m.step_curves(table).collect()] == [1, 2]
    with pytest.raises(ValueError):
        m.union_metrics({"y": other}, required="absent")


def test_align_right(spark):
    actual = spark.createDataFrame([("a", i, 10, float(i)) for i in range(10)], "k string, pos long, n long, value double")
    ahead = spark.createDataFrame([("a", i, 4, float(100 + i)) for i in range(4)], "k string, pos long, n long, forecast double")
    got = sorted((r["value"], r["forecast"]) for r in m.align_right(actual, ahead, ["k"]).collect())
    assert got == [(6.0, 100.0), (7.0, 101.0), (8.0, 102.0), (9.0, 103.0)]


def split_table(spark, series):
    long = long_rows(spark, series).withColumnRenamed("value", "v")
    return long.drop("feature").withColumn("obs_time", F.lit(dt.datetime(2020, 1, 1)).cast("timestamp_ntz"))


def test_learners_beat_the_mean(spark):
    rows = long_rows(spark, {f"s{i}": 10 * i + ar_series(1200, [0.9], seed=i) for i in range(4)})
    for out in (learners.one_step(rows, KEYS, "cnn_lstm", learners.forest())[0],
                learners.one_step(rows, KEYS, "xgboost", learners.boosted())[0]):
        scores = m.forecast_metrics(out, KEYS).collect()
        assert len(scores) == 4 and np.mean([r["R2"] for r in scores]) > 0.3
        assert out.count() == 4 * (120 - 12)
    out, fitted = learners.multi_step(rows, KEYS, "cnn_gru_attention", learners.ridge(), 3)
    assert sorted(fitted) == [1, 2, 3]
    by_step = {r["step"]: r["RMSE"] for r in m.forecast_metrics(out, ["step"]).collect()}
    assert by_step[1] < by_step[3]


def test_trees_as_rows(spark):
    """SQL that walks the node rows gives the forecasts of the fitted ensembles."""
    import duckdb

    rows = long_rows(spark, {f"s{i}": 10 * i + ar_series(300, [0.9], seed=i) for i in range(3)})
    samples = learners.scaled_samples(rows, KEYS, "xgboost")
    for learner in (learners.boosted().setMaxIter(8), learners.forest()):
        fitted = learners.fit_features(samples, learner)["y1"]
        nodes = learners.tree_table(samples, fitted)
        want = {(r["station"], r["pos"]): r["forecast"] for r in learners.predict_features(samples, fitted).collect()}
        walked = {(r["station"], r["pos"]): r["forecast"] for r in learners.predict_trees(samples, nodes).collect()}
        assert walked.keys() == want.keys() and len(want) == 3 * 18
        con = duckdb.connect()
        con.register("node", nodes.toArrow())
        con.register("sample", samples.where("split = 'test'").select(
            "station", "pos", "center", "scale", F.array(*learners.INPUTS).alias("x")).toArrow())
        found = con.execute("""WITH RECURSIVE w AS (
              SELECT station, pos, center, scale, x, tree, 0 AS node FROM sample, (SELECT DISTINCT tree FROM node)
              UNION ALL SELECT station, pos, center, scale, x, tree, CASE WHEN x[n.input] <= threshold THEN n."left" ELSE n."right" END
              FROM w JOIN node n USING (tree, node) WHERE n.input IS NOT NULL)
            SELECT station, pos, any_value(center + 0.0) + any_value(scale) * sum(weight * value) FROM w JOIN node n USING (tree, node)
            WHERE n.input IS NULL GROUP BY ALL""").fetchall()
        assert len(found) == len(want)
        for station, pos, value in found:
            assert value == pytest.approx(want[station, pos], rel=1e-9) == pytest.approx(walked[station, pos], rel=1e-9)


def test_a_failed_feature_is_named(spark, monkeypatch):
    """Without a run a failed fit raises; in a run its reason is the status of its series."""
    x = ar_series(300, [0.8])
    whole = split_table(spark, {"a": x}).withColumn("w", F.col("v") * 2)
    fit = learners.fit_pooled

    def broken(samples, regressor, feature, target="y1"):
        if feature == "w":
            raise RuntimeError("singular")
        return fit(samples, regressor, feature, target)

    monkeypatch.setattr(learners, "fit_pooled", broken)
    long = forecast.series_of(whole, Layout(features=["v", "w"]), None)
    with pytest.raises(RuntimeError, match="singular"):
        learners.one_step(long, KEYS, "cnn_lstm", learners.forest())
    run = forecast.forecast(whole, Layout(features=["v", "w"]), ["cnn_lstm"], top_n=None)
    assert {r["feature"]: r["status"] for r in run.status.collect()} == {"v": "ok", "w": "failed: singular"}


def test_run_by_name(spark):
    table = split_table(spark, {"long": ar_series(300, [0.8]), "mid": ar_series(250, [0.5], 2), "tiny": noise(12)})
    run = forecast.forecast(table, LAYOUT, ["arima", "arima_ann", "cnn_gru_attention"], top_n=None, horizon=2)
    assert set(run.forecasts) == {"arima", "arima_ann", "cnn_gru_attention"}
    status = {(r["model"], r["station"]): r["status"] for r in run.status.collect()}
    assert status["arima", "tiny"] == "too short" and status["cnn_gru_attention", "long"] == "ok"
    types = {r[0] for r in run.all_metrics().select("model_type").distinct().collect()}
    assert types == {"ARIMA", "ARIMA-ANN", "CNN-GRU-Attention-Step1", "CNN-GRU-Attention-Step2", "CNN-GRU-Attention-Avg"}
    parts = run.forecasts["arima_ann"].first()
    assert parts["forecast"] == pytest.approx(parts["linear"] + parts["residual"])


def test_one_failing_model_does_not_stop_the_rest(spark, monkeypatch):
    def broken(*a, **k):
        raise RuntimeError("no luck")

    monkeypatch.setattr(learners, "ridge_steps", broken)
    run = forecast.forecast(split_table(spark, {"a": ar_series(200, [0.5])}), LAYOUT, ["cnn_gru_attention", "arima"])
    assert list(run.forecasts) == ["arima"]
    assert {r["status"] for r in run.status.where("model = 'cnn_gru_attention'").collect()} == {"failed: no luck"}


def test_no_series_long_enough(spark):
    run = forecast.forecast(split_table(spark, {"a": noise(15)}), LAYOUT, ["arima", "cnn_lstm"], top_n=None)
    assert {r["status"] for r in run.status.collect()} == {"too short"}
    assert run.forecasts["cnn_lstm"].count() == 0


def test_missing_values_are_dropped_per_feature(spark):
    x = ar_series(400, [0.8])
    whole = split_table(spark, {"a": x})
    holes = whole.withColumn("v", F.when(F.col("pos") % 5 != 2, F.col("v"))).withColumn("w", F.col("pos") * 1.0)
    long = forecast.series_of(holes, Layout(features=["v", "w"]), None)
    got = {r["feature"]: r for r in long.groupBy("feature").agg(
        F.count("*").alias("rows"), F.max("pos").alias("last"), F.max("n").alias("n")).collect()}
    assert (got["v"]["rows"], got["v"]["last"], got["v"]["n"]) == (320, 319, 320) and got["w"]["n"] == 400
    samples = learners.scaled_samples(long, KEYS, "xgboost")
    counts = {(r[0], r[1]): r[2] for r in samples.groupBy("feature", "split").count().collect()}
    assert counts["v", "test"] == 32 - 12 and counts["v", "val"] == 32 - 12 and counts["v", "train"] == 256 - 12
    run = forecast.forecast(holes, LAYOUT, ["arima", "arima_ann"], top_n=None)
    assert run.forecasts["arima"].count() == 32 and run.forecasts["arima_ann"].count() == 32 - 12


def test_selection(spark):
    assert forecast.selected_models(["all"]) == list(forecast.MODEL_TYPES)
    with pytest.raises(ValueError):
        forecast.selected_models(["prophet"])
    table = split_table(spark, {"a": noise(50), "b": noise(40), "c": noise(60)})
    assert {r[0] for r in forecast.restrict(table, LAYOUT, 2).select("station").distinct().collect()} == {"a", "c"}


def test_drilldown_without_forecast_is_empty(spark):
    long = long_rows(spark, {"a": noise(20)})
    none = spark.createDataFrame([], "station string, feature string, model string, forecast double")
    scores = spark.createDataFrame([("a", "f", "arima", "ARIMA", 1.0)], "station string, feature string, model string, model_type string, RMSE double")
    got = reports.drilldown(long, none, scores, "a", "f")
    assert got["series"].count() == 20 and got["forecast"].count() == 0
    assert got["scores"].columns == ["model", "model_type", "label", "RMSE"]


def test_awkward_station_names_survive(spark):
    names = ["00007", "a/b", "a_b", "a b", "c\\d:e", "三川", None]
    df = spark.createDataFrame([(n, "train", 1.0) for n in names], "station string, split string, v double")
    path = scratch_path(spark, "names")
    tables.write_table(df, path, partition_by=["split", "station"])
    back = tables.read_splits(spark, path, df.schema)
    assert {r["station"] for r in back.collect()} == set(names)


def test_raw_scan_and_strict_times(spark):
    path = scratch_path(spark, "raw")
    raw = spark.createDataFrame([("三川", "2021-01-01", "NA", "1.5"), ("N/A", "bad", "Ⅰ", "--")], tables.raw_schema(["ph"]))
    tables.write_table(raw, path, fmt="csv")
    got = sorted(map(tuple, tables.read_readings(spark, path, tables.raw_schema(["ph"])).collect()), key=str)
    assert got == sorted([("三川", "2021-01-01", None, "1.5"), (None, "bad", "Ⅰ", "--")], key=str)
    assert tables.read_readings(spark, path, tables.raw_schema(["ph"])).columns == ["station", "obs_time", "category", "ph"]
    strict = T.StructType([T.StructField(c, t) for c, t in zip(
        ("station", "obs_time", "category", "ph"), (T.StringType(), T.TimestampNTZType(), T.StringType(), T.StringType()))])
    with pytest.raises(Exception):
        tables.read_clean(spark, path, strict, "csv").collect()


def test_dashboard_skips_missing_columns(spark):
    df = spark.createDataFrame([("s", "Ⅰ", 7.0, 8.0)], "station string, category string, ph double, dissolved_oxygen double")
    panels = reports.dashboard(df, Layout(features=schema.EXT_FEATURES))
    assert set(panels) == {"category_shares", "stations_per_category", "box", "correlation", "ph_vs_dissolved_oxygen"}
