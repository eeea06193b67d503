import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import parsing
from tidemark.operators import cleaning, series
from tidemark.schema import Layout

LAYOUT = Layout(features=["a", "b"], ties=["k"])
SCHEMA = "station string, obs_time string, category string, a string, b string, k int"


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.select("i", expr(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_numbers(spark):
    texts = ["1", " -2.5 ", "+.5", "3.", "1e3", "1E-2", "1d", "1f", "nan", "inf", "Infinity", "0x10", "1,234",
             "--", "*", "", None, "１２", "1 2"]
    want = [1.0, -2.5, 0.5, 3.0, 1000.0, 0.01] + [None] * 13
    assert column(spark, texts, parsing.to_number) == want


def test_times(spark):
    got = column(spark, ["2021/3/5 4:00", "2021-03-05", "20210305", "2021-03-05 04:05:06", "bad", "2021-13-01", None],
                 parsing.to_obs_time)
    day = dt.datetime(2021, 3, 5)
    assert got == [day.replace(hour=4), day, day, dt.datetime(2021, 3, 5, 4, 5, 6), None, None, None]


def test_labels(spark):
    assert column(spark, ["a/b\\c:d", None], parsing.safe_key) == ["a_b_c_d", None]
    assert column(spark, ["X-Step12", "X-Avg", None], parsing.step_number) == [12, None, None]
    assert column(spark, ["X-Step12", "X-Avg", None], parsing.has_step) == [True, False, False]
    assert column(spark, ["/r/arima_ann_metrics.csv", "/r/cnn_lstm_metrics.csv/part-0.csv", "/r/model_comparison.csv"],
                  parsing.model_from_path) == ["arima_ann", "cnn_lstm", None]


def test_overflow_is_missing(spark):
    raw = spark.createDataFrame([("s", "2021-01-01", "I", "1e999", "2", 1)], SCHEMA)
    row = cleaning.type_readings(raw, LAYOUT).first()
    assert row["a"] is None and row["b"] == 2.0


def test_numeric_input_loses_nan(spark):
    rows = spark.createDataFrame([("s", 1.0, float("nan"))], "station string, a double, b double")
    row = cleaning.type_readings(rows, LAYOUT).first()
    assert (row["a"], row["b"]) == (1.0, None)


def make_raw(rows=400, seed=3):
    rng = np.random.default_rng(seed)
    a = rng.normal(10, 2, rows).round(2)
    a[rng.random(rows) < 0.02] *= 30
    text = [f"{x}" for x in a]
    for i in np.flatnonzero(rng.random(rows) < 0.2):
        text[i] = rng.choice(["--", "*", "NA", "1d"])
    b = [f"{x}" for x in rng.integers(0, 50, rows)]
    for i in np.flatnonzero(rng.random(rows) < 0.3):
        b[i] = None
    station = np.where(rng.random(rows) < 0.4, "hot/1", [f"s{i}" for i in rng.integers(0, 6, rows)])
    times = [f"2021-01-{1 + i % 28:02d} {i % 24:02d}:00:00" if i % 17 else "bad" for i in range(rows)]
    frame = pd.DataFrame(dict(station=station, obs_time=times, category="I", a=text, b=b, k=range(rows)))
    frame.loc[frame.index % 41 == 0, "station"] = None
    frame.loc[frame.index % 37 == 0, ["a", "b"]] = ["--", None]
    frame.loc[frame.station == "s5", "b"] = None
    return frame.astype(object).where(frame.notna(), None)


def pandas_clean(frame):
    out = frame.copy()
    out["obs_time"] = pd.to_datetime(out["obs_time"], errors="coerce", format="%Y-%m-%d %H:%M:%S")
    for c in ("a", "b"):
        out[c] = pd.to_numeric(out[c], errors="coerce")
    out = out.dropna(how="all", subset=["a", "b"])
    for c in ("a", "b"):
        q1, q3 = out[c].quantile([0.25, 0.75])
        low, high = q1 - 2 * (q3 - q1), q3 + 2 * (q3 - q1)
        out[c] = out[c].where((out[c] >= low) & (out[c] <= high))
    out = out.sort_values(["station", "obs_time", "k"])
    known = out["station"].notna()
    for c in ("a", "b"):
        filled = out[known].groupby("station")[c].transform(lambda s: s.ffill().bfill())
        out.loc[known, c] = filled
        out[c] = out[c].fillna(out[c].median())
    return out.sort_values("k").reset_index(drop=True)


@pytest.mark.parametrize("limits", [{}, {"group_rows": 20, "group_values": 10}])
def test_clean_equals_pandas(spark, limits):
    frame = make_raw()
    raw = spark.createDataFrame(frame.values.tolist(), SCHEMA)
    got = cleaning.clean(raw, LAYOUT, **limits).orderBy("k").toPandas()
    want = pandas_clean(frame)
    assert got["k"].tolist() == want["k"].tolist()
    np.testing.assert_allclose(got[["a", "b"]].to_numpy(float), want[["a", "b"]].to_numpy(float), rtol=1e-12)
    assert got["station"].isna().sum() == want["station"].isna().sum()


def test_all_null_feature_stays_null(spark):
    raw = spark.createDataFrame([("s", "2021-01-01", "I", "1", "--", i) for i in range(3)], SCHEMA)
    out = cleaning.clean(raw, LAYOUT).collect()
    assert [r["b"] for r in out] == [None] * 3 and [r["a"] for r in out] == [1.0] * 3


def test_absent_feature_is_skipped(spark):
    raw = spark.createDataFrame([("s", "2021-01-01", "1"), ("s", "2021-01-02", "*")], "station string, obs_time string, a string")
    out = cleaning.clean(raw, Layout(features=["a", "b"])).collect()
    assert [r["a"] for r in out] == [1.0] and out[0].asDict().keys() == {"station", "obs_time", "a"}


def test_clean_twice_keeps_rows(spark):
    raw = spark.createDataFrame(make_raw().values.tolist(), SCHEMA)
    once = cleaning.clean(raw, LAYOUT)
    assert cleaning.clean(once, LAYOUT).count() == once.count()


def test_fence_is_strict(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,), (3.0,), (3.5,)], "a double")
    out = cleaning.null_outliers(rows, {"a": (1.0, 3.0)}).collect()
    assert [r[0] for r in out] == [None, 1.0, 3.0, None]


def test_quality_report(spark):
    raw = spark.createDataFrame(make_raw().values.tolist(), SCHEMA)
    report = {r["feature"]: r for r in cleaning.quality_report(raw, LAYOUT).collect()}
    frame = make_raw()
    numbers = pd.to_numeric(frame["b"], errors="coerce")
    assert report["b"]["missing"] == numbers.isna().sum()
    assert report["b"]["rows_in"] - report["b"]["rows_out"] == report["a"]["rows_removed"]


def test_missing_columns(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError):
        series.validate_columns(df, ["a", "z"])
    assert series.validate_columns(df, ["a", "z"], "skip") == ["a"]
