"""Lag sums from one sorted pass, and balanced windows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import autocorr, linear, series

KEYS = ["station", "feature"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def readings(spark, lengths, split=False):
    rng, rows = np.random.default_rng(3), []
    for name, n in lengths.items():
        for i, v in enumerate(rng.normal(1000, 1, n).cumsum() / 10):
            label = "train" if i < int(n * 0.8) else "val" if i < int(n * 0.9) else "test"
            rows.append((name, "f", i, label, float(v)))
    rng.shuffle(rows)
    return spark.createDataFrame([(a, b, int(c), d, float(e)) for a, b, c, d, e in rows],
                                 "station string, feature string, pos long, split string, value double")


def direct(x, center, lags, upto=None):
    d = np.asarray(x) - center
    upto = len(d) if upto is None else upto
    return [float(np.sum(d[k:upto] * d[:max(upto - k, 0)])) if k else float(np.sum(d[:upto] ** 2)) for k in range(lags + 1)]


# Lengths around the segment's: ends in a halo, ends with a segment, one row more.
@pytest.mark.parametrize("limit", [None, 50])
def test_lag_sums_of_short_and_cut_series(spark, limit):
    long = readings(spark, {"a": 7, "b": 50, "c": 49, "d": 51, "e": 333, "g": 45, "h": 100, "i": 1})
    found = {r["station"]: r for r in autocorr.lag_sums(long, KEYS, 12, group_rows=limit).collect()}
    for name, rows in {r["station"]: r["v"] for r in long.groupBy("station").agg(
            F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("v")).collect()}.items():
        x = np.array([r["value"] for r in rows])
        got = found[name]
        assert got["n"] == len(x) and got["mean"] == pytest.approx(x.mean())
        assert got["s"] == pytest.approx(direct(x, x.mean(), 12), rel=1e-9, abs=1e-6)
        assert got["head"] == pytest.approx(list(x[:13] - x.mean()), abs=1e-8)
        assert got["tail"] == pytest.approx(list(x[-13:] - x.mean()), abs=1e-8)


@pytest.mark.parametrize("limit", [None, 40])
def test_split_lag_sums_of_cut_series(spark, limit):
    long = readings(spark, {"a": 400, "b": 50, "c": 3, "d": 45})
    found = {r["station"]: r for r in linear.split_lag_sums(long, KEYS, 12, group_rows=limit).collect()}
    for r in long.where("split <> 'test'").groupBy("station").agg(
            F.sort_array(F.collect_list(F.struct("pos", "value", "split"))).alias("v")).collect():
        x, cut = np.array([v["value"] for v in r["v"]]), sum(v["split"] == "train" for v in r["v"])
        got, center = found[r["station"]], np.mean(x[:cut])
        assert (got["n_train"], got["n"]) == (cut, len(x)) and got["center"] == pytest.approx(center)
        assert got["s_all"] == pytest.approx(direct(x, center, 12), rel=1e-9, abs=1e-6)
        assert got["s_train"] == pytest.approx(direct(x, center, 12, cut), rel=1e-9, abs=1e-6)
        assert got["total_all"] == pytest.approx(np.sum(x - center), rel=1e-9, abs=1e-6)
        assert got["tail_train"] == pytest.approx(list(x[max(cut - 13, 0):cut] - center), abs=1e-8)
        assert got["tail_all"] == pytest.approx(list(x[-13:] - center), abs=1e-8)
        assert got["head"] == pytest.approx(list(x[:13] - center), abs=1e-8)


def test_lag_sums_move_readings_once_without_a_column_per_lag(spark):
    long = readings(spark, {"a": 60, "b": 70})
    plan = plan_of(autocorr.lag_sums(long, KEYS, 40))
    assert "Window" not in plan and plan.count("REPARTITION_BY_NUM") == 1


def test_balanced_windows_are_not_merged(spark):
    long = readings(spark, {"a": 60, "b": 70})
    assert "REPARTITION_BY_NUM" in plan_of(series.supervised_frame(long, KEYS))
