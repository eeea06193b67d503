"""Samples kept as one row per segment: the same samples as from lags row by row."""

import math
import random

import numpy as np
import pyarrow.parquet as pq

from tidemark.operators import learners, series

KEYS = ["station", "feature"]


def _long(spark, lengths, gaps=0.0, seed=3):
    rng, rows = random.Random(seed), []
    for i, n in enumerate(lengths):
        for pos in range(n):
            v = rng.gauss(0, 1) + pos % 7
            v = None if rng.random() < gaps else math.nan if rng.random() < gaps / 2 else v
            split = "train" if pos < n * 8 // 10 else "val" if pos < n * 9 // 10 else "test"
            rows.append((f"s{i}", "f", pos, n, split, v))
    return spark.createDataFrame(rows, "station string, feature string, pos long, n long, split string, value double")


def _rows(df):
    names = sorted(df.columns)
    return sorted(repr([r[c] for c in names]) for r in df.select(names).collect())


def test_packed_samples_are_those_of_the_lags(spark):
    long = _long(spark, [3, 60, 150, 2300], gaps=0.01)
    inputs = [f"x{k}" for k in range(1, 13)]
    for group_rows in (None, 40):
        plain = series.supervised_frame(long, KEYS, horizon=3, group_rows=group_rows)
        packed = series.supervised_frame(long, KEYS, horizon=3, group_rows=group_rows, label="packed")
        assert _rows(packed.drop(series.WHOLE)) == _rows(plain)
        whole = packed.where(series.WHOLE).drop(series.WHOLE)
        assert _rows(whole) == _rows(plain.na.drop(subset=[*inputs, "y1", "y2", "y3"]))


def test_samples_are_not_written_lag_by_lag(spark):
    samples = learners.scaled_samples(_long(spark, [3000]), KEYS, "xgboost", packed=True)
    files = [f.removeprefix("file:") for f in samples.inputFiles()]
    assert sum(pq.ParquetFile(f).metadata.num_rows for f in files) == 3
    assert not any("x12" in pq.ParquetFile(f).schema_arrow.names for f in files)
    assert samples.count() == 3000 - 3 * 12


def test_ridge_sums_of_two_features(spark):
    long = _long(spark, [400, 300])
    both = long.unionByName(_long(spark, [350], seed=9).replace("f", "g", "feature"))
    samples = learners.scaled_samples(both, KEYS, "cnn_gru_attention", horizon=2, packed=True)
    table = {(r["feature"], r["step"]): r for r in learners.fit_ridge_steps(samples, 2, learners.Ridge(0.0)).collect()}
    assert len(table) == 4
    for feature in ("f", "g"):
        rows = samples.where(f"feature = '{feature}' and split = 'train'").select(*learners.INPUTS, "y2").collect()
        x = np.array([[1.0, *r[:12]] for r in rows])
        want = np.linalg.lstsq(x, np.array([r[12] for r in rows]), rcond=None)[0]
        got = table[feature, 2]
        assert np.allclose([got["intercept"], *got["coefficients"]], want, atol=1e-8)
