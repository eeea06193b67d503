import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import lookup, quantiles, series, stats
from tidemark.schema import Layout

LAYOUT = Layout(features=["v"], ties=["k"])


def frame(rows=300, seed=1, hot=0.5):
    rng = np.random.default_rng(seed)
    station = np.where(rng.random(rows) < hot, "hot", [f"s{i}" for i in rng.integers(0, 5, rows)])
    t = pd.to_datetime("2020-01-01") + pd.to_timedelta(rng.integers(0, 40, rows), unit="D")
    v = pd.Series(rng.normal(size=rows)).where(rng.random(rows) > 0.3)
    out = pd.DataFrame(dict(station=station, obs_time=t, v=v, k=rng.permutation(rows)))
    out.loc[out.k % 13 == 0, "obs_time"] = pd.NaT
    return out


def to_spark(spark, pdf):
    text = pdf.assign(obs_time=pdf["obs_time"].dt.strftime("%Y-%m-%d"))
    rows = text.astype(object).where(text.notna(), None).values.tolist()
    return spark.createDataFrame(rows, "station string, obs_time string, v double, k long").withColumn(
        "obs_time", F.col("obs_time").cast("timestamp_ntz"))


@pytest.mark.parametrize("limit", [None, 16, 1])
def test_position(spark, limit):
    pdf = frame()
    got = series.with_position(
        to_spark(spark, pdf), ["station"], series.time_order(LAYOUT), group_rows=limit).toPandas()
    want = pdf.sort_values(["station", "obs_time", "k"])
    want["pos"] = want.groupby("station").cumcount()
    want["n"] = want.groupby("station")["k"].transform("size")
    pd.testing.assert_frame_equal(
        got.sort_values("k")[["k", "pos", "n"]].reset_index(drop=True),
        want.sort_values("k")[["k", "pos", "n"]].reset_index(drop=True), check_dtype=False)


@pytest.mark.parametrize("limit", [None, 16, 3])
def test_fill(spark, limit):
    pdf = frame()
    pdf.loc[pdf.station == "s1", "v"] = np.nan
    pdf.loc[pdf.k % 29 == 0, "station"] = None
    got = series.fill_series(to_spark(spark, pdf), LAYOUT, group_rows=limit).toPandas().sort_values("k")
    want = pdf.sort_values(["station", "obs_time", "k"])
    filled = want[want.station.notna()].groupby("station")["v"].transform(lambda s: s.ffill().bfill())
    want.loc[want.station.notna(), "v"] = filled
    np.testing.assert_array_equal(got["v"].to_numpy(float), want.sort_values("k")["v"].to_numpy(float))


@pytest.mark.parametrize("limit", [None, 9])
def test_lag_and_lead(spark, limit):
    pdf = frame()
    placed = series.with_position(to_spark(spark, pdf), ["station"], series.time_order(LAYOUT))
    got = series.lagged(
        placed, ["station"], {"b": ("k", 3), "f": ("k", -2)}, group_rows=limit).toPandas().sort_values("k")
    want = pdf.sort_values(["station", "obs_time", "k"])
    want["b"], want["f"] = want.groupby("station")["k"].shift(3), want.groupby("station")["k"].shift(-2)
    want = want.sort_values("k")
    assert len(got) == len(want)
    np.testing.assert_array_equal(got[["b", "f"]].to_numpy(float), want[["b", "f"]].to_numpy(float))


def test_lag_needs_room(spark):
    placed = spark.createDataFrame([("a", 0, 1.0)], "station string, pos long, v double")
    with pytest.raises(ValueError):
        series.lagged(placed, ["station"], {"x": ("v", 5)}, group_rows=5)


@pytest.mark.parametrize("n", [1, 2, 9, 10, 11, 105])
def test_split_sizes(spark, n):
    pdf = pd.DataFrame(dict(station="a", obs_time=pd.date_range("2020", periods=n), v=1.0, k=range(n)))
    counts = {r[0]: r[1] for r in series.split_series(to_spark(spark, pdf), LAYOUT).groupBy("split").count().collect()}
    train, val = int(n * 0.8), int(n * 0.1)
    want = {"train": train, "val": val, "test": n - train - val}
    assert counts == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("model,need", [("arima", (10, 5, 5)), ("cnn_lstm", (30, 10, 10)), ("cnn_gru_attention", (34, 17, 17))])
def test_floors(spark, model, need):
    def rows(sizes):
        return [("a", "f", s, 1.0) for s, n in zip(("train", "val", "test"), sizes) for _ in range(n)]

    schema = "station string, feature string, split string, value double"
    assert series.eligible_series(spark.createDataFrame(rows(need), schema), model).count() == 1
    for i in range(3):
        short = [n - (i == j) for j, n in enumerate(need)]
        assert series.eligible_series(spark.createDataFrame(rows(short), schema), model).count() == 0


def test_samples_stay_in_their_split(spark):
    pdf = pd.DataFrame(dict(station="a", obs_time=pd.date_range("2020", periods=200), v=np.arange(200.0), k=range(200)))
    long = series.to_long(series.split_series(to_spark(spark, pdf), LAYOUT), ["station", "pos", "n", "split"], ["v"])
    own = series.supervised_frame(long, ["station", "feature"], horizon=3)
    counts = {r[0]: r[1] for r in own.groupBy("split").count().collect()}
    assert counts == {"train": 160 - 14, "val": 20 - 14, "test": 20 - 14}
    carried = series.supervised_frame(long, ["station", "feature"], horizon=3, carry_context=True)
    assert {r[0]: r[1] for r in carried.groupBy("split").count().collect()} == {"train": 146, "val": 18, "test": 18}
    row = own.where("pos = 20").first()
    assert (row["x1"], row["x12"], row["y1"], row["y3"]) == (19.0, 8.0, 20.0, 22.0)


@pytest.mark.parametrize("values", [None, 5])
def test_quantiles(spark, values):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(dict(g=rng.integers(0, 4, 500), value=rng.normal(size=500).round(1)))
    pdf.loc[pdf.g == 3, "value"] = 7.0
    rows = spark.createDataFrame(pdf.values.tolist(), "g double, value double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    extra = {} if values is None else {"group_values": values}
    for r in quantiles.exact_quantiles(rows, ["g"], probs, **extra).collect():
        mine = pdf[pdf.g == r["g"]]["value"]
        np.testing.assert_allclose(r["q"], mine.quantile(probs), rtol=1e-12)
        assert r["cnt"] == len(mine)


def test_describe_matches_pandas(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(dict(x=rng.gamma(2, size=80), y=rng.normal(size=80), c=4.0))
    pdf.loc[:9, "x"] = np.nan
    rows = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "x double, y double, c double")
    got = {r["feature"]: r for r in stats.describe(rows, ["x", "y", "c"]).collect()}
    for f in ("x", "y", "c"):
        d, r = pdf[f].describe(), got[f]
        np.testing.assert_allclose(
            [r[c] for c in ("count", "mean", "std", "min", "q25", "q50", "q75", "max", "skewness", "kurtosis")],
            [*d, pdf[f].skew(), pdf[f].kurtosis()], rtol=1e-9, atol=1e-9)
        assert r["missing"] == pdf[f].isna().sum()
    matrix = {(r["feature_a"], r["feature_b"]): r["corr"] for r in stats.correlation(rows, ["x", "y"]).collect()}
    np.testing.assert_allclose(matrix["x", "y"], pdf.corr().loc["x", "y"], rtol=1e-9)
    assert matrix["x", "y"] == matrix["y", "x"] and len(matrix) == 4


def test_histogram_matches_numpy(spark):
    x = np.random.default_rng(2).normal(size=300)
    rows = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = stats.histogram(rows, ["x"]).orderBy("bin").collect()
    counts, edges = np.histogram(x, bins="auto")
    assert [r["n"] for r in got] == counts.tolist()
    np.testing.assert_allclose([r["left"] for r in got], edges[:-1], rtol=1e-9, atol=1e-12)


def test_density_close_to_exact(spark):
    x = np.append(np.random.default_rng(2).normal(size=4000), 1000.0)  # far wider than the bandwidth
    rows = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = stats.density(rows, ["x"]).orderBy("point").toPandas()
    h = x.std(ddof=1) * len(x) ** -0.2
    exact = np.exp(-0.5 * ((got["x"].to_numpy()[:, None] - x) / h) ** 2).sum(1) / (len(x) * h * np.sqrt(2 * np.pi))
    np.testing.assert_allclose(got["density"], exact, rtol=1e-9, atol=1e-11)


def test_mode_takes_smallest_tie(spark):
    rows = [("a", "II"), ("a", "I"), ("b", None), ("c", "III"), ("c", "III"), ("c", "I"), (None, "I")]
    modes = {r[0]: r[1] for r in stats.station_modes(spark.createDataFrame(rows, "station string, category string")).collect()}
    assert modes == {"a": "I", "b": None, "c": "III"}


def test_trim_and_trend(spark):
    values = [*np.arange(30.0), 1000.0]
    pdf = pd.DataFrame(dict(station="a", obs_time=pd.date_range("2020", periods=31), v=values, k=range(31)))
    short = pdf.head(5).assign(station="b")
    placed = series.with_position(to_spark(spark, pd.concat([pdf, short])), ["station"], series.time_order(LAYOUT))
    long = series.to_long(placed, ["station", "obs_time", "k", "pos", "n"], ["v"])
    trimmed = stats.display_trim(long, ["station", "feature"], group_rows=8)
    lines = {r["station"]: r for r in stats.trend_lines(trimmed, ["station", "feature"], series.time_order(LAYOUT)).collect()}
    assert lines["a"]["n"] == 30 and lines["b"]["n"] == 5
    np.testing.assert_allclose([lines["a"]["slope"], lines["a"]["intercept"], lines["a"]["mean"]], [1, 0, 14.5], atol=1e-9)
    assert lines["b"]["mean"] is None and lines["b"]["slope"] is None


def test_names(spark):
    counts = spark.createDataFrame(
        [("幸福村(河东元坝)", 2), ("幸福村（河东元坝）", 3), ("unknown", 1)], "station string, n long")
    named = lookup.with_english(counts, "station", lookup.station_names(spark))
    merged = {r[0]: r[1] for r in named.groupBy("station_english").agg(F.sum("n")).collect()}
    assert merged == {"Xingfu Village (Hedong Yuanba)": 5, "unknown": 1}
    assert lookup.feature_names(spark).count() == 22


def test_ranking_over_blocks(spark):
    rows = spark.createDataFrame([(f"s{i:02d}",) for i in range(40) for _ in range(1 + i % 7)], "station string")
    plain = lookup.ranked_stations(rows).orderBy("rank").collect()
    blocks = lookup.ranked_stations(rows, group_rows=6).orderBy("rank").collect()
    assert plain == blocks and [r["rank"] for r in plain] == list(range(1, 41))


def test_tied_times_do_not_depend_on_arrival(spark):
    """No tie columns given: all columns complete the order, so shuffled rows give one result."""
    rnd = np.random.default_rng(6)
    rows = [("s", f"2020-01-{1 + i // 10:02d}", float(i % 7) if i % 3 else None, float(i)) for i in range(300)]
    layout = Layout(features=["a", "b"])
    results = []
    for seed in range(3):
        order = rnd.permutation(len(rows))
        df = spark.createDataFrame([rows[i] for i in order], "station string, obs_time string, a double, b double")
        filled = series.fill_series(df, layout, group_rows=None if seed else 50)
        results.append(sorted(map(tuple, filled.collect())))
    assert results[0] == results[1] == results[2]


def test_sketched_quantiles(spark):
    """One pass, mergeable, within the stated rank error; exact and sketched forms share their columns."""
    rnd = np.random.default_rng(2)
    groups = {"wide": rnd.normal(size=5000), "ties": rnd.integers(0, 3, 2000).astype(float), "one": np.array([4.0]), None: rnd.random(300)}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("wide", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, value double").repartition(7)
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    for accuracy in (20, 500):
        got = quantiles.quantiles(df, ["g"], probs, method="approx", accuracy=accuracy)
        assert set(got.columns) == {"g", "q", "cnt"} == set(quantiles.quantiles(df, ["g"], probs).columns)
        found = {r["g"]: r for r in got.collect()}
        assert found.keys() == groups.keys()
        for g, values in groups.items():
            assert found[g]["cnt"] == len(values)
            for p, q in zip(probs, found[g]["q"]):
                assert q in values
                first, last = (values < q).sum() + 1, (values <= q).sum()
                slack = len(values) / accuracy + 1
                assert first - slack <= p * len(values) <= last + slack
    with pytest.raises(ValueError):
        quantiles.quantiles(df, ["g"], probs, method="guess")
    features = df.withColumnRenamed("value", "v").where("g = 'wide'")
    exact, near = (stats.describe(features, ["v"], method=m).first() for m in ("exact", "approx"))
    assert near["q50"] == pytest.approx(exact["q50"], abs=0.01) and near["mean"] == exact["mean"]
