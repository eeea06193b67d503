"""Scans, typing, cleaning, splits, sample frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query, r6, s6
from catalog import fixtures as fx
from tidemark.operators import cleaning, series
from tidemark.scratch import materialize

_f = ", ".join(fx.FEATURES)
_all = f"station, obs_time, category, {_f}, k1, k2, k3, k4"


@query("type_readings", f"WITH {fx.TYPED_CTE} SELECT {_all} FROM typed")
def type_readings(spark, sf):
    return cleaning.type_readings(fx.raw_readings(spark, sf), fx.LAYOUT)


@query("drop_empty_rows", f"WITH {fx.KEPT_CTE} SELECT {_all} FROM kept")
def drop_empty_rows(spark, sf):
    return cleaning.drop_empty(cleaning.type_readings(fx.raw_readings(spark, sf), fx.LAYOUT), fx.LAYOUT)


@query("null_outliers", f"WITH {fx.FENCED_CTE} SELECT {_all} FROM fenced")
def null_outliers(spark, sf):
    kept = cleaning.drop_empty(fx.typed(spark, sf), fx.LAYOUT)
    return cleaning.null_outliers(kept, cleaning.iqr_fences(kept, fx.LAYOUT))


@query("fill_series", f"WITH {fx.FILLED_CTE} SELECT {_all} FROM filled")
def fill_series(spark, sf):
    return series.fill_series(null_outliers(spark, sf), fx.LAYOUT)


@query("fill_series_blocks", f"WITH {fx.FILLED_CTE} SELECT {_all} FROM filled")
def fill_series_blocks(spark, sf):
    """The fill with stations too long for one task: at most 97 rows per block."""
    return series.fill_series(null_outliers(spark, sf), fx.LAYOUT, group_rows=rows_per_block(spark, sf))


def rows_per_block(spark, sf):
    """A block size below the station length, about 64 blocks in all."""
    return max(97, fx.table(spark, sf, "lineitem").count() // 64)


@query("clean_readings", f"WITH {fx.CLEAN_CTE} SELECT {_all} FROM clean")
def clean_readings(spark, sf):
    return cleaning.clean(fx.raw_readings(spark, sf), fx.LAYOUT)


@query("clean_station_summary", f"""WITH {fx.CLEAN_CTE} SELECT station, count(*) AS n,
  {', '.join(s6(f'avg({c})') + f' AS avg_{c}' for c in fx.FEATURES)}
  FROM clean GROUP BY station""")
def clean_station_summary(spark, sf):
    return cleaning.clean(fx.raw_readings(spark, sf), fx.LAYOUT).groupBy("station").agg(
        F.count(F.lit(1)).alias("n"), *[r6(F.avg(c)).alias(f"avg_{c}") for c in fx.FEATURES])


@query("missing_report", f"""WITH {fx.TYPED_CTE}, u AS (
  {' UNION ALL '.join(f"SELECT '{c}' AS feature, {c} AS v FROM typed" for c in fx.FEATURES)})
  SELECT feature, count(*) - count(v) AS missing,
  {s6('(count(*) - count(v)) * 100e0 / count(*)')} AS missing_pct FROM u GROUP BY feature""")
def missing_report(spark, sf):
    return cleaning.missing_report(fx.typed(spark, sf), fx.FEATURES).withColumn("missing_pct", r6("missing_pct"))


_outlier_sql = " UNION ALL ".join(f"""SELECT '{c}' AS feature, any_value(q1_{c} - 2e0*(q3_{c}-q1_{c})) AS lo,
  any_value(q3_{c} + 2e0*(q3_{c}-q1_{c})) AS hi, count({c}) AS n,
  count(*) FILTER (WHERE {c} < q1_{c} - 2e0*(q3_{c}-q1_{c}) OR {c} > q3_{c} + 2e0*(q3_{c}-q1_{c})) AS outliers
  FROM kept, quart""" for c in fx.FEATURES)


@query("outlier_report", f"""WITH {fx.KEPT_CTE}, o AS ({_outlier_sql})
  SELECT feature, {s6('lo')} AS lo, {s6('hi')} AS hi, n, outliers,
  {s6('outliers * 100e0 / n')} AS outlier_pct FROM o""")
def outlier_report(spark, sf):
    kept = cleaning.drop_empty(fx.typed(spark, sf), fx.LAYOUT)
    out = cleaning.outlier_report(kept, fx.LAYOUT)
    return out.withColumns({c: r6(c) for c in ("lo", "hi", "outlier_pct")})


@query("quality_report", f"""WITH {fx.KEPT_CTE}, o AS ({_outlier_sql}), u AS (
  {' UNION ALL '.join(f"SELECT '{c}' AS feature, {c} AS v FROM typed" for c in fx.FEATURES)}),
  m AS (SELECT feature, count(*) AS rows_in, count(*) - count(v) AS missing FROM u GROUP BY feature)
  SELECT m.feature, missing, outliers, rows_in, (SELECT count(*) FROM kept) AS rows_out,
  rows_in - (SELECT count(*) FROM kept) AS rows_removed FROM m JOIN o USING (feature)""")
def quality_report(spark, sf):
    report = cleaning.quality_report(fx.raw_readings(spark, sf), fx.LAYOUT)
    return report.select("feature", "missing", "outliers", "rows_in", "rows_out", "rows_removed")


@query("split_series", f"WITH {fx.SPLIT_CTE} SELECT station, obs_time, {_f}, k1, k2, k3, k4, pos, n, split FROM splits")
def split_series(spark, sf):
    return series.split_series(fx.clean(spark, sf), fx.LAYOUT).drop("category")


@query("split_series_blocks", f"""WITH {fx.SPLIT_CTE}
  SELECT station, obs_time, {_f}, k1, k2, k3, k4, pos, n, split FROM splits""")
def split_series_blocks(spark, sf):
    return series.split_series(
        fx.clean(spark, sf), fx.LAYOUT, group_rows=rows_per_block(spark, sf)).drop("category")


@query("split_sizes", f"""WITH {fx.SPLIT_CTE} SELECT station, split, count(*) AS rows FROM splits GROUP BY ALL""")
def split_sizes(spark, sf):
    return fx.splits(spark, sf).groupBy("station", "split").agg(F.count(F.lit(1)).alias("rows"))


@query("long_series", f"""WITH {fx.LONG_CTE}
  SELECT station, feature, obs_time, value, k1, k2, k3, k4, pos, n, split FROM long""")
def long_series(spark, sf):
    return fx.long_series(spark, sf)


@query("train_val_rows", f"""WITH {fx.LONG_CTE} SELECT station, feature, count(*) AS n, {s6('avg(value)')} AS mean
  FROM long WHERE split IN ('train', 'val') GROUP BY ALL""")
def train_val_rows(spark, sf):
    both = fx.long_series(spark, sf).where(F.col("split").isin("train", "val"))
    return both.groupBy("station", "feature").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"))


short_split = f"""{fx.SHORT_CTE}, p AS (SELECT *, row_number() OVER w - 1 AS pos,
  count(*) OVER (PARTITION BY station) AS n FROM short
  WINDOW w AS (PARTITION BY station ORDER BY obs_time NULLS LAST, event_id)),
  s AS (SELECT *, CASE WHEN pos < floor(n*0.8e0) THEN 'train'
    WHEN pos < floor(n*0.8e0) + floor(n*0.1e0) THEN 'val' ELSE 'test' END AS split FROM p)"""
_floor_cases = " UNION ALL ".join(
    f"""SELECT station, '{m}' AS model, n_train, n_val, n_test FROM c
        WHERE n_train >= {t} AND n_val >= {v} AND n_test >= {e}"""
    for m in ("arima", "sarima", "arima_ann", "cnn_lstm", "cnn_gru_attention", "xgboost")
    for t, v, e in [series.floors(m, 5)])


@query("eligible_series", f"""WITH {short_split}, c AS (
  SELECT station, count(*) FILTER (WHERE split = 'train') AS n_train,
  count(*) FILTER (WHERE split = 'val') AS n_val, count(*) FILTER (WHERE split = 'test') AS n_test
  FROM s WHERE value IS NOT NULL GROUP BY station) {_floor_cases}""")
def eligible_series(spark, sf):
    placed = series.split_series(fx.short_readings(spark, sf), fx.SHORT)
    long = series.to_long(placed, ["station", "split"], ["value"])
    models = [*series.FLOORS, "cnn_gru_attention"]
    long = materialize(long, "split-values")
    parts = [series.eligible_series(long, m, horizon=5).withColumn("model", F.lit(m)) for m in models]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("feature")


@query("stations_in_all_splits", f"""WITH {short_split}
  SELECT station FROM s GROUP BY station HAVING count(DISTINCT split) = 3""")
def stations_in_all_splits(spark, sf):
    return series.stations_in_all_splits(series.split_series(fx.short_readings(spark, sf), fx.SHORT))


_sup_keys = "station, feature, split, pos"
_sup_sql = f"""WITH {fx.LONG_CTE}, w AS (SELECT *,
  row_number() OVER (PARTITION BY station, feature, split ORDER BY pos) - 1 AS sp,
  count(*) OVER (PARTITION BY station, feature, split) AS sn,
  {', '.join(f'lag(value, {k}) OVER (PARTITION BY station, feature ORDER BY pos) AS x{k}' for k in range(1, 13))},
  {', '.join(f'lead(value, {k - 1}) OVER (PARTITION BY station, feature ORDER BY pos) AS y{k}' for k in range(1, 6))}
  FROM long) SELECT {_sup_keys}, {', '.join(f'x{k}' for k in range(1, 13))}, {', '.join(f'y{k}' for k in range(1, 6))}
  FROM w WHERE sp >= 12 AND sp + 5 <= sn"""


def _supervised(spark, sf, group_rows=None):
    frame = series.supervised_frame(
        fx.long_series(spark, sf), ["station", "feature"], horizon=5, group_rows=group_rows)
    xs = [f"x{k}" for k in range(1, 13)]
    return frame.select("station", "feature", "split", "pos", *xs, *[f"y{k}" for k in range(1, 6)])


@query("supervised_frame", _sup_sql)
def supervised_frame(spark, sf):
    return _supervised(spark, sf)


@query("supervised_frame_segments", _sup_sql)
def supervised_frame_segments(spark, sf):
    """Same samples with series cut into short segments with halos."""
    return _supervised(spark, sf, rows_per_block(spark, sf))


_recent = ", ".join(
    s6("(" + "+".join(f"lag({c}, {k}) OVER w" for k in range(1, 13)) + ")/12e0") + f" AS {c}" for c in fx.FEATURES)


@query("lag_window_arrays", f"""WITH {fx.SPLIT_CTE}, w AS (SELECT station, pos, lag(pos, 12) OVER w AS first, {_recent}
  FROM splits WINDOW w AS (PARTITION BY station ORDER BY pos))
  SELECT station, pos, {_f} FROM w WHERE first IS NOT NULL""")
def lag_window_arrays(spark, sf):
    """Mean of the last twelve values of every feature."""
    shifts = {f"{c}_{k}": (c, k) for c in fx.FEATURES for k in range(1, 13)}
    lags = series.lagged(fx.splits(spark, sf).select("station", "pos", *fx.FEATURES), ["station"], shifts)

    def mean(c):
        return F.aggregate(F.array(*[F.col(f"{c}_{k}") for k in range(1, 13)]), F.lit(0.0), lambda a, x: a + x) / 12.0

    return lags.where("pos >= 12").select("station", "pos", *[r6(mean(c)).alias(c) for c in fx.FEATURES])


_ratio_order = "PARTITION BY station ORDER BY obs_time NULLS LAST, k1, k2, k3, k4"
_ratio_sql = f"""WITH {fx.CLEAN_CTE}, g AS (SELECT * REPLACE (CASE WHEN k1 % 37 <> 0 THEN f_price END AS f_price)
    FROM clean WHERE station IS NOT NULL),
  p AS (SELECT *, row_number() OVER ({_ratio_order}) - 1 AS place, count(*) OVER (PARTITION BY station) AS n FROM g),
  s AS (SELECT *, CASE WHEN place < floor(n * 0.6e0) THEN 'train'
    WHEN place < floor(n * 0.6e0) + floor(n * 0.2e0) THEN 'val' ELSE 'test' END AS split FROM p),
  long AS (SELECT station, 'f_price' AS feature, split, f_price AS value,
    row_number() OVER (PARTITION BY station ORDER BY place) - 1 AS pos FROM s WHERE f_price IS NOT NULL),
  w AS (SELECT *, row_number() OVER (PARTITION BY station, split ORDER BY pos) - 1 AS sp,
    count(*) OVER (PARTITION BY station, split) AS sn,
    {', '.join(f'lag(value, {k}) OVER (PARTITION BY station ORDER BY pos) AS x{k}' for k in range(1, 13))},
    {', '.join(f'lead(value, {k - 1}) OVER (PARTITION BY station ORDER BY pos) AS y{k}' for k in range(1, 6))} FROM long)
  SELECT station, feature, split, pos, {', '.join(f'x{k}' for k in range(1, 13))}, {', '.join(f'y{k}' for k in range(1, 6))}
  FROM w WHERE sp >= 12 AND sp + 5 <= sn"""


@query("supervised_frame_ratios", _ratio_sql)
def supervised_frame_ratios(spark, sf):
    """Samples under a 6:2:2 split of a column with missing values."""
    from tidemark.plans.forecast import series_of

    gaps = fx.clean(spark, sf).withColumn("f_price", F.when(F.col("k1") % 37 != 0, F.col("f_price")))
    placed = series.split_series(gaps, fx.LAYOUT, train=0.6, val=0.2)
    long = series_of(placed, fx.LAYOUT, ["f_price"])
    frame = series.supervised_frame(long, ["station", "feature"], horizon=5)
    xs = [f"x{k}" for k in range(1, 13)]
    return frame.select("station", "feature", "split", "pos", *xs, *[f"y{k}" for k in range(1, 6)])


_ratio_features_sql = f"""WITH {fx.CLEAN_CTE}, g AS (SELECT * REPLACE (
    {', '.join(f'CASE WHEN (k1 + {i}) % 37 <> 0 THEN {c} END AS {c}' for i, c in enumerate(fx.FEATURES))})
    FROM clean WHERE station IS NOT NULL),
  p AS (SELECT *, row_number() OVER ({_ratio_order}) - 1 AS place, count(*) OVER (PARTITION BY station) AS n FROM g),
  s AS (SELECT *, CASE WHEN place < floor(n * 0.6e0) THEN 'train'
    WHEN place < floor(n * 0.6e0) + floor(n * 0.2e0) THEN 'val' ELSE 'test' END AS split FROM p),
  u AS ({' UNION ALL '.join(f"SELECT station, '{c}' AS feature, split, place, {c} AS value FROM s" for c in fx.FEATURES)}),
  long AS (SELECT station, feature, split, value,
    row_number() OVER (PARTITION BY station, feature ORDER BY place) - 1 AS pos FROM u WHERE value IS NOT NULL),
  w AS (SELECT *, row_number() OVER (PARTITION BY station, feature, split ORDER BY pos) - 1 AS sp,
    count(*) OVER (PARTITION BY station, feature, split) AS sn,
    {', '.join(f'lag(value, {k}) OVER (PARTITION BY station, feature ORDER BY pos) AS x{k}' for k in range(1, 13))},
    {', '.join(f'lead(value, {k - 1}) OVER (PARTITION BY station, feature ORDER BY pos) AS y{k}' for k in range(1, 6))} FROM long)
  SELECT station, feature, split, pos, {', '.join(f'x{k}' for k in range(1, 13))}, {', '.join(f'y{k}' for k in range(1, 6))}
  FROM w WHERE sp >= 12 AND sp + 5 <= sn"""


@query("supervised_frame_ratios_features", _ratio_features_sql)
def supervised_frame_ratios_features(spark, sf):
    """The same for every feature, each with missing values in other rows."""
    from tidemark.plans.forecast import series_of

    gaps = fx.clean(spark, sf).withColumns(
        {c: F.when((F.col("k1") + i) % 37 != 0, F.col(c)) for i, c in enumerate(fx.FEATURES)})
    placed = series.split_series(gaps, fx.LAYOUT, train=0.6, val=0.2)
    frame = series.supervised_frame(series_of(placed, fx.LAYOUT, fx.FEATURES), ["station", "feature"], horizon=5)
    xs = [f"x{k}" for k in range(1, 13)]
    return frame.select("station", "feature", "split", "pos", *xs, *[f"y{k}" for k in range(1, 6)])


_wanted = ["f_price", "f_disc", "absent"]


@query("validate_columns", f"WITH {fx.CLEAN_CTE} SELECT station, f_price, f_disc FROM clean")
def validate_columns(spark, sf):
    """Required columns that exist, the missing one skipped."""
    df = fx.clean(spark, sf)
    return df.select("station", *series.validate_columns(df, _wanted, on_missing="skip"))
