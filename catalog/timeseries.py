"""Correlograms and unit-root tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog import query, r6, s6
from catalog.prepare import rows_per_block
from tidemark.operators import autocorr, lookup
from tidemark.operators.series import largest_group

KEYS = ["station", "feature"]


def _sums(spark, sf):
    long = fx.long_series(spark, sf)
    longest = largest_group(fx.splits(spark, sf), ["station"])
    return autocorr.lag_sums(long, KEYS, autocorr.longest_needed_lag(longest))


lag_sums = fx.once("lag-sums", _sums)

_K = autocorr.MAX_LAGS
_acf = f"""{fx.LONG_CTE}, m AS (SELECT station, feature, count(*) AS n, avg(value) AS mean FROM long
    GROUP BY ALL HAVING count(*) >= 20),
  d AS (SELECT station, feature, pos, m.n, value - mean AS d FROM long JOIN m USING (station, feature)),
  l AS (SELECT *, {', '.join(f'lag(d, {k}) OVER w AS d{k}' for k in range(1, _K + 1))} FROM d
        WINDOW w AS (PARTITION BY station, feature ORDER BY pos)),
  a AS (SELECT station, feature, n, [1e0, {', '.join(f'sum(d * d{k}) / sum(d * d)' for k in range(1, _K + 1))}] AS r
        FROM l GROUP BY ALL),
  acf AS (SELECT station, feature, n, r, unnest(range(least({_K}, n // 2) + 1)) AS lag FROM a)"""


def _acf_columns(df):
    return df.select(*KEYS, "n", F.col("lag").cast("long").alias("lag"), r6("acf").alias("acf"), r6("band").alias("band"))


_acf_sql = f"""WITH {_acf} SELECT station, feature, n, lag, {s6('r[lag + 1]')} AS acf,
  {s6(f'''CASE WHEN lag = 0 THEN 0e0 ELSE {autocorr.Z975} * sqrt((1 + 2 * coalesce(
     list_sum(list_transform(r[2:lag], lambda x: x * x)), 0)) / n) END''')} AS band FROM acf"""


@query("autocorrelation", _acf_sql)
def autocorrelation(spark, sf):
    return _acf_columns(autocorr.acf(autocorr.lag_sums(fx.long_series(spark, sf), KEYS, _K), KEYS))


@query("autocorrelation_segments", _acf_sql)
def autocorrelation_segments(spark, sf):
    """The same sums with series cut into short segments."""
    sums = autocorr.lag_sums(fx.long_series(spark, sf), KEYS, _K, group_rows=rows_per_block(spark, sf))
    return _acf_columns(autocorr.acf(sums, KEYS))


_pacf = f"""WITH RECURSIVE {_acf}, p AS (
  SELECT station, feature, n, r, 1 AS k, [r[2]] AS phi, r[2] AS last FROM a
  UNION ALL
  SELECT station, feature, n, r, k + 1,
    list_append(list_transform(phi, lambda x, i: x - b * phi[k + 1 - i]), b), b
  FROM (SELECT *, (r[k + 2] - list_dot_product(phi, list_reverse(r[2:k + 1]))) /
                  (1 - list_dot_product(phi, r[2:k + 1])) AS b FROM p WHERE k < least({_K}, n // 2)))
  SELECT station, feature, n, k AS lag, {s6('last')} AS pacf, {s6(f'{autocorr.Z975} / sqrt(n)')} AS band FROM p"""


@query("partial_autocorrelation", _pacf)
def partial_autocorrelation(spark, sf):
    out = autocorr.pacf(lag_sums(spark, sf), KEYS)
    return out.select(*KEYS, "n", "lag", r6("pacf").alias("pacf"), r6("band").alias("band"))


@query("unit_root_lag0", f"""WITH {fx.LONG_CTE}, l AS (
  SELECT station, feature, value - lag(value) OVER w AS y, lag(value) OVER w AS x FROM long
  WINDOW w AS (PARTITION BY station, feature ORDER BY pos)),
  f AS (SELECT station, feature, count(y) AS nobs, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx,
        regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM l WHERE x IS NOT NULL GROUP BY ALL HAVING count(y) >= 19)
  SELECT station, feature, nobs, 0 AS used_lag,
  {s6('b / sqrt((syy - b * sxy) / (nobs - 2) / sxx)')} AS adf_stat FROM f""")
def unit_root_lag0(spark, sf):
    """Dickey–Fuller statistic without lagged changes."""
    out = autocorr.stationarity(lag_sums(spark, sf), KEYS, max_lag=0)
    return out.select(*KEYS, "nobs", "used_lag", r6("adf_stat").alias("adf_stat"))


# Sums of products over one sample of (regressors …, change) are reduced one regressor at a
# time; what is left in the last corner is the residual sum of squares on those removed so far.
def _reduced(rows: str, name: str) -> str:
    """Product sums of the lists ``v`` in ``rows`` and their reduction: one row per series and step."""
    return f"""{name}_p AS (SELECT station, feature, i, list(g ORDER BY j) AS r FROM (
      SELECT station, feature, i, j, sum(v[i] * v[j]) AS g FROM
        (SELECT station, feature, v, unnest(range(1, len(v) + 1)) AS i FROM {rows}) a,
        LATERAL (SELECT unnest(range(1, len(v) + 1)) AS j) GROUP BY ALL) GROUP BY station, feature, i),
    {name} AS (
      SELECT station, feature, 0 AS k, list(r ORDER BY i) AS m FROM {name}_p GROUP BY station, feature
      UNION ALL
      SELECT station, feature, k + 1, list_transform(m[2:], lambda r: list_transform(r[2:], lambda x, j: x - r[1] * m[1][j + 1] / m[1][1]))
      FROM {name} WHERE len(m) > 2)"""


# Fixed values of the p-value's response surface, as in the operator; the normal integral is its series.
_z = """CASE WHEN stat <= -1.61 THEN 2.1659 + 1.4412 * stat + 0.038269 * stat * stat
    ELSE 1.7339 + 0.93202 * stat - 0.12745 * stat * stat - 0.010368 * stat * stat * stat END"""
_normal = """CASE WHEN abs(z) > 8 THEN CASE WHEN z < 0 THEN 0e0 ELSE 1e0 END ELSE 0.5e0 + exp(-z * z / 2) / sqrt(2 * pi()) * z
    * list_sum(list_transform(range(0, 150), lambda k: exp(k * ln(greatest(z * z, 1e-200)) - k * ln(2e0) - lgamma(k + 1.5e0) + lgamma(1.5e0)))) END"""
_unit_root = f"""{fx.LONG_CTE}, n AS (SELECT station, feature, count(*) AS total, avg(value) AS mean,
    CAST(least(count(*) // 2 - 2, ceil(12e0 * pow(count(*) / 100e0, 0.25e0))) AS BIGINT) AS longest, max(value) > min(value) AS moves
    FROM long GROUP BY ALL HAVING count(*) >= 20),
  x AS (SELECT station, feature, pos, longest, moves, value - mean AS x,
    value - lag(value) OVER (PARTITION BY station, feature ORDER BY pos) AS dx FROM long JOIN n USING (station, feature)),
  w AS MATERIALIZED (SELECT station, feature, pos, longest, dx, lag(x) OVER v AS level,
    list(dx) OVER (PARTITION BY station, feature ORDER BY pos DESC ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING) AS before
    FROM x WHERE moves WINDOW v AS (PARTITION BY station, feature ORDER BY pos)),
  s1 AS (SELECT station, feature, list_concat([level, 1e0], before[1:longest], [dx]) AS v FROM w WHERE pos >= longest + 1),
  {_reduced('s1', 'e1')},
  lagged AS (SELECT station, feature, k - 2 AS used_lag FROM (
    SELECT e1.station, e1.feature, k, row_number() OVER (PARTITION BY e1.station, e1.feature
      ORDER BY (total - 1 - longest) * ln(greatest(m[-1][-1], 0) / (total - 1 - longest)) + 2 * k, k) AS o
    FROM e1 JOIN n ON n.station = e1.station AND n.feature = e1.feature WHERE k >= 2) WHERE o = 1),
  s2 AS (SELECT w.station, w.feature, list_concat([1e0], before[1:used_lag], [level, dx]) AS v
    FROM w JOIN lagged USING (station, feature) WHERE pos >= used_lag + 1),
  {_reduced('s2', 'e2')},
  t AS (SELECT e2.station, e2.feature, used_lag, total - 1 - used_lag AS nobs, m[1][2] / m[1][1] AS b, m[1][1] AS xx,
    m[2][2] - m[1][2] * m[1][2] / m[1][1] AS ssr FROM e2 JOIN lagged ON lagged.station = e2.station AND lagged.feature = e2.feature
    JOIN n ON n.station = e2.station AND n.feature = e2.feature WHERE len(m) = 2),
  u AS (SELECT *, b / sqrt(ssr / (nobs - used_lag - 2) / xx) AS stat FROM t),
  p AS (SELECT *, CASE WHEN stat > 2.74 THEN 1e0 WHEN stat < -18.83 THEN 0e0 ELSE {_normal} END AS p FROM (SELECT *, {_z} AS z FROM u)),
  verdict AS (SELECT station, feature, stat, p, used_lag, nobs, p < 0.05 AS is_stationary FROM n LEFT JOIN p USING (station, feature))"""


@query("unit_root_test", f"""WITH RECURSIVE {_unit_root} SELECT station, feature, {s6('stat', 4)} AS adf_stat, {s6('p')} AS adf_p_value,
  used_lag, nobs, stat IS NOT NULL AS tested, is_stationary,
  CASE WHEN is_stationary THEN 1 WHEN NOT is_stationary THEN 1 END AS p_min, CASE WHEN is_stationary THEN 3 WHEN NOT is_stationary THEN 2 END AS p_max,
  CASE WHEN is_stationary THEN 0 WHEN NOT is_stationary THEN 1 END AS d, CASE WHEN is_stationary THEN 1 WHEN NOT is_stationary THEN 1 END AS q_min,
  CASE WHEN is_stationary THEN 2 WHEN NOT is_stationary THEN 1 END AS q_max FROM verdict""")
def unit_root_test(spark, sf):
    """Unit-root test with the lag of least AIC, its verdict and the suggested orders, for every series."""
    out = autocorr.stationarity(lag_sums(spark, sf), KEYS)
    return out.select(
        *KEYS, r6("adf_stat", 4).alias("adf_stat"), r6("adf_p_value").alias("adf_p_value"), "used_lag", "nobs",
        (F.col("status") == "ok").alias("tested"), "is_stationary", "orders.*")


@query("unit_root_table", f"""WITH RECURSIVE {_unit_root}, {fx.DIM_CTE},
  top AS (SELECT station FROM clean WHERE station IS NOT NULL GROUP BY station ORDER BY count(*) DESC, station LIMIT 3)
  SELECT station || '_' || feature AS key, station, coalesce(english, station) AS english_station,
  feature, feature AS english_feature, is_stationary, {s6('p')} AS adf_p_value
  FROM verdict JOIN top USING (station) LEFT JOIN dim ON name = station""")
def unit_root_table(spark, sf):
    """Result table of the stations with the most rows."""
    top = lookup.top_stations(fx.clean(spark, sf), 3)
    sums = lookup.keep_stations(lag_sums(spark, sf), top)
    tests = autocorr.stationarity(sums, KEYS)
    table = autocorr.unit_root_table(tests, fx.name_dimension(spark, sf), lookup.feature_names(spark))
    return table.withColumn("adf_p_value", r6("adf_p_value"))


@query("unit_root_verdict_lag0", f"""WITH {fx.LONG_CTE}, l AS (
  SELECT station, feature, value - lag(value) OVER w AS y, lag(value) OVER w AS x FROM long
  WINDOW w AS (PARTITION BY station, feature ORDER BY pos)),
  f AS (SELECT station, feature, count(y) AS nobs, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx,
        regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM l WHERE x IS NOT NULL GROUP BY ALL HAVING count(y) >= 19),
  t AS (SELECT *, b / sqrt((syy - b * sxy) / (nobs - 2) / sxx) AS stat FROM f),
  v AS (SELECT *, CASE WHEN stat > 2.74 THEN false WHEN stat < -18.83 THEN true WHEN stat <= -1.61
    THEN 2.1659 + 1.4412 * stat + 0.038269 * stat * stat < -1.6448536269514722
    ELSE 1.7339 + 0.93202 * stat - 0.12745 * stat * stat - 0.010368 * stat * stat * stat < -1.6448536269514722 END AS ok FROM t)
  SELECT station, feature, ok AS is_stationary, CASE WHEN ok THEN 0 ELSE 1 END AS d FROM v""")
def unit_root_verdict_lag0(spark, sf):
    """Verdict at five percent and the suggested differencing, without lagged changes."""
    out = autocorr.stationarity(lag_sums(spark, sf), KEYS, max_lag=0)
    return out.select(*KEYS, "is_stationary", F.col("orders.d").cast("int").alias("d"))
