"""Descriptive statistics and station reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from catalog import query, r6, s6
from catalog import fixtures as fx
from tidemark.names import CATEGORY_DOMAIN
from tidemark.operators import lookup, quantiles, stats
from tidemark.operators.series import time_order, to_long
from tidemark.plans import reports
from tidemark.scratch import materialize

_f = ", ".join(fx.FEATURES)


def _per_feature(select: str, source: str = "typed") -> str:
    """One SELECT per feature; {c} is the column."""
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, {select.format(c=c)} FROM {source}" for c in fx.FEATURES)


@query("describe_features", f"""WITH {fx.TYPED_CTE} {_per_feature(
  "count({c}) AS count, " + s6('avg({c})') + " AS mean, " + s6('stddev_samp({c})') + " AS std, "
  + "min({c}) AS min, max({c}) AS max, " + s6('quantile_cont({c}, 0.25)') + " AS q25, "
  + s6('quantile_cont({c}, 0.5)') + " AS q50, " + s6('quantile_cont({c}, 0.75)') + " AS q75, "
  + "count(*) - count({c}) AS missing, " + s6('(count(*) - count({c})) * 100e0 / count(*)') + " AS missing_pct, "
  + s6('skewness({c})') + " AS skewness, " + s6('kurtosis({c})') + " AS kurtosis")}""")
def describe_features(spark, sf):
    out = stats.describe(fx.typed(spark, sf), fx.FEATURES)
    return out.withColumns({
        c: r6(c) for c in ("mean", "std", "q25", "q50", "q75", "missing_pct", "skewness", "kurtosis")})


_q = [0.05, 0.25, 0.5, 0.75, 0.95]
_qsql = ", ".join(s6(f"quantile_cont(value, {p})") + f" AS q{int(p * 100)}" for p in _q)


def _quantile_columns(df):
    return df.select("station", "feature", "cnt", *[r6(F.col("q")[i]).alias(f"q{int(p * 100)}") for i, p in enumerate(_q)])


@query("series_quantiles", f"WITH {fx.LONG_CTE} SELECT station, feature, count(*) AS cnt, {_qsql} FROM long GROUP BY ALL")
def series_quantiles(spark, sf):
    return _quantile_columns(quantiles.exact_quantiles(fx.long_series(spark, sf), ["station", "feature"], _q))


@query("series_quantiles_ranked", f"""WITH {fx.LONG_CTE}, k AS (
  SELECT CASE WHEN station <> 'ST/00003' THEN station END AS station, feature, value FROM long)
  SELECT station, feature, count(*) AS cnt, {_qsql} FROM k GROUP BY ALL""")
def series_quantiles_ranked(spark, sf):
    """The same quantiles with every larger group narrowed first; one group has a null key."""
    rows = fx.long_series(spark, sf).withColumn("station", F.nullif("station", F.lit("ST/00003")))
    return _quantile_columns(quantiles.exact_quantiles(
        rows, ["station", "feature"], _q, group_values=max(40, rows.count() // 2000)))


@query("global_quantiles_ranked", f"WITH {fx.TYPED_CTE} {_per_feature(', '.join(s6('quantile_cont({c}, ' + str(p) + ')') + f' AS q{int(p * 100)}' for p in _q))}")
def global_quantiles_ranked(spark, sf):
    """Quantiles of whole columns, narrowed over several rounds."""
    rows = to_long(fx.typed(spark, sf), [], fx.FEATURES)
    out = quantiles.exact_quantiles(rows, ["feature"], _q, group_values=max(8, rows.count() // 8000))
    return out.select("feature", *[r6(F.col("q")[i]).alias(f"q{int(p * 100)}") for i, p in enumerate(_q)])


_PROBS_SQL = f"(SELECT unnest([{', '.join(f'{p}e0' for p in _q)}]) AS p)"


@query("series_quantiles_approx", f"""WITH {fx.LONG_CTE} SELECT station, feature, cnt, p, true AS near
  FROM (SELECT station, feature, count(*) AS cnt FROM long GROUP BY ALL), {_PROBS_SQL}""")
def series_quantiles_approx(spark, sf):
    """Sketched quantiles of every series at a rank error of a fiftieth, held against the exact ranks of their values."""
    return _near(fx.long_series(spark, sf), ["station", "feature"], 50)


@query("global_quantiles_approx", f"""WITH {fx.TYPED_CTE}, u AS ({_per_feature('count({c}) AS cnt')})
  SELECT feature, cnt, p, true AS near FROM u, {_PROBS_SQL}""")
def global_quantiles_approx(spark, sf):
    """The same over whole columns at a rank error of a thousandth."""
    return _near(to_long(fx.typed(spark, sf), [], fx.FEATURES), ["feature"], 1000)


def _near(rows, keys, accuracy):
    """Whether a sketch's value holds a rank within cnt / accuracy, and one, of p * cnt."""
    found = quantiles.quantiles(rows, keys, _q, method="approx", accuracy=accuracy)
    each = found.select(*keys, "cnt", F.explode(F.arrays_zip(F.array(*[F.lit(p) for p in _q]).alias("p"), F.col("q"))).alias("z"))
    wanted = each.select(*keys, "cnt", F.col("z.p").alias("p"), F.col("z.q").alias("q"))
    ranks = rows.join(wanted, keys).groupBy(*keys, "cnt", "p").agg(
        F.count_if(F.col("value") < F.col("q")).alias("below"), F.count_if(F.col("value") <= F.col("q")).alias("upto"))
    at, slack = F.col("p") * F.col("cnt"), F.col("cnt") / accuracy + 1
    near = (F.col("below") + 1 <= at + slack) & (F.col("upto") >= at - slack) & (F.col("upto") > F.col("below"))
    return ranks.select(*keys, "cnt", "p", near.alias("near"))


_pairs = " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {i} AS i, {j} AS j, "
    + (s6(f"corr({a}, {b})")) + " AS corr FROM typed"
    for i, a in enumerate(fx.FEATURES) for j, b in enumerate(fx.FEATURES))


@query("correlation_matrix", f"WITH {fx.TYPED_CTE} {_pairs}")
def correlation_matrix(spark, sf):
    return stats.correlation(fx.typed(spark, sf), fx.FEATURES).withColumn("corr", r6("corr"))


@query("correlation_lower_triangle", f"WITH {fx.TYPED_CTE}, c AS ({_pairs}) SELECT * FROM c WHERE i > j")
def correlation_lower_triangle(spark, sf):
    matrix = stats.correlation(fx.typed(spark, sf), fx.FEATURES)
    return stats.lower_triangle(matrix).withColumn("corr", r6("corr"))


def _histogram_sql(bins: str) -> str:
    return f"""WITH {fx.TYPED_CTE}, u AS (
      {" UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v FROM typed WHERE {c} IS NOT NULL" for c in fx.FEATURES)}),
      r AS (SELECT feature, min(v) AS lo, max(v) AS hi, count(*) AS n,
                   quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM u GROUP BY feature),
      b AS (SELECT feature, lo, hi, {bins} AS bins FROM r),
      h AS (SELECT feature, least(floor((v - lo) / (hi - lo) * bins), bins - 1) AS bin, count(*) AS n
            FROM u JOIN b USING (feature) GROUP BY ALL),
      e AS (SELECT feature, lo, hi, bins, unnest(range(CAST(bins AS BIGINT))) AS bin FROM b)
      SELECT e.feature, CAST(e.bin AS BIGINT) AS bin, {s6('lo + e.bin * ((hi - lo) / bins)')} AS "left",
        {s6('lo + (e.bin + 1) * ((hi - lo) / bins)')} AS "right", coalesce(h.n, 0) AS n
      FROM e LEFT JOIN h ON h.feature = e.feature AND h.bin = e.bin"""


@query("histogram_fixed_bins", _histogram_sql("20"))
def histogram_fixed_bins(spark, sf):
    out = stats.histogram(fx.typed(spark, sf), fx.FEATURES, 20)
    return out.withColumns({"left": r6("left"), "right": r6("right")})


@query("histogram_auto_bins", _histogram_sql(
    "ceil((hi - lo) / least((hi - lo) / (log2(n) + 1), 2 * iqr / pow(n, 1e0 / 3e0)))"))
def histogram_auto_bins(spark, sf):
    out = stats.histogram(fx.typed(spark, sf), fx.FEATURES)
    return out.withColumns({"left": r6("left"), "right": r6("right")})


@query("density_curve", f"""WITH {fx.TYPED_CTE}, u AS (
  {" UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v FROM typed WHERE {c} IS NOT NULL" for c in fx.FEATURES)}),
  r AS (SELECT feature, min(v) AS lo, max(v) AS hi, count(*) AS n, stddev_samp(v) * pow(count(*), -0.2e0) AS h
        FROM u GROUP BY feature),
  c AS (SELECT feature, v, count(*) AS m FROM u GROUP BY ALL),
  p AS (SELECT *, lo + point * (hi - lo) / 199e0 AS x FROM (SELECT *, unnest(range(200)) AS point FROM r)),
  d AS (SELECT p.feature, point, any_value(x) AS x, any_value(hi - lo) AS span,
    sum(m * exp(-0.5e0 * pow((x - v) / h, 2))) / any_value(n * h * sqrt(2 * pi())) AS density
    FROM p JOIN c USING (feature) GROUP BY p.feature, point)
  SELECT feature, CAST(point AS INTEGER) AS point, {s6('x')} AS x, {s6('density')} AS density,
  {s6('density * span', 7)} AS scaled FROM d""")
def density_curve(spark, sf):
    """Against the kernel summed over every value, as density and in units of the feature's range."""
    out = stats.density(fx.typed(spark, sf), fx.FEATURES)
    span = F.max("x").over(W.partitionBy("feature")) - F.min("x").over(W.partitionBy("feature"))  # 200 points
    out = out.withColumn("scaled", F.col("density") * span)
    return out.withColumns({"x": r6("x"), "density": r6("density"), "scaled": r6("scaled", 7)})


@query("distribution_report", f"""WITH {fx.TYPED_CTE} {_per_feature(
  "count({c}) AS in_bins, count({c}) AS in_box, " + s6('quantile_cont({c}, 0.5)') + " AS q2, 200 AS points, 20 AS bins")}""")
def distribution_report(spark, sf):
    """The report's three panels, one line per feature."""
    panels = reports.distribution_report(fx.typed(spark, sf), fx.FEATURES, 20)
    bins = panels["histogram"].groupBy("feature").agg(F.sum("n").alias("in_bins"), F.count(F.lit(1)).cast("int").alias("bins"))
    points = panels["density"].groupBy("feature").agg(F.count(F.lit(1)).cast("int").alias("points"))
    box = panels["box"].select("feature", F.col("n").alias("in_box"), r6("q2").alias("q2"))
    return box.join(bins, "feature").join(points, "feature")


@query("box_statistics", f"""WITH {fx.TYPED_CTE}, q AS ({_per_feature(
  "quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3")}),
  u AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v FROM typed WHERE {c} IS NOT NULL" for c in fx.FEATURES)}),
  t AS (SELECT *, v >= q1 - 1.5e0 * (q3 - q1) AND v <= q3 + 1.5e0 * (q3 - q1) AS inside FROM u JOIN q USING (feature))
  SELECT feature, {s6('any_value(q1)')} AS q1, {s6('any_value(q2)')} AS q2, {s6('any_value(q3)')} AS q3,
  min(v) FILTER (WHERE inside) AS whisker_low, max(v) FILTER (WHERE inside) AS whisker_high,
  count(*) FILTER (WHERE NOT inside) AS outliers, count(*) AS n FROM t GROUP BY feature""")
def box_statistics(spark, sf):
    out = stats.box_stats(fx.typed(spark, sf), fx.FEATURES)
    return out.withColumns({c: r6(c) for c in ("q1", "q2", "q3")})


# ---- stations and categories ----------------------------------------------

@query("station_counts", f"""WITH {fx.TYPED_CTE}
  SELECT station, count(*) AS n FROM typed WHERE station IS NOT NULL GROUP BY station""")
def station_counts(spark, sf):
    return lookup.station_counts(fx.typed(spark, sf))


@query("station_ranking", f"""WITH {fx.TYPED_CTE}, c AS (
  SELECT station, count(*) AS n FROM typed WHERE station IS NOT NULL GROUP BY station)
  SELECT station, n, row_number() OVER (ORDER BY n DESC, station) AS rank FROM c""")
def station_ranking(spark, sf):
    return lookup.ranked_stations(fx.typed(spark, sf))


@query("top_stations", f"""WITH {fx.TYPED_CTE}
  SELECT station, count(*) AS n FROM typed WHERE station IS NOT NULL GROUP BY station
  ORDER BY n DESC, station LIMIT 5""")
def top_stations(spark, sf):
    return lookup.top_stations(fx.typed(spark, sf), 5)


@query("top_station_rows", f"""WITH {fx.TYPED_CTE}, t AS (
  SELECT station FROM typed WHERE station IS NOT NULL GROUP BY station ORDER BY count(*) DESC, station LIMIT 5)
  SELECT station, obs_time, {_f}, k1, k2, k3, k4 FROM typed WHERE station IN (SELECT station FROM t)""")
def top_station_rows(spark, sf):
    rows = fx.typed(spark, sf)
    return lookup.keep_stations(rows, lookup.top_stations(rows, 5)).drop("category")


@query("station_availability", f"""WITH {fx.TYPED_CTE}, {fx.DIM_CTE}, c AS (
  SELECT station, count(*) AS n FROM typed WHERE station IS NOT NULL GROUP BY station)
  SELECT station, n, coalesce(english, station) AS english FROM c LEFT JOIN dim ON name = station""")
def station_availability(spark, sf):
    return reports.station_availability(fx.typed(spark, sf), fx.name_dimension(spark, sf), fx.LAYOUT)


@query("top_availability", f"""WITH {fx.TYPED_CTE}, {fx.DIM_CTE}, c AS (
  SELECT station, count(*) AS n FROM typed WHERE station IS NOT NULL GROUP BY station ORDER BY n DESC, station LIMIT 20)
  SELECT station, n, coalesce(english, station) AS english FROM c LEFT JOIN dim ON name = station""")
def top_availability(spark, sf):
    return reports.top_availability(fx.typed(spark, sf), fx.name_dimension(spark, sf), fx.LAYOUT)


@query("rows_per_english_name", f"""WITH {fx.TYPED_CTE}, {fx.DIM_CTE}
  SELECT coalesce(english, station) AS english, count(*) AS n FROM typed LEFT JOIN dim ON name = station
  WHERE station IS NOT NULL GROUP BY 1""")
def rows_per_english_name(spark, sf):
    """Two stations with one display name merge; counts are summed after the lookup."""
    named = lookup.with_english(
        lookup.station_counts(fx.typed(spark, sf)), "station", fx.name_dimension(spark, sf), alias="english")
    return named.groupBy("english").agg(F.sum("n").alias("n"))


@query("station_means", f"""WITH {fx.CLEAN_CTE} SELECT station,
  {', '.join(s6(f'avg({c})') + f' AS {c}' for c in fx.FEATURES)}
  FROM clean WHERE station IS NOT NULL GROUP BY station""")
def station_means(spark, sf):
    out = stats.station_means(fx.clean(spark, sf), fx.FEATURES)
    return out.withColumns({c: r6(c) for c in fx.FEATURES})


@query("indicator_by_station", f"""WITH {fx.CLEAN_CTE}, {fx.DIM_CTE}, u AS (
  {" UNION ALL ".join(f"SELECT station, '{c}' AS feature, avg({c}) AS value FROM clean WHERE station IS NOT NULL GROUP BY station" for c in fx.FEATURES)}),
  r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY {s6('value')} DESC, station) AS rank FROM u)
  SELECT station, feature, {s6('value')} AS value, CAST(rank AS INTEGER) AS rank, coalesce(english, station) AS english
  FROM r LEFT JOIN dim ON name = station WHERE rank <= 20""")
def indicator_by_station(spark, sf):
    out = reports.indicator_by_station(
        fx.clean(spark, sf), fx.FEATURES, fx.name_dimension(spark, sf), fx.LAYOUT)
    return out.withColumn("value", r6("value"))


_domain = ", ".join(f"'{c}'" for c in CATEGORY_DOMAIN)


@query("category_shares", f"""WITH {fx.CLEAN_CTE}, c AS (
  SELECT category, count(*) AS n FROM clean WHERE category IN ({_domain}) GROUP BY category)
  SELECT category, list_position([{_domain}], category) AS rank, n,
  {s6('n * 100e0 / sum(n) OVER ()')} AS share, printf('%.1f%%', n * 100e0 / sum(n) OVER ()) AS label FROM c""")
def category_shares(spark, sf):
    out = stats.category_shares(fx.clean(spark, sf), CATEGORY_DOMAIN)
    return out.select(
        "category", F.col("rank").cast("int").alias("rank"), "n", r6("share").alias("share"),
        F.format_string("%.1f%%", "share").alias("label"))


_modes = f"""{fx.CLEAN_CTE}, c AS (SELECT station, category, count(*) AS n FROM clean
  WHERE station IS NOT NULL AND category IS NOT NULL GROUP BY ALL),
  best AS (SELECT station, category, row_number() OVER (PARTITION BY station ORDER BY n DESC, category) AS r FROM c),
  modes AS (SELECT s.station, b.category FROM (SELECT DISTINCT station FROM clean WHERE station IS NOT NULL) s
            LEFT JOIN best b ON b.station = s.station AND r = 1)"""


@query("station_category_mode", f"WITH {_modes} SELECT station, category FROM modes")
def station_category_mode(spark, sf):
    return stats.station_modes(fx.clean(spark, sf))


@query("stations_per_category", f"""WITH {_modes}
  SELECT category, count(*) AS stations FROM modes WHERE category IS NOT NULL GROUP BY category""")
def stations_per_category(spark, sf):
    return stats.stations_per_category(stats.station_modes(fx.clean(spark, sf)))


def _dashboard(spark, sf):
    return reports.dashboard(fx.clean(spark, sf), fx.LAYOUT, pairs=[("f_qty", "f_price")])


for _a, _b in [("f_qty", "f_price"), ("f_disc", "f_tax"), ("f_qty", "f_tax")]:
    def _pair(spark, sf, a=_a, b=_b):
        return reports.scatter_pairs(fx.clean(spark, sf), [(a, b)], fx.LAYOUT)[f"{a}_vs_{b}"]

    query(f"scatter_{_a}_{_b}", f"WITH {fx.CLEAN_CTE} SELECT {_a} AS x, {_b} AS y, category FROM clean")(_pair)


@query("dashboard_correlation", f"""WITH {fx.CLEAN_CTE}, c AS ({_pairs.replace('FROM typed', 'FROM clean')})
  SELECT * FROM c WHERE i > j""")
def dashboard_correlation(spark, sf):
    return _dashboard(spark, sf)["correlation"].withColumn("corr", r6("corr"))


@query("dashboard_box", f"""WITH {fx.CLEAN_CTE}, q AS ({_per_feature(
  "quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3", "clean")}),
  u AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v FROM clean" for c in fx.FEATURES)}),
  t AS (SELECT *, v >= q1 - 1.5e0 * (q3 - q1) AND v <= q3 + 1.5e0 * (q3 - q1) AS inside FROM u JOIN q USING (feature))
  SELECT feature, {s6('any_value(q1)')} AS q1, {s6('any_value(q2)')} AS q2, {s6('any_value(q3)')} AS q3,
  min(v) FILTER (WHERE inside) AS whisker_low, max(v) FILTER (WHERE inside) AS whisker_high,
  count(*) FILTER (WHERE NOT inside) AS outliers, count(*) AS n FROM t GROUP BY feature""")
def dashboard_box(spark, sf):
    return _dashboard(spark, sf)["box"].withColumns({c: r6(c) for c in ("q1", "q2", "q3")})


# ---- series reports --------------------------------------------------------

_trim = f"""{fx.LONG_CTE}, dated AS (SELECT * FROM long WHERE obs_time IS NOT NULL),
  q AS (SELECT station, feature, count(*) AS cnt, quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS b
        FROM dated GROUP BY ALL),
  trimmed AS (SELECT d.* FROM dated d JOIN q USING (station, feature)
    WHERE cnt <= 10 OR (value >= a - 1.5e0 * (b - a) AND value <= b + 1.5e0 * (b - a)))"""


@query("display_trim", f"WITH {_trim} SELECT station, feature, obs_time, value, k1, k2, k3, k4 FROM trimmed")
def display_trim(spark, sf):
    return reports.trimmed_series(fx.long_series(spark, sf), fx.LAYOUT).select(
        "station", "feature", "obs_time", "value", *fx.TIES)


@query("series_trends", f"""WITH {_trim}, p AS (SELECT *, row_number() OVER (
  PARTITION BY station, feature ORDER BY obs_time NULLS LAST, k1, k2, k3, k4) - 1 AS x FROM trimmed)
  SELECT station, feature, count(*) AS n, {s6('CASE WHEN count(*) > 5 THEN avg(value) END')} AS mean,
  {s6('CASE WHEN count(*) > 5 THEN regr_slope(value, x) END')} AS slope,
  {s6('CASE WHEN count(*) > 5 THEN regr_intercept(value, x) END')} AS intercept
  FROM p GROUP BY ALL""")
def series_trends(spark, sf):
    out = reports.series_trends(fx.long_series(spark, sf), fx.LAYOUT)
    return out.withColumns({c: r6(c) for c in ("mean", "slope", "intercept")})


@query("station_series_report", f"""WITH {_trim}, top AS (
  SELECT station FROM clean WHERE station IS NOT NULL GROUP BY station ORDER BY count(*) DESC, station LIMIT 5),
  p AS (SELECT *, row_number() OVER (
    PARTITION BY station, feature ORDER BY obs_time NULLS LAST, k1, k2, k3, k4) - 1 AS x FROM trimmed
    WHERE station IN (SELECT station FROM top)),
  l AS (SELECT station, feature, avg(value) AS mean, regr_slope(value, x) AS slope,
        regr_intercept(value, x) AS intercept FROM p GROUP BY ALL)
  SELECT station, feature, obs_time, value, x AS pos, {s6('mean', 4)} AS mean, {s6('intercept + slope * x', 4)} AS trend,
  printf('Mean: %.2f', mean) AS label
  FROM p JOIN l USING (station, feature)""")
def station_series_report(spark, sf):
    """Values, mean and trend line of the stations with the most rows."""
    top = lookup.top_stations(fx.clean(spark, sf), 5)
    long = lookup.keep_stations(fx.long_series(spark, sf), F.broadcast(top))  # five stations
    return _with_lines(materialize(long, "report-series"))


def _with_lines(long):
    from tidemark.operators.series import with_position

    keys = ["station", "feature"]
    trimmed = reports.trimmed_series(long, fx.LAYOUT)
    lines = stats.trend_lines(trimmed, keys, time_order(fx.LAYOUT))
    placed = with_position(trimmed.drop("pos", "n"), keys, time_order(fx.LAYOUT))
    joined = stats.attach_series_stats(placed.drop("n"), lines.where("mean is not null"), keys, "n")
    return joined.select(
        "station", "feature", "obs_time", "value", "pos", r6("mean", 4).alias("mean"),
        r6(F.col("intercept") + F.col("slope") * F.col("pos"), 4).alias("trend"),
        F.format_string("Mean: %.2f", "mean").alias("label"))
