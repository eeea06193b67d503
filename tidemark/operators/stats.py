"""Descriptive statistics, distributions, correlations, trends."""

from __future__ import annotations

from functools import reduce
from math import ceil, factorial, log2
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators.quantiles import MAX_GROUP_VALUES, exact_quantiles, feature_quantiles
from tidemark.operators.series import with_position
from tidemark.scratch import max_group_rows

# Fixed values of the display trim and the box plot.
TRIM_PROBS = [0.05, 0.95]
TRIM_FACTOR = 1.5
TRIM_MIN_ROWS = 10
TREND_MIN_ROWS = 5
WHISKER = 1.5


def corrected_skewness(c: str) -> Column:
    """Bias-corrected skewness; null below three values."""
    n = F.count(c).cast("double")
    g1 = F.coalesce(F.skewness(c), F.lit(0.0))
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def corrected_kurtosis(c: str) -> Column:
    """Bias-corrected excess kurtosis; null below four values."""
    n = F.count(c).cast("double")
    factor = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    full = factor * ((n + 1) * F.kurtosis(c) + 6)
    return F.when(n >= 4, F.coalesce(full, F.lit(0.0)))


def per_feature(df: DataFrame, features: list[str], measures) -> DataFrame:
    """One aggregate over the wide table, turned into one row per feature.

    ``measures(feature)`` returns the aliased aggregates of that column.
    """
    one_row = df.agg(*[F.struct(*measures(f)).alias(f) for f in features])
    return one_row.unpivot([], features, "feature", "m").select("feature", "m.*")


def _lookup(table: dict, key: str = "feature") -> Column:
    """Literal map for a value per feature; features are schema-bounded."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.col(key)]


def with_feature_values(df: DataFrame, values: dict[str, list[float]], names: list[str]) -> DataFrame:
    """Attach per-feature numbers that were computed on the driver side."""
    values = {f: v for f, v in values.items() if v is not None}
    return df.withColumns({
        name: _lookup({f: v[i] for f, v in values.items()}).cast("double") if values else F.lit(None).cast("double")
        for i, name in enumerate(names)})


def describe(
    df: DataFrame, features: list[str], *, group_values: int = MAX_GROUP_VALUES, method: str = "exact"
) -> DataFrame:
    """count, mean, std, min, quartiles, max, missing, skewness, kurtosis per feature; ``method`` as in ``quantiles``."""
    rows = F.count(F.lit(1))
    moments = per_feature(df, features, lambda f: [
        F.count(f).alias("count"), F.avg(f).alias("mean"), F.stddev_samp(f).alias("std"),
        F.min(f).cast("double").alias("min"), F.max(f).cast("double").alias("max"),
        (rows - F.count(f)).alias("missing"),
        F.try_divide((rows - F.count(f)) * 100.0, rows).alias("missing_pct"),
        corrected_skewness(f).alias("skewness"), corrected_kurtosis(f).alias("kurtosis")])
    quartiles = feature_quantiles(df, features, [0.25, 0.5, 0.75], group_values=group_values, method=method)
    return with_feature_values(moments, quartiles, ["q25", "q50", "q75"])


def correlation(df: DataFrame, features: list[str]) -> DataFrame:
    """Pairwise-complete Pearson correlations, long form with matrix positions i, j."""
    pairs = [(i, j) for i in range(len(features)) for j in range(i + 1)]
    one_row = df.agg(*[F.corr(features[i], features[j]).alias(f"{i}_{j}") for i, j in pairs])
    lower = one_row.unpivot([], [f"{i}_{j}" for i, j in pairs], "pair", "corr")
    position = F.split("pair", "_")
    names = F.array(*[F.lit(f) for f in features])
    lower = lower.select(position[0].cast("int").alias("i"), position[1].cast("int").alias("j"), "corr")
    both = lower.withColumn(
        "p", F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(
            F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))))
    return both.select(
        names[F.col("p.i")].alias("feature_a"), names[F.col("p.j")].alias("feature_b"), "p.i", "p.j", "corr")


def lower_triangle(matrix: DataFrame) -> DataFrame:
    return matrix.where("i > j")


def _ranges(df: DataFrame, features: list[str]) -> dict:
    rows = per_feature(df, features, lambda f: [
        F.count(f).alias("n"), F.min(f).cast("double").alias("lo"),
        F.max(f).cast("double").alias("hi"), F.stddev_samp(f).alias("sd")]).collect()
    return {r["feature"]: r for r in rows if r["n"]}


def auto_bins(n: int, lo: float, hi: float, iqr: float) -> int:
    """Bin count from the narrower of the Sturges and Freedman–Diaconis widths."""
    if hi <= lo:
        return 1
    widths = [(hi - lo) / (log2(n) + 1)]
    if iqr > 0:
        widths.append(2 * iqr / n ** (1 / 3))
    return max(1, ceil((hi - lo) / min(widths)))


def _bin(value: Column, lo: Column, hi: Column, bins: Column) -> Column:
    raw = F.floor((value - lo) / (hi - lo) * bins)
    return F.when(hi > lo, F.least(raw, bins - 1)).otherwise(F.lit(0)).cast("long")


def _feature_bins(df: DataFrame, ranges: dict, bins: dict[str, int]) -> DataFrame:
    """Occupied bins: (feature, bin, n); counted per column before any shuffle grows."""
    from tidemark.operators.series import to_long

    long = to_long(df, [], list(ranges))
    lo, hi = (_lookup({f: float(r[k]) for f, r in ranges.items()}) for k in ("lo", "hi"))
    count = _lookup({f: int(bins[f]) for f in ranges})
    return long.groupBy("feature", _bin(F.col("value"), lo, hi, count).alias("bin")).agg(F.count("value").alias("n"))


def histogram(
    df: DataFrame, features: list[str], bins: int | str = "auto", *, group_values: int = MAX_GROUP_VALUES
) -> DataFrame:
    """Equal-width histogram per feature, empty bins included, last bin closed."""
    ranges = _ranges(df, features)
    if bins == "auto":
        quartiles = feature_quantiles(df, list(ranges), [0.25, 0.75], group_values=group_values)
        counts = {f: auto_bins(r["n"], r["lo"], r["hi"], quartiles[f][1] - quartiles[f][0]) for f, r in ranges.items()}
    else:
        counts = {f: int(bins) for f in ranges}
    occupied = _feature_bins(df, ranges, counts)
    spark = df.sparkSession
    edges = reduce(lambda a, b: a.unionByName(b), [
        spark.range(counts[f]).select(
            F.lit(f).alias("feature"), F.col("id").alias("bin"), F.lit(r["lo"]).alias("lo"),
            F.lit((r["hi"] - r["lo"]) / counts[f]).alias("width")) for f, r in ranges.items()])
    return edges.join(occupied, ["feature", "bin"], "left").select(
        "feature", "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("left"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("right"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"))


CELLS_PER_BANDWIDTH = 40
KERNEL_TERMS = 6
KERNEL_REACH = 9.0


def density(df: DataFrame, features: list[str], *, grid: int = 200) -> DataFrame:
    """Gaussian kernel density on ``grid`` points between min and max, Scott bandwidth.

    Values are counted into cells of a fortieth of their feature's bandwidth, with
    the power sums of their distance from the cell's centre. The kernel is
    expanded around the centre in those sums, so a point differs from the direct
    sum over all values by less than 1e-12 of the kernel's peak, whatever the
    range. A cell meets the grid points within nine bandwidths only, beyond
    which the kernel is below 1e-17.
    """
    from tidemark.operators.series import to_long

    ranges = {f: r for f, r in _ranges(df, features).items() if r["sd"]}
    if not ranges:
        return df.sparkSession.createDataFrame([], "feature string, point int, x double, density double")
    lo, hi, n, h = (_lookup(t).cast("double") for t in (
        {f: r["lo"] for f, r in ranges.items()}, {f: r["hi"] for f, r in ranges.items()},
        {f: float(r["n"]) for f, r in ranges.items()},
        {f: r["sd"] * r["n"] ** -0.2 for f, r in ranges.items()}))
    place = (F.col("value") - lo) / h
    cell = F.floor(place * CELLS_PER_BANDWIDTH)
    off = place - (F.col("cell") + 0.5) / CELLS_PER_BANDWIDTH
    long = to_long(df, [], list(ranges)).withColumn("cell", cell)
    moments = long.withColumn("off", off).groupBy("feature", "cell").agg(*[
        F.sum(reduce(mul, [F.col("off")] * k, F.lit(1.0))).alias(f"m{k}") for k in range(KERNEL_TERMS)])
    centre = lo + (F.col("cell") + 0.5) / CELLS_PER_BANDWIDTH * h
    step = (hi - lo) / F.lit(float(grid - 1))
    near = [F.greatest(F.lit(0.0), F.ceil((centre - KERNEL_REACH * h - lo) / step)).cast("int"),
            F.least(F.lit(float(grid - 1)), F.floor((centre + KERNEL_REACH * h - lo) / step)).cast("int")]
    met = moments.withColumns({"first": near[0], "last": near[1]}).where("first <= last")
    points = met.withColumn("point", F.explode(F.sequence("first", "last")))
    x = lo + F.col("point") * step
    z = (x - centre) / h
    # Derivatives of the kernel: Hermite polynomials by their recurrence.
    hermite = [F.lit(1.0), F.col("z")]
    for k in range(1, KERNEL_TERMS - 1):
        hermite.append(F.col("z") * hermite[k] - k * hermite[k - 1])
    term = sum((hermite[k] * F.col(f"m{k}") / float(factorial(k)) for k in range(1, KERNEL_TERMS)), F.col("m0"))
    summed = points.withColumn("z", z).groupBy("feature", "point").agg(
        F.sum(F.exp(-0.5 * F.col("z") * F.col("z")) * term).alias("s"))
    everywhere = df.sparkSession.range(grid).select(
        F.explode(F.array(*[F.lit(f) for f in ranges])).alias("feature"), F.col("id").cast("int").alias("point"))
    return everywhere.join(summed, ["feature", "point"], "left").select(
        "feature", "point", x.alias("x"),
        (F.coalesce("s", F.lit(0.0)) / (n * h * F.sqrt(F.lit(2.0) * F.pi()))).alias("density"))


def box_stats(
    df: DataFrame, features: list[str], *, group_values: int = MAX_GROUP_VALUES, method: str = "exact"
) -> DataFrame:
    """Quartiles, whisker ends (furthest values within 1.5 IQR) and outlier counts; ``method`` as in ``quantiles``."""
    quartiles = feature_quantiles(df, features, [0.25, 0.5, 0.75], group_values=group_values, method=method)

    def measures(f):
        q1, _, q3 = quartiles[f]
        lo, hi = q1 - WHISKER * (q3 - q1), q3 + WHISKER * (q3 - q1)
        inside = (F.col(f) >= lo) & (F.col(f) <= hi)
        return [
            F.min(F.when(inside, F.col(f))).cast("double").alias("whisker_low"),
            F.max(F.when(inside, F.col(f))).cast("double").alias("whisker_high"),
            F.count_if(~inside).alias("outliers"), F.count(f).alias("n")]

    stats = per_feature(df, list(quartiles), measures)
    return with_feature_values(stats, quartiles, ["q1", "q2", "q3"])


def attach_series_stats(
    rows: DataFrame, stats: DataFrame, keys: list[str], length: str, *, group_rows: int | None = None
) -> DataFrame:
    """Join one-row-per-series stats to positioned rows, balanced for hot series.

    ``length`` names the stats column with the number of positions in the
    series. Both sides carry a position segment, so a series of any size
    spreads over many join keys.
    """
    size = max_group_rows(rows.sparkSession, group_rows)
    last = F.floor((F.col(length) - 1) / size).cast("long")
    per_segment = stats.withColumn("_seg", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop(length)
    spread = rows.withColumn("_seg", F.floor(F.col("pos") / size).cast("long"))
    return spread.join(per_segment, [*keys, "_seg"]).drop("_seg")


def display_trim(
    long: DataFrame, keys: list[str], *, group_values: int = MAX_GROUP_VALUES, group_rows: int | None = None
) -> DataFrame:
    """Keep values within 1.5 spans of the 5 % and 95 % quantiles of their series.

    ``long`` carries ``pos`` and ``n`` (series length before nulls were dropped).
    Series of ten values or fewer stay whole.
    """
    sizes = long.groupBy(*keys).agg(F.max("pos").alias("_last"))
    quantiles = exact_quantiles(long, keys, TRIM_PROBS, group_values=group_values)
    stats = quantiles.join(sizes, keys).select(
        *keys, "cnt", F.col("q")[0].alias("_a"), F.col("q")[1].alias("_b"),
        (F.col("_last") + 1).alias("_len"))
    span = F.col("_b") - F.col("_a")
    inside = F.col("value").between(F.col("_a") - TRIM_FACTOR * span, F.col("_b") + TRIM_FACTOR * span)
    joined = attach_series_stats(long, stats, keys, "_len", group_rows=group_rows)
    return joined.where((F.col("cnt") <= TRIM_MIN_ROWS) | inside).select(*long.columns)


def trend_lines(trimmed: DataFrame, keys: list[str], order: list[Column], *, group_rows: int | None = None) -> DataFrame:
    """Mean and least-squares line over the position, for series above five values."""
    placed = with_position(
        trimmed.drop("pos", "n"), keys, order, group_rows=group_rows)
    enough = F.col("n") > TREND_MIN_ROWS
    lines = placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"),
        F.regr_slope("value", F.col("pos").cast("double")).alias("slope"),
        F.regr_intercept("value", F.col("pos").cast("double")).alias("intercept"))
    return lines.withColumns({c: F.when(enough, F.col(c)) for c in ("mean", "slope", "intercept")})


def category_shares(df: DataFrame, domain: list[str], category: str = "category") -> DataFrame:
    """Count and share per standard category, in domain order; at most len(domain) rows."""
    counts = df.where(F.col(category).isin(domain)).groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(1)))  # over at most len(domain) rows
    order = F.array_position(F.array(*[F.lit(d) for d in domain]), F.col(category))
    return counts.select(
        category, order.alias("rank"), "n", (F.col("n") * 100.0 / total).alias("share")).orderBy("rank")


def station_modes(df: DataFrame, station: str = "station", category: str = "category") -> DataFrame:
    """Most frequent category per station, smallest on a tie, null when there is none."""
    counts = df.where(F.col(station).isNotNull()).groupBy(station, category).agg(F.count(category).alias("_n"))
    rank = F.when(F.col(category).isNotNull(), F.struct(-F.col("_n"), F.col(category)))
    return counts.groupBy(station).agg(F.min_by(category, rank).alias(category))


def stations_per_category(modes: DataFrame, category: str = "category") -> DataFrame:
    return (
        modes.where(F.col(category).isNotNull()).groupBy(category)
        .agg(F.count(F.lit(1)).alias("stations")).orderBy(category)
    )


def station_means(df: DataFrame, features: list[str], station: str = "station") -> DataFrame:
    return df.where(F.col(station).isNotNull()).groupBy(station).agg(*[F.avg(f).alias(f) for f in features])
