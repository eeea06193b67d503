"""Report queries: each returns the table behind one chart or view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.parsing import fixed, has_step, series_label
from tidemark.names import CATEGORY_DOMAIN
from tidemark.operators import lookup, metrics as m, stats
from tidemark.operators.series import numeric_features, stations_in_all_splits, time_order, to_long, validate_columns
from tidemark.schema import METRICS, Layout

# Rows shown in the top lists.
TOP_ROWS = 20
OVERLAY_STATIONS = 5


# ---- model evaluation ------------------------------------------------------

def model_comparison(metrics: DataFrame, *, exclude_steps: bool = False) -> DataFrame:
    """Mean scores per model, best RMSE first."""
    return m.mean_metrics(metrics, ["model"], exclude_steps=exclude_steps).orderBy("RMSE", "model")


def feature_comparison(metrics: DataFrame) -> DataFrame:
    """Place of each model per feature and metric; single-step rows left out."""
    return m.rank_models(m.mean_metrics(metrics, ["feature", "model"], exclude_steps=True), ["feature"])


def station_comparison(metrics: DataFrame, *, exclude_steps: bool = False) -> DataFrame:
    means = m.mean_metrics(metrics, ["station", "model"], exclude_steps=exclude_steps)
    return m.rank_models(means, ["station"])


def model_summary(metrics: DataFrame) -> DataFrame:
    """Mean scores and row count per model; models without any RMSE are left out."""
    means = m.mean_metrics(metrics, ["model"], count=True)
    return means.where(F.col("RMSE").isNotNull()).orderBy("RMSE", "model")


# ---- readings --------------------------------------------------------------

def distribution_report(df: DataFrame, features: list[str], bins: int | str = "auto") -> dict[str, DataFrame]:
    return {
        "histogram": stats.histogram(df, features, bins),
        "density": stats.density(df, features),
        "box": stats.box_stats(df, features),
    }


def trimmed_series(long: DataFrame, layout: Layout, **kw) -> DataFrame:
    """Dated values of each series without the far tails."""
    dated = long.where(F.col(layout.time).isNotNull())
    return stats.display_trim(dated, [layout.station, "feature"], **kw)


def series_trends(long: DataFrame, layout: Layout, **kw) -> DataFrame:
    """Mean and straight-line trend of every trimmed series."""
    return stats.trend_lines(
        trimmed_series(long, layout, **kw), [layout.station, "feature"], time_order(layout, long.drop("pos", "n")))


def station_availability(df: DataFrame, names: DataFrame, layout: Layout) -> DataFrame:
    """Rows per station with the display name."""
    counts = lookup.station_counts(df, layout.station)
    return lookup.with_english(counts, layout.station, names, alias="english")


def top_availability(df: DataFrame, names: DataFrame, layout: Layout, rows: int = TOP_ROWS) -> DataFrame:
    top = lookup.top_stations(df, rows, layout.station)
    return lookup.with_english(top, layout.station, names, alias="english").orderBy(F.desc("n"), layout.station)


def indicator_by_station(
    df: DataFrame, features: list[str], names: DataFrame, layout: Layout, rows: int = TOP_ROWS
) -> DataFrame:
    """Stations with the highest mean, per feature."""
    means = to_long(stats.station_means(df, features, layout.station), [layout.station], features)
    order = W.partitionBy("feature").orderBy(F.desc("value"), layout.station)
    top = means.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rows)
    return lookup.with_english(top, layout.station, names, alias="english")


def scatter_pairs(df: DataFrame, pairs: list[tuple[str, str]], layout: Layout) -> dict[str, DataFrame]:
    """Point tables (x, y, category) for each pair of columns that exists."""
    return {
        f"{a}_vs_{b}": df.select(F.col(a).alias("x"), F.col(b).alias("y"), F.col(layout.category).alias("category"))
        for a, b in pairs
        if len(validate_columns(df, [a, b, layout.category], "skip")) == 3
    }


# Column pairs of the dashboard's scatter panels.
DASHBOARD_PAIRS = [("ph", "dissolved_oxygen"), ("ammonia_n", "total_p"), ("water_temp", "conductivity")]


def dashboard(
    df: DataFrame, layout: Layout, *, pairs: list[tuple[str, str]] | None = None,
    domain: list[str] | None = None,
) -> dict[str, DataFrame]:
    """Every panel of the dashboard that the available columns allow."""
    domain = domain or CATEGORY_DOMAIN
    features = numeric_features(df, layout.features)
    panels: dict[str, DataFrame] = {}
    if layout.category in df.columns:
        panels["category_shares"] = stats.category_shares(df, domain, layout.category)
        if layout.station in df.columns:
            modes = stats.station_modes(df, layout.station, layout.category)
            panels["stations_per_category"] = stats.stations_per_category(modes, layout.category)
    if features:
        panels["box"] = stats.box_stats(df, features)
        panels["correlation"] = stats.lower_triangle(stats.correlation(df, features))
    panels.update(scatter_pairs(df, pairs or DASHBOARD_PAIRS, layout))
    return panels


# ---- forecasts next to readings -------------------------------------------

def metrics_lookup(metrics: DataFrame) -> DataFrame:
    """Per (station, feature): map of model -> scores and the printable text.

    A model with several rows is represented by its overall row, not a step.
    The map holds one entry per model.
    """
    whole = ~has_step(F.col("model_type"))
    one = metrics.groupBy("station", "feature", "model").agg(
        F.max_by(F.struct(*METRICS), F.struct(whole, F.col("model_type"))).alias("scores"))
    lines = [
        F.when(F.col(f"scores.{x}").isNotNull(), F.concat(F.lit(f"  {x}: "), fixed(F.col(f"scores.{x}"), 4)))
        for x in METRICS]
    text = F.concat_ws("\n", F.concat(F.col("model"), F.lit(":")), *lines)
    entries = F.sort_array(F.collect_list(F.struct(F.col("model"), F.col("scores"), text.alias("text"))))
    grouped = one.groupBy("station", "feature").agg(entries.alias("_entries"))
    return grouped.select(
        "station", "feature",
        F.map_from_entries(F.transform("_entries", lambda e: F.struct(e["model"], e["scores"]))).alias("scores"),
        F.array_join(F.transform("_entries", lambda e: e["text"]), "\n").alias("text"))


def overlay(splits: DataFrame, metrics: DataFrame, layout: Layout, stations: int = OVERLAY_STATIONS) -> DataFrame:
    """Train and test values of the first stations with the scores of every model."""
    present = stations_in_all_splits(splits, layout.station)
    first = present.orderBy(layout.station).limit(stations)
    rows = lookup.keep_stations(splits.where(F.col("split").isin("train", "test")), first, layout.station)
    long = to_long(rows, [layout.station, layout.time, *layout.ties, "pos", "split"], layout.features)
    scores = lookup.keep_stations(
        metrics_lookup(lookup.keep_stations(metrics, first, layout.station)), first, layout.station)
    # at most `stations` x number of features rows
    return long.join(F.broadcast(scores), [layout.station, "feature"], "left")


def drilldown(
    long: DataFrame, forecasts: DataFrame, metrics: DataFrame, station: str, feature: str,
    model: str | None = None,
) -> dict[str, DataFrame]:
    """Readings, forecast next to actual, and all models' scores of one series.

    Without a forecast the forecast table is empty; test values never stand in.
    """
    def one(df: DataFrame) -> DataFrame:
        return df.where((F.col("station") == station) & (F.col("feature") == feature))

    mine = one(forecasts) if model is None else one(forecasts).where(F.col("model") == model)
    scores = one(metrics)
    available = [x for x in METRICS if x in metrics.columns]
    return {
        "series": one(long),
        "forecast": mine,
        "scores": scores.select(
            "model", "model_type", series_label(F.col("station"), F.col("feature")).alias("label"), *available),
    }


def scores_by_type(metrics: DataFrame, model_type: str | None = None) -> DataFrame:
    """Score rows, optionally of one model type, with the metrics the table has."""
    rows = metrics if model_type is None else metrics.where(F.col("model_type") == model_type)
    available = [x for x in METRICS if x in metrics.columns]
    return rows.select(series_label(F.col("station"), F.col("feature")).alias("label"), "model_type", *available)


def catalog_lists(long: DataFrame, metrics: DataFrame) -> dict[str, DataFrame]:
    """Selectable stations with their features, and models."""
    return {
        "series": lookup.distinct_series(long.where("split = 'train'")),
        "models": metrics.select("model").distinct(),
    }
