"""Forecast scores and rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.parsing import has_step, step_number
from tidemark.schema import METRICS


def forecast_metrics(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """RMSE, MAE, MAPE (zero actuals left out) and R2 per key; null where undefined."""
    scored = pairs.where(F.col("forecast").isNotNull() & F.col("actual").isNotNull())
    error = F.col("actual") - F.col("forecast")
    share = F.abs(error) / F.abs(F.nullif("actual", F.lit(0.0)))
    spread = F.nullif(F.var_pop("actual") * F.count(F.lit(1)), F.lit(0.0))
    return scored.groupBy(*keys).agg(
        F.sqrt(F.avg(error * error)).alias("RMSE"),
        F.avg(F.abs(error)).alias("MAE"),
        (F.avg(share) * 100.0).alias("MAPE"),
        (1.0 - F.sum(error * error) / spread).alias("R2"),
    )


def step_metrics(pairs: DataFrame, keys: list[str], model_type: str) -> DataFrame:
    """One row per (key, step) named ``…-Step{k}`` plus the mean over steps named ``…-Avg``."""
    steps = forecast_metrics(pairs, [*keys, "step"]).withColumns({
        "step": F.col("step").cast("int"),
        "model_type": F.concat(F.lit(f"{model_type}-Step"), F.col("step").cast("string"))})
    average = steps.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in METRICS])
    return steps.unionByName(
        average.withColumn("model_type", F.lit(f"{model_type}-Avg")), allowMissingColumns=True)


def union_metrics(tables: dict[str, DataFrame], required: str | None = None) -> DataFrame:
    """Stack per-model metric tables by column name and tag each with its model."""
    used = [df.withColumn("model", F.lit(m)) for m, df in tables.items() if required is None or required in df.columns]
    if not used:
        raise ValueError(f"no metrics table has column {required!r}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), used)


def mean_metrics(metrics: DataFrame, keys: list[str], *, exclude_steps: bool = False, count: bool = False) -> DataFrame:
    """Average scores per key, nulls skipped; metrics the table lacks come out null."""
    if exclude_steps and "model_type" in metrics.columns:
        metrics = metrics.where(~has_step(F.col("model_type")))
    means = [
        (F.avg(m) if m in metrics.columns else F.lit(None).cast("double")).alias(m) for m in METRICS]
    extra = [F.count(F.lit(1)).alias("count")] if count else []
    return metrics.groupBy(*keys).agg(*means, *extra)


def rank_models(means: DataFrame, within: list[str] | None = None) -> DataFrame:
    """Long form with the place of each model per metric: R2 high to low, the rest low to high."""
    within = within or []
    long = means.select(*within, "model", *METRICS).unpivot([*within, "model"], METRICS, "metric", "value")
    better = F.when(F.col("metric") == "R2", -F.col("value")).otherwise(F.col("value"))
    order = W.partitionBy(*within, "metric").orderBy(better.asc_nulls_last(), "model")
    return long.withColumn("rank", F.row_number().over(order))


def step_curves(metrics: DataFrame) -> DataFrame:
    """RMSE and R2 by forecast step for every multi-step row."""
    steps = metrics.where(has_step(F.col("model_type"))).withColumn("step", step_number(F.col("model_type")))
    keep = [c for c in ("feature", "station", "model") if c in steps.columns]
    return steps.select(*keep, "step", "RMSE", "R2").orderBy("feature", "model", "step")


def align_right(actual: DataFrame, forecast: DataFrame, keys: list[str]) -> DataFrame:
    """Match forecasts to the last actual points by position.

    Both sides carry ``pos`` and ``n`` of their own series; the join key is the
    distance to the end, so a long series spreads over many keys.
    """
    a = actual.withColumn("_back", F.col("n") - F.col("pos")).drop("pos", "n")
    f = forecast.withColumn("_back", F.col("n") - F.col("pos")).drop("pos", "n")
    return a.join(f, [*keys, "_back"]).drop("_back")
