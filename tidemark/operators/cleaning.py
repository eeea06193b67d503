"""From raw text readings to a gap-free numeric table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions.parsing import finite, na_to_null, to_number, to_obs_time
from tidemark.operators.quantiles import MAX_GROUP_VALUES, feature_quantiles
from tidemark.operators.series import fill_series
from tidemark.schema import Layout
from tidemark.scratch import materialize, spread

# Fixed value: fence width in inter-quartile ranges.
FENCE = 2.0


def type_readings(df: DataFrame, layout: Layout) -> DataFrame:
    """Missing tokens to null, texts to numbers and zone-less timestamps."""
    def typed(c: str) -> Column:
        text = isinstance(df.schema[c].dataType, StringType)
        if c in layout.features:
            return to_number(F.col(c)) if text else F.col(c).cast("double")
        if c == layout.time:
            return to_obs_time(F.col(c)) if text else F.col(c).cast("timestamp_ntz")
        return na_to_null(F.col(c)) if text else F.col(c)

    parsed = df.select(*[typed(c).alias(c) for c in df.columns])
    return parsed.withColumns({f: finite(F.col(f)) for f in layout.available(df)})


def drop_empty(df: DataFrame, layout: Layout) -> DataFrame:
    """Drop rows in which every feature is missing."""
    return df.na.drop(how="all", subset=layout.available(df))


def iqr_fences(
    df: DataFrame, layout: Layout, *, factor: float = FENCE, group_values: int = MAX_GROUP_VALUES, method: str = "exact"
) -> dict[str, tuple[float, float]]:
    """Outlier fences per feature, from the quartiles over all stations; ``method`` as in ``quantiles``."""
    quartiles = feature_quantiles(df, layout.available(df), [0.25, 0.75], group_values=group_values, method=method)
    return {f: (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)) for f, (q1, q3) in quartiles.items()}


def null_outliers(df: DataFrame, fences: dict[str, tuple[float, float]]) -> DataFrame:
    """Values strictly outside their fence become null; the row stays."""
    return df.withColumns({
        f: F.when((F.col(f) >= lo) & (F.col(f) <= hi), F.col(f)) for f, (lo, hi) in fences.items()})


def fill_median(df: DataFrame, layout: Layout, *, group_values: int = MAX_GROUP_VALUES) -> DataFrame:
    """Replace what is still missing by the median over all stations, taken only where something is."""
    features = layout.available(df)
    missing = df.agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in features]).first() if features else {}
    wanted = [f for f in features if missing[f]]
    medians = feature_quantiles(df, wanted, [0.5], group_values=group_values) if wanted else {}
    return df.na.fill({f: q[0] for f, q in medians.items()}) if medians else df


def clean(
    df: DataFrame,
    layout: Layout,
    *,
    group_rows: int | None = None,
    group_values: int = MAX_GROUP_VALUES,
) -> DataFrame:
    """Type, drop empty rows, null outliers, fill per station, fill with medians.

    The typed and the filled rows are written once each, because the quartiles
    need all typed rows and the medians all filled rows before the next step.
    """
    kept = drop_empty(materialize(type_readings(spread(df), layout), "typed"), layout)
    fences = iqr_fences(kept, layout, group_values=group_values)
    filled = materialize(fill_series(null_outliers(kept, fences), layout, group_rows=group_rows), "filled")
    return fill_median(filled, layout, group_values=group_values)


def missing_report(df: DataFrame, features: list[str]) -> DataFrame:
    """Missing count and share per feature."""
    counts = df.select(*[F.count_if(F.col(f).isNull()).alias(f) for f in features], F.count(F.lit(1)).alias("rows"))
    return counts.unpivot(["rows"], features, "feature", "missing").select(
        "feature", "missing", F.try_divide(F.col("missing") * 100.0, F.col("rows")).alias("missing_pct"))


def outlier_report(df: DataFrame, layout: Layout, **kw) -> DataFrame:
    """Outlier count and share of the non-missing values per feature."""
    fences = iqr_fences(df, layout, **kw)
    spark = df.sparkSession
    bounds = spark.createDataFrame(
        [(f, lo, hi) for f, (lo, hi) in fences.items()], "feature string, lo double, hi double")
    counts = df.agg(*[
        F.struct(
            F.count(f).alias("n"),
            F.count_if((F.col(f) < lo) | (F.col(f) > hi)).alias("outliers"),
        ).alias(f) for f, (lo, hi) in fences.items()])
    per_feature = counts.unpivot([], list(fences), "feature", "c")
    return per_feature.join(F.broadcast(bounds), "feature").select(
        "feature", "lo", "hi", "c.n", "c.outliers",
        F.try_divide(F.col("c.outliers") * 100.0, F.col("c.n")).alias("outlier_pct"))


def quality_report(raw: DataFrame, layout: Layout, **kw) -> DataFrame:
    """Per feature: missing, outliers, rows before and after dropping empty rows."""
    typed = materialize(type_readings(spread(raw), layout), "typed")
    features = layout.available(typed)
    kept = drop_empty(typed, layout)
    known = F.coalesce(*[F.col(f) for f in features]).isNotNull()
    before, after = typed.agg(F.count(F.lit(1)), F.count_if(known)).first()
    return (
        missing_report(typed, features)
        .join(outlier_report(kept, layout, **kw), "feature", "left")
        .withColumns({
            "rows_in": F.lit(before).cast("long"), "rows_out": F.lit(after).cast("long"),
            "rows_removed": F.lit(before - after).cast("long")})
    )
