"""Quantiles that never hold an unbounded group in one task: exact ones, and sketches of stated rank error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators.series import same
from tidemark.scratch import materialize

MAX_GROUP_VALUES = 100_000
ACCURACY = 10_000
CELLS = 1024


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    probs: list[float],
    *,
    value: str = "value",
    group_values: int = MAX_GROUP_VALUES,
) -> DataFrame:
    """Linear-interpolated quantiles per group: keys, ``q`` (array in probs order), ``cnt``.

    Every wanted rank is narrowed to a range of values: a range that holds more
    than ``group_values`` rows and two values or more is cut into cells, the
    rows per cell are counted with map-side combining, and only cells that hold
    a wanted rank go on. Ranges shrink to the values in their cell each time.
    The rows inside the last ranges are then counted by value and ranked. Groups
    that are small from the start skip the narrowing; if all are, one aggregation
    that counts each group's values does. Null keys are a group.
    """
    names = {k: f"_key{i}" for i, k in enumerate(keys)}
    rows = df.where(F.col(value).isNotNull()).select(
        *[F.col(k).alias(n) for k, n in names.items()], F.col(value).cast("double").alias("_v"))
    by = list(names.values())
    largest = rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if largest <= group_values:
        found = rows.groupBy(*by).agg(F.percentile("_v", [float(p) for p in probs]).alias("q"), F.count(F.lit(1)).alias("cnt"))
        return found.where("cnt > 0").select(*[F.col(n).alias(k) for k, n in names.items()], "q", "cnt")
    whole = rows.groupBy(*by).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    ranges = materialize(whole.withColumns({"_before": F.lit(0).cast("long"), "cnt": F.col("_n")}), "ranges")
    done = _open(ranges, group_values, False)
    while not (wide := _open(ranges, group_values, True)).isEmpty():
        ranges = materialize(_narrowed(rows, wide, by, probs), "ranges")
        done = done.unionByName(_open(ranges, group_values, False))
    picked = _values_at_ranks(rows, done, by, probs)
    ranks = picked.groupBy(*by).agg(
        F.map_from_entries(F.collect_set(F.struct("_rank", "_v"))).alias("_at"), F.max("cnt").alias("cnt"))

    def interpolate(p: Column) -> Column:
        a = p * (F.col("cnt") - 1)
        lo, hi = (F.element_at("_at", f(a).cast("long")) for f in (F.floor, F.ceil))
        return lo + (hi - lo) * (a - F.floor(a))

    q = F.transform(F.array(*[F.lit(float(p)) for p in probs]), interpolate)
    return ranks.select(*[F.col(n).alias(k) for k, n in names.items()], q.alias("q"), "cnt")


def approx_quantiles(
    df: DataFrame, keys: list[str], probs: list[float], *, value: str = "value", accuracy: int = ACCURACY
) -> DataFrame:
    """Quantiles per group from mergeable sketches, in the same columns as ``exact_quantiles``.

    One pass: every task sends a summary of each of its groups, and summaries are
    merged. A value is one of the group's, and its rank, counted from one, is off
    ``prob * cnt`` by ``cnt / accuracy`` and one at most.
    A summary holds a multiple of ``accuracy`` values, whatever the group's size.
    Nulls do not count; null keys are a group; a group without a value has no row.
    """
    rows = df.where(F.col(value).isNotNull())
    found = rows.groupBy(*keys).agg(
        F.percentile_approx(F.col(value).cast("double"), [float(p) for p in probs], accuracy).alias("q"),
        F.count(F.lit(1)).alias("cnt"))
    return found.where("cnt > 0")


def quantiles(df: DataFrame, keys: list[str], probs: list[float], *, method: str = "exact", accuracy: int = ACCURACY, **kw) -> DataFrame:
    """``exact_quantiles`` or, with ``method="approx"``, ``approx_quantiles``."""
    if method == "approx":
        kw.pop("group_values", None)
        return approx_quantiles(df, keys, probs, accuracy=accuracy, **kw)
    if method != "exact":
        raise ValueError(f"method is exact or approx, not {method}")
    return exact_quantiles(df, keys, probs, **kw)


def _open(ranges: DataFrame, limit: int, wide: bool) -> DataFrame:
    too_full = (F.col("_n") > limit) & (F.col("_hi") > F.col("_lo"))
    return ranges.where(too_full if wide else ~too_full)


def _wanted_ranks(probs: list[float]) -> Column:
    """The ranks next to each quantile, at most two per probability."""
    at = F.transform(F.array(*[F.lit(float(p)) for p in probs]), lambda p: p * (F.col("cnt") - 1))
    both = F.transform(at, lambda a: F.array(F.floor(a).cast("long"), F.ceil(a).cast("long")))
    return F.array_distinct(F.flatten(both))


def _inside(rows: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """Rows next to the range of their group that holds them; ranges of a group do not overlap."""
    here = F.col("_v").between(F.col("_lo"), F.col("_hi"))
    if not by:
        return rows.withColumn("_one", F.lit(1)).join(ranges.withColumn("_one", F.lit(1)), "_one").where(here).drop("_one")
    joined = rows.join(ranges, same(rows, ranges, by) & here)
    return joined.select(*[rows[c] for c in rows.columns], *[ranges[c] for c in ranges.columns if c not in by])


def _narrowed(rows: DataFrame, ranges: DataFrame, by: list[str], probs: list[float]) -> DataFrame:
    """Cells of the ranges that hold a wanted rank, as ranges of their own."""
    share = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    cell = F.least(F.floor(share * CELLS), F.lit(CELLS - 1)).cast("int")
    cells = _inside(rows, ranges, by).groupBy(*by, F.col("_before").alias("_base"), "cnt", cell.alias("_cell")).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*by, "_base").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("_base") + F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    placed = cells.withColumn("_before", before.cast("long"))
    held = F.exists(_wanted_ranks(probs), lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")))
    return placed.where(held).select(*by, "_lo", "_hi", "_n", "_before", "cnt")


def _values_at_ranks(rows: DataFrame, ranges: DataFrame, by: list[str], probs: list[float]) -> DataFrame:
    """(group, rank, value) for the wanted ranks; equal values count as one row."""
    counted = _inside(rows, ranges, by).groupBy(*by, "_before", "cnt", "_v").agg(F.count(F.lit(1)).alias("_same"))
    upto = F.col("_before") + F.sum("_same").over(
        W.partitionBy(*by, "_before").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    ranked = counted.withColumn("_upto", upto)
    hit = F.filter(_wanted_ranks(probs), lambda r: (r >= F.col("_upto") - F.col("_same")) & (r < F.col("_upto")))
    return ranked.select(*by, "cnt", "_v", F.explode(hit).alias("_rank"))


def feature_quantiles(df: DataFrame, features: list[str], probs: list[float], **kw) -> dict[str, list[float]]:
    """Quantiles of whole columns, one entry per feature that has a value; ``method`` as in ``quantiles``."""
    from tidemark.operators.series import to_long

    rows = quantiles(to_long(df, [], features), ["feature"], probs, **kw).collect()
    return {r["feature"]: list(r["q"]) for r in rows}
