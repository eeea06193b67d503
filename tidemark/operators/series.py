"""Positions, lags, fills and splits inside a series.

A series is the set of rows that share ``keys``. One series may hold a large
part of the table, so nothing here relies on one task per series: when the
largest series exceeds the group limit, rows are range-partitioned by
(keys, order) and per-block results are stitched together through a small
summary with one row per (series, block).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from tidemark.schema import Layout
from tidemark.scratch import balance, materialize, max_group_rows

BLOCK = "_block"
MAX_BLOCKS = 20_000
PACKED_ROWS = 1_000
WHOLE = "_whole"


def time_order(layout: Layout, df: DataFrame | None = None) -> list[Column]:
    """Time, then the tie columns; without any, then every other column of ``df``.

    The order is total up to rows that are equal in all columns, so no result
    depends on how rows arrive.
    """
    ties = layout.ties
    if not ties and df is not None:
        ties = [f.name for f in df.schema if f.name not in (layout.station, layout.time)
                and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return [F.col(layout.time).asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ties]]


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Row count of the largest group."""
    counts = df.groupBy(*keys).count()
    return counts.agg(F.max("count")).first()[0] or 0


def ordered_blocks(df: DataFrame, keys: list[str], order: list[Column], rows: int) -> DataFrame:
    """Globally sorted blocks of about ``rows`` rows, tagged with an ascending block id.

    The result is written to shared storage because range bounds come from a
    sample: evaluating the plan twice could cut the blocks differently.
    """
    blocks = max(2, min(-(-df.count() // rows), MAX_BLOCKS))
    sort_keys = [F.col(k).asc() for k in keys]
    spread = df.repartitionByRange(blocks, *sort_keys, *order)
    return materialize(spread.withColumn(BLOCK, F.spark_partition_id()), "blocks")


def by_size(df: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame | None, DataFrame]:
    """(rows of groups above ``limit`` or None, the other rows).

    Above the limit there are at most rows / limit groups.
    """
    if largest_group(df, keys) <= limit:
        return None, df
    large = materialize(df.groupBy(*keys).count().where(F.col("count") > limit).drop("count"), "large-groups")
    return df.join(large, same(df, large, keys), "left_semi"), df.join(large, same(df, large, keys), "left_anti")


def same(left: DataFrame, right: DataFrame, cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in cols])


def with_position(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    *,
    pos: str = "pos",
    total: str = "n",
    group_rows: int | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in its series and the series length."""
    limit = max_group_rows(df.sparkSession, group_rows)
    if not keys:  # one group: always by range partitions
        return _position_blocks(df, keys, order, pos, total, limit)
    large, rest = by_size(df, keys, limit)
    whole = W.partitionBy(*keys)
    placed = rest.withColumns({
        pos: (F.row_number().over(whole.orderBy(*order)) - 1).cast("long"),
        total: F.count(F.lit(1)).over(whole),
    })
    if large is None:
        return placed
    return placed.unionByName(_position_blocks(large, keys, order, pos, total, limit))


def _position_blocks(df: DataFrame, keys: list[str], order: list[Column], pos: str, total: str, limit: int) -> DataFrame:
    blocks = ordered_blocks(df, keys, order, limit)
    in_block = W.partitionBy(*keys, BLOCK).orderBy(*order)
    series = W.partitionBy(*keys)
    before = series.orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    summary = (
        blocks.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("_rows"))
        .withColumns({
            "_before": F.coalesce(F.sum("_rows").over(before), F.lit(0)),
            total: F.sum("_rows").over(series),
        })
        .drop("_rows")
    )
    ranked = blocks.withColumn("_rank", F.row_number().over(in_block) - 1)
    joined = ranked.join(summary, same(ranked, summary, [*keys, BLOCK]))
    return joined.select(
        *[ranked[c] for c in df.columns],
        (F.col("_before") + F.col("_rank")).cast("long").alias(pos),
        summary[total],
    )


def lagged(
    df: DataFrame,
    keys: list[str],
    lags: dict[str, tuple[str, int]],
    *,
    pos: str = "pos",
    group_rows: int | None = None,
    attach: DataFrame | None = None,
    balanced: bool = False,
) -> DataFrame:
    """Add shifted columns: ``{new: (column, k)}`` takes ``column`` from k rows before.

    Negative k looks ahead. Rows are cut into fixed-length position segments;
    rows near a segment edge are copied into the neighbour as a halo, so every
    shift is local to a segment and no segment exceeds the group limit.
    ``attach`` holds one row per series (with column ``n``) and is joined on
    (series, segment), which stays balanced for a hot series and shares the
    window's partitioning. ``balanced`` sorts in as many tasks as the session shuffles
    into: adaptive execution would merge them by compressed size, and a task's
    sorter would hold a share of the table that grows with it.
    """
    length = max_group_rows(df.sparkSession, group_rows)
    spread = with_segment(df, length, *_reach(lags, length), pos)
    if balanced:
        spread = balance(spread, [*keys, "_seg"])
    if attach is not None:
        extra = [c for c in attach.columns if c not in keys]
        spread = spread.drop(*extra).join(_per_segment(attach, keys, length), [*keys, "_seg"])
    w = W.partitionBy(*keys, "_seg").orderBy(pos)
    shifted = spread.withColumns({new: F.lag(col, k).over(w) for new, (col, k) in lags.items()})
    return shifted.where(F.col("_seg") == _segment(length, pos)).drop("_seg")


def _segment(length: int, pos: str) -> Column:
    return F.floor(F.col(pos) / length).cast("long")


def _reach(lags: dict[str, tuple[str, int]], limit: int) -> tuple[int, int]:
    """Rows that the shifts reach back and ahead."""
    back = max([k for _, k in lags.values()] + [0])
    ahead = max([-k for _, k in lags.values()] + [0])
    if limit <= max(back, ahead):
        raise ValueError("group limit must exceed the largest shift")
    return back, ahead


def with_segment(df: DataFrame, length: int, back: int, ahead: int = 0, pos: str = "pos") -> DataFrame:
    """Every row with its segment, and once more with each neighbour whose halo it is in."""
    seg = _segment(length, pos)
    copies = [F.array(seg)]
    if back:
        near_end = F.col(pos) % length >= length - back
        copies.append(F.when(near_end, F.array(seg + 1)).otherwise(F.array().cast("array<bigint>")))
    if ahead:
        near_start = (F.col(pos) % length < ahead) & (seg > 0)
        copies.append(F.when(near_start, F.array(seg - 1)).otherwise(F.array().cast("array<bigint>")))
    return df.withColumn("_seg", F.explode(F.concat(*copies)))


def _per_segment(attach: DataFrame, keys: list[str], length: int) -> DataFrame:
    """The one row per series of ``attach`` (with ``n``) for each of its segments."""
    last = F.floor((F.col("n") - 1) / length).cast("long")
    extra = [c for c in attach.columns if c not in keys]
    return attach.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_seg"), *extra)


def packed_lagged(
    df: DataFrame,
    keys: list[str],
    lags: dict[str, tuple[str, int]],
    label: str,
    *,
    pos: str = "pos",
    group_rows: int | None = None,
    attach: DataFrame,
    partition_by: list[str] | None = None,
) -> DataFrame:
    """The rows of ``lagged``, from a written table of one row per segment.

    A segment's rows, halo included, are one array of some thousand readings, so every
    reading is moved, sorted and written about once and not once per shift; shifts
    are looked up in the array whenever the result is read. The column ``_whole`` is true
    where nothing from the farthest row back to the farthest ahead is null, NaN or missing.
    """
    limit = max_group_rows(df.sparkSession, group_rows)
    back, ahead = _reach(lags, limit)
    length = min(limit, max(PACKED_ROWS, 10 * (back + ahead)))
    extra = [c for c in attach.columns if c not in keys]
    fields = [pos, *[c for c in df.columns if c not in (pos, *keys, *extra)]]
    segments = with_segment(df, length, back, ahead, pos).groupBy(*keys, "_seg").agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("_rows"))
    packed = materialize(segments.join(_per_segment(attach, keys, length), [*keys, "_seg"]), label, partition_by)
    arrays = {c: F.col("_rows")[c] for c in dict.fromkeys(c for c, _ in lags.values())}
    each = packed.select("*", *[a.alias(f"_of_{c}") for c, a in arrays.items()])
    missing = reduce(lambda a, b: a | b, [F.exists(F.col(f"_of_{c}"), lambda v: _unknown(v, df.schema[c].dataType)) for c in arrays])

    def clear(at: Column) -> Column:
        near = [F.slice(F.col(f"_of_{c}"), F.greatest(at - back + 1, F.lit(1)), F.lit(back + ahead + 1)) for c in arrays]
        return ~reduce(lambda a, b: a | b, [F.exists(a, lambda v: _unknown(v, df.schema[c].dataType)) for c, a in zip(arrays, near)])

    # Looked up once per segment: most have nothing missing.
    by_row = F.when(missing, F.transform(F.sequence(F.lit(0), F.size("_rows") - 1), clear))
    each = each.withColumn("_clear", by_row).select("*", F.posexplode("_rows").alias("_at", "_row"))
    whole = (F.col("_at") >= back) & (F.col("_at") + ahead < F.size("_rows")) & F.coalesce(F.get("_clear", F.col("_at")), F.lit(True))
    rows = each.select(
        *keys, "_seg", "_at", *[f"_of_{c}" for c in arrays], *[F.col("_row")[c].alias(c) for c in fields], *extra, whole.alias(WHOLE))
    own = rows.where(F.col("_seg") == _segment(length, pos))
    shifted = own.withColumns({new: F.get(F.col(f"_of_{col}"), F.col("_at") - F.lit(k)) for new, (col, k) in lags.items()})
    return shifted.drop("_seg", "_at", *[f"_of_{c}" for c in arrays])


def _unknown(value: Column, kind: T.DataType) -> Column:
    return value.isNull() | F.isnan(value) if isinstance(kind, (T.FloatType, T.DoubleType)) else value.isNull()


def fill_series(df: DataFrame, layout: Layout, *, group_rows: int | None = None) -> DataFrame:
    """Forward fill, then back fill, every feature inside its station.

    Rows without a station pass through untouched and never meet a window.
    """
    features, station = layout.available(df), layout.station
    known = df.where(F.col(station).isNotNull())
    limit = max_group_rows(df.sparkSession, group_rows)
    large, rest = by_size(known, [station], limit)
    filled = _fill_whole(rest, layout, features)
    if large is not None:
        filled = filled.unionByName(_fill_blocks(large, layout, features, limit))
    return filled.unionByName(df.where(F.col(station).isNull()))


def _fill_whole(df: DataFrame, layout: Layout, features: list[str]) -> DataFrame:
    w = W.partitionBy(layout.station).orderBy(*time_order(layout, df))
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return df.withColumns({
        c: F.coalesce(F.last(c, True).over(so_far), F.first(c, True).over(whole)) for c in features})


def _fill_blocks(df: DataFrame, layout: Layout, features: list[str], limit: int) -> DataFrame:
    station = layout.station
    order = time_order(layout, df)
    blocks = ordered_blocks(df, [station], order, limit)
    in_block = W.partitionBy(station, BLOCK).orderBy(*order)
    ranked = blocks.withColumn("_rank", F.row_number().over(in_block))
    edges = ranked.groupBy(station, BLOCK).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_rank"))).alias(f"_last_{c}") for c in features],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_rank"))).alias(f"_first_{c}") for c in features],
    )
    series = W.partitionBy(station).orderBy(BLOCK)
    before = series.rowsBetween(W.unboundedPreceding, -1)
    whole = series.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    carry = edges.select(
        station, BLOCK,
        *[F.last(f"_last_{c}", True).over(before).alias(f"_in_{c}") for c in features],
        *[F.first(f"_first_{c}", True).over(whole).alias(f"_any_{c}") for c in features],
    )
    so_far = in_block.rowsBetween(W.unboundedPreceding, 0)
    local = blocks.withColumns({c: F.last(c, True).over(so_far) for c in features})
    joined = local.join(carry, [station, BLOCK])
    return joined.withColumns({
        c: F.coalesce(F.col(c), F.col(f"_in_{c}"), F.col(f"_any_{c}")) for c in features
    }).select(*df.columns)


def split_series(
    df: DataFrame,
    layout: Layout,
    *,
    train: float = 0.8,
    val: float = 0.1,
    group_rows: int | None = None,
) -> DataFrame:
    """Chronological train / val / test label per station; null stations are dropped."""
    known = df.where(F.col(layout.station).isNotNull())
    placed = with_position(known, [layout.station], time_order(layout, df), group_rows=group_rows)
    return label_splits(placed, train=train, val=val)


def label_splits(df: DataFrame, *, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """Split label from ``pos`` and ``n``."""
    train_end = F.floor(F.col("n") * F.lit(float(train)))
    val_end = train_end + F.floor(F.col("n") * F.lit(float(val)))
    return df.withColumn(
        "split",
        F.when(F.col("pos") < train_end, "train").when(F.col("pos") < val_end, "val").otherwise("test"),
    )


def to_long(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """Wide to long: one row per (reading, feature), nulls dropped."""
    doubles = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in features])
    return doubles.unpivot(ids, features, "feature", "value").where(F.col("value").isNotNull())


def numeric_features(df: DataFrame, features: list[str]) -> list[str]:
    """Features whose column has a numeric type."""
    from pyspark.sql.types import NumericType

    return [f for f in features if f in df.columns and isinstance(df.schema[f].dataType, NumericType)]


def validate_columns(df: DataFrame, required: list[str], on_missing: str = "error") -> list[str]:
    """Required columns that exist; raises when one is missing unless told to skip."""
    missing = [c for c in required if c not in df.columns]
    if missing and on_missing == "error":
        raise ValueError(f"missing required columns: {missing}")
    return [c for c in required if c in df.columns]


# Least number of non-null points in (train, val, test) per model.
FLOORS = {
    "arima": (10, 5, 5),
    "sarima": (10, 5, 5),
    "arima_ann": (20, 10, 10),
    "cnn_lstm": (30, 10, 10),
    "xgboost": (20, 5, 5),
}
LOOKBACK = 12


def floors(model: str, horizon: int = 5) -> tuple[int, int, int]:
    if model == "cnn_gru_attention":
        need = LOOKBACK + horizon
        return 2 * need, need, need
    return FLOORS[model]


def split_counts(long: DataFrame, station: str = "station") -> DataFrame:
    """Non-null points per series and split."""
    counts = [F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "val", "test")]
    return long.groupBy(station, "feature").agg(*counts)


def eligible_series(long: DataFrame, model: str, *, horizon: int = 5, station: str = "station") -> DataFrame:
    """Series long enough for ``model`` in every split."""
    train, val, test = floors(model, horizon)
    enough = (F.col("n_train") >= train) & (F.col("n_val") >= val) & (F.col("n_test") >= test)
    return split_counts(long, station).where(enough)


def stations_in_all_splits(df: DataFrame, station: str = "station") -> DataFrame:
    return (
        df.groupBy(station).agg(F.bit_or(
            F.when(F.col("split") == "train", 1).when(F.col("split") == "val", 2)
            .when(F.col("split") == "test", 4).otherwise(0)).alias("_seen"))
        .where("_seen = 7").select(station)
    )


def split_rows(long: DataFrame, keys: list[str]) -> DataFrame:
    """Per series: rows in all, in train and in val, counted from the split column."""
    return long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("split") == s).alias(f"rows_{s}") for s in ("train", "val")])


def split_positions(long: DataFrame) -> DataFrame:
    """Position inside the split (``split_pos``) and length of the split (``split_n``).

    Split lengths are ``rows_train`` and ``rows_val``, the rest is the test split.
    """
    train_end = F.col("rows_train")
    val_end = train_end + F.col("rows_val")
    start = F.when(F.col("split") == "train", F.lit(0)).when(F.col("split") == "val", train_end).otherwise(val_end)
    end = F.when(F.col("split") == "train", train_end).when(F.col("split") == "val", val_end).otherwise(F.col("n"))
    return long.withColumns({"split_pos": (F.col("pos") - start).cast("long"), "split_n": (end - start).cast("long")})


def supervised_frame(
    long: DataFrame,
    keys: list[str],
    *,
    lookback: int = LOOKBACK,
    horizon: int = 1,
    carry_context: bool = False,
    value: str = "value",
    group_rows: int | None = None,
    attach: DataFrame | None = None,
    label: str | None = None,
    partition_by: list[str] | None = None,
) -> DataFrame:
    """Model samples: ``x1`` (latest) … ``x{lookback}`` and targets ``y1`` … ``y{horizon}``.

    A sample stays inside its split; ``carry_context`` lets the inputs (never
    the targets) reach back into the split before. ``long`` has gap-free
    positions; splits may have any lengths. ``attach`` holds one row per wanted
    series with ``n``, ``rows_train`` and ``rows_val``. With a ``label`` the series are
    written, packed, to the shared folder, every read of the frame starts there, and it
    has the column ``_whole`` of ``packed_lagged``.
    """
    balanced = attach is None
    if attach is None:
        attach = split_rows(long, keys)
    shifts = {f"x{k}": (value, k) for k in range(1, lookback + 1)}
    shifts |= {f"y{k}": (value, 1 - k) for k in range(2, horizon + 1)}
    if label is None:
        frame = lagged(long, keys, shifts, group_rows=group_rows, attach=attach, balanced=balanced)
    else:
        frame = packed_lagged(long, keys, shifts, label, group_rows=group_rows, attach=attach, partition_by=partition_by)
    frame = split_positions(frame.withColumn("y1", F.col(value)))
    reach = F.col("pos") if carry_context else F.col("split_pos")
    inside = (reach >= lookback) & (F.col("split_pos") + horizon <= F.col("split_n"))
    return frame.where(inside)
