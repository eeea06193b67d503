"""Autocorrelation, partial autocorrelation and unit-root tests for every series.

All data-sized work is one pass that sums products of a value with its lags
(``lag_products``). Correlations are ratios of those sums; regressions on lags only
need the sums and the first and last few values, so they are solved on one
small row per series.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.parsing import is_significant, order_hint, series_key
from tidemark.operators.series import with_segment
from tidemark.scratch import balance, max_group_rows

# Least length of an analysed series, most lags, 97.5 % normal quantile.
MIN_LENGTH = 20
MAX_LAGS = 40
Z975 = 1.959963984540054
SEGMENT_ROWS = 4096


def sorted_runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Blocks of whole runs of equal ``by`` from rows sorted by it, with the first row of each run."""
    held = None
    for batch in batches:
        block = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        codes = [pc.dictionary_encode(block[c].combine_chunks(), null_encoding="encode").indices.to_numpy() for c in by]
        changed = reduce(np.logical_or, [c[1:] != c[:-1] for c in codes], np.zeros(max(len(block) - 1, 0), bool))
        starts = np.concatenate(([0], np.flatnonzero(changed) + 1)) if len(block) else np.zeros(1, int)
        held = block.slice(starts[-1])
        if starts[-1]:
            yield block.slice(0, starts[-1]).combine_chunks(), starts[:-1]
    if held is not None and len(held):
        yield held.combine_chunks(), np.zeros(1, int)


def _arrays(values: np.ndarray, lengths: np.ndarray, absent: np.ndarray | None = None) -> pa.Array:
    """One list per row from the values of all rows; ``absent`` marks null rows, which have no values."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.float64()), mask=None if absent is None else pa.array(absent))


def _products(block: pa.Table, starts: np.ndarray, length: int, max_lag: int, split: bool) -> list[pa.Array]:
    """Sums of every segment of a block: per weight total, count and lag products, and the segment's first and last values."""
    x, pos, seg = (block[c].to_numpy() for c in ("value", "pos", "_seg"))
    ok = block["value"].is_valid().to_numpy()
    runs = np.diff(np.append(starts, len(x)))
    owner = np.repeat(np.arange(len(starts)), runs)
    own = pos // length == seg
    weights = [own, own & block["_part"].to_numpy()] if split else [own]

    def per_run(v: np.ndarray) -> np.ndarray:
        return np.add.reduceat(v, starts)

    # A short first segment is the whole series: its own mean is the one to centre on.
    whole = (seg[starts] == 0) & (per_run(own.astype(np.int64)) < length)
    counts = [per_run((w & ok).astype(np.int64)) for w in weights]
    means = [per_run(np.where(w & ok, x, 0.0)) / np.maximum(n, 1) for w, n in zip(weights, counts)]
    whole &= counts[-1] > 0
    ref = np.where(counts[-1] > 0, means[-1], means[0])
    d = np.where(ok, x - ref[owner], 0.0)
    out, cut = [pa.array(ref)], np.flatnonzero(~whole)
    inside = np.isin(owner, cut)
    for weight, n in zip(weights, counts):
        s, shares = np.zeros((len(starts), max_lag + 1)), np.zeros((3, len(cut), max_lag + 1))
        for k in range(max_lag + 1):
            now, then = slice(k, None), slice(0, max(len(x) - k, 0))
            paired = weight[now] & (owner[now] == owner[then])
            product = np.zeros(len(x))
            product[now] = np.where(paired, d[now] * d[then], 0.0)
            s[:, k] = per_run(product)
            if len(cut):
                both = np.zeros(len(x), bool)
                both[now] = paired & ok[now] & ok[then] & inside[now]
                at = np.flatnonzero(both)
                for share, v in zip(shares, (d[at], d[at - k], np.ones(len(at)))):
                    share[:, k] = np.bincount(owner[at], v, len(starts))[cut]
        out += [pa.array(per_run(np.where(weight & ok, d, 0.0))), pa.array(n), _arrays(s.ravel(), np.full(len(starts), max_lag + 1))]
        lengths = np.where(whole, 0, max_lag + 1)
        out += [_arrays(v.ravel(), lengths, whole) for v in shares]
    flat = block["value"].combine_chunks()
    places = [[np.arange(a, min(a + max_lag + 1, a + r)) if g == 0 else np.zeros(0, int) for a, r, g in zip(starts, runs, seg[starts])],
              [np.arange(max(a, a + r - max_lag - 1), a + r) for a, r in zip(starts, runs)]]
    absent = [seg[starts] != 0, per_run(own.astype(np.int64)) == 0]
    if split:
        part = block["_part"].to_numpy()
        ends = np.maximum.reduceat(np.where(part, np.arange(len(x)), -1), starts) + 1
        absent.append(counts[1] == 0)
        places.append([np.arange(max(a, e - max_lag - 1), e) if not no else np.zeros(0, int) for a, e, no in zip(starts, ends, absent[-1])])
    for rows, no in zip(places, absent):
        offsets = pa.array(np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32))
        out.append(pa.ListArray.from_arrays(offsets, flat.take(pa.array(np.concatenate(rows).astype(np.int64))), mask=pa.array(no)))
    return out


def lag_products(
    rows: DataFrame, keys: list[str], max_lag: int, stats: DataFrame, center: str, *, part: Column | None = None,
    group_rows: int | None = None,
) -> DataFrame:
    """Per series, next to the columns of ``stats``: ``total`` and ``s``, sums of d and of d[t]*d[t-k] for
    k = 0..max_lag, d being the value minus ``center``; ``head`` and ``tail``, the first and last max_lag + 1
    values, centred.

    With ``part``, true for the rows up to some position, these are named ``total_all``, ``s_all`` and ``tail_all``,
    and ``total_part``, ``s_part`` and ``tail_part`` sum over t in that part; ``center`` is then that part's mean.

    Readings move once, sorted by position segment with a halo. A task multiplies the sorted rows as they pass
    and gives one row per (series, segment). Sums are taken around the segment's own mean and moved to ``center``.
    """
    limit = max_group_rows(rows.sparkSession, group_rows)
    if limit <= max_lag:
        raise ValueError("group limit must exceed the largest shift")
    length = min(limit, max(SEGMENT_ROWS, 10 * max_lag))
    columns = [*keys, "pos", F.col("value").cast("double").alias("value")]
    if part is not None:
        columns.append(F.coalesce(part, F.lit(False)).alias("_part"))
    by = [*keys, "_seg"]
    cut = balance(with_segment(rows.select(*columns), length, max_lag), by).sortWithinPartitions(*by, "pos")
    split = part is not None
    names = ["all", "part"] if split else ["all"]
    fields = ["_ref double"]
    for x in names:
        fields += [f"_t_{x} double", f"_m_{x} long", *[f"_{c}_{x} array<double>" for c in "sabc"]]
    fields += ["head array<double>", *[f"tail_{x} array<double>" for x in names]]
    key_fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name in by)
    key_names = [f.name for f in cut.schema if f.name in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, starts in sorted_runs(batches, by):
            found = _products(block, starts, length, max_lag, split)
            first = [block[c].combine_chunks().take(pa.array(starts)) for c in key_names]
            yield pa.record_batch([*first, *found], [*key_names, *[f.split(" ")[0] for f in fields]])

    pieces = cut.mapInArrow(run, f"{key_fields}, {', '.join(fields)}")
    moved = pieces.join(stats, keys)
    step = F.col("_ref") - F.col(center)

    def around(x: str) -> Column:
        linear = F.zip_with(f"_a_{x}", f"_b_{x}", lambda a, b: step * (a + b))
        extra = F.zip_with(linear, F.col(f"_c_{x}"), lambda v, c: v + step * step * c)
        return F.when(F.col(f"_a_{x}").isNull(), F.col(f"_s_{x}")).otherwise(F.zip_with(F.col(f"_s_{x}"), extra, lambda s, e: s + e))

    for x in names:
        moved = moved.withColumns({f"_s_{x}": around(x), f"_t_{x}": F.col(f"_t_{x}") + step * F.col(f"_m_{x}")})
    kept = [c for c in stats.columns if c not in keys]
    tails = [F.max_by(f"tail_{x}", F.when(F.col(f"tail_{x}").isNotNull(), F.col("_seg"))).alias(f"tail_{x}") for x in names]
    found = moved.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in kept], F.min_by("head", "_seg").alias("head"), *tails,
        *[F.sum(f"_t_{x}").alias(f"total_{x}") for x in names],
        *[F.sum(F.col(f"_s_{x}")[k]).alias(f"_{x}{k}") for x in names for k in range(max_lag + 1)])
    edges = {"head": "head", **{f"tail_{x}": f"tail_{x}" for x in names}}
    found = found.select(
        *keys, *kept, *[f"total_{x}" for x in names],
        *[F.array(*[F.coalesce(f"_{x}{k}", F.lit(0.0)) for k in range(max_lag + 1)]).alias(f"s_{x}") for x in names],
        *[F.transform(F.coalesce(e, F.array().cast("array<double>")), lambda v: v - F.col(center)).alias(e) for e in edges])
    if not split:
        found = found.withColumnsRenamed({"total_all": "total", "s_all": "s", "tail_all": "tail"})
    return found


def lag_sums(
    long: DataFrame, keys: list[str], max_lag: int, *, group_rows: int | None = None
) -> DataFrame:
    """Per series: length, mean, ``s`` = sums of d[t]*d[t-k] for k = 0..max_lag, edges.

    ``long`` has keys, ``pos`` (0-based, gap-free) and ``value``; d is the value
    minus the series mean. ``head`` and ``tail`` hold the first and last
    ``max_lag`` + 1 centred values, ``total`` the sum of all of them.
    """
    stats = long.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    return lag_products(long, keys, max_lag, stats, "mean", group_rows=group_rows)


def analysed(sums: DataFrame) -> DataFrame:
    """Series long enough to analyse, with ``lags`` and the ``acf`` array (null at zero variance)."""
    long_enough = sums.where(F.col("n") >= MIN_LENGTH)
    lags = F.least(F.lit(MAX_LAGS), F.floor(F.col("n") / 2)).cast("int")
    return long_enough.withColumn("lags", F.least(lags, F.size("s") - 1)).withColumn(
        "acf", F.transform(F.slice("s", 1, F.col("lags") + 1), lambda x: F.try_divide(x, F.nullif(F.col("s")[0], F.lit(0.0)))))


def acf(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Autocorrelation per lag with the half-width of its 95 % band (Bartlett)."""
    flat = analysed(sums).select(*keys, "n", F.posexplode("acf").alias("lag", "acf"))
    earlier = W.partitionBy(*keys).orderBy("lag").rowsBetween(W.unboundedPreceding, -1)
    squares = F.coalesce(F.sum(F.when(F.col("lag") > 0, F.col("acf") * F.col("acf"))).over(earlier), F.lit(0.0))
    band = F.when(F.col("lag") == 0, 0.0).otherwise(Z975 * F.sqrt((1 + 2 * squares) / F.col("n")))
    return flat.withColumn("band", band)


def _durbin_levinson(r: Column, lags: Column) -> Column:
    """Partial autocorrelations 1..lags from the autocorrelation array (r[0] = 1)."""
    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def step(state: Column, k: Column) -> Column:
        phi = state["phi"]
        past = F.slice(r, F.lit(2), k - 1)
        top = F.element_at(r, k + 1) - dot(phi, F.reverse(past))
        last = F.try_divide(top, F.nullif(1 - dot(phi, past), F.lit(0.0)))
        grown = F.transform(F.array(last), lambda a: F.struct(
            F.concat(F.zip_with(phi, F.reverse(phi), lambda p, q: p - a * q), F.array(a)).alias("phi"),
            F.concat(state["out"], F.array(a)).alias("out")))
        return grown[0]

    empty = F.array().cast("array<double>")
    start = F.struct(empty.alias("phi"), empty.alias("out"))
    return F.aggregate(F.sequence(F.lit(1), lags), start, step, lambda s: s["out"])


def pacf(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Partial autocorrelation per lag (Yule–Walker) with its constant 95 % band."""
    arrays = analysed(balance(sums, keys)).select(*keys, "n", _durbin_levinson(F.col("acf"), F.col("lags")).alias("p"))
    flat = arrays.select(*keys, "n", F.posexplode("p").alias("_i", "pacf"))
    return flat.select(
        *keys, "n", (F.col("_i") + 1).alias("lag"), "pacf", (Z975 / F.sqrt(F.col("n"))).alias("band"))


class LagSums:
    """One series' lag sums; gives cross products of lags over a range of times."""

    def __init__(self, n: int, s, head, tail, total: float):
        self.n, self.total = int(n), float(total)
        self.s, self.head, self.tail = (np.asarray(v, dtype=float) for v in (s, head, tail))

    def gram(self, start: int, lags: int) -> np.ndarray:
        """Cross products of (x[t], …, x[t-lags], 1) over t in [start, n), start >= lags."""
        out = np.empty((lags + 2, lags + 2))
        tail, m = self.tail, len(self.tail)
        for k in range(lags + 1):
            early = np.concatenate(([0.0], np.cumsum(self.head[k:start] * self.head[:max(start - k, 0)])))
            late = tail[k:] * tail[:m - k]
            late = np.concatenate(([0.0], np.cumsum(late[::-1])))
            for i in range(lags + 1 - k):
                out[i, i + k] = out[i + k, i] = self.s[k] - early[max(start - i - k, 0)] - late[i]
        first = np.concatenate(([0.0], np.cumsum(self.head[:start])))
        last = np.concatenate(([0.0], np.cumsum(tail[::-1])))
        for i in range(lags + 1):
            out[i, -1] = out[-1, i] = self.total - first[start - i] - last[i]
        out[-1, -1] = self.n - start
        return out


def shift(row: np.ndarray, k: int) -> np.ndarray:
    """Move a filter over (x[t], x[t-1], …, 1) back by k steps."""
    out = np.zeros_like(row)
    out[k:-1] = row[:len(row) - 1 - k]
    out[-1] = row[-1]
    return out


def regress(gram: np.ndarray, y: np.ndarray, x: np.ndarray):
    """Least squares of filter ``y`` on filters ``x``: coefficients, residual filter, SSR, X'X."""
    xx, xy = x @ gram @ x.T, x @ gram @ y
    coef = np.linalg.solve(xx, xy)
    residual = y - coef @ x
    return coef, residual, max(float(residual @ gram @ residual), 0.0), xx


# Response surface of the unit-root p-value (constant, one series).
TAU_MAX, TAU_MIN, TAU_STAR = 2.74, -18.83, -1.61
SMALL_P = (2.1659, 1.4412, 3.8269e-2)
LARGE_P = (1.7339, 9.3202e-1, -1.2745e-1, -1.0368e-2)


def unit_root_p(stat: float) -> float:
    if stat > TAU_MAX:
        return 1.0
    if stat < TAU_MIN:
        return 0.0
    coefs = SMALL_P if stat <= TAU_STAR else LARGE_P
    z = sum(c * stat**i for i, c in enumerate(coefs))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def adf_max_lag(n: int) -> int:
    """Default largest lag of the test for a series of n points."""
    return min(n // 2 - 2, math.ceil(12.0 * (n / 100.0) ** 0.25))


def adf_test(sums: LagSums, max_lag: int):
    """Augmented Dickey–Fuller with constant, lag count by AIC: (stat, p, lag, nobs)."""
    def rows(lags: int, width: int):
        level, change = np.zeros(width + 3), np.zeros(width + 3)
        level[1] = 1.0
        change[0], change[1] = 1.0, -1.0
        const = np.zeros(width + 3)
        const[-1] = 1.0
        return change, np.array([level, const] + [shift(change, j) for j in range(1, lags + 1)])

    gram = sums.gram(max_lag + 1, max_lag + 1)
    nobs = sums.n - 1 - max_lag
    y, x = rows(max_lag, max_lag)
    scores = []
    for lag in range(max_lag + 1):
        ssr = regress(gram, y, x[:lag + 2])[2]
        scores.append((nobs * math.log(ssr / nobs) + 2 * (lag + 2), lag))
    best = min(scores)[1]
    y, x = rows(best, best)
    coef, _, ssr, xx = regress(sums.gram(best + 1, best + 1), y, x)
    nobs = sums.n - 1 - best
    variance = ssr / (nobs - len(coef)) * np.linalg.inv(xx)[0, 0]
    stat = coef[0] / math.sqrt(variance)
    return stat, unit_root_p(stat), best, nobs


ADF_FIELDS = "adf_stat double, adf_p_value double, used_lag int, nobs long, status string"


def stationarity(sums: DataFrame, keys: list[str], *, max_lag: int | None = None) -> DataFrame:
    """Unit-root test, verdict and suggested orders per series; one row in, one row out."""
    wanted = analysed(sums).select(*keys, "n", "s", "head", "tail", "total")
    key_fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema if f.name in keys)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                lag = adf_max_lag(r.n) if max_lag is None else min(max_lag, adf_max_lag(r.n))
                try:
                    if lag < 0 or not r.s[0] > 0:
                        raise ValueError("constant or too short")
                    out.append((*adf_test(LagSums(r.n, r.s, r.head, r.tail, r.total), lag), "ok"))
                except (ValueError, np.linalg.LinAlgError, ZeroDivisionError) as e:
                    out.append((None, None, None, None, str(e)))
            tests = pd.DataFrame(out, columns=["adf_stat", "adf_p_value", "used_lag", "nobs", "status"])
            tests = tests.astype({"used_lag": "Int32", "nobs": "Int64", "adf_stat": "float64", "adf_p_value": "float64"})
            yield pd.concat([batch[keys].reset_index(drop=True), tests], axis=1)

    tested = balance(wanted, keys).mapInPandas(solve, f"{key_fields}, {ADF_FIELDS}")
    number = {c: F.when(~F.isnan(c), F.col(c)) for c in ("adf_stat", "adf_p_value")}
    verdict = tested.withColumns(number).withColumn("is_stationary", is_significant(F.col("adf_p_value")))
    return verdict.withColumn("orders", order_hint(F.col("is_stationary")))


def longest_needed_lag(longest: int) -> int:
    """Lags ``lag_sums`` must hold for both the correlogram and the unit-root test."""
    return max(MAX_LAGS, adf_max_lag(longest) + 1)


def unit_root_table(tests: DataFrame, station_names: DataFrame, feature_names: DataFrame) -> DataFrame:
    """Result table: key, station and feature with display names, verdict, p-value."""
    from tidemark.operators.lookup import with_english

    keyed = tests.withColumn("key", series_key(F.col("station"), F.col("feature")))
    named = with_english(keyed, "station", station_names, alias="english_station")
    named = with_english(named, "feature", feature_names, alias="english_feature")
    return named.select(
        "key", "station", "english_station", "feature", "english_feature", "is_stationary", "adf_p_value")
