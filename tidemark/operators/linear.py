"""ARIMA and seasonal ARIMA for every series in one distributed job.

First estimates need nothing but cross products of lags, summed per series in one
read: two regressions, of which the first supplies residuals for moving averages.
From there each order's conditional sum of squares over train is minimised; its
whole recursion over validation chooses the order, which is fitted again on both.
A series is one task's row; one above the group limit is cut into pieces that
are run side by side, pass by pass, for all orders at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product
from operator import sub

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import css
from tidemark.operators.autocorr import Z975, LagSums, lag_products, shift
from tidemark.operators.css import Order
from tidemark.operators.series import floors, lagged
from tidemark.scratch import balance, materialize, max_group_rows, width

MAX_LAG = 12
STEPS_PER_ROW = 10_000
SERIES_PER_SOLVE = 512
READINGS_PER_SOLVE = 200_000
TRAIN_PASSES = 6
FINAL_PASSES = 10


def arima_orders() -> list[Order]:
    return [Order(p, d, q) for d, p, q in product((0, 1), range(4), range(3))]


def sarima_orders(period: int) -> list[Order]:
    grid = product((0, 1), (0, 1), range(3), range(2), range(2), range(2))
    return [Order(p, d, q, sp, sd, period, sq) for d, sd, p, q, sp, sq in grid]


def needed_lag(orders: list[Order]) -> int:
    """Lags that leave room for the long autoregression of every order, and for the last values a forecast needs."""
    period = max(o.period for o in orders)
    own = max(len(o.difference()) - 1 + o.q for o in orders)
    return max(MAX_LAG, own + (period + 2 if period else 0), *(o.reach() for o in orders))


def split_lag_sums(long: DataFrame, keys: list[str], max_lag: int, *, group_rows: int | None = None) -> DataFrame:
    """Lag sums over train and over train plus validation, one row per series.

    ``long`` has keys, ``pos``, ``split`` and ``value``; values are centred on
    the train mean (``center``).
    """
    in_split = {s: F.col("split") == s for s in ("train", "val", "test")}
    stats = long.groupBy(*keys).agg(
        *[F.count_if(c).alias(f"n_{s}") for s, c in in_split.items()],
        F.avg(F.when(in_split["train"], F.col("value"))).alias("center"))
    fitted = stats.withColumn("n", F.col("n_train") + F.col("n_val")).where("n > 0")
    rows = long.where("split <> 'test'").select(*keys, "pos", "split", "value")
    sums = lag_products(rows, keys, max_lag, fitted, "center", part=F.col("split") == "train", group_rows=group_rows)
    return sums.withColumnsRenamed({"total_part": "total_train", "s_part": "s_train", "tail_part": "tail_train"})


def _solve_all(gram: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least squares of many series at once: coefficients (NaN where singular) and residual filters."""
    gx = x @ gram
    xx, xy = gx @ x.transpose(0, 2, 1), np.einsum("smk,sk->sm", gx, y)
    try:
        coef = np.linalg.solve(xx, xy[..., None])[..., 0]
    except np.linalg.LinAlgError:
        coef = np.full(xy.shape, np.nan)
        for i in range(len(xy)):
            try:
                coef[i] = np.linalg.solve(xx[i], xy[i])
            except np.linalg.LinAlgError:
                continue
    return coef, y - np.einsum("sm,smk->sk", coef, x)


def first_estimates(gram: np.ndarray, order: Order) -> np.ndarray:
    """Coefficients of an order from cross products, series x parameters; NaN where not estimable.

    A long autoregression supplies the residuals whose lags stand for the moving
    average; seasonal moving averages begin at zero. Seasonal lags enter by
    themselves, without their products with plain ones.
    """
    count, width = len(gram), gram.shape[1]
    lags, nobs = width - 2, gram[:, -1, -1]
    delta, ar_lags = order.difference(), order.ar_lags()
    theta = np.full((count, order.size()), np.nan)
    long_ar = lags - order.q - (len(delta) - 1) if order.q else 0
    if order.reach() > lags or (order.q and long_ar < max([1, *ar_lags])):
        return theta
    z, const = np.zeros(width), np.zeros(width)
    z[:len(delta)], const[-1] = delta, 1.0
    ys = np.broadcast_to(z, (count, width))
    rows = np.broadcast_to(np.array([const] + [shift(z, k) for k in ar_lags]), (count, 1 + len(ar_lags), width))
    if order.q:
        history = np.array([const] + [shift(z, k) for k in range(1, long_ar + 1)])
        residual = _solve_all(gram, ys, np.broadcast_to(history, (count, *history.shape)))[1]
        moved = []
        for j in range(1, order.q + 1):
            own = np.zeros_like(residual)
            own[:, j:-1] = residual[:, :width - 1 - j]
            own[:, -1] = residual[:, -1]
            moved.append(own)
        rows = np.concatenate([rows, np.stack(moved, 1)], 1)
    theta[:, :rows.shape[1]] = _solve_all(gram, ys, rows)[0]
    theta[:, rows.shape[1]:] = 0.0
    theta[nobs <= max(order.size(), long_ar + 1) + 1] = np.nan
    if order.linear():  # the regression is the fit: an unstable one is none
        theta[~css.stable(order, theta)] = np.nan
        return theta
    return css.shrunk(order, theta)


def starts_of_batch(rows: list, orders: list[Order]) -> list[dict]:
    """Per series, first estimates of every order on train and on train plus validation; None where there are none."""
    by_lags: dict[int, list[int]] = {}
    grams = []
    for i, r in enumerate(rows):
        lags = min(len(r.s_all) - 1, max(2, int(r.n_train) // 4))
        train = LagSums(r.n_train, r.s_train, r.head, r.tail_train, r.total_train)
        both = LagSums(r.n, r.s_all, r.head, r.tail_all, r.total_all)
        grams.append((train.gram(lags, lags), {k: both.gram(k, k) for k in {lags} | {o.reach() for o in orders if o.linear() and o.reach() <= lags}}))
        by_lags.setdefault(lags, []).append(i)
    found: list[dict] = [{"train": [], "both": []} for _ in rows]
    for lags, members in by_lags.items():
        train = np.stack([grams[i][0] for i in members])
        for order in orders:
            # A regression on the sample of the errors themselves, where it is the fit.
            reach = order.reach() if order.linear() and order.reach() <= lags else lags
            estimates = {"train": first_estimates(train, order), "both": first_estimates(np.stack([grams[i][1][reach] for i in members]), order)}
            for name, theta in estimates.items():
                for i, own in zip(members, theta):
                    found[i][name].append(own.tolist() if np.isfinite(own).all() else None)
    return found


def best_orders(scores: np.ndarray, orders: list[Order]) -> np.ndarray:
    """Per series the order of the least score, the smaller one on a tie; -1 without any."""
    size = np.array([o.size() for o in orders])
    out = np.full(len(scores), -1)
    for i, own in enumerate(scores):
        if np.isfinite(own).any():
            out[i] = np.lexsort((np.arange(len(own)), size, own))[0]
    return out


def _thetas(starts: list, order: Order) -> np.ndarray:
    return np.array([s if s is not None else [np.nan] * order.size() for s in starts], float).reshape(len(starts), order.size())


def fit_series(rows: list, orders: list[Order]) -> list[dict]:
    """Models of whole series: every order on train, its error on validation, the best one on both.

    Series of like lengths go together. The last fits are put together by order over all series.
    """
    found = _in_chunks(search_orders, rows, orders, [len(r.values) for r in rows])
    for at in sorted({x["at"] for x in found if "at" in x}):
        here = [i for i, x in enumerate(found) if x.get("at") == at]
        chosen = [(rows[i], found[i]) for i in here]
        for i, model in zip(here, _in_chunks(fit_chosen, chosen, orders, [len(rows[i].values) for i in here])):
            found[i] = model
    return found


def _in_chunks(solve, items: list, orders: list[Order], lengths: list[int]) -> list[dict]:
    """Results in the order of ``items``, solved in chunks of like lengths."""
    place = sorted(range(len(items)), key=lambda i: lengths[i])
    out: list[dict] = [{}] * len(items)
    chunk: list[int] = []
    for k, i in enumerate(place):
        chunk.append(i)
        following = lengths[place[k + 1]] if k + 1 < len(place) else 0
        if not following or following * (len(chunk) + 1) > READINGS_PER_SOLVE:
            for j, found in zip(chunk, _guarded(solve, [items[j] for j in chunk], orders)):
                out[j] = found
            chunk = []
    return out


def _side_by_side(rows: list) -> np.ndarray:
    """Centred readings (time, series), zeros after a series' end."""
    y = np.zeros((max(len(r.values) for r in rows), len(rows)))
    for i, r in enumerate(rows):
        y[:len(r.values), i] = np.asarray(r.values, float) - r.center
    return y


def search_orders(rows: list, orders: list[Order]) -> list[dict]:
    """Per series the best order (``at``) with its train coefficients and its error on validation."""
    y = _side_by_side(rows)
    n_train, n = (np.array([getattr(r, c) for r in rows], int) for c in ("n_train", "n"))
    scores, trained = np.full((len(rows), len(orders)), np.inf), {}
    for at, order in enumerate(orders):
        theta = _thetas([r.train[at] for r in rows], order)
        here = np.flatnonzero(np.isfinite(theta).all(1))
        if not len(here):
            continue
        fit = css.minimise(order, y[:, here], n_train[here], [theta[here]], TRAIN_PASSES)
        trained[at] = dict(zip(here.tolist(), fit.theta))
        errors = css.errors_of(order, css.differenced(order, y[:, here]), fit.theta)
        times = order.reach() + np.arange(len(errors))[:, None]
        held_out = (times >= n_train[here]) & (times < n[here])
        mse = (np.where(held_out, errors, 0.0) ** 2).sum(0) / np.maximum(held_out.sum(0), 1)
        scores[here, at] = np.where(np.isfinite(fit.sse), mse, np.inf)
    best = best_orders(scores, orders)
    return [dict(status="no estimable order") if at < 0 else dict(at=at, theta=trained[at][i], score=scores[i, at])
            for i, at in enumerate(best.tolist())]


def fit_chosen(chosen: list[tuple], orders: list[Order]) -> list[dict]:
    """Models of (series, what the search found), all of one order: fitted again on train plus validation."""
    rows, at = [r for r, _ in chosen], chosen[0][1]["at"]
    order, y, n = orders[at], _side_by_side(rows), np.array([r.n for r in rows], int)
    theta = np.stack([x["theta"] for _, x in chosen])
    again = _thetas([r.both[at] for r in rows], order)
    again = np.where(np.isfinite(again).all(1)[:, None], again, theta)
    fit = css.minimise(order, y, n, [theta, again], FINAL_PASSES)
    errors = css.errors_of(order, css.differenced(order, y), fit.theta)
    found = []
    for k, (r, x) in enumerate(chosen):
        last = errors[:n[k] - order.reach(), k][::-1][:order.memory()]
        found.append(_model(r, order, fit.theta[k], fit.sse[k], x["score"], last))
    return found


def _model(r, order: Order, theta: np.ndarray, sse: float, score: float, last_errors) -> dict:
    ar, ma = (poly[0] for poly in order.polynomials(theta[None]))
    recent = np.asarray(r.tail_all, dtype=float)[::-1]
    errors = [*map(float, last_errors), *[0.0] * (order.memory() - len(last_errors))]
    return dict(
        status="ok", p=order.p, d=order.d, q=order.q, sp=order.sp, sd=order.sd, sq=order.sq, period=order.period,
        const=float(theta[0]), ar=list(-ar[1:]), ma=list(ma[1:]), sigma2=float(sse) / (int(r.n) - order.reach()),
        val_rmse=float(score) ** 0.5, last_values=list(recent[:max(len(ar) - 1, 1)]), last_errors=errors)


MODEL_FIELDS = (
    "status string, p int, d int, q int, sp int, sd int, sq int, period int, const double, ar array<double>, "
    "ma array<double>, sigma2 double, val_rmse double, last_values array<double>, "
    "last_errors array<double>")
_names = [f.split()[0] for f in MODEL_FIELDS.split(", ")]
_types = {c: "Int32" for c in ("p", "d", "q", "sp", "sd", "sq", "period")}


def _key_fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)


def fit_linear(
    long: DataFrame, keys: list[str], orders: list[Order], *, model: str = "arima",
    group_rows: int | None = None,
) -> DataFrame:
    """One model row per series; series that cannot be fitted carry a status instead."""
    length = max_group_rows(long.sparkSession, group_rows)
    sums = split_lag_sums(long, keys, needed_lag(orders), group_rows=group_rows)
    starts = materialize(_starts(sums, keys, orders, model), "first-estimates")
    failed = starts.where("status IS NOT NULL")
    usable = starts.where("status IS NULL")
    values = long.where("split <> 'test'").select(*keys, "pos", "value")
    long_series = usable.where(F.col("n") > length)
    if long_series.isEmpty():
        found = _fit_whole(values, usable, keys, orders)
    else:
        found = _fit_whole(values, usable.where(F.col("n") <= length), keys, orders).unionByName(
            _fit_pieces(values, materialize(long_series, "long-series"), keys, orders, length))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema if f.name not in failed.columns]
    return materialize(found.unionByName(failed.select(*keys, *KEPT, "status", *none)), "linear-models")


KEPT = ["n_train", "n_val", "n_test", "center"]
START_FIELDS = ("n_train long, n_val long, n_test long, n long, center double, status string, "
                "tail_all array<double>, train array<array<double>>, both array<array<double>>")


def _starts(sums: DataFrame, keys: list[str], orders: list[Order], model: str) -> DataFrame:
    train, val, test = floors(model)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            series = list(batch.itertuples(index=False))
            long_enough = [r.n_train >= train and r.n_val >= val and r.n_test >= test for r in series]
            rows = [dict(status="too short")] * len(series)
            wanted = [i for i, ok in enumerate(long_enough) if ok]
            for at in range(0, len(wanted), SERIES_PER_SOLVE):
                chunk = wanted[at:at + SERIES_PER_SOLVE]
                for i, found in zip(chunk, _guarded(starts_of_batch, [series[i] for i in chunk], orders)):
                    rows[i] = found
            kept = batch[[*keys, *KEPT, "n", "tail_all"]].reset_index(drop=True)
            yield pd.concat([kept, pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in ("status", "train", "both")})], axis=1)

    return balance(sums, keys).mapInPandas(solve, f"{_key_fields(sums, keys)}, {START_FIELDS}")


def _fit_whole(values: DataFrame, starts: DataFrame, keys: list[str], orders: list[Order]) -> DataFrame:
    """Series within the group limit: each one row, fitted in batches of like lengths."""
    gathered = values.join(starts.select(*keys), keys, "left_semi").groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda r: r["value"]).alias("values"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _model_rows(batch, keys, fit_series(list(batch.itertuples(index=False)), orders))

    # Tasks of one solve's readings at least: a solve of few series costs almost as much.
    spark = values.sparkSession
    solves = (starts.agg(F.sum("n")).first()[0] or 0) // READINGS_PER_SOLVE
    tasks = max(spark.sparkContext.defaultParallelism, min(width(spark), solves))
    return gathered.join(starts, keys).repartition(tasks, *keys).mapInPandas(solve, _model_schema(starts, keys))


def _model_schema(df: DataFrame, keys: list[str]) -> str:
    return f"{_key_fields(df, keys)}, n_train long, n_val long, n_test long, center double, {MODEL_FIELDS}"


def _model_rows(batch: pd.DataFrame, keys: list[str], rows: list[dict]) -> pd.DataFrame:
    fitted = pd.DataFrame({c: pd.Series([x.get(c) for x in rows], dtype=_types.get(c, object)) for c in _names})
    return pd.concat([batch[[*keys, *KEPT]].reset_index(drop=True), fitted], axis=1)


def _guarded(solve, rows: list, orders: list[Order]) -> list[dict]:
    """A batch; in halves if it fails, so that a bad series fails alone."""
    try:
        return solve(rows, orders)
    except (ValueError, np.linalg.LinAlgError) as e:
        if len(rows) == 1:
            return [dict(status=f"failed: {e}")]
        half = len(rows) // 2
        return _guarded(solve, rows[:half], orders) + _guarded(solve, rows[half:], orders)


# ---- series in pieces -------------------------------------------------------------------------------

FIT_FIELDS = ("o int, until long, theta array<double>, sse double, held_out double, gradient array<double>, "
              "products array<double>, damping double, trial array<double>, other array<double>")


def _fit_pieces(values: DataFrame, starts: DataFrame, keys: list[str], orders: list[Order], length: int) -> DataFrame:
    """Series above the group limit: pieces with a halo, and a row per series and order that says where its descent is.

    A pass runs every piece from nothing, chains the ends into the true states
    before each piece, runs the pieces from those, and adds up their sums. There
    are as many passes as a whole series is given.
    """
    halo = max(o.reach() for o in orders)
    if length <= halo:
        raise ValueError("group limit must exceed the readings that an order reaches back")
    seg = F.floor(F.col("pos") / length).cast("long")
    near_end = F.when(F.col("pos") % length >= length - halo, F.array(seg, seg + 1)).otherwise(F.array(seg))
    centred = values.join(starts.select(*keys, "n", "center"), keys).withColumn("seg", F.explode(near_end))
    pieces = materialize(centred.where(F.col("seg") * length < F.col("n")).groupBy(*keys, "seg").agg(
        F.min("pos").alias("first"), (F.col("seg") * length - F.min("pos")).alias("halo"),
        F.transform(F.sort_array(F.collect_list(F.struct("pos", (F.col("value") - F.col("center")).alias("y")))), lambda r: r["y"]).alias("y")),
        "pieces")
    begun = starts.select(*keys, "n", "n_train", F.posexplode("train").alias("o", "trial")).where("trial IS NOT NULL")
    none = F.lit(None)
    fits = begun.select(
        *keys, "o", F.col("n_train").alias("until"), F.col("trial").alias("theta"), F.lit(float("inf")).alias("sse"),
        none.cast("double").alias("held_out"), none.cast("array<double>").alias("gradient"), none.cast("array<double>").alias("products"),
        F.lit(1e-3).alias("damping"), "trial", none.cast("array<double>").alias("other"))
    for _ in range(TRAIN_PASSES):
        fits = _pass(pieces, fits, starts, keys, orders)
    sizes = F.element_at(F.array(*[F.lit(o.size()) for o in orders]), F.col("o") + 1)
    chosen = fits.where("isnotnull(held_out) AND NOT isnan(held_out)").groupBy(*keys).agg(
        F.min(F.struct("held_out", sizes.alias("size"), "o", "theta")).alias("b")).select(*keys, "b.held_out", "b.o", "b.theta")
    best = materialize(chosen.withColumnRenamed("held_out", "score"), "best-orders")
    again = best.join(starts.select(*keys, "n", "both"), keys)
    fits = again.select(
        *keys, "o", F.col("n").alias("until"), "theta", F.lit(float("inf")).alias("sse"), none.cast("double").alias("held_out"),
        none.cast("array<double>").alias("gradient"), none.cast("array<double>").alias("products"), F.lit(1e-3).alias("damping"),
        F.col("theta").alias("trial"), F.element_at("both", F.col("o") + 1).alias("other"))
    for _ in range(FINAL_PASSES + 1):
        fits = _pass(pieces, fits, starts, keys, orders)
    last = _chained(pieces, fits.withColumn("trial", F.col("theta")), keys, orders).where("seg < 0").select(*keys, "state")
    done = starts.join(best.select(*keys, "score"), keys, "left").join(fits.select(*keys, "o", "theta", "sse"), keys, "left").join(last, keys, "left")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                if r.theta is None:
                    rows.append(dict(status="no estimable order"))
                    continue
                order = orders[int(r.o)]
                errors = np.asarray(r.state, float).reshape(order.memory(), 3 + order.p + order.sp)[::-1, 0]
                rows.append(_model(r, order, np.asarray(r.theta, float), r.sse, r.score / int(r.n_val), errors))
            yield _model_rows(batch, keys, rows)

    return done.mapInPandas(finish, _model_schema(starts, keys))


def _own(order: Order, piece) -> np.ndarray:
    """Readings of a piece with as many before it as the order reaches back."""
    return np.asarray(piece.y, float)[max(0, int(piece.halo) - order.reach()):, None]


def _chained(pieces: DataFrame, fits: DataFrame, keys: list[str], orders: list[Order]) -> DataFrame:
    """(keys, o, seg, state): what precedes each piece under its fit's trial; under seg -1 what the last piece leaves."""
    trials = fits.groupBy(*keys).agg(F.collect_list(F.struct("o", "trial")).alias("trials"))
    joined = pieces.join(trials, keys)
    own_keys = _key_fields(pieces, keys)

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                out = []
                for t in r.trials:
                    order, theta = orders[int(t["o"])], np.asarray(t["trial"], float)
                    errors, _, end = css.run(order, _own(order, r), theta[None])
                    out.append((t["o"], r.seg, len(errors), list(theta), end[:, 0].ravel().tolist()))
                found = pd.DataFrame(out, columns=["o", "seg", "rows", "trial", "end"])
                yield pd.concat([pd.DataFrame({k: [getattr(r, k)] * len(found) for k in keys}), found], axis=1)

    local = joined.mapInPandas(ends, f"{own_keys}, o int, seg long, rows long, trial array<double>, end array<double>")

    def chain(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("seg")
        order, theta = orders[int(batch["o"].iloc[0])], np.asarray(batch["trial"].iloc[0], float)
        state, out = np.zeros((order.memory(), 3 + order.p + order.sp)), []
        for rows, end in zip(batch["rows"], batch["end"]):
            out.append(state.ravel().tolist())
            state = css.carry(order, theta, int(rows), state) + np.asarray(end, float).reshape(state.shape)
        found = {"o": [*batch["o"], batch["o"].iloc[0]], "seg": [*batch["seg"], -1], "state": [*out, state.ravel().tolist()]}
        return pd.DataFrame({**{k: [batch[k].iloc[0]] * (len(batch) + 1) for k in keys}, **found})

    return materialize(local.groupBy(*keys, "o").applyInPandas(chain, f"{own_keys}, o int, seg long, state array<double>"), "piece-states")


def _pass(pieces: DataFrame, fits: DataFrame, starts: DataFrame, keys: list[str], orders: list[Order]) -> DataFrame:
    """Evaluate every fit's trial over all pieces and take its next step."""
    states = _chained(pieces, fits, keys, orders)
    own_keys = _key_fields(pieces, keys)
    wanted = states.where("seg >= 0").join(fits.select(*keys, "o", "trial", "until"), [*keys, "o"]).groupBy(*keys, "seg").agg(
        F.collect_list(F.struct("o", "trial", "until", "state")).alias("trials"))
    joined = pieces.join(wanted, [*keys, "seg"]).join(starts.select(*keys, "n_train", "n"), keys)

    def evaluate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                out = []
                for t in r.trials:
                    order, theta = orders[int(t["o"])], np.asarray(t["trial"], float)
                    y = _own(order, r)
                    state = np.asarray(t["state"], float).reshape(order.memory(), 1, 3 + order.p + order.sp)
                    errors, derivatives, _ = css.run(order, y, theta[None], state)
                    times = (int(r.first) + len(r.y) - len(errors) + np.arange(len(errors)))[:, None]
                    sse, gradient, products = css.sums(errors, derivatives, times < int(t["until"]))
                    held = (times >= int(r.n_train)) & (times < int(r.n))
                    out.append((t["o"], [*sse, (np.where(held, errors, 0.0) ** 2).sum(), *gradient[0], *products[0].ravel()]))
                found = pd.DataFrame(out, columns=["o", "sums"])
                yield pd.concat([pd.DataFrame({k: [getattr(r, k)] * len(found) for k in keys}), found], axis=1)

    parts = joined.mapInPandas(evaluate, f"{own_keys}, o int, sums array<double>")
    each = parts.select(*keys, "o", F.posexplode("sums").alias("i", "x")).groupBy(*keys, "o", "i").agg(F.sum("x").alias("x"))
    total = each.groupBy(*keys, "o").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias("sums"))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [_learned(r, orders[int(r.o)]) for r in batch.itertuples(index=False)]
            names = [f.split()[0] for f in FIT_FIELDS.split(", ")][1:]
            learned = pd.DataFrame(out, columns=names)
            yield pd.concat([batch[[*keys, "o"]].reset_index(drop=True), learned], axis=1)

    return materialize(fits.join(total, [*keys, "o"]).mapInPandas(learn, f"{own_keys}, {FIT_FIELDS}"), "fits")


def _learned(r, order: Order) -> tuple:
    """One fit after its trial's sums: the same step as that of a whole series."""
    size = order.size()
    descent = css.Descent(order, np.asarray(r.trial, float)[None])
    descent.theta, descent.sse, descent.damping = np.asarray(r.theta, float)[None].copy(), np.array([r.sse]), np.array([r.damping])
    if r.gradient is not None:
        descent.gradient = np.asarray(r.gradient, float)[None].copy()
        descent.products = np.asarray(r.products, float).reshape(1, size, size).copy()
    sums = np.asarray(r.sums, float)
    before = float(descent.sse[0])
    descent.learn(sums[:1], sums[None, 2:2 + size], sums[None, 2 + size:].reshape(1, size, size))
    held_out = float(sums[1]) if descent.sse[0] < before else r.held_out
    if r.other is not None:
        trial = np.asarray(r.other, float)
    else:
        trial = descent.propose()[0]
    return (r.until, descent.theta[0].tolist(), float(descent.sse[0]), held_out, descent.gradient[0].tolist(),
            descent.products[0].ravel().tolist(), float(descent.damping[0]), trial.tolist(), None)


def _advance(c: np.ndarray, q: np.ndarray, steps: int):
    """C^steps and the variance accumulated over that many steps, by doubling."""
    power, var = np.eye(len(c)), np.zeros_like(c)
    base_c, base_v = c, q
    while steps:
        if steps & 1:
            var = base_v + base_c @ var @ base_c.T
            power = base_c @ power
        base_v = base_v + base_c @ base_v @ base_c.T
        base_c = base_c @ base_c
        steps >>= 1
    return power, var


def forecast_steps(r) -> pd.DataFrame:
    """Mean and 95 % interval for steps start+1 … start+count of one model row."""
    ar, ma = np.asarray(r.ar, dtype=float), np.asarray(r.ma, dtype=float)
    nx, ne = len(r.last_values), len(r.last_errors)
    size = nx + ne + 1
    c = np.zeros((size, size))
    c[0, :len(ar)], c[0, nx:nx + ne], c[0, -1] = ar, ma, r.const
    for i in range(1, nx):
        c[i, i - 1] = 1.0
    for j in range(1, ne):
        c[nx + j, nx + j - 1] = 1.0
    c[-1, -1] = 1.0
    state = np.concatenate((r.last_values, r.last_errors, [1.0])).astype(float)
    impulse = np.zeros(size)
    impulse[0] = 1.0
    if ne:
        impulse[nx] = 1.0
    power, var = _advance(c, r.sigma2 * np.outer(impulse, impulse), int(r.start))
    state, impulse, variance = power @ state, power @ impulse, var[0, 0]
    mean, spread = np.empty(int(r.count)), np.empty(int(r.count))
    for h in range(int(r.count)):
        state = c @ state
        variance += r.sigma2 * impulse[0] ** 2
        impulse = c @ impulse
        mean[h], spread[h] = state[0], variance
    half = Z975 * np.sqrt(spread)
    mean = mean + r.center
    step = np.arange(int(r.start) + 1, int(r.start) + int(r.count) + 1)
    return pd.DataFrame({
        "step": step, "pos": step + int(r.fitted_rows) - 1,
        "forecast": mean, "lo": mean - half, "hi": mean + half})


def forecast_linear(models: DataFrame, keys: list[str], *, steps_per_row: int = STEPS_PER_ROW) -> DataFrame:
    """Forecast of every test step. Long horizons are cut into pieces that start from a jumped state."""
    usable = models.where("status = 'ok' and n_test > 0")
    pieces = usable.withColumn("start", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("n_test") - 1) / steps_per_row).cast("long")))).withColumns({
            "start": F.col("start") * steps_per_row,
            "count": F.least(F.lit(steps_per_row).cast("long"), F.col("n_test") - F.col("start") * steps_per_row)})
    wanted = pieces.select(
        *keys, "start", "count", (F.col("n_train") + F.col("n_val")).alias("fitted_rows"), "center", "const", "ar", "ma", "sigma2", "last_values", "last_errors")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                out = forecast_steps(r)
                yield pd.concat(
                    [pd.DataFrame({k: [getattr(r, k)] * len(out) for k in keys}), out], axis=1)

    return balance(wanted, [*keys, "start"]).mapInPandas(run, f"{_key_fields(models, keys)}, step long, pos long, forecast double, lo double, hi double")


def against_actual(long: DataFrame, forecasts: DataFrame, keys: list[str]) -> DataFrame:
    """Forecast rows next to the test readings, joined on (series, position).

    Both sides grow with the readings, though the forecasts are made from a row a
    series and so look small to the planner: neither is broadcast.
    """
    test = long.where("split = 'test'").withColumnRenamed("value", "actual").drop("split", "n")
    return test.join(forecasts.hint("merge"), [*keys, "pos"])


def one_step_errors(
    long: DataFrame, models: DataFrame, keys: list[str], *, group_rows: int | None = None, attach: DataFrame | None = None
) -> DataFrame:
    """Every reading with its one-step ``linear`` prediction and ``error``; null without enough history.

    The error is the whole recursion e[t] = w[t] - ma[1] e[t-1] - …, w being the
    autoregressive part, started with zeros where the first w exists. Series
    without a moving average have e = w. ``attach`` adds columns per series.
    """
    held = materialize(models.where("status = 'ok'"), "one-step-models")
    reach = held.agg(F.max(F.size("ar"))).first()[0] or 0
    shifts = {f"_l{k}": ("value", k) for k in range(1, reach + 1)}
    params = held.select(
        *keys, (F.col("n_train") + F.col("n_val") + F.col("n_test")).alias("n"), "center", "const", "ar", "ma")
    extra = []
    if attach is not None:
        extra = [c for c in attach.columns if c not in keys]
        params = params.join(attach, keys)
    rows = lagged(long.drop("n", *extra), keys, shifts, group_rows=group_rows, attach=params, balanced=True)

    def term(k: int) -> Column:
        weight = F.get("ar", F.lit(k - 1))
        return F.when(F.coalesce(weight, F.lit(0.0)) == 0, 0.0).otherwise(weight * (F.col(f"_l{k}") - F.col("center")))

    w = reduce(sub, [term(k) for k in range(1, reach + 1)], F.col("value") - F.col("center")) - F.col("const")
    known = rows.withColumn("error", w).drop(*shifts, "center", "const", "ar")
    plain = known.where("size(ma) = 0").drop("ma")
    moving = _moving_errors(known.where("size(ma) > 0"), keys, max_group_rows(long.sparkSession, group_rows))
    return plain.unionByName(moving).withColumn("linear", F.col("value") - F.col("error"))


def _recur(w: np.ndarray, ma: list[float], state: list[float]) -> np.ndarray:
    """e[t] = w[t] - sum of ma[j] e[t-j]; ``state`` holds the errors before, latest first. Missing w gives 0."""
    past = np.array(state, float)[::-1].reshape(-1, 1, 1)
    return css.recursion(np.nan_to_num(w)[:, None, None], np.array([[1.0, *ma]]), past)[len(state):, 0, 0]


def _moving_errors(rows: DataFrame, keys: list[str], length: int) -> DataFrame:
    """Turn w into the recursive error, by (series, position segment).

    Each segment is first run from zeros; its end, moved on by the recursion's
    power, gives the state the next segment starts from. Segments are then run
    from their true states.
    """
    cut = rows.withColumn("_seg", F.floor(F.col("pos") / length).cast("long"))
    by = [*keys, "_seg"]
    key_fields = _key_fields(cut, by)

    def ends(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("pos")
        ma = list(batch["ma"].iloc[0])
        e = _recur(batch["error"].to_numpy(float), ma, [0.0] * len(ma))
        last = [*e[::-1][:len(ma)], *[0.0] * max(0, len(ma) - len(e))]
        return pd.DataFrame({**{k: [batch[k].iloc[0]] for k in by}, "_rows": [len(e)], "_last": [last], "ma": [ma]})

    def starts(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("_seg")
        ma = list(batch["ma"].iloc[0])
        state, out = np.zeros(len(ma)), []
        step = np.vstack([-np.array(ma), np.eye(len(ma))[:-1]])
        for rows_in, last in zip(batch["_rows"], batch["_last"]):
            out.append(state.tolist())
            state = np.linalg.matrix_power(step, int(rows_in)) @ state + np.asarray(last, float)
        return pd.DataFrame({**{k: batch[k].to_list() for k in by}, "_state": out})

    several = cut.where("_seg > 0").select("_seg").limit(1)
    if several.isEmpty():
        states = None
        ready = cut.withColumn("_state", F.transform("ma", lambda m: F.lit(0.0)))
    else:
        local = cut.select(*by, "pos", "error", "ma").groupBy(*by).applyInPandas(
            ends, f"{key_fields}, _rows long, _last array<double>, ma array<double>")
        states = materialize(local.groupBy(*keys).applyInPandas(starts, f"{key_fields}, _state array<double>"), "states")
        ready = cut.join(states, by)
    kept = [f for f in rows.schema if f.name != "ma"]

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("pos")
        w = batch["error"].to_numpy(float)
        e = _recur(w, list(batch["ma"].iloc[0]), list(batch["_state"].iloc[0]))
        return batch.assign(error=np.where(np.isnan(w), np.nan, e))[[f.name for f in kept]]

    out = ready.groupBy(*by).applyInPandas(run, T.StructType(kept))
    return out.withColumn("error", F.when(~F.isnan("error"), F.col("error")))
