import math

import numpy as np
import pytest

from tidemark.operators import autocorr, css, linear
from tidemark.operators.autocorr import LagSums

KEYS = ["station", "feature"]


def long_rows(spark, series, train=0.8, val=0.1):
    rows = []
    for name, values in series.items():
        n = len(values)
        a, b = int(n * train), int(n * train) + int(n * val)
        rows += [(name, "f", i, n, "train" if i < a else "val" if i < b else "test", float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "station string, feature string, pos long, n long, split string, value double")


def noise(n, seed=0):
    return np.random.default_rng(seed).normal(size=n)


def ar_series(n, coefs, seed=0, mean=5.0):
    e, x = noise(n, seed), np.zeros(n)
    for t in range(n):
        x[t] = e[t] + sum(c * x[t - i - 1] for i, c in enumerate(coefs) if t > i)
    return x + mean


def plain_acf(x, lags):
    d = x - x.mean()
    return np.array([d[k:] @ d[:len(d) - k] / (d @ d) for k in range(lags + 1)])


SERIES = {"ar": ar_series(150, [0.6, -0.2]), "walk": np.cumsum(noise(200, 1)) + 100, "short": noise(21, 2)}


@pytest.mark.parametrize("limit", [None, 41])
def test_acf_and_pacf(spark, limit):
    rows = long_rows(spark, {**SERIES, "tiny": noise(19), "flat": np.full(30, 3.0)})
    sums = autocorr.lag_sums(rows, KEYS, 40, group_rows=limit)
    got = autocorr.acf(sums, KEYS).orderBy("station", "lag").toPandas()
    assert "tiny" not in set(got.station)
    for name, x in SERIES.items():
        lags = min(40, len(x) // 2)
        r = plain_acf(x, lags)
        mine = got[got.station == name]
        np.testing.assert_allclose(mine.acf, r, atol=1e-12)
        band = [0.0] + [autocorr.Z975 * math.sqrt((1 + 2 * (r[1:k] ** 2).sum()) / len(x)) for k in range(1, lags + 1)]
        np.testing.assert_allclose(mine.band, band, rtol=1e-10)
        p = autocorr.pacf(sums, KEYS).where(f"station = '{name}'").orderBy("lag").toPandas()
        want = [np.linalg.solve(np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)]), r[1:k + 1])[-1]
                for k in range(1, lags + 1)]
        np.testing.assert_allclose(p.pacf, want, atol=1e-9)
    assert got[got.station == "flat"].acf.isna().all()


def test_gram_equals_direct_sums():
    x = noise(60, 4)
    m = 7
    s = [x[k:] @ x[:len(x) - k] for k in range(m + 2)]
    sums = LagSums(len(x), s, x[:m + 2], x[-(m + 2):], x.sum())
    for start in (m, m + 1):
        rows = np.array([[*(x[t - i] for i in range(m + 1)), 1.0] for t in range(start, len(x))])
        np.testing.assert_allclose(sums.gram(start, m), rows.T @ rows, atol=1e-10)


def plain_adf(x, max_lag):
    """Direct regressions on the data."""
    dx = np.diff(x)

    def ols(lag, first):
        y = dx[first:]
        cols = [x[first:-1], np.ones(len(y))] + [dx[first - j:len(dx) - j] for j in range(1, lag + 1)]
        a = np.column_stack(cols)
        coef, *_ = np.linalg.lstsq(a, y, rcond=None)
        e = y - a @ coef
        return coef, e @ e, a, len(y)

    scores = []
    for lag in range(max_lag + 1):
        _, ssr, a, n = ols(lag, max_lag)
        scores.append((n * math.log(ssr / n) + 2 * a.shape[1], lag))
    best = min(scores)[1]
    coef, ssr, a, n = ols(best, best)
    se = math.sqrt(ssr / (n - a.shape[1]) * np.linalg.inv(a.T @ a)[0, 0])
    return coef[0] / se, best, n


def test_unit_root(spark):
    rows = long_rows(spark, {**SERIES, "flat": np.full(30, 3.0)})
    lags = autocorr.longest_needed_lag(200)
    got = {r["station"]: r for r in autocorr.stationarity(autocorr.lag_sums(rows, KEYS, lags), KEYS).collect()}
    for name, x in SERIES.items():
        stat, lag, nobs = plain_adf(x, autocorr.adf_max_lag(len(x)))
        assert (got[name]["used_lag"], got[name]["nobs"]) == (lag, nobs)
        assert got[name]["adf_stat"] == pytest.approx(stat, rel=1e-7)
    assert got["ar"]["is_stationary"] is True and got["ar"]["orders"]["d"] == 0
    assert got["walk"]["is_stationary"] is False and got["walk"]["orders"]["d"] == 1
    assert got["flat"]["adf_stat"] is None and got["flat"]["is_stationary"] is None and got["flat"]["orders"] is None


def test_unit_root_p_values():
    # published critical values of the test with constant
    for stat, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)):
        assert autocorr.unit_root_p(stat) == pytest.approx(p, abs=0.002)
    assert autocorr.unit_root_p(-30) == 0.0 and autocorr.unit_root_p(5) == 1.0


def test_ar3_equals_least_squares(spark):
    x = ar_series(300, [0.5, -0.3, 0.2])
    model = linear.fit_linear(long_rows(spark, {"a": x}), KEYS, [linear.Order(3, 0, 0)]).first()
    y = x[:270]
    a = np.column_stack([np.ones(267), y[2:-1], y[1:-2], y[:-3]])
    coef, ssr, *_ = np.linalg.lstsq(a, y[3:], rcond=None)
    np.testing.assert_allclose(model["ar"], coef[1:], atol=1e-9)
    assert model["sigma2"] == pytest.approx(ssr[0] / 267)


def test_moving_average_is_recovered(spark):
    e = noise(4001, 9)
    model = linear.fit_linear(
        long_rows(spark, {"a": e[1:] + 0.5 * e[:-1]}), KEYS, [linear.Order(0, 0, 1)]).first()
    assert model["ma"][0] == pytest.approx(0.5, abs=0.05) and model["sigma2"] == pytest.approx(1, abs=0.06)


def simulate(model, steps):
    """Plain recursion of the fitted equation."""
    x, e = list(reversed(model["last_values"])), list(reversed(model["last_errors"]))
    out, psi = [], [1.0]
    for h in range(steps):
        nxt = model["const"] + sum(a * x[-i - 1] for i, a in enumerate(model["ar"]))
        nxt += sum(m * e[-j - 1] for j, m in enumerate(model["ma"]))
        x.append(nxt)
        e.append(0.0)
        out.append(nxt + model["center"])
        psi.append((model["ma"][h] if h < len(model["ma"]) else 0.0)
                   + sum(a * psi[-i - 1] for i, a in enumerate(model["ar"][:len(psi)])))
    return np.array(out), np.sqrt(model["sigma2"] * np.cumsum(np.square(psi[:steps])))


@pytest.mark.parametrize("order", [
    linear.Order(2, 1, 1), linear.Order(0, 0, 2), linear.Order(0, 1, 0), linear.Order(1, 0, 1, 1, 1, 12)])
def test_forecast_pieces(spark, order):
    t = np.arange(360)
    x = ar_series(360, [0.4]) + 3 * np.sin(2 * np.pi * t / 12) + 0.05 * t
    if order.d and order.q:
        x = np.cumsum(ar_series(360, [0.4], 6, mean=0.0)) + 0.4 * np.cumsum(noise(360, 7))
    models = linear.fit_linear(long_rows(spark, {"a": x}), KEYS, [order], model="sarima" if order.period else "arima")
    model = models.first()
    assert model["status"] == "ok"
    whole = linear.forecast_linear(models, KEYS).orderBy("step").toPandas()
    pieces = linear.forecast_linear(models, KEYS, steps_per_row=7).orderBy("step").toPandas()
    mean, sd = simulate(model, 36)
    for got in (whole, pieces):
        assert got.step.tolist() == list(range(1, 37))
        np.testing.assert_allclose(got.forecast, mean, rtol=1e-8)
        np.testing.assert_allclose(got.hi - got.forecast, linear.Z975 * sd, rtol=1e-8)


def test_search_picks_the_seasonal_order(spark):
    t = np.arange(400)
    x = 10 * np.sin(2 * np.pi * t / 12) + 0.1 * noise(400, 3)
    rows = long_rows(spark, {"a": x})
    seasonal = linear.fit_linear(rows, KEYS, linear.sarima_orders(12), model="sarima")
    model = seasonal.first()
    assert model["sp"] + model["sd"] > 0
    out = linear.against_actual(rows, linear.forecast_linear(seasonal, KEYS), KEYS).toPandas()
    assert len(out) == 40 and np.abs(out.actual - out.forecast).max() < 2


def test_search_segments_agree(spark):
    rows = long_rows(spark, SERIES)
    a = linear.fit_linear(rows, KEYS, linear.arima_orders()).orderBy("station").collect()
    b = linear.fit_linear(rows, KEYS, linear.arima_orders(), group_rows=13).orderBy("station").collect()
    assert [(r["p"], r["d"], r["q"], r["status"]) for r in a] == [(r["p"], r["d"], r["q"], r["status"]) for r in b]


def test_short_and_flat_series_do_not_stop_the_job(spark):
    rows = long_rows(spark, {"tiny": noise(20), "flat": np.full(80, 2.0), "good": ar_series(80, [0.5])})
    got = {r["station"]: r for r in linear.fit_linear(rows, KEYS, linear.arima_orders()).collect()}
    assert got["tiny"]["status"] == "too short" and got["good"]["status"] == "ok"
    assert got["flat"]["status"] == "ok" or "order" in got["flat"]["status"]


def test_one_step_errors(spark):
    x = ar_series(300, [0.7])
    rows = long_rows(spark, {"a": x})
    models = linear.fit_linear(rows, KEYS, [linear.Order(1, 0, 0)])
    phi = models.first()["ar"][0]
    out = linear.one_step_errors(rows, models, KEYS).orderBy("pos").toPandas()
    assert np.isnan(out.error[0])
    const = np.polyfit(x[:269], x[1:270], 1)[1]
    np.testing.assert_allclose(out.linear[1:], const + phi * x[:-1], rtol=1e-9)


def test_errors_of_a_slowly_forgetting_average(spark):
    """Root 0.95: the errors are the whole recursion of the fit, in one piece or in segments."""
    e = noise(5001, 12)
    rows = long_rows(spark, {"a": e[1:] + 0.95 * e[:-1]})
    models = linear.fit_linear(rows, KEYS, [linear.Order(0, 0, 1)])
    model = models.first()
    theta, x = model["ma"][0], e[1:] + 0.95 * e[:-1] - model["center"]
    want, past = [], 0.0
    for v in x:
        past = v - model["const"] - theta * past
        want.append(past)
    for limit in (None, 700):
        out = linear.one_step_errors(rows, models, KEYS, group_rows=limit).orderBy("pos").toPandas()
        np.testing.assert_allclose(out.error, want, atol=1e-9)
    assert model["last_errors"] == pytest.approx([want[4499]], abs=1e-9)


def direct_errors(order, theta, y):
    """Errors of one series by the definition, zero before the first that exists."""
    ar, ma = (p[0] for p in order.polynomials(np.array([theta], float)))
    e = np.zeros(len(y))
    for t in range(order.reach(), len(y)):
        e[t] = sum(c * y[t - i] for i, c in enumerate(ar)) - theta[0] - sum(c * e[t - j] for j, c in enumerate(ma) if 0 < j <= t)
    return e


ORDERS = [css.Order(2, 1, 1, 1, 1, 4, 1), css.Order(0, 1, 1, 0, 1, 12, 1), css.Order(1, 0, 2), css.Order(0, 0, 0), css.Order(2, 0, 0, 1, 0, 5)]


@pytest.mark.parametrize("order", ORDERS)
def test_errors_and_derivatives(order):
    rnd = np.random.default_rng(1)
    y = rnd.normal(size=(120, 3)).cumsum(0) * 0.1 + rnd.normal(size=(120, 3))
    theta = rnd.uniform(-0.3, 0.3, (3, order.size()))
    errors, derivatives, end = css.run(order, y, theta)
    for s in range(3):
        np.testing.assert_allclose(errors[:, s], direct_errors(order, theta[s], y[:, s])[order.reach():], atol=1e-10)
    for k in range(order.size()):
        step = np.zeros_like(theta)
        step[:, k] = 1e-6
        numeric = (css.run(order, y, theta + step)[0] - css.run(order, y, theta - step)[0]) / 2e-6
        np.testing.assert_allclose(derivatives[:, :, k], numeric, atol=1e-6)
    # In two pieces: from the state the first one leaves, and from nothing plus what that state is carried to.
    cut, reach = 70, order.reach()
    first, second = css.run(order, y[:cut], theta), None
    second = css.run(order, y[cut - reach:], theta, first[2])
    np.testing.assert_allclose(np.concatenate([first[0], second[0]]), errors, atol=1e-10)
    np.testing.assert_allclose(np.concatenate([first[1], second[1]]), derivatives, atol=1e-10)
    local = css.run(order, y[cut - reach:], theta)[2]
    for s in range(3):
        np.testing.assert_allclose(local[:, s] + css.carry(order, theta[s], 120 - cut, first[2][:, s]), end[:, s], atol=1e-10)


def test_recursion_of_a_long_series():
    """Blocks of responses equal the step by step recursion."""
    rnd = np.random.default_rng(2)
    x, ma = rnd.normal(size=(3000, 2, 3)), np.array([[1, 0.5, 0, 0, -0.3], [1, 0.95, 0.2, 0, 0.0]])
    state = rnd.normal(size=(4, 2, 3))
    want = np.concatenate([state, np.zeros_like(x)])
    for t in range(4, len(want)):
        want[t] = x[t - 4] - sum(ma[:, j, None] * want[t - j] for j in range(1, 5))
    np.testing.assert_allclose(css.recursion(x, ma, state)[4:], want[4:], atol=1e-9)


def seasonal_series(n, theta, seasonal, seed=0, period=12):
    """(0,1,1)(0,1,1): the differenced series is a product of two moving averages."""
    e = noise(n + period + 1, seed)
    z = e.copy()
    z[1:] += theta * e[:-1]
    z[period:] += seasonal * e[:-period]
    z[period + 1:] += theta * seasonal * e[:-period - 1]
    y = z.copy()
    for t in range(len(y)):
        y[t] += sum(c * y[t - k] for k, c in ((1, 1), (period, 1), (period + 1, -1)) if t >= k)
    return y[period + 1:]


def test_seasonal_moving_average(spark):
    """A planted (0,1,1)(0,1,1) of period 12 is recovered and forecast as by its recursion."""
    rows = long_rows(spark, {"a": seasonal_series(900, -0.5, -0.6, 4), "b": seasonal_series(700, 0.4, -0.5, 5)})
    order = css.Order(0, 1, 1, 0, 1, 12, 1)
    models = linear.fit_linear(rows, KEYS, [order], model="sarima")
    got = {r["station"]: r for r in models.collect()}
    for name, theta, seasonal in (("a", -0.5, -0.6), ("b", 0.4, -0.5)):
        ma = got[name]["ma"]
        assert ma[0] == pytest.approx(theta, abs=0.12) and ma[11] == pytest.approx(seasonal, abs=0.12)
        assert ma[12] == pytest.approx(ma[0] * ma[11], abs=1e-12) and got[name]["sigma2"] == pytest.approx(1, abs=0.15)
    out = linear.forecast_linear(models.where("station = 'a'"), KEYS).orderBy("step").toPandas()
    mean, sd = simulate(got["a"], len(out))
    np.testing.assert_allclose(out.forecast, mean, rtol=1e-8)
    np.testing.assert_allclose(out.hi - out.forecast, linear.Z975 * sd, rtol=1e-8)
    orders = [css.Order(p, 1, q, sp, 1, 12, sq) for p in (0, 1) for q in (0, 1) for sp in (0, 1) for sq in (0, 1)]
    chosen = linear.fit_linear(rows, KEYS, orders, model="sarima").collect()
    assert all(r["q"] + r["p"] > 0 and r["sq"] + r["sp"] > 0 for r in chosen)


@pytest.mark.parametrize("limit", [None, 60])
def test_validation_error_is_the_whole_recursion(spark, limit):
    """Root 0.95: the score of an order and the last errors are those of the recursion from the first reading."""
    e = noise(501, 12)
    x = e[1:] + 0.95 * e[:-1]
    rows = long_rows(spark, {"a": x, "b": ar_series(300, [0.6], 3)})
    order = css.Order(0, 0, 1)
    model = linear.fit_linear(rows, KEYS, [order], group_rows=limit).where("station = 'a'").first()
    y = x[:450] - model["center"]
    assert np.isnan(linear.first_estimates(np.zeros((1, 14, 14)), order)).all()
    # The same search by hand: train on 400, score on the next 50.
    sums = linear.split_lag_sums(rows, KEYS, linear.needed_lag([order])).where("station = 'a'").first()
    train = LagSums(400, sums["s_train"], sums["head"], sums["tail_train"], sums["total_train"])
    start = linear.first_estimates(train.gram(12, 12)[None], order)
    fits = css.minimise(order, y[:400, None], np.array([400]), [start], linear.TRAIN_PASSES)
    errors = direct_errors(order, fits.theta[0], y)
    assert model["val_rmse"] == pytest.approx(np.sqrt((errors[400:] ** 2).mean()), rel=1e-6)
    theta = [model["const"], model["ma"][0]]
    last = direct_errors(order, theta, y)
    assert model["last_errors"][0] == pytest.approx(last[-1], abs=1e-9)
    assert model["sigma2"] == pytest.approx((last ** 2).mean(), rel=1e-9)


def test_gradient_vanishes_and_variance_is_no_larger_than_the_first_estimate(spark):
    for seed, order in enumerate([css.Order(1, 0, 1), css.Order(2, 1, 2), css.Order(1, 0, 0, 1, 0, 12, 0), css.Order(0, 1, 1, 0, 1, 12, 1)]):
        x = np.cumsum(ar_series(400, [0.4, 0.2], seed, 0.0)) * 0.2 + ar_series(400, [0.5], seed + 9, 0.0)
        rows = long_rows(spark, {"a": x})
        model = linear.fit_linear(rows, KEYS, [order], model="sarima" if order.period else "arima").first()
        y = (x[:360] - model["center"])[:, None]
        sums = linear.split_lag_sums(rows, KEYS, linear.needed_lag([order])).first()
        both = LagSums(sums["n"], sums["s_all"], sums["head"], sums["tail_all"], sums["total_all"])
        lags = min(len(sums["s_all"]) - 1, 80)
        start = linear.first_estimates(both.gram(lags, lags)[None], order)
        first = (css.run(order, y, start)[0] ** 2).sum()
        n = 360 - order.reach()
        assert model["sigma2"] * n <= first * (1 + 1e-12)
        found = css.minimise(order, y, np.array([360]), [start], 60)
        assert model["sigma2"] * n == pytest.approx(found.sse[0], rel=1e-4)
        ratio = np.abs(found.gradient[0]) / np.sqrt(np.diagonal(found.products[0]) * found.sse[0])
        assert ratio[css.stable(order, found.theta * 1.0005).repeat(len(ratio))].max(initial=0) < 1e-4


def test_pieces_give_the_same_models(spark):
    """Series above the group limit: the same orders and coefficients as in one row."""
    rows = long_rows(spark, {"a": seasonal_series(300, -0.5, -0.6, 4), "b": ar_series(260, [0.5, 0.2], 8), "c": noise(240, 3)})
    orders = [css.Order(1, 0, 1), css.Order(0, 1, 1, 0, 1, 12, 1), css.Order(2, 0, 0)]
    whole = linear.fit_linear(rows, KEYS, orders, model="sarima").orderBy("station").collect()
    pieces = linear.fit_linear(rows, KEYS, orders, model="sarima", group_rows=70).orderBy("station").collect()
    for a, b in zip(whole, pieces):
        assert (a["p"], a["d"], a["q"], a["sq"], a["status"]) == (b["p"], b["d"], b["q"], b["sq"], b["status"])
        for c in ("ar", "ma", "last_errors", "last_values"):
            np.testing.assert_allclose(a[c], b[c], atol=1e-7)
        assert a["sigma2"] == pytest.approx(b["sigma2"], rel=1e-9) and a["val_rmse"] == pytest.approx(b["val_rmse"], rel=1e-7)


def test_forecast_rows_are_not_broadcast(spark):
    """A row a series makes many forecast rows: what looks small to the planner grows with the readings."""
    rows = [(f"s{s}", "v", i, 100, "test", float(i)) for s in range(3) for i in range(90, 100)]
    long = spark.createDataFrame(rows, "station string, feature string, pos long, n long, split string, value double")
    models = spark.createDataFrame(
        [(f"s{s}", "v", 80, 10, 10, "ok", 1.0, 0.0, [0.5], [], 1.0, [2.0], []) for s in range(3)],
        "station string, feature string, n_train long, n_val long, n_test long, status string, center double, const double, "
        "ar array<double>, ma array<double>, sigma2 double, last_values array<double>, last_errors array<double>")
    out = linear.against_actual(long, linear.forecast_linear(models, KEYS), KEYS)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r["station"], r["pos"]): r["forecast"] for r in out.collect()}
    assert got == {(f"s{s}", p): 1 + 2 * 0.5 ** (p - 89) for s in range(3) for p in range(90, 100)}


def test_lags_share_one_filter(monkeypatch):
    """The plain lags of all coefficients are shifts of one filtered series, not a filter each."""
    calls, plain = [], css.filtered
    monkeypatch.setattr(css, "filtered", lambda *a: calls.append(1) or plain(*a))
    y = np.random.default_rng(9).normal(size=(200, 20))
    order = css.Order(3, 1, 2)
    theta = np.full((20, order.size()), 0.1)
    errors, derivatives, _ = css.run(order, y, theta)
    assert len(calls) == 1 + order.q
    want = np.zeros((200, 20))
    z = np.diff(y, axis=0, prepend=0.0)
    for t in range(4, 200):
        want[t] = z[t] - 0.1 - 0.1 * (z[t - 1] + z[t - 2] + z[t - 3] + want[t - 1] + want[t - 2])
    np.testing.assert_allclose(errors, want[4:], atol=1e-12)
    inside = np.arange(4, 200)[:, None] < np.arange(150, 170)
    sse, gradient, products = css.sums(errors, derivatives, inside)
    e, j = np.where(inside, errors, 0), np.where(inside[:, :, None], derivatives, 0)
    np.testing.assert_allclose(sse, (e * e).sum(0))
    np.testing.assert_allclose(gradient, np.einsum("ts,tsm->sm", e, j), atol=1e-9)
    np.testing.assert_allclose(products, np.einsum("tsm,tsn->smn", j, j), atol=1e-9)
