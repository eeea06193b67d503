"""Descents over whole series: the same sums as the recursions give, fewer passes."""

import numpy as np
import pytest

from tidemark.operators import css

ORDERS = [css.Order(*o) for o in ((0, 0, 0), (3, 1, 2), (0, 1, 1), (2, 0, 0), (1, 0, 1, 1, 1, 6, 1), (2, 1, 0, 1, 0, 12, 1), (0, 0, 2, 2, 0, 5, 2))]


def _theta(order, count, rng):
    return css.shrunk(order, rng.uniform(-0.6, 0.6, (count, order.size())))


@pytest.mark.parametrize("order", ORDERS)
def test_sums_of_whole_series(order):
    rng = np.random.default_rng(3)
    length = np.array([90, 120, 71, 120, 100])
    y = np.where(np.arange(120)[:, None] < length, rng.normal(size=(120, 5)), 0.0)
    theta, base = _theta(order, 5, rng), css.differenced(order, y)
    errors, derivatives, _ = css.run(order, y, theta)
    np.testing.assert_allclose(css.errors_of(order, base, theta), errors, atol=1e-10)
    inside = (order.reach() + np.arange(len(errors)))[:, None] < length
    for got, want in zip(css.slopes(order, base, theta, length), css.sums(errors, derivatives, inside)):
        np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-8)
    np.testing.assert_allclose(css.squares(errors, order, length), css.sums(errors, derivatives, inside)[0], rtol=1e-12)


def test_stability_is_that_of_the_roots():
    rng = np.random.default_rng(4)
    for n in (3, 4, 6):
        polys = np.concatenate([np.ones((300, 1)), rng.normal(size=(300, n)) * 0.5], axis=1)
        largest = np.array([np.abs(np.roots(p)).max() for p in polys])
        got = css.stable_polynomials(polys)
        assert got.any() and not got.all()
        assert (got == (largest < css.STABLE)).all()


def test_regressions_take_one_pass(monkeypatch):
    rng = np.random.default_rng(5)
    order, y = css.Order(2, 0, 0), rng.normal(size=(200, 4))
    x = [np.column_stack([np.ones(198), y[1:-1, s], y[:-2, s]]) for s in range(4)]
    start = np.array([np.linalg.lstsq(x[s], y[2:, s], rcond=None)[0] for s in range(4)])
    calls, driven = [], css._driven
    monkeypatch.setattr(css, "_driven", lambda *a, **k: calls.append(1) or driven(*a, **k))
    found = css.minimise(order, y, np.full(4, 200), [start], 6)
    assert len(calls) == 1
    np.testing.assert_allclose(found.theta, start)
