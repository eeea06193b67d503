"""Conditional sums of squares of seasonal ARIMA models, for many series at once.

The errors of a model are a recursion: e[t] = w[t] - b[1] e[t-1] - …, where w is
the product of the plain, seasonal and differencing polynomials applied to the
series, and b the product of the plain and seasonal moving averages. They start
with zeros where the first w exists. The derivatives follow recursions with the
same b, so sums of their products give damped Gauss–Newton steps. Everything is
linear in the state before the first reading: a long series is run piece by
piece, each from the state the pieces before it lead to.

Arrays are (time, series, …); coefficients are (series, parameter) in the order
constant, plain and seasonal autoregression, plain and seasonal moving average.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

STABLE = 0.999
BLOCK = 64
MAX_DAMPING = 1e9
ROUNDING = 1e-16
GOING = 0.7


@dataclass(frozen=True)
class Order:
    p: int
    d: int
    q: int
    sp: int = 0
    sd: int = 0
    period: int = 0
    sq: int = 0

    def difference(self) -> np.ndarray:
        poly = np.ones(1)
        for _ in range(self.d):
            poly = np.convolve(poly, [1.0, -1.0])
        for _ in range(self.sd):
            poly = np.convolve(poly, [1.0] + [0.0] * (self.period - 1) + [-1.0])
        return poly

    def ar_lags(self) -> list[int]:
        return list(range(1, self.p + 1)) + [self.period * i for i in range(1, self.sp + 1)]

    def ma_lags(self) -> list[int]:
        return list(range(1, self.q + 1)) + [self.period * i for i in range(1, self.sq + 1)]

    def reach(self) -> int:
        """How many readings the first error needs before it."""
        return len(self.difference()) - 1 + self.p + self.period * self.sp

    def memory(self) -> int:
        """How many errors the next one needs."""
        return self.q + self.period * self.sq

    def size(self) -> int:
        return 1 + self.p + self.sp + self.q + self.sq

    def linear(self) -> bool:
        """Whether the errors are linear in the coefficients, so that one regression fits them."""
        return not self.q and not self.sq and not (self.p and self.sp)

    def parts(self, theta: np.ndarray) -> tuple[np.ndarray, ...]:
        """Polynomials of the four kinds of coefficients: phi, seasonal phi, theta, seasonal theta."""
        ends = np.cumsum([1, self.p, self.sp, self.q, self.sq])
        steps, signs = (1, self.period, 1, self.period), (-1.0, -1.0, 1.0, 1.0)
        return tuple(_poly(theta[:, a:b], step, sign) for a, b, step, sign in zip(ends[:-1], ends[1:], steps, signs))

    def polynomials(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Full autoregression, differences included, and full moving average."""
        phi, seasonal_phi, ma, seasonal_ma = self.parts(theta)
        delta = np.broadcast_to(self.difference(), (len(theta), len(self.difference())))
        return _times(_times(phi, seasonal_phi), delta), _times(ma, seasonal_ma)


def _poly(coefs: np.ndarray, step: int, sign: float) -> np.ndarray:
    out = np.zeros((len(coefs), coefs.shape[1] * step + 1))
    out[:, 0] = 1.0
    out[:, step::step or 1][:, :coefs.shape[1]] = sign * coefs
    return out


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), a.shape[1] + b.shape[1] - 1))
    for i in range(b.shape[1]):
        out[:, i:i + a.shape[1]] += a * b[:, i:i + 1]
    return out


def stable_polynomials(polys: np.ndarray) -> np.ndarray:
    """Per row 1 + c1 z + …: whether every root lies outside the unit circle."""
    n = polys.shape[1] - 1
    ok = np.isfinite(polys).all(1)
    if n == 0 or not ok.any():
        return ok
    if n <= 2:
        ok[ok] = _largest_root(polys[ok]) < STABLE
        return ok
    ok[ok] = _inside(polys[ok, 1:] / STABLE ** np.arange(1, n + 1))
    return ok


def _inside(coefs: np.ndarray) -> np.ndarray:
    """Whether all inverse roots of 1 + c1 z + … have a modulus below one, by stepping down to reflection coefficients."""
    ok = np.ones(len(coefs), bool)
    while coefs.shape[1]:
        last = coefs[:, -1:]
        ok &= np.abs(last[:, 0]) < 1.0
        last = np.where(ok[:, None], last, 0.0)
        coefs = (coefs[:, :-1] - last * coefs[:, -2::-1]) / (1.0 - last ** 2)
    return ok


def _largest_root(polys: np.ndarray) -> np.ndarray:
    """Largest modulus of the inverse roots of 1 + c1 z or 1 + c1 z + c2 z^2."""
    half = np.abs(polys[:, 1])
    if polys.shape[1] == 2:
        return half
    half, c2 = half / 2, polys[:, 2]
    inner = half ** 2 - c2
    return np.where(inner < 0, np.sqrt(np.abs(c2)), half + np.sqrt(np.maximum(inner, 0.0)))


def stable(order: Order, theta: np.ndarray) -> np.ndarray:
    """Whether all four polynomials of each row are stable; seasonal ones in powers of the period."""
    ok = np.isfinite(theta).all(1)
    for poly, step in zip(order.parts(theta), (1, order.period or 1, 1, order.period or 1)):
        ok &= stable_polynomials(poly[:, ::step])
    return ok


# ---- recursions -------------------------------------------------------------------------------------

def filtered(x: np.ndarray, poly: np.ndarray, first: int) -> np.ndarray:
    """Polynomial of the shift applied to each series, for times from ``first`` on."""
    lags = [lag for lag in range(poly.shape[1]) if poly[:, lag].any()]
    if not lags:
        return np.zeros((len(x) - first, x.shape[1]))
    out = poly[:, lags[0]] * x[first - lags[0]:len(x) - lags[0]]
    for lag in lags[1:]:
        out += poly[:, lag] * x[first - lag:len(x) - lag]
    return out


def recursion(x: np.ndarray, ma: np.ndarray, state: np.ndarray) -> np.ndarray:
    """y[t] = x[t] - ma[1] y[t-1] - …, after the rows of ``state`` (earliest first), which lead the result."""
    memory = len(state)
    out = np.concatenate([state, np.zeros_like(x)])
    lags = [j for j in range(1, ma.shape[1]) if ma[:, j].any()]
    if not lags:
        out[memory:] = x
        return out
    if _few(x.shape[1], x.shape[2], len(x)):
        for s in range(x.shape[1]):
            out[:, s] = _in_blocks(x[:, s], ma[s], state[:, s])
        return out
    steps = np.ascontiguousarray(np.concatenate([state, x]).transpose(0, 2, 1))
    _step(steps, ma, memory)
    return steps.transpose(0, 2, 1)


def _few(series: int, columns: int, times: int) -> bool:
    """Whether blocks of times are cheaper than single steps."""
    return series * columns < 256 and times > 16 * BLOCK


def _step(out: np.ndarray, ma: np.ndarray, memory: int, again: bool = False) -> None:
    """The recursion in place, by steps; rows from ``memory`` on hold what drives it.

    ``out`` is (time, column, series), so that a step runs along the series. With
    ``again`` the last column is driven by the negative of the first besides.
    """
    weights = [(j, np.ascontiguousarray(ma[:, j])) for j in range(1, ma.shape[1]) if ma[:, j].any()]
    part = np.empty(out.shape[1:])
    for t in range(memory, len(out)):
        row = out[t]
        for j, weight in weights:
            np.multiply(out[t - j], weight, out=part)
            np.subtract(row, part, out=row)
        if again:
            row[-1] -= row[0]


def _in_blocks(x: np.ndarray, ma: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The recursion of one series, block by block: responses to a block's input and to the state before it."""
    memory, size = len(state), max(BLOCK, len(state))
    impulse = np.zeros(size)
    for t in range(size):
        impulse[t] = (t == 0) - ma[1:t + 1] @ impulse[max(0, t - len(ma) + 1):t][::-1][:len(ma) - 1] if t else 1.0
    places = np.subtract.outer(np.arange(size), np.arange(size))
    own = np.where(places >= 0, impulse[places], 0.0)
    # What the state adds to the first inputs, then as any input.
    carried = np.zeros((size, memory))
    for i in range(memory):
        for j in range(memory - i, len(ma)):
            if j - (memory - i) < size:
                carried[j - (memory - i), i] -= ma[j]
    carried = own @ carried
    blocks = -(-len(x) // size)
    padded = np.zeros((blocks * size, x.shape[1]))
    padded[:len(x)] = x
    parts = own @ padded.reshape(blocks, size, x.shape[1])
    for b in range(blocks):
        parts[b] += carried @ state
        state = parts[b][size - memory:]
    return np.concatenate([np.zeros((memory, x.shape[1])), parts.reshape(-1, x.shape[1])[:len(x)]])


def inputs(order: Order, y: np.ndarray, theta: np.ndarray, out: np.ndarray) -> None:
    """What drives the error and its derivatives by the constant and the autoregressions, from ``reach`` on.

    They go into the first columns of ``out`` (time, column, series).
    """
    phi, seasonal_phi, *_ = order.parts(theta)
    delta = np.broadcast_to(order.difference(), (len(theta), len(order.difference())))
    # One filter for all plain lags and one for all seasonal ones: their columns are its shifts.
    plain = filtered(y, _times(seasonal_phi, delta), order.reach() - order.p)
    times = len(plain) - order.p
    error = out[:, 0]
    np.subtract(plain[order.p:], theta[:, 0], out=error)
    out[:, 1] = -1.0
    for i in range(1, order.p + 1):
        moved = plain[order.p - i:][:times]
        error += phi[:, i] * moved
        np.negative(moved, out=out[:, 1 + i])
    if order.sp:
        span = order.period * order.sp
        seasonal = filtered(y, _times(phi, delta), order.reach() - span)
        for i in range(1, order.sp + 1):
            np.negative(seasonal[span - i * order.period:][:times], out=out[:, 1 + order.p + i])


def _moved(poly: np.ndarray, lag: int) -> np.ndarray:
    return np.concatenate([np.zeros((len(poly), lag)), poly], axis=1)


def run(order: Order, y: np.ndarray, theta: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(errors, derivatives, last state) over the times from ``reach`` on.

    The state holds the last ``memory`` rows of the error, its derivatives by
    the constant and autoregressions, and of the filtered error from which
    those by the moving averages follow.
    """
    _, ma = order.polynomials(theta)
    memory, width, times = order.memory(), 2 + order.p + order.sp, len(y) - order.reach()
    whole = np.zeros((memory + times, width + 1, y.shape[1]))
    if state is not None:
        whole[:memory] = state.transpose(0, 2, 1)
    inputs(order, y, theta, whole[memory:])
    if memory and _few(y.shape[1], width, times):
        driven = recursion(whole[memory:, :width].transpose(0, 2, 1), ma, whole[:memory, :width].transpose(0, 2, 1))
        again = recursion(-driven[memory:, :, :1], ma, whole[:memory, width:].transpose(0, 2, 1))
        whole = np.concatenate([driven, again], axis=2).transpose(0, 2, 1)
    elif memory:
        _step(whole, ma, memory, again=True)
    else:
        np.negative(whole[:, 0], out=whole[:, width])
    *_, plain, seasonal = order.parts(theta)
    steps = [(i, seasonal) for i in range(1, order.q + 1)] + [(i * order.period, plain) for i in range(1, order.sq + 1)]
    derivatives = np.empty((times, order.size(), y.shape[1]))
    derivatives[:, :width - 1] = whole[memory:, 1:width]
    for column, (lag, other) in enumerate(steps, start=width - 1):
        derivatives[:, column] = filtered(whole[:, width], _moved(other, lag), memory)
    return whole[memory:, 0], derivatives.transpose(0, 2, 1), whole[len(whole) - memory:].transpose(0, 2, 1)


def carry(order: Order, theta: np.ndarray, rows: int, state: np.ndarray) -> np.ndarray:
    """Where ``rows`` steps without input lead a state of one series."""
    memory = order.memory()
    if not memory:
        return state
    _, ma = order.polynomials(theta[None])
    step = np.zeros((memory, memory))  # earliest row first
    step[np.arange(memory - 1), np.arange(1, memory)] = 1.0
    step[-1] = -ma[0, :0:-1]
    both = np.zeros((2 * memory, 2 * memory))
    both[:memory, :memory] = both[memory:, memory:] = step
    both[-1, :memory] = -step[-1]  # the filtered error is driven by the error's negative
    power = np.linalg.matrix_power(both, rows)
    out = np.einsum("ij,jc->ic", power[:memory, :memory], state)
    out[:, -1] += power[memory:, :memory] @ state[:, 0]
    return out


def sums(errors: np.ndarray, derivatives: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sum of squares, its half gradient, products of derivatives) of each series over the times ``inside``."""
    inside = np.broadcast_to(inside, errors.shape)
    outside = np.flatnonzero(~inside.all(1))
    cut = int(outside[0]) if len(outside) else len(errors)
    total = _sums(errors[:cut], derivatives[:cut])
    if cut == len(errors):
        return total
    rest = inside[cut:]
    tail = _sums(np.where(rest, errors[cut:], 0.0), np.where(rest[:, :, None], derivatives[cut:], 0.0))
    return tuple(a + b for a, b in zip(total, tail))


def _sums(e: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if e.shape[1] < 16:
        j = np.ascontiguousarray(d.transpose(1, 0, 2))
        return np.einsum("ts,ts->s", e, e), np.einsum("ts,stm->sm", e, j), j.transpose(0, 2, 1) @ j
    size = d.shape[2]
    gradient, products = np.empty((e.shape[1], size)), np.empty((e.shape[1], size, size))
    for a in range(size):
        gradient[:, a] = np.einsum("ts,ts->s", e, d[:, :, a])
        for b in range(a + 1):
            products[:, a, b] = products[:, b, a] = np.einsum("ts,ts->s", d[:, :, a], d[:, :, b])
    return np.einsum("ts,ts->s", e, e), gradient, products


# ---- whole series -----------------------------------------------------------------------------------

def differenced(order: Order, y: np.ndarray) -> np.ndarray:
    """The series under the differences of an order, which no coefficient changes."""
    delta = order.difference()
    return filtered(y, np.broadcast_to(delta, (y.shape[1], len(delta))), len(delta) - 1)


def _driven(order: Order, base: np.ndarray, theta: np.ndarray, slopes: bool) -> np.ndarray:
    """Errors and, negated, what their derivatives are made of, of whole series: (time, column, series).

    The first ``memory`` rows are zeros. Columns are the error and, with ``slopes``, its derivatives by
    the constant and the autoregressions, and the error under the inverse of the plain and of the seasonal
    moving average: the lags of those are the derivatives by the coefficients of each.
    """
    phi, seasonal_phi, ma, seasonal_ma = order.parts(theta)
    memory, span = order.memory(), order.period * order.sp
    times = max(len(base) - order.p - span, 0)
    linear = 2 + order.p + order.sp if slopes else 1
    out = np.zeros((memory + times, linear + ((order.q > 0) + (order.sq > 0)) * slopes, base.shape[1]))
    if not times:
        return out
    own = out[memory:]
    plain = base
    if order.sp:
        plain = base[span:].copy()
        for i in range(1, order.sp + 1):
            plain += seasonal_phi[:, i * order.period] * base[span - i * order.period:][:len(plain)]
    np.subtract(plain[order.p:], theta[:, 0], out=own[:, 0])
    for i in range(1, order.p + 1):
        own[:, 0] += phi[:, i] * plain[order.p - i:][:times]
    if slopes:
        own[:, 1] = 1.0
        for i in range(1, order.p + 1):
            own[:, 1 + i] = plain[order.p - i:][:times]
        if order.sp:
            seasonal = base[order.p:].copy()
            for i in range(1, order.p + 1):
                seasonal += phi[:, i] * base[order.p - i:][:len(seasonal)]
            for i in range(1, order.sp + 1):
                own[:, 1 + order.p + i] = seasonal[span - i * order.period:][:times]
    if order.sq:
        _seasonal_steps(out[:, :linear], seasonal_ma, memory, order.period)
    if order.q:
        _plain_steps(out[:, :linear + 1] if slopes else out, ma, memory, slopes)
    if order.sq and slopes:
        own[:, -1] = own[:, 0]
        _seasonal_steps(out[:, -1:], seasonal_ma, memory, order.period)
    return out


def _seasonal_steps(out: np.ndarray, poly: np.ndarray, memory: int, period: int) -> None:
    """The recursion of a seasonal moving average in place, a period at a time."""
    lags = range(period, poly.shape[1], period)
    weights = [np.ascontiguousarray(poly[:, lag]) for lag in lags]
    for at in range(memory, len(out), period):
        block = out[at:at + period]
        for lag, weight in zip(lags, weights):
            block -= weight * out[at - lag:at - lag + len(block)]


def _plain_steps(out: np.ndarray, poly: np.ndarray, memory: int, again: bool) -> None:
    """The recursion of a plain moving average in place; with ``again`` the last column is driven by the first."""
    weights = [(lag, np.ascontiguousarray(poly[:, lag])) for lag in range(1, poly.shape[1])]
    rows, part = list(out), np.empty(out.shape[1:])
    multiply, subtract, add = np.multiply, np.subtract, np.add
    firsts, lasts = (list(out[:, 0]), list(out[:, -1])) if again else ([], [])
    for t in range(memory, len(out)):
        row = rows[t]
        for lag, weight in weights:
            multiply(rows[t - lag], weight, part)
            subtract(row, part, row)
        if again:
            add(lasts[t], firsts[t], lasts[t])


def errors_of(order: Order, base: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Errors of whole series from their differences, over the times from ``reach`` on."""
    return _driven(order, base, theta, slopes=False)[order.memory():, 0]


def slopes(order: Order, base: np.ndarray, theta: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``sums`` of whole series over their first ``length`` readings, derivatives read as lags of what they are made of."""
    out, memory, linear = _driven(order, base, theta, slopes=True), order.memory(), 2 + order.p + order.sp
    moved = [out[memory:, k] for k in range(linear)]
    moved += [out[memory - j:len(out) - j, linear] for j in range(1, order.q + 1)]
    moved += [out[memory - i * order.period:len(out) - i * order.period, -1] for i in range(1, order.sq + 1)]
    cut = _common(order, len(moved[0]), length)
    products = _products([m[:cut] for m in moved])
    if cut < len(moved[0]):
        inside = _inside_length(order, cut, len(moved[0]), length)
        products += _products([np.where(inside, m[cut:], 0.0) for m in moved])
    return products[:, 0, 0], -products[:, 0, 1:], products[:, 1:, 1:]


def _common(order: Order, times: int, length: np.ndarray) -> int:
    """How many errors lie within the readings of every series."""
    return max(0, min(int(length.min()) - order.reach(), times))


def _inside_length(order: Order, start: int, end: int, length: np.ndarray) -> np.ndarray:
    return order.reach() + np.arange(start, end)[:, None] < length


def _products(columns: list[np.ndarray]) -> np.ndarray:
    out = np.empty((columns[0].shape[1], len(columns), len(columns)))
    for a in range(len(columns)):
        for b in range(a + 1):
            out[:, a, b] = out[:, b, a] = np.einsum("ts,ts->s", columns[a], columns[b])
    return out


def squares(errors: np.ndarray, order: Order, length: np.ndarray) -> np.ndarray:
    """Sum of squares of each series over its first ``length`` readings."""
    cut = _common(order, len(errors), length)
    rest = np.where(_inside_length(order, cut, len(errors), length), errors[cut:], 0.0)
    return np.einsum("ts,ts->s", errors[:cut], errors[:cut]) + np.einsum("ts,ts->s", rest, rest)


# ---- descent ----------------------------------------------------------------------------------------

@dataclass
class Descent:
    """Damped Gauss–Newton for many fits of one order: only steps that lower the sum of squares stay."""

    order: Order
    trial: np.ndarray
    theta: np.ndarray = field(init=False)
    sse: np.ndarray = field(init=False)
    gradient: np.ndarray = field(init=False)
    products: np.ndarray = field(init=False)
    damping: np.ndarray = field(init=False)
    gain: np.ndarray = field(init=False)

    def __post_init__(self):
        count, size = self.trial.shape
        self.theta, self.sse = self.trial.copy(), np.full(count, np.inf)
        self.gradient, self.products = np.zeros((count, size)), np.zeros((count, size, size))
        self.damping, self.gain = np.full(count, 1e-3), np.full(count, np.inf)

    def where(self, kept: np.ndarray) -> Descent:
        """The descents of some fits."""
        out = Descent(self.order, self.trial[kept])
        for name in ("theta", "sse", "gradient", "products", "damping", "gain"):
            setattr(out, name, getattr(self, name)[kept])
        return out

    def learn(self, sse: np.ndarray, gradient: np.ndarray, products: np.ndarray) -> None:
        """Take the trial's sums; where it is no better the next one is shorter."""
        finite = np.isfinite(sse) & np.isfinite(gradient).all(1) & np.isfinite(products).all((1, 2))
        better = finite & (sse < self.sse)
        self.damping = np.where(better, np.maximum(self.damping * 0.1, 1e-12), np.minimum(self.damping * 10, MAX_DAMPING))
        self.theta[better], self.sse[better] = self.trial[better], sse[better]
        self.gradient[better], self.products[better] = gradient[better], products[better]

    def learn_last(self, sse: np.ndarray) -> None:
        """Take the sum of squares of a trial that no step follows."""
        better = np.isfinite(sse) & (sse < self.sse)
        self.theta[better], self.sse[better] = self.trial[better], sse[better]

    def propose(self) -> np.ndarray:
        """Next trial: the damped step, halved until it is stable; ``gain`` is what the whole step promises."""
        size = self.theta.shape[1]
        scale = np.einsum("smm->sm", self.products)
        scale = np.maximum(scale, 1e-12 * np.maximum(scale.max(1, keepdims=True), 1e-300))
        left = self.products + (self.damping[:, None] * scale + 1e-14 * scale)[:, :, None] * np.eye(size)
        root = np.sqrt(scale)
        step = -np.linalg.solve(left / root[:, :, None] / root[:, None], (self.gradient / root)[:, :, None])[:, :, 0] / root
        step[~np.isfinite(step).all(1)] = 0.0
        self.gain = -np.einsum("sm,sm->s", self.gradient, step)
        bad = np.flatnonzero(~stable(self.order, self.theta + step))
        for _ in range(12):
            if not len(bad):
                break
            step[bad] *= 0.5
            bad = bad[~stable(self.order, self.theta[bad] + step[bad])]
        step[bad] = 0.0
        self.trial = self.theta + step
        return self.trial


def shrunk(order: Order, theta: np.ndarray) -> np.ndarray:
    """Starting values drawn towards zero until they are stable."""
    out = theta.copy()
    for _ in range(20):
        bad = np.isfinite(out).all(1) & ~stable(order, out)
        if not bad.any():
            break
        out[bad, 1:] *= 0.8
    return out


def minimise(order: Order, y: np.ndarray, length: np.ndarray, starts: list[np.ndarray], passes: int) -> Descent:
    """Least conditional sum of squares of each series (time, series) over its first ``length`` readings.

    Every start is evaluated, the best goes on. A fit whose next step promises less than
    the rounding of its sum of squares is at its end and takes no part in further passes.
    """
    y = y[:max(int(length.max()), order.reach())]
    base = differenced(order, y)
    whole, here = Descent(order, starts[0]), np.arange(len(length))
    descent, last = whole, passes + len(starts) - 2
    for i in range(last + 1):
        if i < last:
            descent.learn(*slopes(order, base, descent.trial, length))
        else:
            descent.learn_last(squares(errors_of(order, base, descent.trial), order, length))
        if i + 1 < len(starts):
            descent.trial = starts[i + 1]
            continue
        if i < last:
            descent.propose()
        going = descent.gain > ROUNDING * descent.sse
        if i == last or not going.any() or going.mean() < GOING:
            whole.theta[here], whole.sse[here] = descent.theta, descent.sse
            if i == last or not going.any():
                break
            descent, here, base, length = descent.where(going), here[going], np.ascontiguousarray(base[:, going]), length[going]
    return whole
