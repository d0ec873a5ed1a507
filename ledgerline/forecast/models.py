"""Forecasting models as array expressions.

A model maps the dense history of one series (``values``, oldest first, and the
calendar month number of its first item) and a number of steps to an array of
forecasts. All models of all series are therefore evaluated in one projection,
with no shuffle beyond the one that built the arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators.series import month_range, month_shift

Model = Callable[[Column, int], Column]

# Grid of smoothing weights tried by the exponential smoothing models. Around its best point the search goes on in
# steps of a fifth, twice; the middle step keeps the point itself, so the error never rises.
ALPHAS = [round(0.05 * i, 2) for i in range(1, 20)]
ALPHA_STEPS = [[i * 0.01 for i in range(-4, 5)], [i * 0.002 for i in range(-4, 5)]]
HOLT_ALPHAS = [0.1, 0.3, 0.5, 0.7, 0.9]
HOLT_BETAS = [0.05, 0.1, 0.3, 0.5]
# (added to alpha, factor of beta, added to phi) of the neighbours looked at, by level
HOLT_STEPS = [[(a, b, 0.0) for a in (-0.1, 0.0, 0.1) for b in (0.7, 1.0, 1.4)], [(a, b, 0.0) for a in (-0.05, 0.0, 0.05) for b in (0.85, 1.0, 1.2)]]
DAMPED_STEPS = [[(a, b, p) for a, b, _ in level for p in (-step, 0.0, step)] for level, step in zip(HOLT_STEPS, (0.04, 0.02))]
LEAST_WEIGHT, MOST_WEIGHT = 0.001, 0.999
LEAST_PHI, MOST_PHI = 0.8, 0.98


def _within(value: Column, low: float = LEAST_WEIGHT, high: float = MOST_WEIGHT) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def _repeat(value: Column, steps: int) -> Column:
    return F.array_repeat(value, F.lit(steps))


def _last(values: Column, back: int = 1) -> Column:
    return F.get(values, F.size(values) - back)


def naive(values: Column, steps: int) -> Column:
    return _repeat(_last(values), steps)


def seasonal_naive(values: Column, steps: int, season: int = 12) -> Column:
    n = F.size(values)
    return A.steps(steps, lambda h: F.get(values, n - season + F.pmod(h - 1, F.lit(season))))


def mean(values: Column, steps: int) -> Column:
    return _repeat(A.mean(values), steps)


def _same_month_mean(values: Column, n: Column, h: Column, season: int = 12) -> Column:
    """Mean of the items that fall into the calendar month of step ``h``."""
    first = F.pmod(n + h - 1, F.lit(season))
    where = F.when(first < n, F.sequence(first, F.greatest(n - 1, first), F.lit(season)))
    return F.try_divide(A.total(F.transform(where, lambda i: F.get(values, i))), F.size(where))


def calendar_month_mean(values: Column, steps: int) -> Column:
    n = F.size(values)
    return A.steps(steps, lambda h: _same_month_mean(values, n, h))


def average_factor(values: Column, steps: int) -> Column:
    """Last year's total times its growth over the year before, spread evenly; 0 without a base."""
    recent = A.total(A.tail(values, 12))
    before = A.total(A.tail(values, 24)) - recent
    factor = F.when(before != 0, recent / before).otherwise(F.lit(0.0))
    return _repeat(factor * recent / 12.0, steps)


def seasonal_linear(values: Column, steps: int) -> Column:
    """Line through the 12-month rolling mean times the mean ratio to it per calendar month."""
    def fit(v: Column) -> Column:
        n = F.size(v)
        rolled = F.transform(A.positions(1, n - 11), lambda i: A.total(F.slice(v, i, F.lit(12))) / 12.0)
        k = F.size(rolled).cast("double")
        sum_t = k * (k - 1) / 2.0
        sum_tt = (k - 1) * k * (2 * k - 1) / 6.0
        sum_y = A.total(rolled)
        sum_ty = A.total(F.transform(rolled, lambda y, i: y * i.cast("double")))
        slope = F.try_divide(k * sum_ty - sum_t * sum_y, k * sum_tt - sum_t * sum_t)
        return F.struct(slope.alias("b"), ((sum_y - slope * sum_t) / k).alias("a"), n.alias("n"))

    def project(line: Column) -> Column:
        n = line["n"]
        ratios = F.transform(values, lambda v, i: F.try_divide(v, line["a"] + line["b"] * (i - 11)))
        return A.let(ratios, lambda q: A.steps(
            steps, lambda h: (line["a"] + line["b"] * (n - 11 + h - 1)) * _same_month_mean(q, n, h)))

    return A.let(fit(values), project)


def _refined(found: Column, closer: Callable[[Column, list], Column], level: list) -> Column:
    """The best point of ``level`` around ``found``, which is worked out once."""
    return A.let(found, lambda best: closer(best, level))


def exponential_smoothing_fit(values: Column) -> Column:
    """struct(sse, alpha, level) of the best weight: on the grid, then twice around the best so far.

    The level starts at the first value; the error is the sum of squared one-step errors.
    """
    def run(v: Column, a: Column) -> Column:
        start = F.struct(F.get(v, F.lit(0)).alias("level"), F.lit(0.0).alias("sse"))

        def step(state: Column, y: Column) -> Column:
            miss = y - state["level"]
            return F.struct((state["level"] + a * miss).alias("level"), (state["sse"] + miss * miss).alias("sse"))

        return F.aggregate(
            _after_first(v), start, step,
            lambda s: F.struct(s["sse"].alias("sse"), a.alias("alpha"), s["level"].alias("level")))

    def search(v: Column) -> Column:
        def closer(best: Column, level: list[float]) -> Column:
            near = F.transform(F.array(*[F.lit(s) for s in level]), lambda s: _within(best["alpha"] + s))
            return F.array_min(F.transform(near, lambda a: run(v, a)))

        found = F.array_min(F.transform(F.array(*[F.lit(a) for a in ALPHAS]), lambda a: run(v, a)))
        for level in ALPHA_STEPS:
            found = _refined(found, closer, level)
        return found

    return A.let(values, search)


def _after_first(values: Column) -> Column:
    return F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))


def exponential_smoothing(values: Column, steps: int) -> Column:
    return _repeat(exponential_smoothing_fit(values)["level"], steps)


def holt_fit(values: Column, phis: Iterable[float] = (1.0,)) -> Column:
    """struct(sse, alpha, beta, phi, level, trend) of the best point: on the grid, then twice around the best so far.

    The second value starts the trend. The damping is searched along if there is a choice of it.
    """
    def run(v: Column, g: Column) -> Column:
        first, second = F.get(v, F.lit(0)), F.get(v, F.lit(1))
        start = F.struct(first.alias("level"), (second - first).alias("trend"), F.lit(0.0).alias("sse"))

        def step(s: Column, y: Column) -> Column:
            carried = g["phi"] * s["trend"]
            miss = y - s["level"] - carried
            return F.struct(
                (s["level"] + carried + g["alpha"] * miss).alias("level"),
                (carried + g["alpha"] * g["beta"] * miss).alias("trend"),
                (s["sse"] + miss * miss).alias("sse"),
            )

        return F.aggregate(
            _after_first(v), start, step,
            lambda s: F.struct(
                s["sse"].alias("sse"), g["alpha"].alias("alpha"), g["beta"].alias("beta"), g["phi"].alias("phi"),
                s["level"].alias("level"), s["trend"].alias("trend")))

    phis = list(phis)
    damped = len(phis) > 1
    points = [(a, b, p) for p in phis for a in HOLT_ALPHAS for b in HOLT_BETAS]
    grid = F.transform(
        F.arrays_zip(*[F.array(*[F.lit(float(x[i])) for x in points]).alias(n) for i, n in enumerate(("alpha", "beta", "phi"))]),
        lambda g: g)

    def neighbours(best: Column, level: list[tuple[float, float, float]]) -> Column:
        steps = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip("abp", s)]) for s in level])
        phi = (lambda s: _within(best["phi"] + s["p"], LEAST_PHI, MOST_PHI)) if damped else (lambda s: best["phi"])
        return F.transform(steps, lambda s: F.struct(
            _within(best["alpha"] + s["a"]).alias("alpha"), _within(best["beta"] * s["b"]).alias("beta"), phi(s).alias("phi")))

    def search(v: Column) -> Column:
        found = F.array_min(F.transform(grid, lambda g: run(v, g)))
        for level in DAMPED_STEPS if damped else HOLT_STEPS:
            found = _refined(found, lambda best, steps: F.array_min(F.transform(neighbours(best, steps), lambda g: run(v, g))), level)
        return found

    return A.let(values, search)


def holt(values: Column, steps: int) -> Column:
    return A.let(holt_fit(values), lambda f: A.steps(steps, lambda h: f["level"] + f["trend"] * h))


def autoregressive(values: Column, steps: int) -> Column:
    """First-order autoregression without constant by conditional least squares, kept stationary."""
    n = F.size(values)
    earlier = F.slice(values, F.lit(1), F.greatest(n - 1, F.lit(0)))
    later = F.slice(values, F.lit(2), F.greatest(n - 1, F.lit(0)))
    raw = F.coalesce(F.try_divide(A.dot(earlier, later), A.dot(earlier, earlier)), F.lit(0.0))
    phi = F.greatest(F.lit(-0.999), F.least(F.lit(0.999), raw))
    return A.let(phi, lambda f: A.steps(steps, lambda h: F.pow(f, h) * _last(values)))


def double_difference(values: Column, steps: int) -> Column:
    """Straight line through the last two values."""
    step = _last(values) - _last(values, 2)
    return A.steps(steps, lambda h: _last(values) + h * step)


def quadratic_fit(values: Column) -> Column:
    """struct(c0, c1, c2, n) of a least-squares parabola; time is centred, so two sums vanish."""
    n = F.size(values).cast("double")
    mid = (n - 1) / 2.0
    moments = F.aggregate(
        F.transform(values, lambda y, i: F.struct(y.alias("y"), (i - mid).alias("u"))),
        F.struct(*[F.lit(0.0).alias(c) for c in ("u2", "u4", "y", "uy", "u2y")]),
        lambda s, r: F.struct(
            (s["u2"] + r["u"] * r["u"]).alias("u2"),
            (s["u4"] + r["u"] * r["u"] * r["u"] * r["u"]).alias("u4"),
            (s["y"] + r["y"]).alias("y"),
            (s["uy"] + r["u"] * r["y"]).alias("uy"),
            (s["u2y"] + r["u"] * r["u"] * r["y"]).alias("u2y"),
        ),
    )

    def solve(s: Column) -> Column:
        c2 = F.try_divide(n * s["u2y"] - s["u2"] * s["y"], n * s["u4"] - s["u2"] * s["u2"])
        return F.struct(
            ((s["y"] - c2 * s["u2"]) / n).alias("c0"), F.try_divide(s["uy"], s["u2"]).alias("c1"), c2.alias("c2"),
            n.alias("n"),
        )

    return A.let(moments, solve)


def quadratic_trend(values: Column, steps: int) -> Column:
    def project(f: Column) -> Column:
        def at(h: Column) -> Column:
            u = f["n"] - 1 + h - (f["n"] - 1) / 2.0
            return f["c0"] + f["c1"] * u + f["c2"] * u * u
        return A.steps(steps, at)

    return A.let(quadratic_fit(values), project)


def or_zero(model: Model) -> Model:
    """Zeros for an empty history."""
    def guarded(values: Column, steps: int) -> Column:
        return F.transform(model(values, steps), lambda x: F.coalesce(x, F.lit(0.0)))
    return guarded


# Order is the tie-break of the selection.
REGISTRY: dict[str, Model] = {
    "holt": holt,
    "sarima": autoregressive,
    "naive": naive,
    "snaive": seasonal_naive,
    "ExponentialSmoothing": exponential_smoothing,
    "SeasonalLinear": seasonal_linear,
    "SimpleExpSmoothing": exponential_smoothing,
    "mean": mean,
    "avg_factor": average_factor,
    "monthly_mean": calendar_month_mean,
}
PAIR_MODELS = ["naive", "snaive", "mean", "SimpleExpSmoothing"]
DEFAULT_MODELS = [m for m in REGISTRY if m != "monthly_mean"]


def forecast(arrays: DataFrame, keys: list[str], model: str | Model, steps: int, extra: list[str] = ()) -> DataFrame:
    """One row per (key, step) with its month and value."""
    run = or_zero(REGISTRY[model] if isinstance(model, str) else model)
    ahead = arrays.select(*keys, *extra, "last_month", run(F.col("values"), steps).alias("_f"))
    return explode_steps(ahead, keys, "_f", extra)


def explode_steps(df: DataFrame, keys: list[str], column: str, extra: list[str] = (), keep_empty: bool = False) -> DataFrame:
    """One row per step of the array; ``keep_empty`` keeps a row of nulls for a missing array."""
    # outer: the inner form adds a size filter below, which would evaluate the forecast once more
    rows = df.select(*keys, *extra, "last_month", F.posexplode_outer(column).alias("_p", "value"))
    return (rows if keep_empty else rows.where(F.col("_p").isNotNull())).select(
        *keys, *extra, (F.col("_p") + 1).alias("step"),
        month_shift("last_month", F.col("_p") + 1).alias("month"), "value",
    )
