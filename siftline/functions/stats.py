"""Proportion statistics as native SQL expressions.

Arguments are SQL operands (column names or literals), so each statistic is one
parsed expression. Binomial tails are summed outward from the observed count, where
terms shrink monotonically, so the work grows with the square root of the count.
Point probabilities use the saddle-point form (Loader 2000), accurate for large trials.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WILSON_Z = 1.96
ONE_SIDED_ALPHA = 0.05
NEWTON_STEPS = 12


def _num(value: float) -> str:
    return f"{value!r}D"


def _let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once inside ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _clamp(value: str) -> str:
    return f"greatest(0D, least(1D, {value}))"


def fraction(k: str, n: str) -> Column:
    return F.expr(f"CASE WHEN {n} > 0 THEN {k} / {n} ELSE 0D END")


def wilson_bounds(k: str, n: str) -> tuple[Column, Column]:
    """Wilson 95 % interval, clamped to [0, 1]; [0, 0] without trials."""
    z2 = _num(WILSON_Z * WILSON_Z)
    p = f"(least({k}, {n}) / {n})"
    center = f"({p} + {z2} / (2D * {n}))"
    half = f"{_num(WILSON_Z)} * sqrt({p} * (1D - {p}) / {n} + {z2} / (4D * {n} * {n}))"
    bound = lambda sign: F.expr(
        f"CASE WHEN {n} > 0 THEN {_clamp(f'({center} {sign} {half}) / (1D + {z2} / {n})')} ELSE 0D END"
    )
    return bound("-"), bound("+")


def bonferroni(alpha: float, family: str, looks: str) -> Column:
    return F.expr(f"{_num(min(max(alpha, 0.0), 1.0))} / (greatest({family}, 1) * greatest({looks}, 1))")


def _stirling_error(x: str) -> str:
    """log(x!) minus Stirling's approximation; exact factorials below 16."""
    small = f"ln(factorial(CAST(least({x}, 15D) AS INT))) - ({x} + 0.5D) * ln({x}) + {x} - {_num(0.5 * math.log(2 * math.pi))}"
    series = f"(1D / 12 - (1D / 360 - (1D / 1260 - 1D / 1680 / ({x} * {x})) / ({x} * {x})) / ({x} * {x})) / {x}"
    return f"(CASE WHEN {x} < 16 THEN {small} ELSE {series} END)"


def _deviance(x: str, mean: str) -> str:
    return f"({x} * ln({x} / ({mean})) + ({mean}) - {x})"


def _log_pmf(k: str, n: str, p: str) -> str:
    """Operands are doubles."""
    body = (
        f"{_stirling_error(n)} - {_stirling_error(k)} - {_stirling_error(f'({n} - {k})')} "
        f"- {_deviance(k, f'{n} * {p}')} - {_deviance(f'({n} - {k})', f'{n} * (1D - {p})')} "
        f"+ 0.5D * ln({n} / ({_num(2 * math.pi)} * {k} * ({n} - {k})))"
    )
    return f"(CASE WHEN {k} <= 0 THEN {n} * log1p(-{p}) WHEN {k} >= {n} THEN {n} * ln({p}) ELSE {body} END)"


def _tail_terms(k: str) -> str:
    # Nine standard deviations beyond the count: what is left is below 1e-17 of the first term.
    return f"(9D * sqrt({k} + 1D) + 50D)"


def _relative_tail(limit: str, ratio: str) -> str:
    """1 + r(1) + r(1) r(2) + ... for ``limit`` further terms; ``ratio`` is over ``j``."""
    steps = f"IF({limit} >= 1, sequence(1, CAST(greatest({limit}, 1D) AS INT)), CAST(array() AS ARRAY<INT>))"
    return (
        f"aggregate({steps}, named_struct('t', 1D, 's', 0D), "
        f"(a, j) -> named_struct('t', a.t * ({ratio}), 's', a.s + a.t), a -> a.s + a.t)"
    )


def _lower_factor(k: str, n: str, p: str) -> str:
    """P(X <= k) / P(X = k), for k at or below the mean."""
    return _relative_tail(
        f"least({k}, {_tail_terms(k)})", f"({k} - j + 1D) / ({n} - {k} + j) * ((1D - {p}) / {p})"
    )


def _upper_factor(k: str, n: str, p: str) -> str:
    """P(X >= k) / P(X = k), for k above the mean."""
    return _relative_tail(
        f"least({n} - {k}, {_tail_terms(k)})", f"({n} - {k} - j + 1D) / ({k} + j) * ({p} / (1D - {p}))"
    )


def binomial_survival(k: str, n: str, p: float) -> Column:
    """P(X >= k) for X ~ Binomial(n, p)."""
    p = min(max(p, 0.0), 1.0)
    if p in (0.0, 1.0):
        return F.expr(f"CASE WHEN {k} <= 0 THEN 1D WHEN {n} <= 0 OR {k} > {n} THEN 0D ELSE {_num(p)} END")
    kd, nd, low, q = f"CAST({k} AS DOUBLE)", f"CAST({n} AS DOUBLE)", f"(CAST({k} AS DOUBLE) - 1D)", _num(p)
    upper = f"exp({_log_pmf(kd, nd, q)}) * {_upper_factor(kd, nd, q)}"
    lower = f"1D - exp({_log_pmf(low, nd, q)}) * {_lower_factor(low, nd, q)}"
    return F.expr(
        f"CASE WHEN {k} <= 0 THEN 1D WHEN {n} <= 0 OR {k} > {n} THEN 0D "
        f"WHEN {k} > {n} * {q} THEN {_clamp(upper)} ELSE {_clamp(lower)} END"
    )


def clopper_pearson_upper(k: str, n: str) -> Column:
    """One-sided 95 % upper bound: the p at which P(X <= k) falls to 5 %.

    The log of that tail is concave and decreasing in p, so Newton's method
    approaches the root from the right after one step and cannot diverge. A settled
    estimate skips the tail sum.
    """
    kd, nd = f"CAST(least({k}, {n}) AS DOUBLE)", f"CAST({n} AS DOUBLE)"
    z, z2 = _num(1.645), _num(1.645 * 1.645)
    start = f"(v.k + {z2} / 2 + {z} * sqrt(v.k * (v.n - v.k) / v.n + {z2} / 4)) / (v.n + {z2})"
    start = f"least(greatest({start}, (v.k + 0.5D) / v.n), 1D - 0.5D * (v.n - v.k) / (v.n + 1D) / (v.n + 1D))"
    # d/dp log P(X <= k) = -(n - k) P(X = k) / ((1 - p) P(X <= k)).
    excess = f"{_log_pmf('v.k', 'v.n', 'e.p')} + ln(f) - {_num(math.log(ONE_SIDED_ALPHA))}"
    target = "e.p + x * (1D - e.p) * f / (v.n - v.k)"
    moved = f"named_struct('p', greatest(v.k / v.n, least({target}, (1D + e.p) / 2D)), 'done', abs(x) < 1e-13D)"
    step = _let("f", _lower_factor("v.k", "v.n", "e.p"), _let("x", excess, moved))
    root = (
        f"aggregate(sequence(1, {NEWTON_STEPS}), named_struct('p', {start}, 'done', false), "
        f"(e, i) -> IF(e.done, e, {step}), e -> e.p)"
    )
    bound = _let("v", f"named_struct('k', {kd}, 'n', {nd})", root)
    return F.expr(
        f"CASE WHEN {n} <= 0 THEN 0D WHEN {k} <= 0 THEN {_clamp(f'1D - pow({_num(ONE_SIDED_ALPHA)}, 1D / {n})')} "
        f"WHEN {k} >= {n} THEN 1D ELSE {_clamp(bound)} END"
    )
