"""Tail probabilities as Column expressions, and the same in DuckDB."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels of the continued fractions, which converge long before for the arguments that the functions pass them.
BETA_LEVELS, ERFC_LEVELS, ERF_TERMS = 400, 100, 60
_TINY = 1e-300


def _let(x: Column, f) -> Column:
    """f of x, with x evaluated once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series at x + 8, and the factors between."""

    def at(x: Column) -> Column:
        z = x + 8
        z2 = z * z
        series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / (1188 * z2)) / z2) / z2) / z2) / z
        between = sum((F.ln(x + i) for i in range(1, 8)), F.ln(x))
        return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - between

    return _let(x.cast("double"), at)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, from its first level on."""
    safe = lambda v: F.when(F.abs(v) < _TINY, F.lit(_TINY)).otherwise(v)

    def level(state: Column, i: Column) -> Column:
        m = F.floor((i + 1) / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = F.when(i % 2 == 1, even).otherwise(odd)
        return _let(
            F.struct(safe(1 + step / state["c"]).alias("c"), (1 / safe(1 + step * state["d"])).alias("d")),
            lambda n: F.struct(n["c"].alias("c"), n["d"].alias("d"), (state["h"] * n["c"] * n["d"]).alias("h")),
        )

    d = 1 / safe(1 - (a + b) * x / (a + 1))
    begin = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(2 * BETA_LEVELS)), begin, level, lambda s: s["h"])


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function I_x(a, b) for a, b > 0 and 0 <= x <= 1."""
    a, b, x = (c.cast("double") for c in (a, b, x))

    def of(v: Column) -> Column:
        a, b, x = v["a"], v["b"], v["x"]
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.log1p(-x))
        inner = F.when(x < (a + 1) / (a + b + 2), front * _beta_fraction(a, b, x) / a).otherwise(1 - front * _beta_fraction(b, a, 1 - x) / b)
        return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(inner)

    return _let(F.struct(a.alias("a"), b.alias("b"), x.alias("x")), of)


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0: a series below 2, a continued fraction from there."""

    def at(x: Column) -> Column:
        term = lambda s, i: _let(s["t"] * 2 * x * x / (2 * i.cast("double") + 1), lambda t: F.struct(t.alias("t"), (s["s"] + t).alias("s")))
        series = F.aggregate(F.sequence(F.lit(1), F.lit(ERF_TERMS)), F.struct(x.alias("t"), x.alias("s")), term, lambda s: s["s"])
        fraction = F.aggregate(F.sequence(F.lit(ERFC_LEVELS), F.lit(1), F.lit(-1)), x, lambda f, k: x + k.cast("double") / 2 / f)
        below = 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * series
        return F.when(x < 2, below).otherwise(F.exp(-x * x) / (math.sqrt(math.pi) * fraction))

    return _let(x.cast("double"), at)


def pearson_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n pairs; 1 for two pairs, null for fewer or without a correlation."""
    return F.when(n > 2, incomplete_beta((n - 2) / 2, F.lit(0.5), 1 - r * r)).when((n == 2) & r.isNotNull(), F.lit(1.0))


def rank_sum_normal_p(u: Column, n1: Column, n0: Column, tie_term: Column) -> Column:
    """Two-sided normal p of U with continuity correction; tie_term: sum of t^3 - t over ties of t values. 1 where all
    values are equal."""
    n = (n1 + n0).cast("double")
    var = n1 * n0 / 12.0 * ((n + 1) - tie_term / (n * (n - 1)))
    z = (F.abs(u - n1 * n0 / 2.0) - 0.5) / F.sqrt(var)
    return F.when((n1 == 0) | (n0 == 0), None).when(var <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), erfc(F.greatest(z, F.lit(0.0)) / math.sqrt(2))))


def erfc_sql(x: str) -> str:
    series = f"list_reduce(list_prepend({{'t': {x}, 's': {x}, 'i': 0::bigint}}, list_transform(range(1, {ERF_TERMS + 1}), lambda i: {{'t': 0.0::double, 's': 0.0::double, 'i': i}})), lambda s, e: {{'t': s.t * 2 * {x} * {x} / (2 * e.i + 1), 's': s.s + s.t * 2 * {x} * {x} / (2 * e.i + 1), 'i': e.i}}).s"
    fraction = f"list_reduce(list_prepend({x}, list_transform(range({ERFC_LEVELS}, 0, -1), lambda k: k::double)), lambda f, k: {x} + k / 2 / f)"
    return f"case when {x} < 2 then 1 - 2 / sqrt(pi()) * exp(-{x} * {x}) * {series} else exp(-{x} * {x}) / (sqrt(pi()) * {fraction}) end"


def rank_sum_normal_sql(u: str, n1: str, n0: str, ties: str) -> str:
    var = f"({n1} * {n0} / 12.0::double * (({n1} + {n0} + 1) - {ties} / (({n1} + {n0})::double * ({n1} + {n0} - 1))))"
    x = f"(greatest((abs({u} - {n1} * {n0} / 2.0::double) - 0.5::double) / sqrt({var}), 0) / sqrt(2.0::double))"
    return f"case when {var} <= 0 then 1.0::double else least(1.0::double, {erfc_sql(x)}) end"


def beta_sql(a: str, b: str, x: str) -> str:
    """I_x(a, b) in DuckDB."""

    def fraction(a: str, b: str, x: str) -> str:
        step = f"case when e.i % 2 = 1 then ((e.i + 1) // 2) * ({b} - (e.i + 1) // 2) * {x} / (({a} + 2 * ((e.i + 1) // 2) - 1) * ({a} + 2 * ((e.i + 1) // 2))) else -({a} + e.i // 2) * ({a} + {b} + e.i // 2) * {x} / (({a} + 2 * (e.i // 2)) * ({a} + 2 * (e.i // 2) + 1)) end"
        d0 = f"1 / (1 - ({a} + {b}) * {x} / ({a} + 1))"
        begin = f"{{'c': 1.0::double, 'd': {d0}, 'h': {d0}, 'i': 0::bigint}}"
        rest = f"list_transform(range(1, {2 * BETA_LEVELS + 1}), lambda i: {{'c': 0.0::double, 'd': 0.0::double, 'h': 0.0::double, 'i': i}})"
        return f"list_reduce(list_prepend({begin}, {rest}), lambda s, e: {{'c': 1 + ({step}) / s.c, 'd': 1 / (1 + ({step}) * s.d), 'h': s.h * (1 + ({step}) / s.c) / (1 + ({step}) * s.d), 'i': e.i}}).h"

    front = f"exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + {a} * ln({x}) + {b} * ln(1 - {x}))"
    return f"case when {x} <= 0 then 0.0::double when {x} >= 1 then 1.0::double when {x} < ({a} + 1) / ({a} + {b} + 2) then {front} * {fraction(a, b, x)} / {a} else 1 - {front} * {fraction(b, a, f'(1 - {x})')} / {b} end"
