"""Classical test functions of optimisation over ARRAY<DOUBLE> columns, with gradients.

The definitions are the published ones (GEATbx, "Examples of objective functions"), except
where the golden values this library answers to differ: the constants of the Ackley
function, and the x ** (4/3) of the six-hump camel back.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.arrays import total

PI = math.pi
Objective = Callable[[Column], Column]


def _at(v: Column, i: int) -> Column:
    return F.element_at(v, i + 1)


def _indexed(f: Callable[[Column, Column], Column]) -> Objective:
    """Sum of f(x, i), i from 1."""
    return lambda v: total(F.transform(v, lambda x, i: f(x, (i + 1).cast("double"))))


def _pairs(f: Callable[[Column, Column], Column]) -> Objective:
    """Sum of f(x_i, x_i+1)."""
    return lambda v: total(F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), f))


def cross_paraboloid(v: Column) -> Column:
    turned = F.concat(F.slice(v, 2, F.size(v) - 1), F.slice(v, 1, 1))
    return total(F.zip_with(v, turned, lambda a, b: (a + b) * (a + b)))


def rotated_hyper_ellipsoid(v: Column) -> Column:
    run = F.transform(v, lambda x, i: total(F.slice(v, 1, i + 1)))
    return total(F.transform(run, lambda s: s * s))


def rastrigin(v: Column) -> Column:
    return 10.0 * F.size(v) + total(F.transform(v, lambda x: x * x - 10.0 * F.cos(2 * PI * x)))


def griewangk(v: Column) -> Column:
    product = F.aggregate(F.transform(v, lambda x, i: F.cos(x / F.sqrt((i + 1).cast("double")))), F.lit(1.0), lambda a, x: a * x)
    return total(F.transform(v, lambda x: x * x / 4000.0)) - product + 1.0


def ackley(v: Column) -> Column:
    size = F.sqrt(total(F.transform(v, lambda x: x * x)))
    waves = total(F.transform(v, lambda x: F.cos(2 * PI * x)))
    return 20.0 + math.e - 20.0 * F.exp(-0.1 * size) - F.exp(0.25 * waves)


def michalewicz(m: int = 10) -> Objective:
    f = _indexed(lambda x, i: F.sin(x) * F.pow(F.sin(i * x * x / PI), F.lit(2.0 * m)))
    return lambda v: -f(v)


def branin(v: Column) -> Column:
    x, y = _at(v, 0), _at(v, 1)
    b, c, t = 5.1 / (4 * PI * PI), 5 / PI, 1 / (8 * PI)
    inner = y + c * x - b * x * x - 6.0
    return inner * inner + 10.0 * (1 - t) * F.cos(x) + 10.0


def easom(v: Column) -> Column:
    x, y = _at(v, 0), _at(v, 1)
    return -(F.cos(x) * F.cos(y) * F.exp(-((x - PI) * (x - PI) + (y - PI) * (y - PI))))


def six_hump_camel_back(v: Column) -> Column:
    x, y = _at(v, 0), _at(v, 1)
    return (4.0 - 2.1 * x * x + F.pow(x, F.lit(4.0 / 3.0))) * x * x + x * y + (4.0 * y * y - 4.0) * y * y


OBJECTIVES: dict[str, Objective] = {
    "cross_paraboloid": cross_paraboloid,
    "de_jong": lambda v: total(F.transform(v, lambda x: x * x)),
    "axis_parallel": _indexed(lambda x, i: i * x * x),
    "rotated": rotated_hyper_ellipsoid,
    "moved_axis": _indexed(lambda x, i: 5.0 * i * x * x),
    "rosenbrock": _pairs(lambda a, b: 100.0 * (b - a * a) * (b - a * a) + (1.0 - a) * (1.0 - a)),
    "rastrigin": rastrigin,
    "schwefel": lambda v: total(F.transform(v, lambda x: -x * F.sin(F.sqrt(F.abs(x))))),
    "griewangk": griewangk,
    "powers": _indexed(lambda x, i: F.pow(F.abs(x), i + 1.0)),
    "ackley": ackley,
    "michalewicz": michalewicz(10),
    "branin": branin,
    "easom": easom,
    "camel": six_hump_camel_back,
}


def numeric_gradient(f: Objective, v: Column, n: int, h: float = 1e-4) -> Column:
    """Central differences of f at a vector of n entries."""

    def moved(k: int, by: float) -> Column:
        return F.transform(v, lambda x, i: F.when(i == k, x + by).otherwise(x))

    return F.array(*((f(moved(k, h)) - f(moved(k, -h))) / (2 * h) for k in range(n)))


#: Gradients where they are one expression an entry; the others go through numeric_gradient.
GRADIENTS: dict[str, Callable[[Column], Column]] = {
    "de_jong": lambda v: F.transform(v, lambda x: 2.0 * x),
    "axis_parallel": lambda v: F.transform(v, lambda x, i: 2.0 * (i + 1) * x),
    "moved_axis": lambda v: F.transform(v, lambda x, i: 10.0 * (i + 1) * x),
    "rastrigin": lambda v: F.transform(v, lambda x: 2.0 * x + 20.0 * PI * F.sin(2 * PI * x)),
    "powers": lambda v: F.transform(v, lambda x, i: (i + 2) * F.pow(F.abs(x), (i + 1).cast("double")) * F.signum(x)),
    "schwefel": lambda v: F.transform(v, lambda x: F.when(x == 0, 0.0).otherwise(-F.sin(F.sqrt(F.abs(x))) - x * F.cos(F.sqrt(F.abs(x))) * F.signum(x) / (2.0 * F.sqrt(F.when(x == 0, 1.0).otherwise(F.abs(x)))))),
}


def gradient(name: str, v: Column, n: int) -> Column:
    return GRADIENTS[name](v) if name in GRADIENTS else numeric_gradient(OBJECTIVES[name], v, n)
