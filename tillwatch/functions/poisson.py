"""Upper Poisson tail as a Spark expression with a bounded number of terms."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SMALL_COUNT = 100
NODES, WEIGHTS = np.polynomial.legendre.leggauss(24)


def _small(k: Column, rate: Column) -> Column:
    """1 - sum of the first k terms, each from the one before."""
    empty = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * rate / i
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    terms = F.when(k > 1, F.sequence(F.lit(1), (k - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(terms, empty, step, lambda acc: acc["total"])
    return 1.0 - total * F.exp(-rate)


def _log_gamma(a: Column) -> Column:
    """Stirling series; for a > 100 the next term is below 1e-17."""
    inv = 1.0 / a
    return (
        (a - 0.5) * F.log(a) - a + 0.5 * float(np.log(2 * np.pi))
        + inv / 12 - F.pow(inv, 3) / 360 + F.pow(inv, 5) / 1260
    )


def _large(k: Column, rate: Column) -> Column:
    """Regularised lower incomplete gamma P(k, rate) by fixed-order Gauss-Legendre quadrature
    of the density between ``rate`` and the far side of its peak."""
    a = k.cast("double")
    peak = a - 1.0
    spread = F.sqrt(peak)
    below = rate <= peak
    edge = F.when(
        below, F.greatest(F.lit(0.0), F.least(peak - 7.5 * spread, rate - 5.0 * spread))
    ).otherwise(F.greatest(peak + 11.5 * spread, rate + 6.0 * spread))
    centre = peak * F.log(peak) - peak - _log_gamma(a)
    half = (edge - rate) / 2
    nodes = F.array(*[
        F.struct(F.lit(float(node + 1)).alias("node"), F.lit(float(weight)).alias("weight"))
        for node, weight in zip(NODES, WEIGHTS, strict=True)
    ])

    def add(total: Column, at: Column) -> Column:
        t = rate + half * at["node"]
        return total + at["weight"] * F.exp(peak * F.log(t / peak) - (t - peak))

    integral = F.aggregate(nodes, F.lit(0.0), add) * half * F.exp(centre)
    return F.when(below, -integral).otherwise(1.0 - integral)


def poisson_tail(k: Column, rate: Column) -> Column:
    """P(X >= k) for X ~ Poisson(rate), in [0, 1].

    Counts up to 100 sum the terms below k. Larger ones (a busy bucket can hold millions) use
    the quadrature, whose cost does not depend on k. Like the direct sum, both report 0 once
    the tail falls below double-precision resolution of 1.
    """
    tail = F.when(k <= SMALL_COUNT, _small(k, rate)).otherwise(_large(k, rate))
    floored = F.transform(F.array(tail), lambda p: F.when(p < 1.1e-16, 0.0).otherwise(F.least(p, F.lit(1.0))))
    return F.when(k <= 0, 1.0).when(rate <= 0, 0.0).otherwise(floored[0])


def poisson_tail_value(k: int, rate: float) -> float:
    """The same tail for one pair of numbers, for stateful stream operators."""
    if k <= 0:
        return 1.0
    if rate <= 0:
        return 0.0
    if k <= SMALL_COUNT:
        tail = 1.0 - math.fsum(math.exp(i * math.log(rate) - rate - math.lgamma(i + 1)) for i in range(k))
    else:
        peak = k - 1.0
        spread, below = math.sqrt(peak), rate <= peak
        edge = max(0.0, min(peak - 7.5 * spread, rate - 5 * spread)) if below else max(peak + 11.5 * spread, rate + 6 * spread)
        half = (edge - rate) / 2
        t = rate + half * (NODES + 1)
        area = float(np.sum(WEIGHTS * np.exp(peak * np.log(t / peak) - (t - peak)))) * half
        area *= math.exp(peak * math.log(peak) - peak - math.lgamma(k))
        tail = -area if below else 1.0 - area
    return 0.0 if tail < 1.1e-16 else min(1.0, tail)
