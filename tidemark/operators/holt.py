"""Holt's linear method as folds over arrays of months, in column expressions only.

One-step errors are linear in the start level and slope. So one fold over a series carries three
runs: from the first value with slope 0, and the changes by a unit of start level and
of start slope. Sums of their products give the least-squares start in closed form
(two equations), and with it the squared error of a pair of weights.

The weights are sought on a grid, then on finer grids around the best point. All of it
is one expression per series, so series are fitted where they are, each on its own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Level weights and, as shares of them, slope weights of the first grid.
ALPHAS = [0.05, 0.15, 0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 0.95]
SHARES = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
#: Spacing of the finer grids; each reaches two steps to both sides of the best point.
STEPS = [0.04, 0.015, 0.006, 0.0025]
LEAST_ALPHA = 1e-4


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def _runs(y: Column, alpha: Column, share: Column) -> Column:
    """The three runs at the end of the series, and sums of their errors and of products of errors."""
    names = ["l0", "b0", "l1", "b1", "l2", "b2", "s0", "s1", "s2", "q00", "q01", "q02", "q11", "q12", "q22"]
    start = {"l0": F.element_at(y, 1), "l1": F.lit(1.0), "b2": F.lit(1.0)}
    zero = F.struct(*[start.get(name, F.lit(0.0)).alias(name) for name in names])

    def month(run: Column, value: Column) -> Column:
        def moved(e: Column) -> Column:
            fields = {}
            for k in range(3):
                ahead = run[f"l{k}"] + run[f"b{k}"]
                level = ahead + alpha * e[f"e{k}"]
                fields[f"l{k}"] = level
                fields[f"b{k}"] = run[f"b{k}"] + share * ((level - run[f"l{k}"]) - run[f"b{k}"])
                fields[f"s{k}"] = run[f"s{k}"] + e[f"e{k}"]
                for j in range(k, 3):
                    fields[f"q{k}{j}"] = run[f"q{k}{j}"] + e[f"e{k}"] * e[f"e{j}"]
            return F.struct(*[fields[name].alias(name) for name in names])

        errors = [value - (run["l0"] + run["b0"]), -(run["l1"] + run["b1"]), -(run["l2"] + run["b2"])]
        return let(F.struct(*[e.alias(f"e{k}") for k, e in enumerate(errors)]), moved)

    return F.aggregate(y, zero, month)


def fit_at(y: Column, alpha: Column, share: Column) -> Column:
    """The fit of a series with given weights: sse, alpha, share, level, trend, sigma.

    ``level`` and ``trend`` are those after the last month, from the start with the
    least squared error; ``sigma`` is the population deviation of the errors. A
    start that the errors do not determine is the first value without a slope.
    """

    def solved(r: Column) -> Column:
        det = r["q11"] * r["q22"] - r["q12"] * r["q12"]
        sure = F.abs(det) > 1e-12 * F.greatest(r["q11"] * r["q22"], F.lit(1e-300))
        return let(
            F.struct(
                F.when(sure, (r["q02"] * r["q12"] - r["q01"] * r["q22"]) / det).otherwise(0.0).alias("l"),
                F.when(sure, (r["q01"] * r["q12"] - r["q02"] * r["q11"]) / det).otherwise(0.0).alias("b"),
            ),
            lambda start: finished(r, start["l"], start["b"]),
        )

    def finished(r: Column, more: Column, slope: Column) -> Column:
        squares = r["q00"] + more * more * r["q11"] + slope * slope * r["q22"]
        sse = F.greatest(squares + 2.0 * (more * r["q01"] + slope * r["q02"] + more * slope * r["q12"]), F.lit(0.0))
        mean = (r["s0"] + more * r["s1"] + slope * r["s2"]) / F.size(y)
        return F.struct(
            sse.alias("sse"), alpha.alias("alpha"), share.alias("share"),
            (r["l0"] + more * r["l1"] + slope * r["l2"]).alias("level"),
            (r["b0"] + more * r["b1"] + slope * r["b2"]).alias("trend"),
            F.sqrt(F.greatest(sse / F.size(y) - mean * mean, F.lit(0.0))).alias("sigma"),
        )

    return let(_runs(y, alpha, share), solved)


def _best(y: Column, alphas: Column, shares: Column) -> Column:
    fits = F.transform(alphas, lambda a: F.array_min(F.transform(shares, lambda s: fit_at(y, a, s))))
    return F.array_min(fits)


def _around(best: Column, y: Column, step: float) -> Column:
    """The best fit of a grid with spacing ``step`` around a fit."""
    offsets = F.lit([k * step for k in range(-2, 3)])

    def near(centre: Column, low: float) -> Column:
        return F.transform(offsets, lambda o: F.least(F.greatest(centre + o, F.lit(low)), F.lit(1.0)))

    return let(near(best["alpha"], LEAST_ALPHA), lambda alphas: let(near(best["share"], 0.0), lambda shares: _best(y, alphas, shares)))


def fit(y: Column) -> Column:
    """The best fit of an array of months without gaps, as ``fit_at`` gives it; ties go to the smaller weights."""
    best = _best(y, F.lit(ALPHAS), F.lit(SHARES))
    for step in STEPS:
        best = let(best, partial(_around, y=y, step=step))
    return best
