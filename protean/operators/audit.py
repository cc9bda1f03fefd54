"""Audits: how an answer depends on the choices behind it."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grid(spark, choices: dict[str, list]) -> DataFrame:
    """Every combination of the levels of each choice: a plan of a few rows."""
    out = None
    for name, levels in choices.items():
        d = spark.createDataFrame([(v,) for v in levels], [name])
        out = d if out is None else out.join(F.broadcast(d))
    return out


def main_effects(runs: DataFrame, factors: list[str], value: str) -> DataFrame:
    """(factor, effect, share): total variation less that within the levels of the factor."""
    total = runs.agg(F.var_pop(value).alias("t"))
    out = None
    for f in factors:
        g = runs.groupBy(f).agg(F.count("*").alias("n"), F.var_pop(value).alias("v"))
        d = g.agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("within")).join(F.broadcast(total))
        d = d.select(F.lit(f).alias("factor"), (F.col("t") - F.col("within")).alias("effect"), F.try_divide(F.col("t") - F.col("within"), F.col("t")).alias("share"))
        out = d if out is None else out.unionByName(d)
    return out


def shapley(runs: DataFrame, factors: list[str], value: str) -> DataFrame:
    """(factor, share) of the variation: mean gain of a factor over all orders, from the closed index of each subset.

    A subset's index is the variance of the means over its levels; one pass of grouping sets gives
    them all, and 2^k numbers reach the driver.
    """
    k = len(factors)
    if k > 12:
        raise ValueError("more than 12 factors")
    groups = runs.cube(*factors).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.grouping_id().alias("g"))
    n = F.sum("n")
    index = {r.g: r.v for r in groups.groupBy("g").agg((F.sum(F.col("n") * F.col("m") * F.col("m")) / n - F.pow(F.sum(F.col("n") * F.col("m")) / n, F.lit(2))).alias("v")).collect()}
    full = (1 << k) - 1
    of = lambda s: index[full - sum(1 << (k - 1 - factors.index(f)) for f in s)]  # noqa: E731  a grouping bit is set where a factor is left out
    from math import factorial

    total, out = of(factors), []
    for f in factors:
        rest = [x for x in factors if x != f]
        v = sum(factorial(len(s)) * factorial(k - len(s) - 1) / factorial(k) * (of([*s, f]) - of(s)) for r in range(k) for s in combinations(rest, r))
        out.append((f, float(v / total) if total else 0.0))
    return runs.sparkSession.createDataFrame(out, "factor string, share double")


def stability(runs: DataFrame, item: str, value: str, tolerance: float) -> DataFrame:
    """(item, runs, least, most, stable): items whose answers differ by at most the tolerance."""
    g = runs.groupBy(item).agg(F.count(value).alias("runs"), F.min(value).alias("least"), F.max(value).alias("most"))
    return g.withColumn("stable", F.col("most") - F.col("least") <= tolerance)
