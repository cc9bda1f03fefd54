"""Cells, reflections, density maps and lattice images."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cell_volume(a: float, b: float, c: float, alpha: float, beta: float, gamma: float) -> float:
    """Volume from lengths and angles in degrees."""
    x, y, z = (math.cos(math.radians(v)) for v in (alpha, beta, gamma))
    return a * b * c * math.sqrt(max(0.0, 1 - x * x - y * y - z * z + 2 * x * y * z))


def reciprocal_metric(a: float, b: float, c: float, alpha: float, beta: float, gamma: float) -> tuple[float, ...]:
    """(h2, k2, l2, hk, hl, kl) coefficients of 1/d^2."""
    v = cell_volume(a, b, c, alpha, beta, gamma)
    ca, cb, cg = (math.cos(math.radians(t)) for t in (alpha, beta, gamma))
    sa, sb, sg = (math.sin(math.radians(t)) for t in (alpha, beta, gamma))
    ra, rb, rc = b * c * sa / v, a * c * sb / v, a * b * sg / v
    return ra * ra, rb * rb, rc * rc, 2 * ra * rb * (ca * cb - cg) / (sa * sb), 2 * ra * rc * (ca * cg - cb) / (sa * sg), 2 * rb * rc * (cb * cg - ca) / (sb * sg)


def inverse_d_squared(cell: tuple[float, ...], h: Column, k: Column, l: Column) -> Column:  # noqa: E741
    m = [F.lit(float(v)) for v in reciprocal_metric(*cell)]
    return m[0] * h * h + m[1] * k * k + m[2] * l * l + m[3] * h * k + m[4] * h * l + m[5] * k * l


def d_spacing(cell: tuple[float, ...], h: Column, k: Column, l: Column) -> Column:  # noqa: E741
    """Spacing of planes; null for 0, 0, 0."""
    q = inverse_d_squared(cell, h, k, l)
    return F.when(q > 0, 1 / F.sqrt(q))


def resolution_shells(reflections: DataFrame, cell: tuple[float, ...], shells: int, lowest: float, highest: float) -> DataFrame:
    """(shell, n, mean_amplitude, mean_intensity) in equal steps of 1/d^2 between two limits; equal ones are 0 and shells - 1."""
    q = inverse_d_squared(cell, F.col("h"), F.col("k"), F.col("l"))
    s = F.least(F.lit(shells - 1), F.floor((q - lowest) / F.lit((highest - lowest) / shells)))
    inside = reflections.where((q >= lowest) & (q <= highest))
    return inside.groupBy(s.alias("shell")).agg(F.count("*").alias("n"), F.avg("amplitude").alias("mean_amplitude"), F.avg(F.col("amplitude") * F.col("amplitude")).alias("mean_intensity"))


def smoothed_shells(shells: DataFrame) -> DataFrame:
    """(shell, rms): counts and intensity sums smoothed by [0.75, 1, 0.75], then the root of their quotient."""
    w = Window.orderBy("shell")
    side = lambda c: F.lit(0.75) * (F.coalesce(F.when(F.lag("shell").over(w) == F.col("shell") - 1, F.lag(c).over(w)), F.lit(0.0)) + F.coalesce(F.when(F.lead("shell").over(w) == F.col("shell") + 1, F.lead(c).over(w)), F.lit(0.0)))
    s = shells.select("shell", F.col("n").cast("double").alias("c"), (F.col("n") * F.col("mean_intensity")).alias("s"))
    return s.select("shell", F.sqrt((F.col("s") + side("s")) / (F.col("c") + side("c"))).alias("rms"))


def unique_reflections(reflections: DataFrame) -> DataFrame:
    """One row for each Friedel pair: (h, k, l, amplitude, n); the half-space with the first non-zero index positive."""
    flip = (F.col("h") < 0) | ((F.col("h") == 0) & ((F.col("k") < 0) | ((F.col("k") == 0) & (F.col("l") < 0))))
    s = F.when(flip, -1).otherwise(1)
    return reflections.groupBy(*[(F.col(c) * s).alias(c) for c in "hkl"]).agg(F.avg("amplitude").alias("amplitude"), F.count("*").alias("n"))


def structure_factors(atoms: DataFrame, reflections: DataFrame, scatter: str = "occupancy", limit: int = 1_000_000) -> DataFrame:
    """(h, k, l, re, im) of fractional atoms (u, v, w) at a list of reflections.

    The list is small beside the atoms, 24 bytes a reflection: it is refused beyond ``limit``, travels with the
    kernel, and every partition of atoms gives one partial sum for each reflection. Atoms without a number take no part.
    """
    hkl = [tuple(r) for r in reflections.select(*[F.col(c).cast("long").alias(c) for c in "hkl"]).distinct().limit(limit + 1).collect()]
    if len(hkl) > limit:
        raise ValueError(f"more than {limit} reflections; give them in parts")
    index = np.array(sorted(hkl), dtype=float).reshape(-1, 3)

    def partial(batches):
        total = np.zeros((len(index), 2))
        for pdf in batches:
            at = pdf.dropna().to_numpy(float)
            for lo in range(0, len(at), 256):
                part = at[lo : lo + 256]
                for first in range(0, len(index), 4096):  # at most 256 x 4,096 phases at a time
                    phase = 2 * np.pi * (index[first : first + 4096] @ part[:, :3].T)
                    total[first : first + 4096, 0] += np.cos(phase) @ part[:, 3]
                    total[first : first + 4096, 1] += np.sin(phase) @ part[:, 3]
        for first in range(0, len(index), 65_536):
            some = slice(first, first + 65_536)
            yield pd.DataFrame({**{c: index[some, i].astype("int64") for i, c in enumerate("hkl")}, "re": total[some, 0], "im": total[some, 1]})

    sums = atoms.select(*[F.col(c).cast("double") for c in ("u", "v", "w", scatter)]).mapInPandas(partial, "h long, k long, l long, re double, im double")
    kinds = dict(reflections.dtypes)
    return sums.groupBy("h", "k", "l").agg(F.sum("re").alias("re"), F.sum("im").alias("im")).select(*[F.col(c).cast(kinds[c]).alias(c) for c in "hkl"], "re", "im")


def map_correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """(correlation, voxels) of two maps (ix, iy, iz, value) placed alike."""
    return a.select("ix", "iy", "iz", F.col("value").alias("p")).join(b.select("ix", "iy", "iz", F.col("value").alias("q")), ["ix", "iy", "iz"]).agg(F.corr("p", "q").alias("correlation"), F.count("*").alias("voxels"))


def lattice_images(points: DataFrame, box: tuple[float, float, float], reach: int = 1) -> DataFrame:
    """Points and their images in the cells around: (atom, image, x, y, z)."""
    r = range(-reach, reach + 1)
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in r for b in r for c in r])
    d = points.select("atom", "x", "y", "z", F.explode(steps).alias("i"))
    return d.select("atom", F.concat_ws(",", "i.a", "i.b", "i.c").alias("image"), *[(F.col(c) + F.col(f"i.{k}") * F.lit(float(s))).alias(c) for c, k, s in zip("xyz", "abc", box, strict=True)])


def apply_operators(points: DataFrame, operators: list[tuple[str, list[float]]]) -> DataFrame:
    """Points under rigid operators (name, 12 numbers row by row): (atom, operator, x, y, z). The list is part of the plan."""
    out = None
    for name, m in operators:
        cols = [(sum((F.lit(float(m[4 * i + j])) * F.col(c) for j, c in enumerate("xyz")), F.lit(0.0)) + F.lit(float(m[4 * i + 3]))).alias(n) for i, n in enumerate("xyz")]
        d = points.select("atom", F.lit(name).alias("operator"), *cols)
        out = d if out is None else out.unionByName(d)
    return out
