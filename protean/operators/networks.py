"""Elastic networks, leaflets, polymers, and distances between conformations and paths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.graph import spread
from .spatial import cross_pairs, pairs_within, radius_components


def _typed(df: DataFrame, keys) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys)


def gaussian_network(points: DataFrame, cutoff: float, keys: tuple[str, ...], modes: int = 5, limit: int = 3000) -> DataFrame:
    """(keys, atom, mode, eigenvalue, value): slow modes of the contact graph's Laplacian, one dense problem for each group.

    Groups over ``limit`` points are refused: the work grows as the cube of a group.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > limit:
            raise ValueError(f"a group of {len(pdf)} points is over the limit of {limit}")
        pdf = pdf.sort_values("atom")
        x = pdf[["x", "y", "z"]].to_numpy(float)
        near = (((x[:, None] - x[None]) ** 2).sum(-1) <= cutoff * cutoff).astype(float)
        np.fill_diagonal(near, 0)
        value, vector = np.linalg.eigh(np.diag(near.sum(1)) - near)
        use = [i for i in range(len(value)) if value[i] > 1e-9][:modes]
        out = []
        for m, i in enumerate(use):
            v = vector[:, i] * (1 if vector[np.argmax(np.abs(vector[:, i])), i] >= 0 else -1)
            out += [(*pdf[list(keys)].iloc[0], int(a), m, float(value[i]), float(w)) for a, w in zip(pdf["atom"], v, strict=True)]
        return pd.DataFrame(out, columns=[*keys, "atom", "mode", "eigenvalue", "value"])

    return spread(points, *keys).groupBy(*keys).applyInPandas(solve, f"{_typed(points, keys)}, atom long, mode int, eigenvalue double, value double")


def anisotropic_fluctuations(points: DataFrame, cutoff: float, keys: tuple[str, ...], limit: int = 3000) -> DataFrame:
    """(keys, atom, fluctuation): trace of each atom's block of the pseudo-inverse of the Hessian, six zero modes left out.

    One dense problem of three numbers a point for each group. Groups over ``limit`` points (648 MB of numbers, and a few times that
    while it is solved) are refused: the work grows as the cube of a group.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > limit:
            raise ValueError(f"a group of {len(pdf)} points is over the limit of {limit}")
        pdf = pdf.sort_values("atom")
        x = pdf[["x", "y", "z"]].to_numpy(float)
        n = len(x)
        d = x[:, None] - x[None]
        q = (d**2).sum(-1)
        w = np.where((q > 0) & (q <= cutoff * cutoff), 1 / np.where(q > 0, q, 1), 0.0)
        blocks = -np.einsum("ij,ijk,ijl->ijkl", w, d, d)
        blocks[np.arange(n), np.arange(n)] = -blocks.sum(axis=1)
        value, vector = np.linalg.eigh(blocks.transpose(0, 2, 1, 3).reshape(3 * n, 3 * n))
        keep = value > 1e-6 * max(1e-12, value.max(initial=0.0))
        f = ((vector[:, keep] ** 2) / value[keep]).sum(axis=1).reshape(n, 3).sum(axis=1)
        return pd.DataFrame([(*pdf[list(keys)].iloc[0], int(a), float(v)) for a, v in zip(pdf["atom"], f, strict=True)], columns=[*keys, "atom", "fluctuation"])

    return spread(points, *keys).groupBy(*keys).applyInPandas(solve, f"{_typed(points, keys)}, atom long, fluctuation double")


def leaflets(heads: DataFrame, cutoff: float) -> DataFrame:
    """(atom, leaflet): head groups joined by chains of neighbours; leaflets are ranked by size, then by their smallest atom."""
    c = radius_components(heads, cutoff)
    named = heads.select("atom").join(c.withColumnRenamed("node", "atom"), "atom", "left").withColumn("comp", F.coalesce("comp", "atom"))
    # a window over leaflets, not atoms
    rank = named.groupBy("comp").agg(F.count("*").alias("n")).select("comp", (F.row_number().over(Window.orderBy(F.desc("n"), "comp")) - 1).alias("leaflet"))
    return named.join(rank, "comp").select("atom", "leaflet")


def polymer_statistics(points: DataFrame, keys=("chain",), order: str = "atom") -> DataFrame:
    """(keys, bonds, contour, end_to_end, mean_cosine): of chains of points in order."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = points.select(*keys, order, *[(F.lead(c).over(w) - F.col(c)).alias(f"u{c}") for c in "xyz"], *[(F.lead(c, 2).over(w) - F.lead(c).over(w)).alias(f"v{c}") for c in "xyz"])
    n = lambda p: F.sqrt(sum((F.col(f"{p}{c}") * F.col(f"{p}{c}") for c in "xyz"), F.lit(0.0)))
    cos = F.try_divide(sum((F.col(f"u{c}") * F.col(f"v{c}") for c in "xyz"), F.lit(0.0)), n("u") * n("v"))
    ends = F.sqrt(sum((F.pow(F.sum(f"u{c}"), F.lit(2)) for c in "xyz"), F.lit(0.0)))
    return d.groupBy(*keys).agg(F.count("ux").alias("bonds"), F.sum(n("u")).alias("contour"), ends.alias("end_to_end"), F.avg(cos).alias("mean_cosine"))


def dielectric(dipoles: DataFrame, volume: float, temperature: float) -> DataFrame:
    """(permittivity) from total dipoles (mx, my, mz in e A) of frames: 1 + variance of M over 3 V kT eps0."""
    var = sum((F.var_pop(f"m{c}") for c in "xyz"), F.lit(0.0))
    # e^2 A^2 / (A^3 * k K * eps0), in SI
    scale = (1.602176634e-19**2 * 1e-20) / (3 * volume * 1e-30 * 1.380649e-23 * temperature * 8.8541878128e-12)
    return dipoles.agg((1 + var * F.lit(scale)).alias("permittivity"))


def torus_distance(a: list[Column], b: list[Column]) -> Column:
    """Root mean square of angle differences (radians), each taken the short way round."""
    turn = lambda x, y: F.atan2(F.sin(x - y), F.cos(x - y))
    return F.sqrt(sum((turn(x, y) * turn(x, y) for x, y in zip(a, b, strict=True)), F.lit(0.0)) / len(a))


def hausdorff(first: DataFrame, second: DataFrame, coords=("x", "y", "z"), reach: float | None = None) -> DataFrame:
    """(hausdorff) of two paths of frames: the largest distance of a frame of one to its nearest of the other.

    ``reach`` bounds the nearest distances; with it frames meet by cell join, else every pair is met,
    which is for paths of a few thousand frames.
    """
    a = first.select(F.col("frame").alias("atom"), *[F.col(c).alias(k) for c, k in zip(coords, "xyz", strict=True)])
    b = second.select(F.col("frame").alias("atom"), *[F.col(c).alias(k) for c, k in zip(coords, "xyz", strict=True)])
    if reach is None:
        ends = a.union(b).agg(*[(F.max(k) - F.min(k)).alias(k) for k in "xyz"]).first()
        reach = sum((v or 0.0) ** 2 for v in ends) ** 0.5 + 1e-9
    met = cross_pairs(a, b, reach)
    one = met.groupBy("first").agg(F.min("distance").alias("d")).select("d")
    two = met.groupBy("second").agg(F.min("distance").alias("d")).select("d")
    return one.union(two).agg(F.max("d").alias("hausdorff"))


def harmonic_similarity(a: DataFrame, b: DataFrame, columns: list[str], ridge: float = 1e-6) -> DataFrame:
    """(mean_term, covariance_term, distance, similarity) of two ensembles of wide rows as Gaussians.

    The Bhattacharyya distance of their means and sample covariances, to whose diagonals ``ridge`` is
    added, and exp(-distance). Moments are one pass of partial sums each.
    """

    def moments(d: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
        r = d.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)], *[F.covar_samp(columns[i], columns[j]).alias(f"c_{i}_{j}") for i, j in pairs]).first()
        m = np.zeros((len(columns), len(columns)))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"c_{i}_{j}"] or 0.0
        return np.array([r[f"m_{i}"] for i in range(len(columns))]), m + ridge * np.eye(len(columns))

    (ma, ca), (mb, cb) = moments(a), moments(b)
    both, d = (ca + cb) / 2, ma - mb
    dets = [np.linalg.slogdet(x) for x in (both, ca, cb)]
    if any(sign <= 0 for sign, _ in dets):
        raise ValueError("a covariance is not positive definite; raise the ridge")
    mean_term = float(d @ np.linalg.solve(both, d)) / 8
    covariance_term = 0.5 * (dets[0][1] - (dets[1][1] + dets[2][1]) / 2)
    distance = float(max(0.0, mean_term + covariance_term))
    return a.sparkSession.createDataFrame([(mean_term, float(covariance_term), distance, float(np.exp(-distance)))], "mean_term double, covariance_term double, distance double, similarity double")


def agglomerative(distances: DataFrame, keys: list[str], threshold: float, method: str = "average", limit: int = 2000) -> DataFrame:
    """(keys, item, cluster): merging the two nearest clusters until none is within ``threshold``; numbered by smallest item.

    average, complete or single linkage; one dense problem for each group, refused over ``limit`` items.
    """
    if method not in ("average", "complete", "single"):
        raise ValueError(method)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["first"]) | set(pdf["second"]))
        if len(names) > limit:
            raise ValueError(f"{len(names)} items are over the limit of {limit}")
        at = {v: i for i, v in enumerate(names)}
        d = np.full((len(names), len(names)), np.inf)
        for a, b, v in zip(pdf["first"], pdf["second"], pdf["distance"], strict=True):
            d[at[a], at[b]] = d[at[b], at[a]] = v
        size, member = np.ones(len(names)), np.arange(len(names))
        while len(names) > 1:
            i, j = sorted(np.unravel_index(int(np.argmin(d)), d.shape))
            if not d[i, j] <= threshold:
                break
            new = {"average": (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j]), "complete": np.maximum(d[i], d[j]), "single": np.minimum(d[i], d[j])}[method]
            d[i], d[:, i], d[j], d[:, j] = new, new, np.inf, np.inf
            d[i, i] = np.inf
            size[i] += size[j]
            member[member == j] = i
        rank = {c: k for k, c in enumerate(sorted(set(member)))}
        return pd.DataFrame([(*pdf[keys].iloc[0], n, rank[m]) for n, m in zip(names, member, strict=True)], columns=[*keys, "item", "cluster"])

    kind = dict(distances.dtypes)["first"]
    return distances.groupBy(*keys).applyInPandas(solve, f"{_typed(distances, keys)}, item {kind}, cluster int")


def contact_counts(frames: DataFrame, cutoff: float) -> DataFrame:
    """(frame, contacts) of points (frame, atom, x, y, z): one join for all frames, 0 where there are none."""
    p = pairs_within(frames, cutoff, keys=("frame",)).groupBy("frame").agg(F.count("*").alias("n"))
    return frames.select("frame").distinct().join(p, "frame", "left").select("frame", F.coalesce("n", F.lit(0)).alias("contacts"))


def interface_atoms(points: DataFrame, cutoff: float) -> DataFrame:
    """Rows of ``points`` (…, chain) strictly closer than ``cutoff`` to an atom of another chain."""
    p = pairs_within(points, cutoff, extra=("chain",)).where((F.col("first_chain") != F.col("second_chain")) & (F.col("distance") < cutoff))
    near = p.select(F.explode(F.array("first", "second")).alias("atom")).distinct()
    return points.join(near, "atom", "left_semi")


def buried_area(together: DataFrame, apart: DataFrame) -> DataFrame:
    """(buried) of areas (atom, area) of a complex and of its parts."""
    t = together.select("atom", F.col("area").alias("t"))
    return apart.join(t, "atom").agg((F.sum("area") - F.sum("t")).alias("buried"))
