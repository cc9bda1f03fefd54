"""Vector expressions on (x, y, z) struct columns and moments of point sets.

Row-wise measures are plain Column arithmetic and stay inside whole-stage code generation; moments
are partial aggregates; only 3 x 3 and 4 x 4 eigenproblems, one for each group, go through Arrow.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vec(x, y, z) -> Column:
    c = lambda v: F.col(v) if isinstance(v, str) else v
    return F.struct(c(x).cast("double").alias("x"), c(y).cast("double").alias("y"), c(z).cast("double").alias("z"))


def let(value: Column, body) -> Column:
    """``body`` of ``value`` computed once; nested vector expressions would else repeat their parts."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sub(a: Column, b: Column) -> Column:
    return F.struct(*[(a[c] - b[c]).alias(c) for c in "xyz"])


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return F.struct((a["y"] * b["z"] - a["z"] * b["y"]).alias("x"), (a["z"] * b["x"] - a["x"] * b["z"]).alias("y"), (a["x"] * b["y"] - a["y"] * b["x"]).alias("z"))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    return norm(sub(a, b))


def normalise(a: Column) -> Column:
    """Unit vector; null without a direction."""
    n = norm(a)
    return F.when(n > 0, F.struct(*[(a[c] / n).alias(c) for c in "xyz"]))


def angle(a: Column, vertex: Column, c: Column) -> Column:
    """Radians at ``vertex``; null when a side has no length."""
    u, v = sub(a, vertex), sub(c, vertex)
    n = norm(u) * norm(v)
    return F.when(n > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(u, v) / n))))


def dihedral(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Radians in (-pi, pi] about b-c; null when a plane is undefined."""
    u, v, w = sub(b, a), sub(c, b), sub(d, c)
    n1, n2 = cross(u, v), cross(v, w)
    ok = (dot(n1, n1) > 0) & (dot(n2, n2) > 0)
    return F.when(ok, F.atan2(dot(cross(n1, n2), v) / norm(v), dot(n1, n2)))


def place_atom(i: Column, j: Column, k: Column, length: Column, bend: Column, turn: Column) -> Column:
    """The point at ``length`` from k, with angle j-k-l ``bend`` and torsion i-j-k-l ``turn`` (radians)."""
    along, side, up = -length * F.cos(bend), length * F.sin(bend) * F.cos(turn), length * F.sin(bend) * F.sin(turn)

    def placed(b: Column, n: Column, m: Column) -> Column:
        return F.struct(*[(k[c] + along * b[c] + side * m[c] + up * n[c]).alias(c) for c in "xyz"])

    return let(normalise(sub(k, j)), lambda b: let(normalise(cross(sub(j, i), b)), lambda n: let(cross(n, b), lambda m: placed(b, n, m))))


def centroid(points: DataFrame, keys=()) -> DataFrame:
    return points.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in "xyz"], F.count("*").alias("n"))


def centre_of_mass(points: DataFrame, mass: str, keys=()) -> DataFrame:
    m = F.col(mass)
    return points.groupBy(*keys).agg(*[F.try_divide(F.sum(m * F.col(c)), F.sum(m)).alias(c) for c in "xyz"])


def radius_of_gyration(points: DataFrame, mass: str, keys=()) -> DataFrame:
    """One pass: the second moment about the centre is the raw one less the centre's."""
    m = F.col(mass)
    s = points.groupBy(*keys).agg(F.sum(m).alias("m"), *[F.sum(m * F.col(c)).alias(f"s{c}") for c in "xyz"], F.sum(m * (F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)).alias("q"))
    centre = sum(((F.col(f"s{c}") / F.col("m")) ** 2 for c in "xyz"), F.lit(0.0))
    return s.select(*keys, F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("m") - centre)).alias("radius_of_gyration"))


def second_moments(points: DataFrame, mass: str, keys=()) -> DataFrame:
    """Covariance-like sums about the centre of mass: (keys, m, xx, yy, zz, xy, xz, yz)."""
    m = F.col(mass)
    pairs = [("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z")]
    s = points.groupBy(*keys).agg(F.sum(m).alias("m"), *[F.sum(m * F.col(c)).alias(f"s{c}") for c in "xyz"], *[F.sum(m * F.col(a) * F.col(b)).alias(f"q{a}{b}") for a, b in pairs])
    return s.select(*keys, "m", *[(F.col(f"q{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}") / F.col("m")).alias(a + b) for a, b in pairs])


def inertia_tensor(points: DataFrame, mass: str, keys=()) -> DataFrame:
    s = second_moments(points, mass, keys)
    c = F.col
    return s.select(*keys, (c("yy") + c("zz")).alias("ixx"), (c("xx") + c("zz")).alias("iyy"), (c("xx") + c("yy")).alias("izz"), (-c("xy")).alias("ixy"), (-c("xz")).alias("ixz"), (-c("yz")).alias("iyz"))


def _eigen(s: DataFrame, keys) -> DataFrame:
    """Descending eigenvalues of the symmetric 3 x 3 matrix in (xx .. yz) of every row."""

    @F.pandas_udf("a double, b double, c double")
    def values(xx: pd.Series, yy: pd.Series, zz: pd.Series, xy: pd.Series, xz: pd.Series, yz: pd.Series) -> pd.DataFrame:
        m = np.stack([xx, xy, xz, xy, yy, yz, xz, yz, zz], axis=1).reshape(-1, 3, 3)
        v = np.linalg.eigvalsh(m)[:, ::-1] if len(m) else np.zeros((0, 3))
        return pd.DataFrame({"a": v[:, 0], "b": v[:, 1], "c": v[:, 2]})

    return s.select(*keys, values("xx", "yy", "zz", "xy", "xz", "yz").alias("v")).select(*keys, "v.*")


def gyration_shape(points: DataFrame, mass: str, keys=()) -> DataFrame:
    """(keys, a, b, c, asphericity, shape) from the gyration tensor's eigenvalues."""
    s = second_moments(points, mass, keys)
    s = s.select(*keys, *[(F.col(k) / F.col("m")).alias(k) for k in ("xx", "yy", "zz", "xy", "xz", "yz")])
    e = _eigen(s, keys)
    trace = F.col("a") + F.col("b") + F.col("c")
    mean = trace / 3
    asph = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("a") - (F.col("b") + F.col("c")) / 2) / trace))
    return e.select(*keys, "a", "b", "c", F.when(trace > 0, asph).alias("asphericity"), F.when(trace > 0, 27 * (F.col("a") - mean) * (F.col("b") - mean) * (F.col("c") - mean) / trace**3).alias("shape"))


def rmsd(left: DataFrame, right: DataFrame, keys=(), weight: str | None = None) -> DataFrame:
    """Root mean square deviation of matched atoms, without fitting: (keys, rmsd, atoms)."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    a = left.select(*keys, "atom", *[F.col(c).alias(f"a_{c}") for c in "xyz"], *([weight] if weight else []))
    b = right.select(*keys, "atom", *[F.col(c).alias(f"b_{c}") for c in "xyz"])
    d2 = sum(((F.col(f"a_{c}") - F.col(f"b_{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    return a.join(b, [*keys, "atom"]).groupBy(*keys).agg(F.sqrt(F.sum(w * d2) / F.sum(w)).alias("rmsd"), F.count("*").alias("atoms"))


def superpose(left: DataFrame, right: DataFrame, keys=()) -> DataFrame:
    """Best rigid fit of ``left`` on ``right``: (keys, rmsd, atoms, rotation, translation).

    The sums that the fit needs (sizes, centres, the 3 x 3 covariance) are partial aggregates over
    atoms in any number of partitions; only 16 numbers a group reach the eigenproblem.
    """
    a = left.select(*keys, "atom", *[F.col(c).alias(f"a{c}") for c in "xyz"])
    b = right.select(*keys, "atom", *[F.col(c).alias(f"b{c}") for c in "xyz"])
    sums = [F.count("*").alias("n")] + [F.sum(f"{s}{c}").alias(f"s_{s}{c}") for s in "ab" for c in "xyz"] + [F.sum(F.col(f"a{c}") * F.col(f"b{d}")).alias(f"c_{c}{d}") for c in "xyz" for d in "xyz"] + [F.sum(sum((F.col(f"{s}{c}") ** 2 for c in "xyz"), F.lit(0.0))).alias(f"q_{s}") for s in "ab"]
    g = a.join(b, [*keys, "atom"]).groupBy(*keys).agg(*sums)
    names = [c for c in g.columns if c not in keys]

    @F.pandas_udf("rmsd double, atoms long, rotation array<double>, translation array<double>")
    def fit(*cols: pd.Series) -> pd.DataFrame:
        v = dict(zip(names, (np.asarray(c, dtype=float) for c in cols), strict=True))
        out = []
        for i in range(len(v["n"])):
            n = v["n"][i]
            ca = np.array([v[f"s_a{c}"][i] for c in "xyz"]) / n
            cb = np.array([v[f"s_b{c}"][i] for c in "xyz"]) / n
            h = np.array([[v[f"c_{c}{d}"][i] for d in "xyz"] for c in "xyz"]) - n * np.outer(ca, cb)
            e0 = v["q_a"][i] - n * ca @ ca + v["q_b"][i] - n * cb @ cb
            u, s, vt = np.linalg.svd(h)
            sign = np.sign(np.linalg.det(u @ vt)) or 1.0
            rot = (u * [1, 1, sign]) @ vt
            left_over = max(0.0, e0 - 2 * (s[0] + s[1] + sign * s[2]))
            out.append((float(np.sqrt(left_over / n)), int(n), rot.T.ravel().tolist(), (cb - rot.T @ ca).tolist()))
        return pd.DataFrame(out, columns=["rmsd", "atoms", "rotation", "translation"])

    return g.select(*keys, fit(*names).alias("f")).select(*keys, "f.*")


def circular_summary(values: DataFrame, angle_col: str, keys=(), tolerance: float = 1e-12) -> DataFrame:
    """(keys, n, mean, resultant, variance) of angles in radians; no mean where they cancel."""
    s = values.groupBy(*keys).agg(F.count(angle_col).alias("n"), F.sum(F.sin(angle_col)).alias("s"), F.sum(F.cos(angle_col)).alias("c"))
    r = F.hypot("s", "c") / F.col("n")
    return s.select(*keys, "n", F.when(r > tolerance, F.atan2("s", "c")).alias("mean"), r.alias("resultant"), (1 - r).alias("variance"))


def best_plane(points: DataFrame, keys=()) -> DataFrame:
    """(keys, deviation): root mean square distance from the least-squares plane."""
    s = second_moments(points.withColumn("_one", F.lit(1.0)), "_one", keys)
    e = _eigen(s.select(*keys, *[(F.col(k) / F.col("m")).alias(k) for k in ("xx", "yy", "zz", "xy", "xz", "yz")]), keys)
    return e.select(*keys, F.sqrt(F.greatest(F.lit(0.0), F.col("c"))).alias("deviation"))


#: Points in a block of a distance matrix.
BLOCK = 1024


def distance_matrix(points: DataFrame, keys=()) -> DataFrame:
    """(keys, first, second, distance) of all pairs with the same keys, first < second.

    Quadratic by definition, but in blocks: points are dealt to blocks by hash and each pair of blocks is a
    task's work of bounded size, so a set of any size is spread over the cluster.
    """
    keys = list(keys)
    size = points.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("_n"))
    p = points.select(*keys, "atom", vec("x", "y", "z").alias("p"))
    p = (p.join(size, keys) if keys else p.join(F.broadcast(size))).withColumn("_b", F.pmod(F.xxhash64("atom"), F.col("_n")))  # one row where there are no keys
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))
    a = p.select(*keys, F.col("_b").alias("_i"), every.alias("_j"), F.col("atom").alias("first"), F.col("p"))
    b = p.select(*keys, every.alias("_i"), F.col("_b").alias("_j"), F.col("atom").alias("second"), F.col("p").alias("q"))
    return a.join(b, [*keys, "_i", "_j"]).where("first < second").select(*keys, "first", "second", distance(F.col("p"), F.col("q")).alias("distance"))
