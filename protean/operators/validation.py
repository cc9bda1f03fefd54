"""Quality checks: filters over atoms, bonds, and their aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spatial import pairs_within


def quality_flags(atoms: DataFrame) -> DataFrame:
    """(atom_index, flag): zero or out-of-range occupancy, negative B factor; an atom may have several."""
    flags = F.array_compact(F.array(F.when(F.col("occupancy") == 0, "zero_occupancy"), F.when((F.col("occupancy") < 0) | (F.col("occupancy") > 1), "occupancy_range"), F.when(F.col("b_factor") < 0, "negative_b")))
    return atoms.select("atom_index", F.explode(flags).alias("flag"))


def altloc_occupancy_sums(atoms: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(residue_index, atom_name, total): labelled groups whose occupancies do not add up to 1."""
    g = atoms.where("altloc is not null and altloc != ''").groupBy("residue_index", "atom_name").agg(F.sum("occupancy").alias("total"))
    return g.where(F.abs(F.col("total") - 1) > tolerance)


def b_factor_distribution(atoms: DataFrame, keys=()) -> DataFrame:
    """(keys, n, mean, variance, minimum, maximum, median); population variance, mean-of-middle median."""
    b = "b_factor"
    return atoms.where(F.col(b).isNotNull()).groupBy(*keys).agg(F.count(b).alias("n"), F.avg(b).alias("mean"), F.var_pop(b).alias("variance"), F.min(b).alias("minimum"), F.max(b).alias("maximum"), F.expr(f"percentile({b}, 0.5)").alias("median"))


def b_factor_outliers(atoms: DataFrame, threshold: float) -> DataFrame:
    """(atom_index, z) with |z| over the threshold; the statistics are one row."""
    s = atoms.agg(F.avg("b_factor").alias("m"), F.stddev_pop("b_factor").alias("s"))
    z = F.try_divide(F.col("b_factor") - F.col("m"), F.col("s"))
    return atoms.join(F.broadcast(s)).select("atom_index", z.alias("z")).where(F.abs("z") > threshold)


def completeness(expected: DataFrame, observed: DataFrame, chain: str = "chain", position: str = "position") -> DataFrame:
    """(chain, expected, observed, missing) of the sequence positions of each chain."""
    o = observed.select(chain, position).distinct().withColumn("seen", F.lit(1))
    j = expected.select(chain, position).distinct().join(o, [chain, position], "left")
    return j.groupBy(chain).agg(F.count("*").alias("expected"), F.count("seen").alias("observed")).withColumn("missing", F.col("expected") - F.col("observed"))


def overvalent_atoms(bonds: DataFrame, elements: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(atom, bonds, limit) of atoms with more bonds than their element takes."""
    ends = bonds.select(F.explode(F.array("atom_a", "atom_b")).alias("atom"))
    n = ends.groupBy("atom").agg(F.count("*").alias("bonds"))
    most = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    return n.join(elements.select("atom", "element"), "atom").select("atom", "bonds", F.try_element_at(most, F.col("element")).alias("limit")).where("bonds > limit")


def bond_lengths(bonds: DataFrame, points: DataFrame) -> DataFrame:
    """(atom_a, atom_b, length)."""
    a = points.select(F.col("atom").alias("atom_a"), *[F.col(c).alias(f"a{c}") for c in "xyz"])
    b = points.select(F.col("atom").alias("atom_b"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    d2 = sum(((F.col(f"a{c}") - F.col(f"b{c}")) * (F.col(f"a{c}") - F.col(f"b{c}")) for c in "xyz"), F.lit(0.0))
    return bonds.select("atom_a", "atom_b").join(a, "atom_a").join(b, "atom_b").select("atom_a", "atom_b", F.sqrt(d2).alias("length"))


def bond_length_deviations(bonds: DataFrame, points: DataFrame, radii: dict[str, float], tolerance: float) -> DataFrame:
    """(atom_a, atom_b, length, expected) whose length departs from the sum of radii by more than ``tolerance``."""
    if not tolerance >= 0:
        raise ValueError("a tolerance is not negative")
    r = F.create_map(*[F.lit(x) for kv in radii.items() for x in kv])
    e = points.select("atom", F.try_element_at(r, F.col("element")).alias("r"))
    d = bond_lengths(bonds, points).join(e.toDF("atom_a", "ra"), "atom_a").join(e.toDF("atom_b", "rb"), "atom_b")
    return d.select("atom_a", "atom_b", "length", (F.col("ra") + F.col("rb")).alias("expected")).where(F.abs(F.col("length") - F.col("expected")) > tolerance)


def clashes(points: DataFrame, bonds: DataFrame, max_radius: float, tolerance: float, radius: str = "radius") -> DataFrame:
    """(first, second, overlap): radii less distance over the tolerance, not bonded within three bonds."""
    e = bonds.select(F.col("atom_a").alias("u"), F.col("atom_b").alias("v"))
    e = e.union(e.select("v", "u")).distinct()
    reach = e
    path = e
    for _ in range(2):
        path = path.join(e.select(F.col("u").alias("v"), F.col("v").alias("w")), "v").select("u", F.col("w").alias("v")).distinct()
        reach = reach.union(path)
    # an atom takes what it is bonded with along, so that the pairs are not shuffled to meet the bonds
    near = reach.where("u != v").groupBy(F.col("u").alias("atom")).agg(F.collect_set("v").alias("bonded"))
    p = pairs_within(points.join(near, "atom", "left"), 2 * max_radius, extra=(radius, "bonded"))
    over = F.col(f"first_{radius}") + F.col(f"second_{radius}") - F.col("distance")
    hit = p.withColumn("overlap", over).where(F.col("overlap") > tolerance)
    return hit.where(~F.coalesce(F.array_contains("first_bonded", F.col("second")), F.lit(False))).select("first", "second", "overlap")


def clash_score(n_clashes: DataFrame, atoms: DataFrame) -> DataFrame:
    """(clash_score): clashes for a thousand atoms."""
    return n_clashes.agg(F.count("*").alias("c")).join(F.broadcast(atoms.agg(F.count("*").alias("n")))).select(F.try_divide(F.lit(1000.0) * F.col("c"), F.col("n")).alias("clash_score"))


def cis_peptides(omega: DataFrame, limit: float = 1.5707963267948966) -> DataFrame:
    """Rows (…, omega in radians) whose peptide bond is cis."""
    return omega.where(F.abs("omega") < limit)


def gaps(residues: DataFrame, keys=("chain",), number: str = "resid") -> DataFrame:
    """(keys, before, after): missing numbers between neighbouring residues."""
    w = Window.partitionBy(*keys).orderBy(number)
    d = residues.select(*keys, number).distinct().select(*keys, F.lag(number).over(w).alias("before"), F.col(number).alias("after"))
    return d.where("after - before > 1")
