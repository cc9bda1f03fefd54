"""Fixed-radius and nearest-neighbour joins over point tables (atom, x, y, z, ...).

Space is cut into cells as wide as the cutoff; points meet through an equi-join on cells, so a join
is a hash or sort-merge join of partitions, never a cross join. Pairs within one set visit 14 cells
(own and the 13 ahead) instead of 27. Cells with many points are met block by block, so that a task's
work is bounded however dense the points are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.graph import spread

#: Own cell first, then the half of the 26 around that is ahead in order.
HALF = [(0, 0, 0)] + [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0)]
FULL = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]


def _checked(cutoff: float) -> float:
    if not cutoff >= 0 or cutoff == float("inf"):
        raise ValueError("a cutoff is finite and not negative")
    return float(cutoff)


def _finite(df: DataFrame) -> DataFrame:
    """Points with three finite coordinates; others take no part."""
    ok = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf")) for c in "xyz"]
    return df.where(ok[0] & ok[1] & ok[2])


def _cells(df: DataFrame, width: float, offsets=None) -> DataFrame:
    at = [F.floor(F.col(c) / F.lit(width)).alias(f"c{c}") for c in "xyz"]
    df = df.select("*", *at)
    if offsets is None:
        return df
    steps = F.array(*[F.struct(*[F.lit(v).cast("long").alias(f"d{c}") for v, c in zip(o, "xyz", strict=True)]) for o in offsets])
    df = df.select("*", F.explode(steps).alias("o"))
    return df.select(*[c for c in df.columns if c not in ("cx", "cy", "cz", "o")], *[(F.col(f"c{c}") + F.col(f"o.d{c}")).alias(f"c{c}") for c in "xyz"], F.expr("o.dx = 0 and o.dy = 0 and o.dz = 0").alias("own"))


def squared_distance(a: str, b: str) -> Column:
    """Of two struct columns, or of two prefixes ending in ``_``."""
    dot = "" if a.endswith("_") else "."
    return sum(((F.col(f"{a}{dot}{c}") - F.col(f"{b}{dot}{c}")) * (F.col(f"{a}{dot}{c}") - F.col(f"{b}{dot}{c}")) for c in "xyz"), F.lit(0.0))


def _pick(df: DataFrame, prefix: str, keep) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in keep])


#: Points of either side that meet in one block of a cell.
BLOCK = 2048


def _meet(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The join of two sides by cell: block by block, in tasks of their own, where a cell holds more than a block.

    Points are dealt to the blocks of their cell by hash; each meets every block of the other side once.
    """
    cells = left.groupBy(*on).agg(F.count("*").alias("_l")).join(right.groupBy(*on).agg(F.count("*").alias("_r")), on)
    if (cells.agg(F.max(F.col("_l") * F.col("_r"))).first()[0] or 0) <= BLOCK * BLOCK:
        return left.join(right, on)
    blocks = cells.select(*on, *[F.ceil(F.col(c) / BLOCK).cast("long").alias(c) for c in ("_l", "_r")])
    own = lambda d, n: F.pmod(F.xxhash64(*[c for c in d.columns if c not in on]), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = left.join(blocks, on).select(*left.columns, own(left, "_l").alias("_i"), every("_r").alias("_j"))
    b = right.join(blocks, on).select(*right.columns, every("_l").alias("_i"), own(right, "_r").alias("_j"))
    return spread(a, *on, "_i", "_j").join(spread(b, *on, "_i", "_j").hint("merge"), [*on, "_i", "_j"]).drop("_i", "_j")


def met_within(points: DataFrame, cutoff: float, keys: tuple[str, ...] = (), extra: tuple[str, ...] = ()) -> DataFrame:
    """Each pair of ``pairs_within`` once, in either order: (keys, a_*, b_*, d2) with atom, x, y, z and ``extra`` of both."""
    r = _checked(cutoff)
    p = _finite(points)
    keep = list(dict.fromkeys(["atom", "x", "y", "z", *extra]))
    width = r if r > 0 else 1e-9
    left = _cells(p, width).select(*keys, "cx", "cy", "cz", *[F.col(c).alias(f"a_{c}") for c in keep])
    right = _cells(p, width, HALF).select(*keys, "cx", "cy", "cz", "own", *[F.col(c).alias(f"b_{c}") for c in keep])
    met = _meet(left, right, [*keys, "cx", "cy", "cz"]).where(((~F.col("own")) & (F.col("a_atom") != F.col("b_atom"))) | (F.col("own") & (F.col("a_atom") < F.col("b_atom"))))
    d2 = squared_distance("a_", "b_")
    return met.where(d2 <= F.lit(r) * F.lit(r)).withColumn("d2", d2).drop("cx", "cy", "cz", "own")


def pairs_within(points: DataFrame, cutoff: float, keys: tuple[str, ...] = (), extra: tuple[str, ...] = ()) -> DataFrame:
    """Unordered pairs with distance <= cutoff: (keys, first, second, distance, extras of both); first < second."""
    met = met_within(points, cutoff, keys, extra)
    swap = F.col("a_atom") > F.col("b_atom")
    out = [F.least("a_atom", "b_atom").alias("first"), F.greatest("a_atom", "b_atom").alias("second"), F.sqrt("d2").alias("distance")]
    for c in extra:
        out += [F.when(swap, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")).alias(f"first_{c}"), F.when(swap, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(f"second_{c}")]
    return met.select(*keys, *out)


def cross_pairs(first: DataFrame, second: DataFrame, cutoff: float, keys: tuple[str, ...] = (), extra: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of a point of ``first`` and one of ``second``: (keys, first, second, distance, extras)."""
    r = _checked(cutoff)
    width = r if r > 0 else 1e-9
    keep = list(dict.fromkeys(["atom", "x", "y", "z", *extra]))
    left = _cells(_finite(first), width).select(*keys, "cx", "cy", "cz", *[F.col(c).alias(f"a_{c}") for c in keep])
    right = _cells(_finite(second), width, FULL).select(*keys, "cx", "cy", "cz", *[F.col(c).alias(f"b_{c}") for c in keep])
    d2 = squared_distance("a_", "b_")
    met = _meet(left, right, [*keys, "cx", "cy", "cz"]).where(d2 <= F.lit(r) * F.lit(r))
    return met.select(*keys, F.col("a_atom").alias("first"), F.col("b_atom").alias("second"), F.sqrt(d2).alias("distance"), *[F.col(f"{p}_{c}").alias(f"{n}_{c}") for c in extra for p, n in (("a", "first"), ("b", "second"))])


def pairs_within_periodic(points: DataFrame, cutoff: float, box: tuple[float, float, float], keys: tuple[str, ...] = ()) -> DataFrame:
    """As ``pairs_within``, measured to the nearest image in an orthogonal box; needs cutoff <= half of each side."""
    r = _checked(cutoff)
    if any(r > side / 2 for side in box):
        raise ValueError("the cutoff reaches over half of the box")
    n = [max(1, int(side // r)) if r > 0 else 1 for side in box]
    p = _finite(points)
    for c, side, k in zip("xyz", box, n, strict=True):
        p = p.withColumn(f"w{c}", F.col(c) - F.lit(float(side)) * F.floor(F.col(c) / F.lit(float(side))))
        p = p.withColumn(f"c{c}", F.least(F.lit(k - 1), F.floor(F.col(f"w{c}") / F.lit(side / k))).cast("int"))
    left = p.select(*keys, "cx", "cy", "cz", F.col("atom").alias("first"), *[F.col(f"w{c}").alias(f"a_{c}") for c in "xyz"])
    around = p
    for c, k in zip("xyz", n, strict=True):
        around = around.withColumn(f"c{c}", F.explode(F.array_distinct(F.array(*[F.pmod(F.col(f"c{c}") + o, F.lit(k)) for o in (-1, 0, 1)]))))
    right = around.select(*keys, "cx", "cy", "cz", F.col("atom").alias("second"), *[F.col(f"w{c}").alias(f"b_{c}") for c in "xyz"])
    d2 = F.lit(0.0)
    for c, side in zip("xyz", box, strict=True):
        d = F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))
        d = F.least(d, F.lit(float(side)) - d)
        d2 = d2 + d * d
    return _meet(left, right, [*keys, "cx", "cy", "cz"]).where((F.col("first") < F.col("second")) & (d2 <= F.lit(r) * F.lit(r))).select(*keys, "first", "second", F.sqrt(d2).alias("distance"))


def within(points: DataFrame, targets: DataFrame, cutoff: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``points`` within ``cutoff`` of any target; targets themselves are in."""
    near = cross_pairs(points, targets, cutoff, keys).select(*keys, F.col("first").alias("atom"))
    found = near.unionByName(targets.select(*keys, "atom")).distinct()
    return points.join(found, [*keys, "atom"], "left_semi")


def around(points: DataFrame, targets: DataFrame, cutoff: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """``within`` without the targets."""
    return within(points, targets, cutoff, keys).join(targets.select(*keys, "atom"), [*keys, "atom"], "left_anti")


def beyond(points: DataFrame, targets: DataFrame, cutoff: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``points`` that ``within`` does not give."""
    return points.join(within(points, targets, cutoff, keys).select(*keys, "atom"), [*keys, "atom"], "left_anti")


def knn(queries: DataFrame, targets: DataFrame, k: int, start: float, keys: tuple[str, ...] = (), exclude_self: bool = True) -> DataFrame:
    """The k nearest targets of each query: (query, rank, target, distance); ties by target.

    Queries that find fewer than k within ``start`` are asked again with twice the radius, so each
    round is a fixed-radius join of the queries that are left. Where targets are dense the first radius is
    less than ``start``: about 8 k of them to a cube of its width, as points see it.
    """
    from ..functions.graph import cut

    q, t = _finite(queries), _finite(targets)
    ends = q.select("x", "y", "z").union(t.select("x", "y", "z")).agg(*[(F.max(c) - F.min(c)).alias(c) for c in "xyz"]).first()
    far = sum((v or 0.0) ** 2 for v in ends) ** 0.5  # no target is farther
    order = Window.partitionBy(*keys, "first").orderBy("distance", "second")
    out, radius, left = None, float(start), q
    n = F.count("*").cast("double")
    dense = _cells(t, radius).groupBy(*keys, "cx", "cy", "cz").agg(n.alias("n")).agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0.0
    while dense > 8 * max(1, k):
        radius, dense = radius / 2, dense / 8
    while True:
        met = cross_pairs(left, t, radius, keys)
        if exclude_self:
            met = met.where("first != second")
        ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ranked = cut(ranked.select(*keys, F.col("first").alias("query"), "rank", F.col("second").alias("target"), "distance"))
        full = ranked.where(F.col("rank") == k).select(*keys, F.col("query").alias("atom"))
        last = radius > far
        done = ranked if last else ranked.join(full.withColumnRenamed("atom", "query"), [*keys, "query"], "left_semi")
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        left = cut(left.join(full, [*keys, "atom"], "left_anti"))
        if not left.limit(1).count():
            return out
        radius *= 2


class _Grid:
    """Points of one task in small cells, of which two points are always within the radius; neighbours are up to two cells away."""

    STEPS = sorted(((a, b, c) for a in range(-2, 3) for b in range(-2, 3) for c in range(-2, 3)), key=lambda o: sum(v * v for v in o))

    def __init__(self, xyz: np.ndarray, radius: float) -> None:
        at = np.floor((xyz - xyz.min(axis=0)) / (radius / 3**0.5 * (1 - 1e-9))).astype(np.int64)
        side = at.max(axis=0) + 5
        self.turn = np.array([side[1] * side[2], side[2], 1])
        code = (at + 2) @ self.turn
        self.order = np.argsort(code, kind="stable")
        self.code, begin = np.unique(code[self.order], return_index=True)
        self.ends = np.append(begin, len(code))
        self.xyz, self.r2 = xyz[self.order], radius * radius

    def rows(self, cell: int) -> slice:
        return slice(self.ends[cell], self.ends[cell + 1])

    def beside(self, step) -> np.ndarray:
        """The cell that is ``step`` away from each, -1 where there is none."""
        want = self.code + np.array(step) @ self.turn
        k = np.minimum(np.searchsorted(self.code, want), len(self.code) - 1)
        return np.where(self.code[k] == want, k, -1)

    def near(self, a: int, b: int) -> bool:
        """Whether any points of two cells are within the radius: a few first, then all in blocks."""
        p, q = self.xyz[self.rows(a)], self.xyz[self.rows(b)]
        close = lambda u, v: bool((((u[:, None] - v[None]) ** 2).sum(axis=2) <= self.r2).any())
        if len(p) * len(q) > 4096 and close(p[:32], q[:32]):
            return True
        k = max(1, 1_000_000 // len(q))
        return any(close(p[i : i + k], q) for i in range(0, len(p), k))


def _tiles(points: DataFrame, radius: float, behind: bool) -> DataFrame:
    """Points by tiles of four radii, each with those up to a radius ahead of it (and behind): every pair within the radius shares a tile."""
    width, reach = 4 * radius, radius * (1 + 1e-9)
    p = _finite(points).select("atom", "x", "y", "z")
    for c in "xyz":
        low, high = F.floor((F.col(c) - F.lit(reach)) / width), F.floor((F.col(c) + F.lit(reach if behind else 0.0)) / width)
        p = p.withColumn(f"t{c}", F.explode(F.sequence(low, high)))
    own = F.lit(True)
    for c in "xyz":
        own = own & (F.floor(F.col(c) / width) == F.col(f"t{c}"))
    return spread(p.withColumn("own", own), "tx", "ty", "tz")


def radius_components(points: DataFrame, radius: float) -> DataFrame:
    """(node, comp) of all points with coordinates, joined by chains of points within ``radius``; comp is the smallest atom.

    Points of one small cell belong together, so tiles join cells and give one label a point; pairs are never made.
    """
    from ..functions.graph import components

    r = _checked(radius)
    atom = dict(points.dtypes)["atom"]
    if r == 0:
        same = _finite(points).groupBy("x", "y", "z").agg(F.min("atom").alias("b"), F.collect_list("atom").alias("a")).select(F.explode("a").alias("a"), "b")
        labels = same
    else:

        def joined(t: pa.Table) -> pa.Table:
            atoms = t["atom"].to_numpy()
            g = _Grid(np.stack([t[c].to_numpy() for c in "xyz"], axis=1), r)
            up = np.arange(len(g.code))

            def top(i: int) -> int:
                while up[i] != i:
                    up[i] = up[up[i]]
                    i = up[i]
                return i

            for step in g.STEPS:
                if step > (0, 0, 0):
                    to = g.beside(step)
                    for a in np.flatnonzero(to >= 0):
                        i, j = top(a), top(to[a])
                        if i != j and g.near(a, to[a]):
                            up[max(i, j)] = min(i, j)
            root = np.array([top(i) for i in range(len(up))])[np.repeat(np.arange(len(up)), np.diff(g.ends))]
            least = np.full(len(up), np.iinfo(np.int64).max)
            np.minimum.at(least, root, atoms[g.order])
            return pa.table({"a": pa.array(atoms[g.order]), "b": pa.array(least[root].astype(atoms.dtype))})

        labels = _tiles(points, r, False).groupBy("tx", "ty", "tz").applyInArrow(joined, f"a {atom}, b {atom}")
    found = components(labels)
    return _finite(points).select(F.col("atom").alias("node")).distinct().join(found, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))


def crowded(points: DataFrame, radius: float, minimum: int) -> DataFrame:
    """(atom) of points with at least ``minimum`` points within ``radius``, themselves included; pairs are never made."""
    r = _checked(radius)
    atom = dict(points.dtypes)["atom"]

    def counted(t: pa.Table) -> pa.Table:
        own = t["own"].to_numpy(zero_copy_only=False).astype(bool)
        g = _Grid(np.stack([t[c].to_numpy() for c in "xyz"], axis=1), r)
        have = np.diff(g.ends)
        core = np.repeat(have >= minimum, have)
        beside = np.stack([g.beside(s) for s in g.STEPS])
        for a in np.flatnonzero(have < minimum):
            p, n = g.xyz[g.rows(a)], np.zeros(have[a], dtype=int)
            for b in beside[:, a][beside[:, a] >= 0]:
                n += (((p[:, None] - g.xyz[g.rows(b)][None]) ** 2).sum(axis=2) <= g.r2).sum(axis=1)
                if (n >= minimum).all():
                    break
            core[g.rows(a)] = n >= minimum
        return pa.table({"atom": pa.array(t["atom"].to_numpy()[g.order][core & own[g.order]])})

    return _tiles(points, r, True).groupBy("tx", "ty", "tz").applyInArrow(counted, f"atom {atom}")


def first_few(rows: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """Rows with the ``k`` least (``order``) of each group of ``keys``: each Arrow batch keeps its own few, so not all rows are shuffled."""

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.lexsort([b.column(c).to_numpy(zero_copy_only=False) for c in (*reversed(order), *reversed(keys))])
            new = np.zeros(len(at), dtype=bool)
            for c in keys:
                v = b.column(c).to_numpy(zero_copy_only=False)[at]
                new[1:] |= v[1:] != v[:-1]
            new[:1] = True
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            yield b.take(pa.array(at[place < k]))

    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.mapInArrow(few, rows.schema).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def contact_map(points: DataFrame, cutoff: float, min_separation: int = 0) -> DataFrame:
    """Least distance of each residue pair: (res_a, res_b, min_distance, pairs).

    Points carry ``residue`` and ``chain``; pairs of one residue go, and pairs of one chain whose
    residues are at most ``min_separation`` apart.
    """
    p = pairs_within(points, cutoff, extra=("residue", "chain"))
    p = p.where("first_residue != second_residue")
    if min_separation:
        p = p.where((F.col("first_chain") != F.col("second_chain")) | (F.abs(F.col("first_residue") - F.col("second_residue")) > min_separation))
    return p.groupBy(F.least("first_residue", "second_residue").alias("res_a"), F.greatest("first_residue", "second_residue").alias("res_b")).agg(F.min("distance").alias("min_distance"), F.count("*").alias("pairs"))


def coordination_numbers(points: DataFrame, cutoff: float) -> DataFrame:
    """(atom, neighbours) of every point, none included."""
    p = pairs_within(points, cutoff)
    ends = p.select(F.explode(F.array("first", "second")).alias("atom"))
    return points.select("atom").join(ends.groupBy("atom").agg(F.count("*").alias("n")), "atom", "left").select("atom", F.coalesce("n", F.lit(0)).alias("neighbours"))


def radial_distribution(points: DataFrame, maximum: float, width: float, volume: float) -> DataFrame:
    """g(r) of one set: (bin, pairs, g); the ideal count is pairs * shell / volume."""
    n = points.count()
    ideal = n * (n - 1) / 2
    p = pairs_within(points, maximum).where(F.col("distance") < maximum)
    h = p.groupBy(F.floor(F.col("distance") / width).alias("bin")).agg(F.count("*").alias("pairs"))
    lo, hi = F.col("bin") * F.lit(width), (F.col("bin") + 1) * F.lit(width)
    shell = F.lit(4.0) * F.pi() * (hi * hi * hi - lo * lo * lo) / 3 / F.lit(volume)
    return h.select("bin", "pairs", (F.col("pairs") / (F.lit(float(ideal)) * shell)).alias("g"))


def linear_density(points: DataFrame, axis: str, low: float, high: float, bins: int, weight: str | None = None) -> DataFrame:
    """Weight for each unit of length along an axis, half open [low, high): (bin, weight, density)."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    width = (high - low) / bins
    inside = points.where((F.col(axis) >= low) & (F.col(axis) < high))
    b = F.least(F.lit(bins - 1), F.floor((F.col(axis) - low) / width))
    return inside.groupBy(b.alias("bin")).agg(F.sum(w).alias("weight")).withColumn("density", F.col("weight") / F.lit(width))


def density_map(points: DataFrame, spacing: float, origin=(0.0, 0.0, 0.0), weight: str | None = None) -> DataFrame:
    """Weight for each unit of volume by voxel: (ix, iy, iz, density)."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    at = [F.floor((F.col(c) - F.lit(o)) / F.lit(spacing)).alias(f"i{c}") for c, o in zip("xyz", origin, strict=True)]
    return _finite(points).groupBy(*at).agg((F.sum(w) / F.lit(spacing**3)).alias("density"))


def contact_potential(voxels: DataFrame, charges: DataFrame, cutoff: float, constant: float = 332.0637) -> DataFrame:
    """Screened potential at voxels (atom, x, y, z): sum of q K / (4 max(d^2, 1)) within the cutoff."""
    met = cross_pairs(voxels.withColumn("charge", F.lit(0.0)), charges, cutoff, extra=("charge",))
    term = F.col("second_charge") * F.lit(constant) / (4 * F.greatest(F.col("distance") * F.col("distance"), F.lit(1.0)))
    return met.groupBy(F.col("first").alias("atom")).agg(F.sum(term).alias("potential"))


def half_sphere_exposure(sites: DataFrame, radius: float) -> DataFrame:
    """Neighbours above and below each site (atom, x, y, z, vx, vy, vz): up counts a positive projection on v."""
    plain = sites.select("atom", "x", "y", "z", "vx", "vy", "vz")
    met = cross_pairs(plain, plain, radius, extra=("x", "y", "z", "vx", "vy", "vz")).where("first != second")
    dot = sum(((F.col(f"second_{c}") - F.col(f"first_{c}")) * F.col(f"first_v{c}") for c in "xyz"), F.lit(0.0))
    n = met.groupBy(F.col("first").alias("atom")).agg(F.sum((dot > 0).cast("long")).alias("up"), F.sum((dot <= 0).cast("long")).alias("down"))
    return sites.select("atom").join(n, "atom", "left").select("atom", F.coalesce("up", F.lit(0)).alias("up"), F.coalesce("down", F.lit(0)).alias("down"))


def interface(points: DataFrame, chain_a, chain_b, cutoff: float) -> DataFrame:
    """Residues of two chains with an atom within ``cutoff`` of the other chain: (chain, residue)."""
    p = points.select("atom", "x", "y", "z", "chain", "residue")
    met = cross_pairs(p.where(F.col("chain") == chain_a), p.where(F.col("chain") == chain_b), cutoff, extra=("chain", "residue"))
    return met.select(F.explode(F.array(F.struct(F.col("first_chain").alias("chain"), F.col("first_residue").alias("residue")), F.struct(F.col("second_chain").alias("chain"), F.col("second_residue").alias("residue")))).alias("r")).select("r.*").distinct()


def native_contacts(reference: DataFrame, target: DataFrame, cutoff: float, tolerance: float) -> DataFrame:
    """Share of reference contacts that the target keeps: (native, kept, fraction)."""
    ref = pairs_within(reference, cutoff)
    t = _finite(target)
    a = t.select(F.col("atom").alias("first"), *[F.col(c).alias(f"a_{c}") for c in "xyz"])
    b = t.select(F.col("atom").alias("second"), *[F.col(c).alias(f"b_{c}") for c in "xyz"])
    met = ref.join(a, "first", "left").join(b, "second", "left")
    kept = F.coalesce(F.sqrt(squared_distance("a_", "b_")) <= F.lit(cutoff + tolerance), F.lit(False))
    return met.agg(F.count("*").alias("native"), F.sum(kept.cast("long")).alias("kept")).select("native", F.coalesce("kept", F.lit(0)).alias("kept"), F.try_divide("kept", "native").alias("fraction"))
