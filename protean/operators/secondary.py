"""Secondary structure of backbones by hydrogen-bond patterns, and backbones from torsions.

Donor-acceptor pairs come from a cell join on C-alpha positions and stay in the JVM with their
energies, as do bends and torsion ranges, which are windows over a model. Only the ladders, whose
bulges are joined one after the other, run in an Arrow kernel, a model at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.graph import cut
from . import geometry as g
from .backbone import _COULOMB
from .spatial import pairs_within

#: Reach of C-alphas of a pair, longest peptide bond, weakest bond, least energy, bend (degrees).
REACH, PEPTIDE, LIMIT, LEAST, BEND = 9.0, 2.5, -0.5, -9.9, 70.0
#: Centre of phi and psi of a polyproline helix and the half width of both, in degrees.
PHI, PSI, HALF = -75.0, 145.0, 29.0
#: A trace of C-alphas alone; the longest step, and distances over three steps in helices and strands.
STEP, HELIX, STRAND = 4.5, (3.08, 7.28), (8.98, 11.82)


def _whole(p: str) -> Column:
    """A position is there, with finite numbers."""
    out = F.col(p).isNotNull()
    for c in "xyz":
        v = F.col(p)[c]
        out = out & F.coalesce((v == v) & ~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))
    return out


def indexed(residues: DataFrame, keys: list[str], chain: str, order: str) -> DataFrame:
    """``residues`` (name, n, ca, c, o) by place i in their model, with what their neighbours tell.

    ``ok``: all four atoms are there; ``h``: the amide hydrogen, at N where the residue before has no carbonyl
    and null for proline; ``link``: bonded to the residue before; ``bend`` and ``ppii`` as in ``assign``.
    """
    w = Window.partitionBy(*keys).orderBy(chain, order)
    c = F.col
    d = residues.select(*keys, chain, order, "name", *[F.when(_whole(p), c(p)).alias(p) for p in ("n", "ca", "c", "o")])
    d = d.select("*", (F.row_number().over(w) - 1).alias("i"), F.lag(F.struct(chain, "c", "o")).over(w).alias("_b"), F.lead("n").over(w).alias("_n"), F.lag("ca", 2).over(w).alias("_p2"), F.lead("ca", 2).over(w).alias("_q2"))
    same = F.coalesce(c("_b")[chain].eqNullSafe(c(chain)) & c("_b").isNotNull(), F.lit(False))
    co = g.sub(c("_b.c"), c("_b.o"))
    far = g.norm(co)
    along = F.struct(*[(c("n")[k] + co[k] / far).alias(k) for k in "xyz"])
    d = d.withColumns({
        "ok": c("n").isNotNull() & c("ca").isNotNull() & c("c").isNotNull() & c("o").isNotNull(),
        "link": same & F.coalesce(g.distance(c("_b.c"), c("n")) <= PEPTIDE, F.lit(False)),
        "h": F.when(F.coalesce(c("name") == "PRO", F.lit(False)), F.lit(None)).otherwise(F.when(same & F.coalesce(far > 1e-6, F.lit(False)), along).otherwise(c("n"))),
        "phi": F.degrees(g.dihedral(c("_b.c"), c("n"), c("ca"), c("c"))),
        "psi": F.degrees(g.dihedral(c("n"), c("ca"), c("c"), c("_n"))),
    })
    at = lambda k: F.coalesce(F.lead("link", k).over(w) if k > 0 else F.lag("link", -k).over(w), F.lit(False))
    a, b = g.sub(c("ca"), c("_p2")), g.sub(c("_q2"), c("ca"))
    size = F.sqrt(g.dot(a, a) * g.dot(b, b))
    near = lambda v, to: F.abs(c(v) - to) <= HALF
    d = d.withColumns({
        "bend": at(-1) & c("link") & at(1) & at(2) & F.coalesce((size > 0) & (g.dot(a, b) < size * math.cos(math.radians(BEND))), F.lit(False)),
        "ppii": c("link") & at(1) & F.coalesce(near("phi", PHI) & near("psi", PSI), F.lit(False)),
    })
    return d.drop("_b", "_n", "_p2", "_q2", "phi", "psi")


def backbone_bonds(placed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, acceptor, donor, energy): the two strongest acceptors of each donor, over all chains of a model.

    Energies are rounded to 0.001 kcal/mol and not under -9.9; ties go to the acceptor that comes first.
    """
    c = F.col
    at = placed.where("ok").select(*keys, c("i").alias("atom"), *[c("ca")[k].alias(k) for k in "xyz"], F.struct("n", "h", "c", "o").alias("r"))
    met = pairs_within(at, REACH, tuple(keys), ("r",))
    ways = F.array(
        F.struct(c("second").alias("acceptor"), c("first").alias("donor"), c("second_r").alias("a"), c("first_r").alias("d")),
        F.struct(c("first").alias("acceptor"), c("second").alias("donor"), c("first_r").alias("a"), c("second_r").alias("d")),
    )
    met = met.select(*keys, F.explode(ways).alias("p")).select(*keys, "p.*").where("donor != acceptor + 1 and d.h is not null")
    met = met.select(*keys, "acceptor", "donor", *[g.distance(c(p), c(q)).alias(n) for n, p, q in (("on", "a.o", "d.n"), ("ch", "a.c", "d.h"), ("oh", "a.o", "d.h"), ("cn", "a.c", "d.n"))])
    e = F.round(F.lit(_COULOMB) * (1 / c("on") + 1 / c("ch") - 1 / c("oh") - 1 / c("cn")), 3)
    e = F.when(F.least("on", "ch", "oh", "cn") < 0.5, F.lit(LEAST)).otherwise(F.greatest(e, F.lit(LEAST)))
    w = Window.partitionBy(*keys, "donor").orderBy("energy", "acceptor")
    return met.select(*keys, "acceptor", "donor", e.alias("energy")).where(c("energy") < LIMIT).withColumn("_r", F.row_number().over(w)).where("_r <= 2").drop("_r")


def _bridges(bonds: set[tuple[int, int]], run: np.ndarray, ca: np.ndarray) -> list[tuple[int, int, bool]]:
    """(i, j, parallel) in order, from the four patterns of two bonds; bonds are (acceptor, donor)."""
    last = len(run) - 1
    tried = set()
    for a, d in bonds:
        # where a bond is the first of a pattern: parallel (two), antiparallel wide and narrow
        tried |= {(d - 1, a), (a, d - 1), (d - 1, a + 1), (a, d)}
    out = []
    for i, j in sorted(t for t in tried if t[0] >= 1 and t[1] >= t[0] + 3 and t[1] < last):
        if run[i - 1] != run[i + 1] or run[j - 1] != run[j + 1] or ((ca[i] - ca[j]) ** 2).sum() > REACH * REACH:
            continue
        if {(j, i + 1), (i - 1, j)} <= bonds or {(i, j + 1), (j - 1, i)} <= bonds:
            out.append((i, j, True))
        elif {(j - 1, i + 1), (i - 1, j + 1)} <= bonds or {(i, j), (j, i)} <= bonds:
            out.append((i, j, False))
    return out


def _ladders(bridges: list[tuple[int, int, bool]], run: np.ndarray) -> list[list]:
    """[parallel, first i, last i, first j, last j, bridges]: neighbouring bridges, then across bulges."""
    open_, ladders = {}, []
    for i, j, parallel in bridges:
        k = open_.pop((parallel, i - 1, j - 1 if parallel else j + 1), None)
        if k is None:
            k = len(ladders)
            ladders.append([parallel, i, i, j, j, 1])
        else:
            got = ladders[k]
            got[2], got[5] = i, got[5] + 1
            got[4 if parallel else 3] = j
        open_[parallel, i, j] = k
    ladders.sort(key=lambda t: (t[1], t[3]))
    k = 0
    while k < len(ladders):
        one, m = ladders[k], k + 1
        while m < len(ladders) and ladders[m][1] - one[2] < 6:
            two = ladders[m]
            i_gap = two[1] - one[2]
            j_gap = two[3] - one[4] if one[0] else one[3] - two[4]
            whole = run[one[1]] == run[max(one[2], two[2])] and run[min(one[3], two[3])] == run[max(one[4], two[4])]
            if one[0] == two[0] and i_gap > 0 and whole and 0 <= j_gap < (6 if i_gap < 3 else 3):
                one[2], one[3], one[4], one[5] = two[2], min(one[3], two[3]), max(one[4], two[4]), one[5] + two[5]
                del ladders[m]
            else:
                m += 1
        k += 1
    return ladders


def states_of(link: np.ndarray, bend: np.ndarray, ppii: np.ndarray, ca: np.ndarray, bonds: set[tuple[int, int]]) -> np.ndarray:
    """Letters of the residues of a model: H, G, I, E, B, T, S, P, else C."""
    n = len(link)
    run, out = np.cumsum(~link), np.full(n, "C", dtype=object)
    for _, i0, i1, j0, j1, size in _ladders(_bridges(bonds, run, ca), run):
        for lo, hi in ((i0, i1), (j0, j1)):
            part = out[lo : hi + 1]
            part[part != "E"] = "E" if size > 1 else "B"
    begins = {s: np.zeros(n, bool) for s in (3, 4, 5)}
    for a, d in bonds:
        if d - a in begins and run[a] == run[d]:
            begins[d - a][a] = True
    # two turns that begin side by side make a helix; alpha takes what it finds, pi may take alpha
    for s, letter, over in ((4, "H", None), (3, "G", "CG"), (5, "I", "CIH")):
        for i in np.flatnonzero(begins[s][1:] & begins[s][:-1]) + 1:
            part = out[i : i + s]
            if over is None or all(v in over for v in part):
                part[:] = letter
    turn = np.zeros(n, bool)
    for s, at in begins.items():
        for k in range(1, s):
            turn[k:] |= at[:-k]
    out[(out == "C") & turn] = "T"
    out[(out == "C") & bend] = "S"
    three = ppii[:-2] & ppii[1:-1] & ppii[2:] if n > 2 else np.zeros(0, bool)
    spread = np.zeros(n, bool)
    for k in range(3):
        spread[k : k + len(three)] |= three
    out[(out == "C") & spread] = "P"
    return out


def trace_states(ca: np.ndarray) -> np.ndarray:
    """Letters of a chain known by C-alphas alone (nan where unknown): H, E, C, and null without a position."""
    n = len(ca)
    there = ~np.isnan(ca).any(axis=1)
    out = np.where(there, "C", None).astype(object)
    if n < 4:
        return out
    step = np.sqrt(((ca[1:] - ca[:-1]) ** 2).sum(axis=1)) <= STEP
    far = np.sqrt(((ca[3:] - ca[:-3]) ** 2).sum(axis=1))
    whole = step[:-2] & step[1:-1] & step[2:]
    for letter, (lo, hi) in (("E", STRAND), ("H", HELIX)):
        at = whole & (far >= lo) & (far <= hi)
        for k in range(4):
            out[k : k + len(at)][at] = letter
    return out


def assign(residues: DataFrame, keys: list[str], chain: str = "chain", order: str = "resid", given: str | None = None) -> DataFrame:
    """(keys, chain, order, state, source) of residues (name, and positions n, ca, c, o as structs).

    Letters: H, G, I (helices over 4, 3 and 5), E (ladder), B (bridge), T (turn), S (bend), P (polyproline), C.
    Source: dssp; ca_only for chains with no other backbone atom; file where ``given`` has a letter, which is kept;
    none, with a null state, for residues that lack an atom. ``order`` ranks the residues of a chain; bonds join
    chains of one model (``keys``), patterns stay within unbroken stretches. Rows are ranked by chain and order,
    so repeated ones must have been resolved.
    """
    placed = cut(indexed(residues, keys, chain, order))  # read by both sides of the pairs and by the kernel
    kinds = dict(residues.dtypes)

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a = a.sort_values("i", ignore_index=True)
        ca = a[["x", "y", "z"]].to_numpy(float)
        got = states_of(a["link"].to_numpy(bool), a["bend"].to_numpy(bool), a["ppii"].to_numpy(bool), ca, set(zip(b["acceptor"], b["donor"], strict=True)))
        state, source = np.where(a["ok"], got, None), np.where(a["ok"], "dssp", "none").astype(object)
        for _, at in a.groupby(chain, dropna=False).indices.items():
            if not a["more"].to_numpy(bool)[at].any():
                state[at] = trace_states(ca[at])
                source[at] = ["none" if v is None else "ca_only" for v in state[at]]
        return pd.DataFrame({**{k: a[k] for k in [*keys, chain, order]}, "state": state, "source": source})

    c = F.col
    left = placed.select(*keys, chain, order, "i", "ok", "link", "bend", "ppii", *[c("ca")[k].alias(k) for k in "xyz"], (c("n").isNotNull() | c("c").isNotNull() | c("o").isNotNull()).alias("more"))
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, chain, order]) + ", state string, source string"
    bonds = backbone_bonds(placed, keys).select(*[c(k).alias(f"_k_{k}") for k in keys], "acceptor", "donor")
    out = left.groupBy(*keys).cogroup(bonds.groupBy(*[f"_k_{k}" for k in keys])).applyInPandas(kernel, schema)
    if not given:
        return out
    out = out.join(residues.select(*keys, chain, order, c(given).alias("_given")), [*keys, chain, order])
    kept = c("_given").isNotNull() & (c("_given") != "")
    return out.select(*keys, chain, order, F.when(kept, c("_given")).otherwise(c("state")).alias("state"), F.when(kept, "file").otherwise(c("source")).alias("source"))


#: Lengths (A) and angles (degrees) of an ideal backbone.
BONDS_OF = {"n_ca": 1.458, "ca_c": 1.525, "c_n": 1.329, "c_o": 1.231}
ANGLES_OF = {"n": 121.7, "ca": 111.0, "c": 117.2, "o": 120.1}


def _next(a: np.ndarray, b: np.ndarray, c: np.ndarray, length: float, angle: float, torsion: float) -> np.ndarray:
    """The point at a length from c, an angle at c and a torsion about b-c (degrees)."""
    t, p = math.radians(angle), math.radians(torsion)
    u = (c - b) / np.linalg.norm(c - b)
    v = np.cross(b - a, u)
    v /= np.linalg.norm(v)
    return c + length * (-math.cos(t) * u + math.sin(t) * (math.cos(p) * np.cross(v, u) + math.sin(p) * v))


def backbone_positions(torsions: DataFrame, keys: list[str], order: str = "resid") -> DataFrame:
    """``torsions`` (keys, order, phi, psi, omega; degrees) with positions n, ca, c, o of an ideal backbone.

    The first residue of a chain (``keys``) stands at the origin. A chain is built by one task, point by
    point. Null torsions count as 180.
    """
    point = "struct<x: double, y: double, z: double>"
    names = ("n", "ca", "c", "o")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        phi, psi, omega = (pdf[k].fillna(180.0).to_numpy(float) for k in ("phi", "psi", "omega"))
        at = math.radians(ANGLES_OF["ca"])
        n, ca = np.zeros(3), np.array([BONDS_OF["n_ca"], 0.0, 0.0])
        c = ca + BONDS_OF["ca_c"] * np.array([-math.cos(at), math.sin(at), 0.0])
        rows = []
        for k in range(len(pdf)):
            if k:
                n = _next(n, ca, c, BONDS_OF["c_n"], ANGLES_OF["c"], psi[k - 1])
                ca = _next(ca, c, n, BONDS_OF["n_ca"], ANGLES_OF["n"], omega[k])
                c = _next(c, n, ca, BONDS_OF["ca_c"], ANGLES_OF["ca"], phi[k])
            rows.append((n, ca, c, _next(n, ca, c, BONDS_OF["c_o"], ANGLES_OF["o"], psi[k] + 180.0)))
        for name, column in zip(names, zip(*rows, strict=True), strict=True):
            pdf[name] = [{"x": p[0], "y": p[1], "z": p[2]} for p in map(np.ndarray.tolist, column)]
        return pdf

    schema = ", ".join(f"`{c}` {t}" for c, t in torsions.dtypes) + "".join(f", {n} {point}" for n in names)
    return torsions.groupBy(*keys).applyInPandas(build, schema)
