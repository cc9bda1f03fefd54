"""Secondary structure, backbones from torsions, and splits and totals, against serial plain Python."""

import itertools
import math

import numpy as np
import pytest
from protean.functions.graph import cut
from protean.functions.totals import running
from protean.operators import crystal, dataset, secondary
from pyspark.sql import functions as F

POINT = "struct<x: double, y: double, z: double>"
RESIDUES = f"model int, chain string, resid int, name string, n {POINT}, ca {POINT}, c {POINT}, o {POINT}"


def _states(rows, keys):
    out = {}
    for r in sorted(rows, key=lambda r: (r.model, r.chain, r.resid)):
        out.setdefault(tuple(r[k] for k in keys), []).append(r.state or "-")
    return {k: "".join(v) for k, v in out.items()}


def _ideal(spark, basins, n=16):
    rows = [(m, "A", i, "ALA", float(phi), float(psi), 180.0) for m, (phi, psi) in enumerate(basins) for i in range(n)]
    return cut(secondary.backbone_positions(spark.createDataFrame(rows, "model int, chain string, resid int, name string, phi double, psi double, omega double"), ["model", "chain"]))


def test_ideal_backbones(spark):
    b = _ideal(spark, [(-57, -47), (-60, -27), (-57, -70), (-75, 145), (-120, 130)])
    got = _states(secondary.assign(b, ["model"]).collect(), ["model"])
    assert got == {(k,): "C" + s * 14 + "C" for k, s in enumerate("HGIPC")}
    trace = b.withColumns({c: F.lit(None).cast(POINT) for c in ("n", "c", "o")})
    rows = secondary.assign(trace, ["model"]).collect()
    assert _states(rows, ["model"]) == {(k,): s * 16 for k, s in enumerate("HHHEE")} and {r.source for r in rows} == {"ca_only"}


def test_backbones_have_the_torsions_they_were_built_from(spark):
    from protean.operators import backbone

    b = _ideal(spark, [(-57, -47), (-120, 130)])
    for r in backbone.backbone_torsions(b, ["model", "chain"]).collect():
        want = [(-57, -47), (-120, 130)][r.model]
        assert r.phi is None or math.isclose(math.degrees(r.phi), want[0], abs_tol=1e-6)
        assert r.psi is None or math.isclose(math.degrees(r.psi), want[1], abs_tol=1e-6)
        assert r.omega is None or math.isclose(abs(math.degrees(r.omega)), 180, abs_tol=1e-6)


def test_missing_atoms_and_given_states(spark):
    b = _ideal(spark, [(-57, -47)]).withColumn("o", F.when(F.col("resid") != 8, F.col("o"))).withColumn("file", F.when(F.col("resid") == 2, "E").when(F.col("resid") == 3, ""))
    rows = {r.resid: (r.state, r.source) for r in secondary.assign(b, ["model"], given="file").collect()}
    assert rows[8] == (None, "none") and rows[2] == ("E", "file") and rows[3] == ("H", "dssp") and len(rows) == 16
    assert secondary.assign(b.limit(0), ["model"]).count() == 0
    nothing = b.withColumns({c: F.lit(None).cast(POINT) for c in ("n", "ca", "c", "o")})
    assert {(r.state, r.source) for r in secondary.assign(nothing, ["model"]).collect()} == {(None, "none")}


def _serial(res):
    """The published procedure, step by step, over all pairs: res is a list of (chain, name, n, ca, c, o) of one model."""
    n = len(res)
    d = lambda a, b: math.dist(a, b)
    link = [k > 0 and res[k - 1][0] == res[k][0] and d(res[k - 1][4], res[k][2]) <= 2.5 for k in range(n)]
    unbroken = lambda a, b: 0 <= a and b < n and all(link[a + 1 : b + 1])
    hydrogen = []
    for k in range(n):
        h = np.array(res[k][2])
        if k and res[k - 1][0] == res[k][0]:
            co = np.array(res[k - 1][4]) - np.array(res[k - 1][5])
            h = h + co / np.linalg.norm(co)
        hydrogen.append(None if res[k][1] == "PRO" else h)
    best = {}
    for don, acc in itertools.permutations(range(n), 2):
        if don == acc + 1 or hydrogen[don] is None or d(res[don][3], res[acc][3]) > 9:
            continue
        far = [d(res[acc][5], res[don][2]), d(res[acc][4], hydrogen[don]), d(res[acc][5], hydrogen[don]), d(res[acc][4], res[don][2])]
        e = -9.9 if min(far) < 0.5 else max(-9.9, round(27.888 * (1 / far[0] + 1 / far[1] - 1 / far[2] - 1 / far[3]), 3))
        best.setdefault(don, []).append((e, acc))
    hb = {(don, acc) for don, v in best.items() for e, acc in sorted(v)[:2] if e < -0.5}
    ladders = []
    for i in range(1, n - 1):
        for j in range(i + 3, n - 1):
            if not unbroken(i - 1, i + 1) or not unbroken(j - 1, j + 1) or d(res[i][3], res[j][3]) > 9:
                continue
            if ((i + 1, j) in hb and (j, i - 1) in hb) or ((j + 1, i) in hb and (i, j - 1) in hb):
                kind = 1
            elif ((i + 1, j - 1) in hb and (j + 1, i - 1) in hb) or ((j, i) in hb and (i, j) in hb):
                kind = -1
            else:
                continue
            for lad in ladders:
                if lad[0] == kind and lad[1][-1] == i - 1 and lad[2][-1] == j - kind:
                    lad[1].append(i)
                    lad[2].append(j)
                    break
            else:
                ladders.append((kind, [i], [j]))
    ladders = sorted([k, i, sorted(j)] for k, i, j in ladders)
    ladders.sort(key=lambda t: (t[1][0], t[2][0]))
    a = 0
    while a < len(ladders):
        b = a + 1
        while b < len(ladders):
            (k1, i1, j1), (k2, i2, j2) = ladders[a], ladders[b]
            gap = i2[0] - i1[-1]
            other = j2[0] - j1[-1] if k1 == 1 else j1[0] - j2[-1]
            ok = k1 == k2 and 0 < gap < 6 and unbroken(min(i1[0], i2[0]), max(i1[-1], i2[-1])) and unbroken(min(j1[0], j2[0]), max(j1[-1], j2[-1]))
            if ok and ((0 <= other < 6 and gap < 3) or 0 <= other < 3):
                ladders[a] = [k1, i1 + i2, sorted(j1 + j2)]
                del ladders[b]
            else:
                b += 1
        a += 1
    s = ["C"] * n
    for _, i, j in ladders:
        for part in (i, j):
            for k in range(part[0], part[-1] + 1):
                if s[k] != "E":
                    s[k] = "E" if len(i) > 1 else "B"
    start = lambda k, size: k >= 0 and (k + size, k) in hb and unbroken(k, k + size)
    for size, letter in ((4, "H"), (3, "G"), (5, "I")):
        for k in range(1, n - size):
            if start(k, size) and start(k - 1, size):
                span = range(k, k + size)
                if size == 4 or all(s[m] in ("C", letter) or (size == 5 and s[m] == "H") for m in span):
                    for m in span:
                        s[m] = letter
    for k in range(1, n - 1):
        if s[k] == "C":
            if any(start(k - m, size) for size in (3, 4, 5) for m in range(1, size)):
                s[k] = "T"
            elif unbroken(k - 2, k + 2):
                u, v = np.array(res[k][3]) - res[k - 2][3], np.array(res[k + 2][3]) - res[k][3]
                if math.degrees(math.acos(np.clip(u @ v / np.linalg.norm(u) / np.linalg.norm(v), -1, 1))) > 70:
                    s[k] = "S"
    return "".join(s)


def test_random_backbones_match_the_serial_procedure(spark):
    """Points in small boxes: bonds, bridges of both kinds, bulges and breaks abound."""
    rng, rows, torsions = np.random.default_rng(8), [], []
    basins = [(-57, -47), (-60, -27), (-57, -70), (-75, 145), (-120, 130), (55, 45)]
    for m in range(40):
        for chain in "AB":
            ca = np.cumsum(rng.normal(0, 1.2 + m % 4 * 0.4, (28, 3)), axis=0) * 0.5
            for i in range(28):
                name = "PRO" if rng.random() < 0.05 else "ALA"
                if m < 20:
                    at = [ca[i] + rng.normal(0, 0.8, 3) for _ in range(3)]
                    rows.append((m, chain, i, name, *[tuple(map(float, p)) for p in (at[0], ca[i], at[1], at[2])]))
                else:  # stretches of one conformation, two chains through each other
                    basin = basins[(m + i // 7 * (1 + m % 5)) % 6]
                    torsions.append((m, chain, i, name, *[float(v + rng.normal(0, 4 * (m % 3))) for v in basin], 180.0))
    built = secondary.backbone_positions(spark.createDataFrame(torsions, "model int, chain string, resid int, name string, phi double, psi double, omega double"), ["model", "chain"])
    rows += [(r.model, r.chain, r.resid, r.name, *[tuple(p) if r.chain == "A" else (p.x, p.z + 4.0, -p.y) for p in (r.n, r.ca, r.c, r.o)]) for r in built.collect()]
    got = _states(secondary.assign(spark.createDataFrame(rows, RESIDUES), ["model"]).collect(), ["model"])
    want = {(m,): _serial([(r[1], *r[3:]) for r in rows if r[0] == m]) for m in range(40)}
    seen = "".join(want.values())
    assert all(c in seen for c in "HGIEBTSC"), sorted(set(seen))
    for m in range(40):
        no_p = [(g, w) for g, w in zip(got[m,], want[m,], strict=True) if g != "P"]
        assert all(g == w for g, w in no_p) and all(w == "C" for g, w in zip(got[m,], want[m,], strict=True) if g == "P")


def test_an_antiparallel_hairpin_and_a_lone_bridge():
    n = 16
    link, off = np.array([False] + [True] * (n - 1)), np.zeros(n, bool)
    near = np.zeros((n, 3))
    bonds = {(3, 12), (12, 3), (5, 10), (10, 5)}
    assert "".join(secondary.states_of(link, off, off, near, bonds)) == "CCCEEETTTTEEECCC"  # the innermost bond is a turn over five
    assert "".join(secondary.states_of(link, off, off, near, {(3, 12), (12, 3)})) == "CCCBCCCCCCCCBCCC"


@pytest.mark.parametrize("shares", [{"train": 0.8, "validation": 0.1, "test": 0.1}, {"a": 1 / 3, "b": 0.5, "none": 0.0}, {"x": 0.0, "y": 0.0}])
def test_splits_of_clusters_match_the_serial_filling(spark, shares):
    from fractions import Fraction

    rng = np.random.default_rng(3)
    rows = [(int(i), None if rng.random() < 0.2 else f"c{int(rng.pareto(0.6)) % 60}") for i in rng.permutation(700)]
    got = {r.id: r.split for r in dataset.split_clusters(spark.createDataFrame(rows, "id long, cluster string"), "cluster", shares).collect()}
    groups = {}
    for i, c in rows:
        groups.setdefault(c if c is not None else i, []).append(i)
    part = {k: Fraction(str(v)) for k, v in shares.items() if v} or dict.fromkeys(shares, Fraction(1))
    fill, want = dict.fromkeys(part, 0), {}
    for g in sorted(groups.values(), key=lambda g: (-len(g), min(g))):
        to = min(part, key=lambda k: (fill[k] / part[k], list(part).index(k)))
        fill[to] += len(g)
        want |= dict.fromkeys(g, to)
    assert got == want


def test_levels_beyond_64_bits():
    to, got = dataset._dealt([10**20, 0], [1, 3], 10**19, np.array([0, 1, 40, 41]))
    assert to.tolist()[0] == 1 and sum(got[-1]) == 41 and 10**20 + int(got[-1][0]) * 10**19 > 0


def test_running_totals_and_batches(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), None if i % 11 == 0 else int(rng.integers(1, 90))) for i in rng.permutation(500)]
    d = spark.createDataFrame(rows, "id long, atom_count long")
    total, want = 0, {}
    for i, v in sorted(rows):
        want[i], total = total, total + (v or 0)
    assert {r.id: r.before for r in running(d, [F.asc("id")], F.col("atom_count"), "before").collect()} == want
    assert {r.id: r.batch for r in dataset.batches(d, 300).collect()} == {k: v // 300 for k, v in want.items()}
    assert dataset.batches(d.limit(0), 300).count() == 0


def test_structure_factors_match_their_sum(spark):
    rng = np.random.default_rng(2)
    at = rng.random((700, 4))
    hkl = [(int(a), int(b), int(c)) for a, b, c in rng.integers(-9, 9, (60, 3))]
    atoms = spark.createDataFrame([tuple(map(float, r)) for r in at] + [(None, 0.1, 0.1, 1.0)], "u double, v double, w double, occupancy double")
    got = {(r.h, r.k, r.l): complex(r.re, r.im) for r in crystal.structure_factors(atoms, spark.createDataFrame(hkl, "h int, k int, l int")).collect()}
    assert got.keys() == set(hkl)
    assert all(abs(f - (at[:, 3] * np.exp(2j * np.pi * (at[:, :3] @ np.array(k)))).sum()) < 1e-8 for k, f in got.items())
    with pytest.raises(ValueError):
        crystal.structure_factors(atoms, spark.createDataFrame(hkl, "h int, k int, l int"), limit=10)
