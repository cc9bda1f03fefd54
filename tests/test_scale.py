"""Work and memory of single tasks, and results against plain forms of the same job."""

import numpy as np
from pyspark.sql import functions as F


def _cloud(spark, n, seed=0, copies=1):
    x = np.random.default_rng(seed).normal(0, 0.13, (n, 3)).round(3)
    return spark.createDataFrame([(i, *map(float, x[i // copies]), i % 4, i % 2) for i in range(n)], "atom long, x double, y double, z double, residue int, chain int")


def test_search_of_superpositions_is_dealt_to_tasks(spark, monkeypatch):
    from protean.operators import compare

    r = np.random.default_rng(1)
    p = r.normal(0, 1, (90, 3))
    q = p @ np.linalg.qr(r.normal(0, 1, (3, 3)))[0] + r.normal(0, 0.3, (90, 3))
    best = lambda part, parts: max(int((d2 <= 0.16).sum(axis=1).max()) for d2 in compare._poses(p, q, 0.4, part=part, parts=parts))
    assert max(best(k, 7) for k in range(7)) == best(0, 1)
    c = _cloud(spark, 120)
    m = c.withColumn("x", F.col("x") * 1.1)
    whole = sorted(map(tuple, compare.gdt_search(c, m, (0.01, 0.02), ["residue"]).collect()))
    monkeypatch.setattr(compare, "_ATOMS_A_TASK", 5)
    assert sorted(map(tuple, compare.gdt_search(c, m, (0.01, 0.02), ["residue"]).collect())) == whole


def test_dense_cells_are_met_block_by_block(spark, monkeypatch):
    from protean.operators import interactions, spatial

    c = _cloud(spark, 150).withColumns({f"v{k}": F.col(k) + 1.5 for k in "xyz"})
    rows = lambda d: sorted(map(tuple, d.collect()))
    every = lambda: [rows(spatial.pairs_within(c, 0.2)), rows(spatial.cross_pairs(c, c, 0.1)), rows(spatial.pairs_within_periodic(c, 0.1, (0.4, 0.4, 0.4))), rows(interactions.pi_stacking(c, 0.2, 0.6, 1.0, 0.05, 0.15, 0.15))]
    whole = every()
    assert "_i" not in spatial.pairs_within(c, 0.2)._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(spatial, "BLOCK", 7)
    assert "_i" in spatial.pairs_within(c, 0.2)._jdf.queryExecution().optimizedPlan().toString()
    assert every() == whole and all(whole)


def test_structures_are_written_and_read_in_parts(spark):
    import pytest
    from protean.sources import exchange

    a = spark.range(50).select(F.lit("A").alias("structure_id"), (F.col("id") % 25).alias("atom_index"), (F.col("id") / 25 + 1).cast("int").alias("model"), F.lit("CA").alias("atom_name"), F.lit("C").alias("element_symbol"), F.lit("ALA").alias("label_comp_id"), F.lit("A").alias("auth_asym_id"), F.lit(7).alias("auth_seq_id"), *[(F.col("id") / k).alias(c) for k, c in ((1, "x"), (2, "y"), (4, "z"))])
    want = sorted((r.model, r.atom_index, r.x, r.y, r.z) for r in a.collect())
    for kind in ("gro", "history", "rst7", "lammpstrj", "sdf", "cif"):
        parts = exchange.text_parts(a, kind, 10).cache()
        assert parts.count() == 6
        assert sorted((r.model, r.atom_index, r.x, r.y, r.z) for r in exchange.parsed(parts, kind).select("model", "atom_index", *[F.round(c, 3).alias(c) for c in "xyz"]).collect()) == [(m, i, *(pytest.approx(v, abs=0.06) for v in xyz)) for m, i, *xyz in want]
    with pytest.raises(Exception, match="not places"):
        exchange.text_parts(a.where("atom_index <> 3"), "gro", 10).collect()


def test_hydrogens_may_have_the_numbers_of_acceptors(spark):
    from protean.operators import interactions

    at = lambda *rows: spark.createDataFrame(rows, "atom long, x double, y double, z double")
    h = at((11, 0.05, 0.0, 0.0)).withColumn("donor", F.lit(1).cast("long"))
    r = interactions.hydrogen_bonds(at((1, 0.0, 0.0, 0.0)), at((11, 0.1, 0.0, 0.0)), h, 0.11, 2.0).collect()
    assert [(x.donor, x.hydrogen, x.acceptor) for x in r] == [(1, 11, 11)]


def test_components_and_cores_of_points_make_no_pairs(spark):
    from protean.operators import ensemble, networks, spatial, trajectory

    c = _cloud(spark, 90, copies=2)
    x = np.array([[r.x, r.y, r.z] for r in c.orderBy("atom").collect()])
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= 0.07**2
    want = list(range(len(x)))
    for _ in x:
        want = [min(want[j] for j in np.flatnonzero(near[i])) for i in range(len(x))]
    assert dict(map(tuple, spatial.radius_components(c, 0.07).collect())) == dict(enumerate(want)) == dict(map(tuple, ensemble.single_linkage_of(c, 0.07).collect()))
    assert {r.atom for r in spatial.crowded(c, 0.07, 4).collect()} == set(np.flatnonzero(near.sum(1) >= 4).tolist())
    assert spatial.radius_components(c, 0.0).where("comp <> node").count() == 45
    assert len({r.leaflet for r in networks.leaflets(c, 0.07).collect()}) == len(set(want))
    assert trajectory.dbscan(c, 0.07, 4).where("core").count() == int((near.sum(1) >= 4).sum())


def test_clusters_may_take_many_rounds(spark):
    from protean.operators import trajectory

    at = (2.0 ** -np.arange(1, 40)).tolist()
    p = spark.createDataFrame([(i, v) for i, v in enumerate(at)], "atom long, x double")
    assert trajectory.kmeans.__defaults__[-1] >= 1000 and trajectory.kmeans(p, [[0.0], [0.6]], ("x",)).count() == 39


def test_nearest_few_are_chosen_before_the_shuffle(spark):
    from protean.operators import spatial

    rows = spark.range(2000).select((F.col("id") % 3).alias("k"), F.pmod(F.col("id") * 7919, F.lit(101)).cast("double").alias("d"), "id").coalesce(1)
    got = spatial.first_few(rows, ["k"], ["d", "id"], 2)
    every = sorted((r.k, r.d, r.id) for r in rows.collect())
    assert sorted(map(tuple, got.collect())) == [r for k in range(3) for r in [x for x in every if x[0] == k][:2]]


def test_pairs_take_both_conformations_along(spark):
    from protean.operators import compare, spatial

    a = _cloud(spark, 80)
    b = a.where("atom <> 5").withColumn("x", F.col("x") * 1.2)
    pairs = lambda d, r: spatial.pairs_within(d, r)
    one = compare.contact_similarity(pairs(a, 0.1), pairs(b, 0.1)).first().jaccard
    assert compare.contact_similarity_of(a, b, 0.1).first().jaccard == one
    two = compare.qs_score(pairs(a, 0.15), pairs(b, 0.15), 0.12, 0.05, 0.12).first().qs
    assert abs(compare.qs_score_of(a, b, 0.12, 0.05, 0.12).first().qs - two) < 1e-12
    assert compare.contact_similarity_of(a.limit(0), b.limit(0), 0.1).first().jaccard == 1.0


def test_equal_sets_of_bits_are_compared_once(spark):
    from protean.operators import chemistry, dataset

    r = np.random.default_rng(3)
    sets = [sorted(set(r.integers(0, 12, r.integers(1, 7)).tolist())) for _ in range(25)] + [list(range(30)), list(range(1, 31)), []]
    rows = [(3 * i + k, s) for i, s in enumerate(sets) for k in range(2)]
    f = spark.createDataFrame(rows, "id long, bits array<bigint>")
    like = {(i, j): len({*a} & {*b}) / len({*a} | {*b}) for i, a in rows for j, b in rows if i < j and a and b}
    got = {(x.first, x.second): x.similarity for x in (r.asDict() and type("R", (), r.asDict()) for r in dataset.tanimoto(f, 0.6).collect())}
    assert got == {k: v for k, v in like.items() if v >= 0.6}
    plain = spark.createDataFrame([k for k, v in like.items() if v >= 0.5], "first long, second long")
    assert sorted(map(tuple, chemistry.butina_of(f, 0.5).collect())) == sorted(map(tuple, chemistry.butina(plain, f).collect()))
    assert dataset.bit_classes(f).where("id = rep").count() < len(sets)


def test_single_pairs_are_not_shuffled_for_edges(spark):
    from protean.operators import dataset

    p = spark.createDataFrame([(2, 1), (3, 1)], "first long, second long")
    d = dataset.graph_edges(p, True, True)
    assert "Aggregate" not in d._jdf.queryExecution().optimizedPlan().toString() and sorted(map(tuple, d.collect())) == [(1, 2), (1, 3), (2, 1), (3, 1)]


def test_anisotropic_networks_of_over_a_thousand_points(spark):
    from protean.operators import networks

    assert networks.anisotropic_fluctuations(_cloud(spark, 1010).withColumn("one", F.lit(1)), 0.1, ("one",)).count() == 1010
