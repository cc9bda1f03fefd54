import itertools
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from protean.operators import compare, dataset, geometry, interactions, sequence, spatial, surface, trajectory
from pyspark.sql import functions as F


def cloud(spark, p, **extra):
    rows = [(i, *map(float, v), *(e[i] for e in extra.values())) for i, v in enumerate(p)]
    return spark.createDataFrame(rows, "atom long, x double, y double, z double" + "".join(f", {k} {'string' if isinstance(v[0], str) else 'double'}" for k, v in extra.items()))


def brute(p, r):
    return {(i, j) for i, j in itertools.combinations(range(len(p)), 2) if math.dist(p[i], p[j]) <= r}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(*[st.floats(-3, 3)] * 3), min_size=2, max_size=25), st.floats(0.1, 2))
def test_pairs_match_brute_force(spark, p, r):
    got = {(x.first, x.second) for x in spatial.pairs_within(cloud(spark, p), r).collect()}
    near = {(i, j) for i, j in itertools.combinations(range(len(p)), 2) if abs(math.dist(p[i], p[j]) - r) < 1e-9}
    assert got ^ brute(p, r) <= near


def test_pairs_do_not_depend_on_pose_or_partitions(spark):
    p = np.random.default_rng(1).normal(size=(40, 3))
    turn = np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1]])
    one = {(x.first, x.second) for x in spatial.pairs_within(cloud(spark, p), 0.8).collect()}
    two = {(x.first, x.second) for x in spatial.pairs_within(cloud(spark, p @ turn.T + 5).repartition(7), 0.8).collect()}
    assert one == two == brute(p, 0.8)


def test_cross_pairs_and_limits(spark):
    a, b = cloud(spark, [(0, 0, 0), (1, 0, 0), (10, 0, 0)]), cloud(spark, [(0.5, 0, 0), (20, 0, 0)])
    assert {(x.first, x.second, x.distance) for x in spatial.cross_pairs(a, b, 1.0).collect()} == {(0, 0, 0.5), (1, 0, 0.5)}
    assert spatial.cross_pairs(a.limit(0), b, 1.0).count() == 0
    with pytest.raises(ValueError):
        spatial.cross_pairs(a, b, -1.0)
    nan = cloud(spark, [(0, 0, 0), (float("nan"), 0, 0), (0, 0, 0)])
    assert [(x.first, x.second) for x in spatial.pairs_within(nan, 0.0).collect()] == [(0, 2)]


def test_knn_reaches_far_points(spark):
    p = [(0, 0, 0), (1, 0, 0), (100, 0, 0), (101, 0, 0), (0, 50, 0)]
    got = {(x.query, x.rank): x.target for x in spatial.knn(cloud(spark, p), cloud(spark, p), 2, 0.5).collect()}
    for i in range(5):
        order = sorted((math.dist(p[i], p[j]), j) for j in range(5) if j != i)
        assert [got[i, 1], got[i, 2]] == [order[0][1], order[1][1]]
    assert spatial.knn(cloud(spark, p), cloud(spark, p), 9, 0.5).count() == 20


def test_periodic_pairs(spark):
    p = np.random.default_rng(2).uniform(-5, 15, size=(40, 3))
    d = np.abs(p[:, None] - p[None])
    d = d % 10
    d = np.sqrt((np.minimum(d, 10 - d) ** 2).sum(-1))
    want = {(i, j) for i, j in itertools.combinations(range(40), 2) if d[i, j] <= 2.5}
    assert {(x.first, x.second) for x in spatial.pairs_within_periodic(cloud(spark, p), 2.5, (10, 10, 10)).collect()} == want


def test_superposition_undoes_a_motion(spark):
    p = np.random.default_rng(3).normal(size=(30, 3))
    c, s = math.cos(0.7), math.sin(0.7)
    q = p @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]).T + [1, 2, 3]
    r = geometry.superpose(cloud(spark, p), cloud(spark, q)).first()
    assert r.rmsd < 1e-6 and r.atoms == 30
    assert np.allclose(p @ np.array(r.rotation).reshape(3, 3).T + r.translation, q)


def test_measures(spark):
    d = spark.range(1).select(*[geometry.vec(*[F.lit(float(v)) for v in p]).alias(n) for n, p in zip("abcd", [(1, 0, 0), (0, 0, 0), (0, 1, 0), (0, 1, 1)], strict=True)])
    r = d.select(geometry.angle(F.col("a"), F.col("b"), F.col("c")).alias("angle"), geometry.dihedral(*[F.col(c) for c in "abcd"]).alias("turn"), geometry.angle(F.col("a"), F.col("a"), F.col("c")).alias("none")).first()
    assert math.isclose(r.angle, math.pi / 2) and math.isclose(abs(r.turn), math.pi / 2) and r.none is None
    l = geometry.place_atom(F.col("a"), F.col("b"), F.col("c"), F.lit(1.5), F.lit(2.0), F.lit(0.8))  # noqa: E741
    r = d.select(l.alias("l"), "*").select(geometry.distance(F.col("l"), F.col("c")).alias("d"), geometry.angle(F.col("b"), F.col("c"), F.col("l")).alias("angle"), geometry.dihedral(F.col("a"), F.col("b"), F.col("c"), F.col("l")).alias("turn")).first()
    assert math.isclose(r.d, 1.5) and math.isclose(r.angle, 2.0) and math.isclose(r.turn, 0.8)


def test_surface_of_one_and_two_spheres(spark):
    one = surface.accessible_area(cloud(spark, [(0, 0, 0)], radius=[1.6]), 1.6).first().area
    assert math.isclose(one, 4 * math.pi * 9, rel_tol=1e-9)
    two = [r.area for r in surface.accessible_area(cloud(spark, [(0, 0, 0), (3, 0, 0)], radius=[1.6, 1.6]), 1.6).collect()]
    cap = 2 * math.pi * 3 * (3 - 1.5)
    assert all(math.isclose(v, 4 * math.pi * 9 - cap, rel_tol=0.01) for v in two)


def test_alignment_against_plain_recursion(spark):
    def want(a, b, mode):
        low = -1e9
        h = {(-1, -1): 0}
        e, f = {}, {}
        n, m = len(a), len(b)
        H = [[low] * (m + 1) for _ in range(n + 1)]
        E, G = [[low] * (m + 1) for _ in range(n + 1)], [[low] * (m + 1) for _ in range(n + 1)]
        H[0][0] = 0
        for i in range(n + 1):
            for j in range(m + 1):
                if i:
                    E[i][j] = max(H[i - 1][j] - 2, E[i - 1][j] - 1)
                if j:
                    G[i][j] = max(H[i][j - 1] - 2, G[i][j - 1] - 1)
                if i or j:
                    d = H[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1) if i and j else low
                    H[i][j] = max(d, E[i][j], G[i][j])
                    if mode == "local":
                        H[i][j] = max(0, H[i][j])
        return max(map(max, H)) if mode == "local" else H[n][m]

    pairs = [("ACDEFGHIKL", "CDEFGHIKL"), ("AAAA", "TTTT"), ("GATTACA", "GCATGCU"), ("", "AB"), ("ABCABC", "BC")]
    d = spark.createDataFrame(pairs, "a string, b string")
    for mode in ("global", "local"):
        for r in d.select("a", "b", sequence.align(mode)("a", "b").alias("s")).collect():
            assert r.s.score == want(r.a, r.b, mode), (mode, r)
            if mode == "global":
                assert r.s.left.replace("-", "") == r.a and r.s.right.replace("-", "") == r.b
    assert d.select(sequence.align("semi")("a", "b").alias("s")).first().s.score == 9


def test_trees(spark):
    d = spark.createDataFrame([(0, "a", "b", 2.0), (0, "a", "c", 6.0), (0, "b", "c", 6.0)], "g int, first string, second string, distance double")
    assert sequence.tree(d, ["g"]).first().newick == "((a:1,b:1):2,c:3);"
    assert sequence.tree(d, ["g"], "nj").first().newick.count("(") == 2


def test_clusters(spark):
    p = [(0, 0, 0), (0.1, 0, 0), (0.2, 0, 0), (5, 0, 0), (5.1, 0, 0), (5.2, 0, 0), (9, 9, 9), (0.35, 0, 0)]
    c = {r.atom: (r.core, r.cluster) for r in trajectory.dbscan(cloud(spark, p), 0.16, 3).collect()}
    assert c[1] == (True, 1) and c[0] == (False, 1) and c[6] == (False, None) and c[4][1] == 4
    k = {r.atom: r.cluster for r in trajectory.kmeans(cloud(spark, p[:6]), [[0, 0, 0], [5, 0, 0]]).collect()}
    assert k == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1}
    with pytest.raises(ValueError):
        trajectory.kmeans(cloud(spark, p[:3]), [[0, 0, 0], [50, 0, 0]])


def test_components_shorten_a_long_chain(spark):
    from protean.functions.graph import components

    e = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.comp for r in components(e).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100


def test_splits_keep_clusters_whole(spark):
    m = spark.createDataFrame([(i, "c%d" % (i % 7) if i % 5 else None) for i in range(100)], "id long, cluster string")
    s = dataset.split_clusters(m, "cluster", {"train": 0.8, "test": 0.2})
    assert s.count() == 100
    assert s.join(m, "id").where("cluster is not null").groupBy("cluster").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


def test_bond_perception_and_water_bridges(spark):
    p = cloud(spark, [(0, 0, 0), (1.5, 0, 0), (0, 0.3, 0)], element=["C", "C", "H"], altloc=["", "", ""])
    got = {(r.atom_a, r.atom_b) for r in interactions.perceived_bonds(p, {"C": 1.6, "H": 0.9}).collect()}
    assert got == {(0, 1)}
    b = spark.createDataFrame([(9, 1), (2, 9), (9, 3), (4, 5)], "donor long, acceptor long")
    w = spark.createDataFrame([(9,)], "atom long")
    assert {(r.first, r.second) for r in interactions.water_bridges(b, w).collect()} == {(1, 2), (1, 3), (2, 3)}


def test_contact_similarity_of_nothing(spark):
    e = spark.createDataFrame([], "first long, second long")
    assert compare.contact_similarity(e, e).first().jaccard == 1.0


def test_networks(spark):
    from protean.operators import networks

    line = cloud(spark, [(float(i), 0, 0) for i in range(6)]).withColumn("g", F.lit(1))
    r = networks.gaussian_network(line, 1.1, ("g",), 2).where("mode = 0").collect()
    assert math.isclose(r[0].eigenvalue, 2 - 2 * math.cos(math.pi / 6), rel_tol=1e-9)
    f = {x.atom: x.fluctuation for x in networks.anisotropic_fluctuations(cloud(spark, np.random.default_rng(0).normal(size=(12, 3))).withColumn("g", F.lit(1)), 9.0, ("g",)).collect()}
    assert len(f) == 12 and min(f.values()) > 0
    with pytest.raises(Exception, match="limit"):
        networks.gaussian_network(line, 1.1, ("g",), limit=3).count()
    d = geometry.distance_matrix(cloud(spark, [(0, 0, 0), (0.1, 0, 0), (5, 0, 0), (5.2, 0, 0), (9, 0, 0)])).withColumn("g", F.lit(1))
    for m in ("average", "complete", "single"):
        assert {x.item: x.cluster for x in networks.agglomerative(d, ["g"], 1.0, m).collect()} == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}


def test_fingerprints_and_butina(spark):
    from protean.operators import chemistry

    a = spark.createDataFrame([(m, m * 10 + i, e) for m in (1, 2, 3) for i, e in enumerate("CCO" if m < 3 else "CNO")], "molecule long, atom long, element string")
    b = spark.createDataFrame([(m * 10 + i, m * 10 + i + 1, "single") for m in (1, 2, 3) for i in (0, 1)], "atom_a long, atom_b long, order string")
    f = {x.molecule: set(x.bits) for x in chemistry.circular_fingerprint(a, b).collect()}
    assert f[1] == f[2] != f[3]
    t = dataset.tanimoto(spark.createDataFrame([(k, sorted(v)) for k, v in f.items()], "id long, bits array<long>"), 0.9)
    assert [(x.first, x.second, x.similarity) for x in t.collect()] == [(1, 2, 1.0)]
    s = spark.createDataFrame([(1, 2), (1, 3), (3, 4)], "first long, second long")
    items = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    assert {x.id: x.centre for x in chemistry.butina(s, items).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_minimizers_against_a_plain_loop(spark):
    seqs = ["ACGTTGCATGACC", "AAAA", "AC", "", "TTTTTTTTTT", "GATTACAGATTACA" * 20]
    d = spark.createDataFrame(list(enumerate(seqs)) + [(99, None)], "id long, sequence string")
    k, w = 3, 4
    want = set()
    for i, s in enumerate(seqs):
        words = [(s[p : p + k], p) for p in range(len(s) - k + 1)]
        want |= {(i, p, x) for a in range(len(words) - w + 1) for x, p in [min(words[a : a + w])]}
    assert {tuple(r) for r in sequence.minimizers(d, k, w).collect()} == want
    assert sequence.kmers(d, k, keys=["id"]).count() == sum(max(0, len(s) - k + 1) for s in seqs)


def test_progressive_msa(spark):
    rows = [(1, "a", "ACDEFGHIKL"), (1, "b", "CDEFGHIKL"), (1, "c", "ACDEFGIKL"), (2, "x", "MMM"), (2, "y", None)]
    got = sequence.progressive_msa(spark.createDataFrame(rows, "g int, name string, sequence string"), ["g"]).collect()
    by = {(r.g, r.name): r.aligned for r in got}
    assert by == {(1, "a"): "ACDEFGHIKL", (1, "b"): "-CDEFGHIKL", (1, "c"): "ACDEFG-IKL", (2, "x"): "MMM"}


def test_alignment_by_matrix_and_band(spark):
    matrix = sequence.parse_matrix("# a small table\n   A  C  G  X\nA  4 -1  0 -2\nC -1  5 -3 -2\nG  0 -3  6 -2\nX -2 -2 -2 -1\n")
    rows = [(1, "ACGGA", "ACGA"), (2, "GATTACA", "GCATGCA"), (3, "A", "A"), (4, "CCC", "GGG"), (5, None, "A")]
    d = spark.createDataFrame(rows, "id int, s string, t string")

    def gotoh(a, b, score, opening, extend):
        low = float("-inf")
        h, f = [0.0] + [-opening - j * extend for j in range(len(b))], [low] * (len(b) + 1)
        for i, x in enumerate(a):
            row, e = [-opening - i * extend], low
            for j, y in enumerate(b, 1):
                f[j] = max(h[j] - opening, f[j] - extend)
                e = max(row[j - 1] - opening, e - extend)
                row.append(max(h[j - 1] + score(x, y), e, f[j]))
            h = row
        return h[-1]

    of = lambda x, y: matrix[x if (x, x) in matrix else "X", y if (y, y) in matrix else "X"]
    got = d.select("id", sequence.align("global", matrix=matrix, opening=5.0, extend=1.0)("s", "t").alias("a"), sequence.global_score(matrix=matrix, opening=5.0, extend=1.0)("s", "t").alias("g"), sequence.align("global", band=4)("s", "t").alias("b"), sequence.global_score()("s", "t").alias("p")).collect()
    for (_, s, t), r in zip(rows, sorted(got), strict=True):
        if s is None:
            assert r.g is None and r.a.score is None
            continue
        want = gotoh(s, t, of, 5.0, 1.0)
        assert r.a.score == want == r.g and (r.a.left.replace("-", ""), r.a.right.replace("-", "")) == (s, t)
        assert r.p == gotoh(s, t, lambda x, y: 1 if x == y else -1, 2.0, 1.0) == r.b.score
    w = spark.createDataFrame([("AC",), ("GG",), ("AZ",)], "kmer string")
    got = [tuple(r) for r in sequence.similar_kmers(w, "ACG", matrix, 5).collect()]
    want = [(k, a + b, float(matrix[k[0], a] + matrix[k[1], b])) for k in ("AC", "GG") for a in "ACG" for b in "ACG" if matrix[k[0], a] + matrix[k[1], b] >= 5]
    assert sorted(got) == sorted(want)
    q = spark.createDataFrame([(1, "TTACGTA"), (2, "GGGG")], "id int, sequence string")
    r = spark.createDataFrame([(7, "CCACGTC"), (8, "TTTT")], "id int, sequence string")
    assert [(x.query, x.reference, x.score, x.left) for x in sequence.seed_and_extend(q, r, 4).collect()] == [(1, 7, 4.0, "ACGT")]


def test_positions_and_distance_faults(spark):
    v = spark.createDataFrame([(1, "A"), (2, "C"), (9, "G")], "number int, wild string")
    c = spark.createDataFrame([(2, "A"), (3, "D")], "number int, letter string")
    assert {r.number: r.state for r in sequence.map_positions(v, c, 1).collect()} == {1: "matched", 2: "mismatched", 9: "absent"}
    d = spark.createDataFrame([(1, 1, 0.0), (1, 2, 3.0), (2, 1, 3.5), (2, 2, 1.0), (1, 3, -1.0), (3, 1, float("nan")), (4, 1, 2.0)], "first int, second int, distance double")
    assert {(r.first, r.second): r.fault for r in sequence.distance_faults(d).collect()} == {(1, 2): "asymmetric", (2, 1): "asymmetric", (2, 2): "diagonal", (1, 3): "negative", (3, 1): "not finite", (4, 1): "missing"}


def test_superposition_searches(spark):
    rng = np.random.default_rng(4)
    p = np.cumsum(rng.normal(size=(60, 3)) * 2.2, axis=0)
    a = 0.9
    turn = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
    moved = p @ turn + [5, -3, 2]
    bent = moved.copy()
    bent[45:] += [40, 0, 0]
    ref, whole, part = cloud(spark, p), cloud(spark, moved), cloud(spark, bent)
    assert compare.tm_score(ref, whole).first().tm < 0.5
    r = compare.tm_score_search(ref, whole).first()
    assert r.tm == pytest.approx(1.0) and r.atoms == 60
    assert 0.74 < compare.tm_score_search(ref, part).first().tm < 0.85
    g = compare.gdt_search(ref, part, compare.GDT_HA).collect()
    assert all(x.fraction >= 0.75 for x in g) and g[0].score == pytest.approx(np.mean([x.fraction for x in g]))
    with pytest.raises(Exception, match="no partner"):
        compare.tm_score_search(ref, part.where("atom > 0")).collect()
    keyed = compare.tm_score_search(ref.withColumn("k", F.lit("x")).union(ref.withColumn("k", F.lit("y"))), whole.withColumn("k", F.lit("x")).union(part.withColumn("k", F.lit("y"))), ["k"]).collect()
    assert {x.k for x in keyed} == {"x", "y"}


def test_chain_assignment_against_all_permutations(spark):
    rng = np.random.default_rng(2)
    rows = [(s, f"r{i}", f"m{j}", float(v)) for s, (n, m) in enumerate([(4, 4), (3, 5), (5, 3)]) for i in range(n) for j, v in enumerate(rng.random(m))]
    got = compare.map_chains(spark.createDataFrame(rows, "pair int, reference string, model string, score double")).collect()
    for s, (n, m) in enumerate([(4, 4), (3, 5), (5, 3)]):
        v = {(r[1], r[2]): r[3] for r in rows if r[0] == s}
        few, many = min(n, m), max(n, m)
        best = max(sum(v[(f"r{i}", f"m{j}") if n <= m else (f"r{j}", f"m{i}")] for i, j in enumerate(c)) for c in itertools.permutations(range(many), few))
        mine = [r for r in got if r.pair == s]
        assert sum(r.score for r in mine) == pytest.approx(best) and len({r.reference for r in mine}) == len({r.model for r in mine}) == few


def test_distance_matrix_in_blocks(spark, monkeypatch):
    p = np.random.default_rng(0).normal(size=(50, 3))
    d = cloud(spark, p).withColumn("k", F.col("atom") % 3)
    monkeypatch.setattr(geometry, "BLOCK", 5)
    got = {(r.first, r.second): r.distance for r in geometry.distance_matrix(d, ["k"]).collect()}
    assert got == {(i, j): pytest.approx(math.dist(p[i], p[j])) for i, j in itertools.combinations(range(50), 2) if i % 3 == j % 3}
    assert geometry.distance_matrix(d).count() == 50 * 49 // 2
    m = {r.k: r.item for r in trajectory.medoid(geometry.distance_matrix(d, ["k"]), ["k"]).collect()}
    assert m == {k: min(range(k, 50, 3), key=lambda i: sum(math.dist(p[i], p[j]) for j in range(k, 50, 3))) for k in range(3)}


def test_harmonic_similarity_is_the_bhattacharyya_one(spark):
    from protean.operators import networks

    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(200, 3)), rng.normal(size=(150, 3)) @ np.diag([1, 2, 0.5]) + [1, 0, 0]
    r = networks.harmonic_similarity(cloud(spark, x), cloud(spark, y), ["x", "y", "z"], 0.01).first()
    ca, cb = np.cov(x.T) + 0.01 * np.eye(3), np.cov(y.T) + 0.01 * np.eye(3)
    m, d = (ca + cb) / 2, x.mean(0) - y.mean(0)
    want = d @ np.linalg.inv(m) @ d / 8 + 0.5 * math.log(np.linalg.det(m) / math.sqrt(np.linalg.det(ca) * np.linalg.det(cb)))
    assert r.distance == pytest.approx(want) and r.similarity == pytest.approx(math.exp(-want))
    assert networks.harmonic_similarity(cloud(spark, x), cloud(spark, x), ["x", "y", "z"]).first().similarity == pytest.approx(1.0)
