import pytest
from protean.sources import grids, sequences, structures

PDB = """MODEL        1
ATOM      1  N   GLY A   1      11.104   6.134  -6.504  1.00 10.50           N
HETATM    2 ZN    ZN B   2A      1.000   2.000   3.000  0.50 20.00          ZN2+
ENDMDL
MODEL        2
ATOM      1  N   GLY A   1      12.104   6.134  -6.504  1.00 10.50           N
ENDMDL
END
"""
CIF = """data_X
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.type_symbol
_atom_site.label_atom_id
_atom_site.label_alt_id
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.label_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.auth_seq_id
_atom_site.auth_asym_id
ATOM 1 N N . GLY A 1 1.0 2.0 3.0 10 B
ATOM 2 O "O5'" . G A . 1.5 ? 3.0 11 B
#
_entry.id X
"""


def test_pdb(spark, tmp_path):
    (tmp_path / "a.pdb").write_text(PDB)
    r = structures.read_structures(spark, str(tmp_path / "a.pdb")).orderBy("model", "atom_index").collect()
    assert [(x.structure_id, x.model, x.atom_index, x.atom_name, x.x, x.element_symbol, x.ins_code, x.formal_charge) for x in r] == [("a", 1, 0, "N", 11.104, "N", "", None), ("a", 1, 1, "ZN", 1.0, "ZN", "A", 2), ("a", 2, 0, "N", 12.104, "N", "", None)]
    lines = [x.value for x in structures.pdb_lines(structures.read_pdb(spark, str(tmp_path / "a.pdb"))).orderBy("model", "atom_index").collect()]
    (tmp_path / "b.pdb").write_text("\n".join(lines[:2]))
    again = structures.read_pdb(spark, str(tmp_path / "b.pdb")).orderBy("atom_index").collect()
    assert [(x.atom_name, x.x, x.y, x.z, x.label_comp_id, x.auth_seq_id) for x in again] == [(x.atom_name, x.x, x.y, x.z, x.label_comp_id, x.auth_seq_id) for x in r[:2]]


def test_mmcif(spark, tmp_path):
    (tmp_path / "a.cif").write_text(CIF)
    r = structures.read_structures(spark, str(tmp_path / "a.cif")).orderBy("atom_index").collect()
    assert [(x.atom_name, x.label_asym_id, x.auth_asym_id, x.label_seq_id, x.auth_seq_id, x.y) for x in r] == [("N", "A", "B", 1, 10, 2.0), ("O5'", "A", "B", None, 11, None)]


def test_free_formats(spark, tmp_path):
    files = {
        "m.xyz": "2\nwater\nO 0 0 0\nH 0 0 1\n1\n\nC 1 2 3\n",
        "m.gro": "t\n    1\n    1SOL     OW    1   0.100   0.200   0.300\n 1 1 1\n",
        "m.pqr": "ATOM 1 N GLY 1 1.0 2.0 3.0 -0.5 1.8\n",
        "m.lammpstrj": "ITEM: TIMESTEP\n0\nITEM: NUMBER OF ATOMS\n1\nITEM: BOX BOUNDS pp pp pp\n0 10\n0 10\n0 10\nITEM: ATOMS id type xs ys zs\n1 2 0.5 0.5 0.1\n",
        "m.mol2": "@<TRIPOS>MOLECULE\nx\n@<TRIPOS>ATOM\n1 C1 0 0 1 C.3 1 LIG 0.1\n@<TRIPOS>BOND\n",
        "m.sdf": "x\n\n\n  1  0\n    1.0000    2.0000    3.0000 C   0\nM  END\n$$$$\n",
    }
    want = {"m.xyz": 3, "m.gro": 1, "m.pqr": 1, "m.lammpstrj": 1, "m.mol2": 1, "m.sdf": 1}
    for n, t in files.items():
        (tmp_path / n).write_text(t)
        d = structures.read_structures(spark, str(tmp_path / n)).collect()
        assert len(d) == want[n], n
        if n == "m.gro":
            assert (d[0].x, d[0].z) == (1.0, 3.0)
        if n == "m.lammpstrj":
            assert (d[0].x, d[0].z) == (5.0, 1.0)
        if n == "m.pqr":
            assert (d[0].charge, d[0].radius) == (-0.5, 1.8)
    t = structures.xyz_text(structures.read_structures(spark, str(tmp_path / "m.xyz"))).orderBy("model").first().value
    assert t.splitlines()[0] == "2" and t.splitlines()[2].startswith("O 0.000000")
    with pytest.raises(ValueError):
        structures.read_structures(spark, "a.nothing")


def test_sequences(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nACGT\nAC\n>two\nGG\n")
    r = sequences.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("name").collect()
    assert [(x.name, x.description, x.sequence) for x in r] == [("one", "first", "ACGTAC"), ("two", "", "GG")]
    text = [x.value for x in sequences.fasta_text(sequences.read_fasta(spark, str(tmp_path / "a.fa")), 4).orderBy("name").collect()]
    assert text == [">one first\nACGT\nAC", ">two\nGG"]
    (tmp_path / "a.fq").write_text("@r1 x\nAC\nGT\n+\n!!\n!!\n")
    assert sequences.read_fastq(spark, str(tmp_path / "a.fq")).first().quality == "!!!!"
    (tmp_path / "a.aln").write_text("CLUSTAL\n\na AC\nb A-\n  *\n\na GT\nb GG\n")
    assert {x.name: x.sequence for x in sequences.read_clustal(spark, str(tmp_path / "a.aln")).collect()} == {"a": "ACGT", "b": "A-GG"}
    (tmp_path / "a.sto").write_text("# STOCKHOLM 1.0\na AC\nb A-\n//\n")
    assert sequences.read_stockholm(spark, str(tmp_path / "a.sto")).count() == 2
    (tmp_path / "a.phy").write_text("2 4\na ACGT\nb AC\nGG\n")
    assert [x.sequence for x in sequences.read_phylip(spark, str(tmp_path / "a.phy")).orderBy("at").collect()] == ["ACGT", "ACGG"]


def test_grids(spark, tmp_path):
    (tmp_path / "a.dx").write_text("object 1 class gridpositions counts 2 1 2\norigin 1 0 0\ndelta 0.5 0 0\ndelta 0 1 0\ndelta 0 0 2\nobject 2 class gridconnections counts 2 1 2\nobject 3 class array type double rank 0 items 4 data follows\n1 2 3\n4\n")
    r = grids.read_grid(spark, str(tmp_path / "a.dx"), "dx").orderBy("ix", "iz").collect()
    assert [(x.ix, x.iz, x.x, x.z, x.value) for x in r] == [(0, 0, 1.0, 0.0, 1.0), (0, 1, 1.0, 2.0, 2.0), (1, 0, 1.5, 0.0, 3.0), (1, 1, 1.5, 2.0, 4.0)]


def test_binary_containers(spark, tmp_path):
    import numpy as np
    from protean.sources import binary

    x = np.random.default_rng(0).normal(size=(3, 5, 3)).astype("f4").astype(float)
    (tmp_path / "a.dcd").write_bytes(binary.dcd_bytes(x))
    r = binary.read_dcd(spark, str(tmp_path / "a.dcd")).orderBy("frame", "atom").collect()
    assert np.allclose([[q.x, q.y, q.z] for q in r], x.reshape(-1, 3)) and r[-1].frame == 2
    v = np.random.default_rng(1).normal(size=(2, 3, 4)).astype("f4").astype(float)
    (tmp_path / "a.mrc").write_bytes(binary.mrc_bytes(v, (2, 3, 4, 90, 90, 90)))
    g = {(q.ix, q.iy, q.iz): q.value for q in binary.read_mrc(spark, str(tmp_path / "a.mrc")).collect()}
    assert all(g[i] == v[i] for i in np.ndindex(2, 3, 4))
    t = np.array([[1, 0, 0, 5.5], [0, 1, 2, np.nan]])
    (tmp_path / "a.mtz").write_bytes(binary.mtz_bytes(["H", "K", "L", "F"], "HHHF", t, (10, 20, 30, 90, 90, 90)))
    m = binary.read_mtz(spark, str(tmp_path / "a.mtz"), ("H", "K", "L", "F", "SIGF")).orderBy("K").collect()
    assert [(q.H, q.K, q.L, q.F, q.SIGF) for q in m] == [(1, 0, 0, 5.5, None), (0, 1, 2, None, None)]
    assert binary.mtz_table((tmp_path / "a.mtz").read_bytes())[2] == (10, 20, 30, 90, 90, 90)
    with pytest.raises(Exception, match="DCD|records|lengths"):
        binary.read_dcd(spark, str(tmp_path / "a.mrc")).count()


def test_exchange_odd_values_and_frames(spark):
    from protean.sources import exchange
    from protean.sources.structures import ATOMS
    from pyspark.sql import functions as F

    rows = [("s", 1, 0, "O5'", "it's \"odd\"", None), ("s", 1, 1, "C A", "data_x", ""), ("s", 1, 2, "_n", "a;b", "#"), ("s", 2, 0, "N", ";x", "?")]
    a = spark.createDataFrame([(*r, 1.0 + i, 2.5, -3.25) for i, r in enumerate(rows)], "structure_id string, model int, atom_index long, atom_name string, label_comp_id string, altloc string, x double, y double, z double")
    got = exchange.parsed(exchange.text_of(a, "cif"), "cif").orderBy("model", "atom_index").collect()
    assert [(r.model, r.atom_index, r.atom_name, r.label_comp_id, r.x, r.y, r.z) for r in got] == [(r[1], r[2], r[3], r[4], 1.0 + i, 2.5, -3.25) for i, r in enumerate(rows)]
    assert got[2].altloc == "#" and got[0].occupancy is None and got[0].element_symbol == ""
    plain = a.withColumn("atom_name", F.lit("C")).withColumn("label_comp_id", F.lit("ALA"))
    for kind in ("gro", "history", "txyz", "lammpstrj", "cif"):
        r = exchange.parsed(exchange.text_of(plain, kind), kind).orderBy("model", "atom_index").collect()
        assert [(x.model, x.atom_index, round(x.x, 3)) for x in r] == [(1, 0, 1.0), (1, 1, 2.0), (1, 2, 3.0), (2, 0, 4.0)]
    one = plain.where("model = 1")
    r = exchange.parsed(exchange.text_of(one, "mdcrd"), "mdcrd", atoms=3).orderBy("atom_index").collect()
    assert [(x.x, x.y, x.z) for x in r] == [(1.0, 2.5, -3.25), (2.0, 2.5, -3.25), (3.0, 2.5, -3.25)]
    assert exchange.text_of(plain.limit(0), "cif").count() == 0 and len(ATOMS) > 0
    with pytest.raises(ValueError, match="unknown"):
        exchange.text_of(plain, "nothing")


def test_topologies_and_tables(spark, tmp_path):
    from protean.sources import exchange

    psf = "PSF\n\n       2 !NATOM\n 1 SEG 5 ALA N NH1 -0.47 14.007 0\n 2 SEG 5 ALA CA CT1 0.07 12.011 0\n\n       1 !NBOND\n 1 2\n"
    top = "%VERSION x\n%FLAG POINTERS\n%FORMAT(10I8)\n       2       1\n%FLAG ATOM_NAME\n%FORMAT(20a4)\nN   CA  \n%FLAG CHARGE\n%FORMAT(5E16.8)\n  1.82223000E+01 -1.82223000E+01\n%FLAG RESIDUE_LABEL\n%FORMAT(20a4)\nALA \n%FLAG RESIDUE_POINTER\n%FORMAT(10I8)\n       1\n"
    data = "title\n\n2 atoms\n\nAtoms # charge\n\n1 1 0.5 1.0 2.0 3.0\n2 1 -0.5 4.0 5.0 6.0\n\nVelocities\n\n1 0 0 0\n"
    itp = "[ moleculetype ]\nX 3\n[ atoms ]\n; nr type resnr res atom cgnr charge\n1 C 1 ALA CA 1 0.25 12.0\n[ bonds ]\n1 2\n"
    trc = "TIMESTEP\n1 0.5\nEND\nPOSITIONRED\n0.1 0.2 0.3\n#1\n0.4 0.5 0.6\nEND\n"
    aims = "lattice_vector 2 0 0\nlattice_vector 0 2 0\nlattice_vector 0 0 2\natom_frac 0.5 0.5 0 Si # x\n"
    t = lambda text: spark.createDataFrame([("a", text)], "structure_id string, value string")
    names = lambda kind, text: [(r.atom_name, r.label_comp_id, r.charge) for r in exchange.parsed(t(text), kind).orderBy("atom_index").collect()]
    assert names("psf", psf) == [("N", "ALA", -0.47), ("CA", "ALA", 0.07)] and list(exchange.psf_bonds(psf)) == [(0, 1)]
    assert names("prmtop", top) == [("N", "ALA", pytest.approx(1.0)), ("CA", "ALA", pytest.approx(-1.0))]
    assert [(r.x, r.charge) for r in exchange.parsed(t(data), "lammps").orderBy("atom_index").collect()] == [(1.0, 0.5), (4.0, -0.5)]
    assert names("itp", itp) == [("CA", "ALA", 0.25)]
    assert [round(r.y, 6) for r in exchange.parsed(t(trc), "trc").orderBy("atom_index").collect()] == [2.0, 5.0]
    assert [(r.x, r.z, r.element_symbol) for r in exchange.parsed(t(aims), "aims").collect()] == [(1.0, 0.0, "SI")]
    (tmp_path / "a.xvg").write_text("# c\n@ title\n0 1.5\n1 -2e3 4\n")
    assert [list(r["values"]) for r in exchange.read_xvg(spark, str(tmp_path / "a.xvg")).orderBy("row").collect()] == [[0.0, 1.5], [1.0, -2000.0, 4.0]]
    v = spark.createDataFrame([("m", i, float(i), 0.0, 1.0) for i in range(3)], "mesh string, vertex long, x double, y double, z double")
    f = spark.createDataFrame([("m", 0, 1, 2)], "mesh string, a long, b long, c long")
    assert exchange.obj_text(v, f).first().value.splitlines() == ["v 0.000000 0.000000 1.000000", "v 1.000000 0.000000 1.000000", "v 2.000000 0.000000 1.000000", "f 1 2 3"]
    assert exchange.cif_table(t(CIF), "_entry").first()["items"] == {"id": "X"}


def test_alignment_texts_and_variants(spark, tmp_path):
    rows = [("f", 0, "one", "ACD-E"), ("f", 1, "two", "A-DGE")]
    d = spark.createDataFrame(rows, "file string, at int, name string, sequence string")
    for kind in ("clustal", "stockholm", "phylip", "a2m", "a3m"):
        (tmp_path / f"x.{kind}").write_text(sequences.sequences_text(d, kind).first().value)
        got = sequences.read_sequences(spark, str(tmp_path / f"x.{kind}"), kind).collect()
        assert sorted((r.name, r.sequence) for r in got) == [("one", "ACD-E"), ("two", "A-DGE")]
    for kind, bad in (("clustal", "A-DG"), ("a3m", "A-DG"), ("a2m", "A1DGE")):
        with pytest.raises(Exception, match="differ|symbol"):
            sequences.sequences_text(d.union(spark.createDataFrame([("f", 2, "x", bad)], d.schema)), kind).collect()
    (tmp_path / "v.csv").write_text('variant,score,"a, b"\nA12G,0.5,1\nAla3Val:C4D,x,2\n\n')
    v = sequences.read_variants(spark, str(tmp_path / "v.csv")).orderBy("row").collect()
    assert [(r.wild, r.number, r.mutant, r.substitutions) for r in v] == [("A", 12, "G", 1), (None, None, None, 2)]
    assert v[0]["values"] == {"score": 0.5, "a, b": 1.0} and v[1]["values"] == {"score": None, "a, b": 2.0}
