import warnings

import pytest
from protean.plans import selection as s

ROWS = [(0, "A", "B", 0.0), (1, "A", "B", 1.0), (2, "B", "A", 3.0), (3, "B", "A", 50.0)]


@pytest.fixture(scope="module")
def atoms(spark):
    return spark.createDataFrame([(i, i, c, d, "GLY", "CA", "C", x, 0.0, 0.0, float(10 * i)) for i, c, d, x in ROWS], "atom_index long, residue_index long, label_asym_id string, auth_asym_id string, label_comp_id string, atom_name string, element_symbol string, x double, y double, z double, b_factor double")


def ids(df):
    return sorted(r.atom_index for r in df.select("atom_index").collect())


@pytest.mark.parametrize("text", ["label_chain A and within 2.5 of label_chain B", "within 2.5 of label_chain B and label_chain A"])
def test_operand_order(atoms, text):
    assert ids(s.Selector(atoms).select(text)) == [1]


def test_negated_left_side_is_the_universe(atoms):
    # inside "not chain B" there is no chain B atom to be near
    assert ids(s.Selector(atoms).select("not chain B and within 2.5 of chain B")) == []
    assert ids(s.Selector(atoms).select("not chain B and global within 2.5 of chain B")) == [1]


@pytest.mark.parametrize("text", ["name CA", "not (chain A or chain B)", "within 5 of (chain A and resid 3:7)", "byres bfactor > 20", "same residue as name CA", "bonded 2 index 1", "sphlayer 1 2 protein", "cylayer 1 2 3 -3 all", "point 1 2 3 4", "prop abs x <= 3", "altloc none", "name 'and'"])
def test_printing_is_canonical(text):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        n = s.parse(text)
        assert s.parse(s.show(n)) == n and s.show(s.parse(s.show(n))) == s.show(n)
        assert s.parse(text).fingerprint() == n.fingerprint()


def test_warnings_and_errors(atoms):
    with pytest.warns(s.SelectionWarning, match="W4001"):
        s.parse("name CA and chain A or chain B")
    with pytest.warns(s.SelectionWarning, match="W4002"):
        s.parse("bfactor = 0.1")
    with pytest.warns(s.SelectionWarning, match="W4003"):
        assert ids(s.Selector(atoms).select("group nothing")) == []
    for bad in ("", "name", "within of chain A", "(name CA", "nosuch 3", "name CA )"):
        with pytest.raises(s.SelectionError):
            s.parse(bad)
    with pytest.raises(s.SelectionError, match="E4003"):
        s.Selector(atoms).select("plddt > 3")


def test_aliases_and_builder(atoms):
    a = s.Aliases()
    a.define("left", "chain A")
    a.define("both", "$left or chain B")
    assert ids(s.Selector(atoms, aliases=a).select("$both and bfactor > 5")) == [1, 2, 3]
    a.define("loop", "$loop")
    with pytest.raises(s.SelectionError):
        s.Selector(atoms, aliases=a).select("$loop")
    assert ids(s.Selector(atoms).select(s.sel.chain("A") & ~s.sel.index(0))) == [1]
    assert ids(s.Selector(atoms).select(s.sel.within(2.5, s.sel.chain("B")))) == [1, 2, 3]


def test_globs_and_completion():
    assert s.glob("C*") == "^C.*$" and s.glob("CA") is None and s.glob("[!H]?") == "^[^H].$" and s.glob(r"C\*") == r"^C\*$"
    assert "within" in s.complete("name CA and with")
