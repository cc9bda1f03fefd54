import json

import pytest
from protean.plans.policy import Policy, govern
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def atoms(spark):
    rows = [(0, 1, 0, "A", "CA", "", 1.0, 0.0), (1, 1, 1, "A", "CB", "A", 0.6, 1.0), (2, 1, 1, "A", "CB", "B", 0.4, 2.0), (3, 1, 2, "B", "CA", "A", 0.5, None), (4, 1, 2, "B", "CA", "B", 0.5, 4.0), (5, 2, 0, "A", "CA", "", 1.0, 9.0)]
    return spark.createDataFrame([(*r, 0.0, 0.0, "C") for r in rows], "atom_index long, model int, residue_index long, label_asym_id string, atom_name string, altloc string, occupancy double, x double, y double, z double, element_symbol string")


def ids(d):
    return sorted(r.atom_index for r in d.collect())


def test_policies(atoms):
    assert ids(Policy().apply(atoms)) == [0, 1, 3]
    assert ids(Policy(model="all", altloc="none").apply(atoms)) == [0, 5]
    assert ids(Policy(model=2).apply(atoms)) == [5]
    assert ids(Policy(altloc="highest_occupancy").apply(atoms)) == [0, 1, 3]
    with pytest.raises(ValueError):
        Policy(altloc="any")


def test_governed_results(atoms):
    mean = lambda a: a.agg(F.avg("x").alias("x"))
    r = govern(atoms, Policy(), mean)
    assert (r.status, r.intended, r.used, r.missing) == ("partial", 3, 2, 1) and r.value.first().x == 0.5
    assert govern(atoms, Policy(missing_atoms="refuse"), mean).status == "indeterminate"
    assert govern(atoms, Policy(), mean, needs=("plddt",)).reason == "no column plddt"
    assert govern(atoms.limit(0), Policy(), mean).status == "indeterminate"
    assert json.loads(r.provenance())["coverage"]["missing"] == 1
