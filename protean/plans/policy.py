"""Policies and governed results.

A policy says which atoms an analysis is about; applying it is a chain of filters on the atom table.
A governed result keeps the answer beside its coverage and status, and an answer that the data do
not support is indeterminate instead of guessed.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """Decisions that change answers; the words are the ones accepted."""

    model: str | int = "first"  # first, all, or a number
    altloc: str = "conformer_consistent"  # conformer_consistent, highest_occupancy, all, none
    identifiers: str = "auth"  # auth, label
    hydrogens: str = "explicit_only"  # explicit_only, exclude
    missing_atoms: str = "report"  # report, refuse
    tolerance: float = 1e-9

    def __post_init__(self):
        allowed = {"altloc": ("conformer_consistent", "highest_occupancy", "all", "none"), "identifiers": ("auth", "label"), "hydrogens": ("explicit_only", "exclude"), "missing_atoms": ("report", "refuse")}
        for k, words in allowed.items():
            if getattr(self, k) not in words:
                raise ValueError(f"{k}: {getattr(self, k)!r} is none of {', '.join(words)}")

    def apply(self, atoms: DataFrame, keys=()) -> DataFrame:
        out = atoms
        if self.model == "first":
            out = first_model(out, keys)
        elif self.model != "all":
            out = out.where(F.col("model") == int(self.model))
        if self.hydrogens == "exclude":
            out = out.where(~F.upper("element_symbol").isin("H", "D"))
        return {"conformer_consistent": conformer_consistent, "highest_occupancy": highest_occupancy, "none": blank_only, "all": lambda a, keys: a}[self.altloc](out, keys)


def _blank(c: str = "altloc"):
    return F.coalesce(F.col(c), F.lit("")).isin("", ".", " ")


def first_model(atoms: DataFrame, keys=()) -> DataFrame:
    low = atoms.groupBy(*keys).agg(F.min("model").alias("_first"))
    met = atoms.join(F.broadcast(low)) if not keys else atoms.join(low, list(keys))
    return met.where(F.col("model") == F.col("_first")).drop("_first")


def conformer_consistent(atoms: DataFrame, keys=(), chain: str = "label_asym_id") -> DataFrame:
    """One label for each chain: the largest sum of occupancies, ties to the smallest label. Blank atoms stay."""
    k = [*keys, chain]
    score = atoms.where(~_blank()).groupBy(*k, "altloc").agg(F.round(F.sum("occupancy"), 6).alias("s"))
    best = score.groupBy(*k).agg(F.min(F.struct((-F.col("s")).alias("s"), "altloc")).alias("b")).select(*k, F.col("b.altloc").alias("_best"))
    return atoms.join(best, k, "left").where(_blank() | (F.col("altloc") == F.col("_best"))).drop("_best")


def highest_occupancy(atoms: DataFrame, keys=()) -> DataFrame:
    """Of the places of one atom of a residue, the one with the largest occupancy, ties to the smallest label."""
    w = Window.partitionBy(*keys, "residue_index", "atom_name").orderBy(F.desc("occupancy"), "altloc", "atom_index")
    return atoms.withColumn("_r", F.row_number().over(w)).where(_blank() | (F.col("_r") == 1)).drop("_r")


def blank_only(atoms: DataFrame, keys=()) -> DataFrame:
    return atoms.where(_blank())


@dataclass(frozen=True)
class Analysis:
    """An answer with what it rests on."""

    value: DataFrame | None
    status: str  # complete, partial, indeterminate
    intended: int
    used: int
    missing: int
    policy: Policy
    reason: str = ""
    assumptions: tuple[str, ...] = field(default=())

    def provenance(self) -> str:
        """Deterministic JSON of everything but the rows."""
        return json.dumps({"assumptions": self.assumptions, "coverage": {"intended": self.intended, "missing": self.missing, "used": self.used}, "policy": asdict(self.policy), "reason": self.reason, "status": self.status}, sort_keys=True)


def govern(atoms: DataFrame, policy: Policy, analyse: Callable[[DataFrame], DataFrame], needs: tuple[str, ...] = ("x", "y", "z"), keys=()) -> Analysis:
    """``analyse`` on the atoms that the policy chooses and that have every value in ``needs``.

    Coverage is one aggregation. Without a needed column, without a usable atom, or with missing
    values under ``refuse``, the answer is indeterminate.
    """
    absent = [c for c in needs if c not in atoms.columns]
    if absent:
        return Analysis(None, "indeterminate", 0, 0, 0, policy, f"no column {', '.join(absent)}")
    chosen = policy.apply(atoms, keys)
    ok = F.lit(True)
    for c in needs:
        ok = ok & F.col(c).isNotNull()
    n = chosen.agg(F.count("*").alias("n"), F.coalesce(F.sum(ok.cast("long")), F.lit(0)).alias("used")).first()
    missing = n.n - n.used
    if not n.used:
        return Analysis(None, "indeterminate", n.n, 0, missing, policy, "no usable atom")
    if missing and policy.missing_atoms == "refuse":
        return Analysis(None, "indeterminate", n.n, n.used, missing, policy, f"{missing} atoms lack a value")
    return Analysis(analyse(chosen.where(ok)), "partial" if missing else "complete", n.n, n.used, missing, policy)
