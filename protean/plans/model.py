"""Driver tables seen as molecular data. Each projection is plain SQL, so an oracle can repeat it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point cloud of ``embeddings``: (atom, x, y, z, chain, residue, mass)."""
    e = F.col("embedding")
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("atom"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y"), e[2].cast("double").alias("z"),
        (F.col("label") % 2).alias("chain"), F.col("label").alias("residue"), (F.col("vec_id") % 3 + 1).cast("double").alias("mass"),
        F.when(F.col("vec_id") % 2 == 0, 1.0).otherwise(-1.0).alias("charge"), e[3].cast("double").alias("vx"), e[4].cast("double").alias("vy"), e[5].cast("double").alias("vz"),
    )


CLOUD = """p as (select vec_id as atom, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z, label % 2 as chain, label as residue,
 (vec_id % 3 + 1)::double as mass, case when vec_id % 2 = 0 then 1.0 else -1.0 end as charge,
 embedding[4]::double as vx, embedding[5]::double as vy, embedding[6]::double as vz from embeddings)"""


def moved(points: DataFrame) -> DataFrame:
    """A second conformation of the cloud: the same atoms, displaced by their next components."""
    return points.select("atom", "chain", "residue", "mass", "charge", *[(F.col(c) + F.col(f"v{c}") * 0.1).alias(c) for c in "xyz"])


MOVED = "m as (select atom, chain, residue, mass, x + vx * 0.1 as x, y + vy * 0.1 as y, z + vz * 0.1 as z from p)"

#: Fixed values shared with the oracle text.
_NAMES = ["N", "CA", "C", "O", "CB", "CG", "CD"]
_COMPONENTS = ["ALA", "GLY", "SER", "HOH", "LYS", "ZN"]


_LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` with each line's place in its order (line numbers repeat)."""
    w = Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER)
    return read(spark, sf_dir, "lineitem").withColumn("line", F.row_number().over(w).cast("long"))


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atom table of ``lineitem``: residues are orders, atoms their lines."""
    order, line = F.col("l_orderkey"), F.col("line")
    names, comps = F.array(*map(F.lit, _NAMES)), F.array(*map(F.lit, _COMPONENTS))
    name = F.element_at(names, ((line - 1) % 7 + 1).cast("int"))
    return _lines(spark, sf_dir).select(
        (order * 64 + line).alias("atom_index"), (order * 64 + line).alias("atom_site_id"), order.alias("residue_index"), (order % 26).alias("chain_index"), (order % 3).alias("entity_index"),
        F.chr(F.lit(65) + order % 26).alias("label_asym_id"), F.chr(F.lit(90) - order % 26).alias("auth_asym_id"), F.element_at(comps, (order % 6 + 1).cast("int")).alias("label_comp_id"),
        F.element_at(comps, (order % 6 + 1).cast("int")).alias("auth_comp_id"), (order % 500).cast("int").alias("label_seq_id"), (order % 500).cast("int").alias("auth_seq_id"), F.lit("").alias("ins_code"),
        F.col("l_linestatus").alias("segid"), name.alias("atom_name"), F.substring(name, 1, 1).alias("element_symbol"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("altloc"),
        (F.col("l_extendedprice") / 1000).alias("x"), (F.col("l_partkey") % 1000 / 10.0).alias("y"), (F.col("l_suppkey") % 100 + F.col("l_tax") * 10).alias("z"),
        (F.col("l_discount") * 10).alias("occupancy"), F.col("l_quantity").alias("b_factor"), F.lit(1).alias("model"),
    )


LINES = "ln as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) as line from lineitem)"

ATOMS = LINES + """, a as (select l_orderkey * 64 + line as atom_index, l_orderkey as residue_index, l_orderkey % 26 as chain_index, l_orderkey % 3 as entity_index,
 chr(cast(65 + l_orderkey % 26 as integer)) as chain, ['ALA','GLY','SER','HOH','LYS','ZN'][cast(l_orderkey % 6 + 1 as integer)] as resname, cast(l_orderkey % 500 as integer) as resid,
 l_linestatus as segid, ['N','CA','C','O','CB','CG','CD'][cast((line - 1) % 7 + 1 as integer)] as name, case when l_returnflag = 'N' then '' else l_returnflag end as altloc,
 l_extendedprice / 1000 as x, l_partkey % 1000 / 10.0::double as y, l_suppkey % 100 + l_tax * 10 as z, l_discount * 10 as occupancy, l_quantity as b_factor from ln)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1-D trajectories of ``events``: (series, frame, value, ts, event_type)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("series"), (F.row_number().over(w) - 1).cast("long").alias("frame"), "value", "ts", "event_type", "event_id")


FRAMES = "f as (select user_id as series, row_number() over (partition by user_id order by ts, event_id) - 1 as frame, value, ts, event_type, event_id from events)"


def bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of bonds along each residue of ``atoms``."""
    key = F.col("l_orderkey") * 64 + F.col("line")
    return _lines(spark, sf_dir).where("line > 1").select((key - 1).alias("atom_a"), key.alias("atom_b"), F.lit("single").alias("order"))


BONDS = "b as (select l_orderkey * 64 + line - 1 as atom_a, l_orderkey * 64 + line as atom_b from ln where line > 1)"
