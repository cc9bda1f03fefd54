"""Connected components of an edge table."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage into the folder that all executors share; only local mode may go without one."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        sc.setCheckpointDir(shared or "file://" + tempfile.mkdtemp(prefix="protean-"))
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of the nodes in edges (a, b); comp is the smallest node of the component.

    Labels take the least around them and then their label's label, so paths shorten by half a round.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")))
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        step = labels.join(around, "node").select("node", F.col("comp").alias("old"), F.least("comp", "c").alias("comp"))
        upper = step.select(F.col("node").alias("comp"), F.col("comp").alias("upper"))
        new = cut(step.join(upper, "comp").select("node", "old", F.col("upper").alias("comp")))
        labels = new.select("node", "comp")
        if not new.where("old != comp").limit(1).count():
            return labels


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Partitioned by ``keys`` into a number that adaptive plans keep: small rows may be long work, and so are not put together by their bytes."""
    return df.repartition(max(200, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)
