"""Statistics of series and ensembles beyond single frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histogram(values: DataFrame, value: str, low: float, high: float, bins: int, keys=()) -> DataFrame:
    """(keys, bin, n, density), half open; density integrates to the share inside."""
    width = (high - low) / bins
    total = values.groupBy(*keys).agg(F.count(value).alias("t")) if keys else values.agg(F.count(value).alias("t"))
    d = values.where((F.col(value) >= low) & (F.col(value) < high)).groupBy(*keys, F.floor((F.col(value) - low) / width).alias("bin")).agg(F.count("*").alias("n"))
    d = d.join(F.broadcast(total), list(keys)) if keys else d.join(F.broadcast(total))
    return d.select(*keys, "bin", "n", (F.col("n") / (F.col("t") * width)).alias("density"))


def free_energy(counts: DataFrame, kt: float, keys=()) -> DataFrame:
    """(…, energy): -kT ln of a count over the largest one."""
    top = F.max("n").over(Window.partitionBy(*keys))
    return counts.withColumn("energy", -F.lit(kt) * F.log(F.col("n") / top))


def transitions(states: DataFrame, keys=("series",), state: str = "state", order: str = "frame") -> DataFrame:
    """(before, after, n, probability) of states in neighbouring frames."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = states.select(F.lag(state).over(w).alias("before"), F.col(state).alias("after")).where("before is not null")
    n = d.groupBy("before", "after").agg(F.count("*").alias("n"))
    return n.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy("before")))


def dwell_times(states: DataFrame, keys=("series",), state: str = "state", order: str = "frame") -> DataFrame:
    """(keys, state, visits, mean, longest): lengths of stays in a state."""
    w, s = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys, state).orderBy(order)
    d = states.select(*keys, state, (F.row_number().over(w) - F.row_number().over(s)).alias("_run"))
    runs = d.groupBy(*keys, state, "_run").agg(F.count("*").alias("n"))
    return runs.groupBy(*keys, state).agg(F.count("*").alias("visits"), F.avg("n").alias("mean"), F.max("n").alias("longest"))


def velocities(frames: DataFrame, value: str = "value", keys=("series",), time: str = "frame") -> DataFrame:
    """(keys, time, velocity) by the difference to the frame before."""
    w = Window.partitionBy(*keys).orderBy(time)
    return frames.select(*keys, time, F.try_divide(F.col(value) - F.lag(value).over(w), F.col(time) - F.lag(time).over(w)).alias("velocity")).where("velocity is not null")


def running_mean(frames: DataFrame, reach: int, value: str = "value", keys=("series",), order: str = "frame") -> DataFrame:
    """(keys, order, mean) over ``reach`` frames to either side."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-reach, reach)
    return frames.select(*keys, order, F.avg(value).over(w).alias("mean"))


def cross_correlation(wide: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of each pair of columns, in one pass."""
    pairs = [(x, y) for i, x in enumerate(columns) for y in columns[i + 1 :]]
    one = wide.agg(F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.corr(x, y).alias("r")) for x, y in pairs]).alias("m"))
    return one.select(F.explode("m").alias("m")).select("m.*")


def group_variance(values: DataFrame, group: str, value: str) -> DataFrame:
    """(between, within, total, share): how much of the variation a grouping holds."""
    g = values.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    t = g.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"))
    between = F.col("q") - F.col("n") * F.col("mean") * F.col("mean")
    return t.select(between.alias("between"), "within", (between + F.col("within")).alias("total"), F.try_divide(between, between + F.col("within")).alias("share"))


def single_linkage(distances: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """(item, cluster): items joined by chains of distances at or under the threshold; named by the smallest."""
    from ..functions.graph import components

    c = components(distances.where(F.col("distance") <= threshold).select(F.col("first").alias("a"), F.col("second").alias("b")))
    return items.select("item").join(c.withColumnRenamed("node", "item"), "item", "left").select("item", F.coalesce("comp", "item").alias("cluster"))


def single_linkage_of(points: DataFrame, threshold: float) -> DataFrame:
    """``single_linkage`` of points (atom, x, y, z) by their distances, which are not made."""
    from .spatial import radius_components

    c = radius_components(points, threshold).withColumnRenamed("node", "item")
    return points.select(F.col("atom").alias("item")).join(c, "item", "left").select("item", F.coalesce("comp", "item").alias("cluster"))


def time_windows(events: DataFrame, size: str, keys=("event_type",)) -> DataFrame:
    """(start, keys, n, total) of windows that do not overlap."""
    d = events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", size).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return d.select(F.col("w.start").cast("timestamp_ntz").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, gap_seconds: int, keys=("series",)) -> DataFrame:
    """(keys, session, start, n): stretches without a pause of more than ``gap_seconds``."""
    w = Window.partitionBy(*keys).orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    d = events.withColumn("_new", F.coalesce((at - F.lag(at).over(w) > gap_seconds * 1_000_000).cast("int"), F.lit(0)))
    d = d.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "session").agg(F.min("ts").alias("start"), F.count("*").alias("n"))


def nearest_before(left: DataFrame, right: DataFrame, keys=("series",), order: str = "ts", value: str = "value") -> DataFrame:
    """As-of join: each row of ``left`` with the last ``value`` of ``right`` at or before it.

    Both sides go once through one sort by key and time; no range join.
    """
    a = left.select(*keys, order, F.col("id"), F.lit(None).cast(dict(right.dtypes)[value]).alias("v"), F.lit(1).alias("side"))
    b = right.select(*keys, order, F.lit(None).cast(dict(left.dtypes)["id"]).alias("id"), F.col(value).alias("v"), F.lit(0).alias("side"))
    w = Window.partitionBy(*keys).orderBy(order, "side", "v").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("last", F.last("v", ignorenulls=True).over(w)).where("side = 1").select(*keys, order, "id", "last")
