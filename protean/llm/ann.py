"""Approximate nearest neighbours by multi-index hashing.

Directions are rotated by a matrix learned on a bounded sample (principal axes, then alternating
rotation towards the corners of the cube) and their signs make a 64-bit code. Codes are split into
substrings, each with an index of its own. If two codes differ in at most r bits, one of m substrings
differs in at most r / m: probing every bucket that near in each index retrieves every code within
radius r. What is within r is ranked again by the inner product of the original vectors in double
precision. The radius is learned on the sample too, for a wanted recall; queries with fewer than k
rows in it are searched again without a radius.

Rows are indexed once: the index is a table (substring number, value, id, code), and a query's probes
are joined to it. A pair that several substrings find counts for the first of them. Each row is moved
once for each substring and each vector once more to its hits, so what is shuffled grows with rows and hits.
Equal vectors are one entry that carries its k + 1 smallest identifiers, found in two levels, so copies
fill no bucket. Where the radius is so wide that probes would name most buckets (PROBES), which
happens when vectors have no structure, an index cannot narrow anything: there the same codes are
compared in blocks, whole queries against whole rows, and only what is within the radius is ranked.

The largest inner product, not the nearest direction, is wanted: rows get one more component that
brings all to one norm.

Defined results: vectors that are null, all zero, of another length than most, or that hold null or
non-finite components take no part, nor do null identifiers; rows that repeat a query's identifier
count as the query's own; ties go to the smaller identifier; fewer rows than k give them all; empty
tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sampled, stored

BITS, TABLES = 64, 4
#: About so many rows are learned on, at most twice as many: those with the smallest hashes; queries among them.
SAMPLE, SAMPLE_QUERIES = 8192, 256
RECALL = 0.98
#: Blocks of the search by codes, and queries that are ranked at a time in one.
QUERY_BLOCK, ROW_BLOCK, STEP = 8192, 16384, 512
#: Buckets of one index that a query may probe: substrings of 16 bits that differ in three bits at most are 697.
PROBES = 700
#: Parts that the identifiers of equal vectors are dealt to before the smallest are taken.
SALT = 64
ROUNDS = 15


def usable(v: Column) -> Column:
    """No null, no non-finite component, not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _rotations(x: np.ndarray, bits: int, seed: int = 7) -> np.ndarray:
    """(dimensions, bits): learned rotations, side by side until there are enough bits."""
    rng = np.random.default_rng(seed)
    _, axes = np.linalg.eigh(x.T @ x)
    out, have = [], 0
    while have < bits:
        w = axes[:, ::-1][:, : min(bits - have, x.shape[1])]
        y = x @ w
        r, _ = np.linalg.qr(rng.normal(size=(w.shape[1], w.shape[1])))
        for _ in range(ROUNDS):
            u, _, vt = np.linalg.svd(np.where(y @ r >= 0, 1.0, -1.0).T @ y)
            r = (u @ vt).T
        out.append(w @ r)
        have += w.shape[1]
    return np.concatenate(out, axis=1)


def _codes(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    return np.packbits(x @ rotation >= 0, axis=1, bitorder="little").view(np.uint64).ravel()


def _raised(v: np.ndarray, norm: float) -> np.ndarray:
    """Rows with one more component, so that all have length ``norm``."""
    return np.concatenate([v, np.sqrt(np.maximum(0, norm**2 - (v**2).sum(1, keepdims=True)))], axis=1)


def _flat(v: np.ndarray) -> np.ndarray:
    return np.concatenate([v, np.zeros((len(v), 1))], axis=1)


def learn(rows: DataFrame, k: int, recall: float = RECALL) -> tuple[int, float, np.ndarray, int] | None:
    """(dimensions, largest norm, rotation, radius) of a table (id, v)."""
    n = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(n).alias("norm")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not dims:
        return None
    d, norm = dims[0].d, dims[0].norm
    got = sorted(sampled(rows.where(F.size("v") == d), F.col("id"), SAMPLE, dims[0].n).select("id", "v").limit(2 * SAMPLE).collect())
    v = np.array([r.v for r in got], dtype=float)
    x = _raised(v, norm)
    rotation = _rotations(x, BITS)
    q = v[:SAMPLE_QUERIES]
    score = q @ v.T
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    near = np.argsort(-score, axis=1)[:, : max(1, min(k, len(v) - 1))]
    apart = np.bitwise_count(_codes(_flat(q), rotation)[:, None] ^ _codes(x, rotation)[near])
    # a sample's neighbours are farther than the table's, so this radius is on the safe side
    return d, norm, rotation, int(np.quantile(apart, recall)) if len(v) > k else BITS


class MultiIndex:
    """Substring indexes of a block of codes."""

    def __init__(self, codes: np.ndarray, tables: int = TABLES):
        self.codes, self.tables, self.width = codes, tables, BITS // tables
        self.buckets = [np.unique(self._part(codes, j), return_inverse=True) for j in range(tables)]

    def _part(self, codes: np.ndarray, j: int) -> np.ndarray:
        return (codes >> np.uint64(j * self.width)) & np.uint64((1 << self.width) - 1)

    def within(self, queries: np.ndarray, radius: int) -> np.ndarray:
        """(queries, codes): True for every code within ``radius``; found by probing near buckets, then by the whole code."""
        found = np.zeros((len(queries), len(self.codes)), dtype=bool)
        for j, (values, where) in enumerate(self.buckets):
            near = np.bitwise_count(self._part(queries, j)[:, None] ^ values[None, :]) <= radius // self.tables
            found |= near[:, where]
        found &= np.bitwise_count(queries[:, None] ^ self.codes[None, :]) <= radius
        return found


def _matrix(b: pa.Array, d: int) -> np.ndarray:
    return np.asarray(b.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(-1, d)


def probe_masks(radius: int, tables: int = TABLES) -> list[int] | None:
    """What a substring is changed by to reach every bucket a query probes; None where these are more than PROBES."""
    width, flips = BITS // tables, radius // tables
    if sum(math.comb(width, i) for i in range(flips + 1)) > PROBES:
        return None
    return [sum(1 << b for b in c) for i in range(flips + 1) for c in itertools.combinations(range(width), i)]


def _part(code: str, j: str) -> str:
    return f"(shiftrightunsigned({code}, {j} * {BITS // TABLES}) & {(1 << BITS // TABLES) - 1}L)"


def indexed(entries: DataFrame) -> DataFrame:
    """(j, value, entry, code): the substring indexes of all entries."""
    return entries.select("entry", "code", F.explode(F.sequence(F.lit(0), F.lit(TABLES - 1))).alias("j")).withColumn("value", F.expr(_part("code", "j")))


def candidates(queries: DataFrame, index: DataFrame, radius: int, masks: list[int]) -> DataFrame:
    """(query_id, entry): every pair of codes within ``radius``, once, by probing near buckets."""
    flips = radius // TABLES
    probes = queries.select("query_id", F.col("code").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(TABLES - 1))).alias("j"))
    # the masks are a literal of PROBES numbers at most
    probes = probes.withColumn("value", F.explode(F.transform(F.array(*map(F.lit, masks)), lambda m: F.expr(_part("q", "j")).bitwiseXOR(m.cast("long")))))
    met = probes.join(index.hint("merge"), ["j", "value"])
    earlier = F.expr(f"exists(sequence(0, {TABLES - 1}), i -> i < j and bit_count({_part('(q ^ code)', 'i')}) <= {flips})")
    return met.where((F.expr("bit_count(q ^ code)") <= radius) & ~earlier).select("query_id", "entry")


def _coded(rotation: np.ndarray, norm: float, d: int):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("v"), d)
            c = _codes(_raised(v, norm), rotation).view(np.int64) if len(v) else np.zeros(0, np.int64)
            q = _codes(_flat(v), rotation).view(np.int64) if len(v) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(c), pa.array(q)], names=[*b.schema.names, "code", "asks_code"])

    return code


def _searched(k: int, d: int, radius: int):
    """Ranks a block of queries against a block of entries, of which those within the radius by their codes."""

    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out_q, out_e = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if queries.num_rows and rows.num_rows:
            v, entry = _matrix(rows["v"].combine_chunks(), d), rows["entry"].to_numpy()
            index = MultiIndex(rows["code"].to_numpy().view(np.uint64))
            for at in range(0, queries.num_rows, STEP):
                some = queries.slice(at, STEP)
                q, qid = _matrix(some["v"].combine_chunks(), d), some["query_id"].to_numpy()
                score = np.where(index.within(some["code"].to_numpy().view(np.uint64), radius), q @ v.T, -np.inf)
                for i, s in enumerate(score):
                    # k + 1 entries, as one may be the query's own; near ties stay in until scores are computed exactly
                    least = np.partition(s, -k - 1)[-k - 1] if len(s) > k + 1 else -np.inf
                    near = np.flatnonzero((s >= least - 1e-9 * (1 + abs(least))) if np.isfinite(least) else np.isfinite(s))
                    out_q.append(np.full(len(near), qid[i]))
                    out_e.append(entry[near])
        return pa.table({"query_id": pa.array(np.concatenate(out_q), pa.int64()), "entry": pa.array(np.concatenate(out_e), pa.int64())})

    return search


def _scanned(queries: DataFrame, entries: DataFrame, n_queries: int, n_rows: int, k: int, d: int, radius: int) -> DataFrame:
    """(query_id, entry): the nearest entries within the radius by comparing codes block by block."""
    nq, nr = max(1, -(-n_queries // QUERY_BLOCK)), max(1, -(-n_rows // ROW_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    one = lambda n, c: F.pmod(F.xxhash64(c), F.lit(n).cast("long"))
    q = queries.select("query_id", "code", "v", one(nq, "query_id").alias("qb"), every(nr).alias("rb"))
    r = entries.select("entry", "code", "v", every(nq).alias("qb"), one(nr, "entry").alias("rb"))
    return q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInArrow(_searched(k, d, radius), "query_id long, entry long")


def smallest_ids(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): different vectors with their k + 1 smallest identifiers; copies are thinned in parts first."""
    salt = F.pmod(F.xxhash64("id"), F.lit(SALT))
    first = rows.select("id", "v", salt.alias("salt")).distinct().withColumn("n", F.row_number().over(Window.partitionBy("v", "salt").orderBy("id"))).where(F.col("n") <= k + 1)
    return first.groupBy("v").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids"))


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query."""
    spark, v = vectors.sparkSession, F.col(vector_col)
    rows = stored(vectors.where(F.col(id_col).isNotNull() & usable(v)).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")), "ann-rows")
    model = learn(rows, k, recall)
    if model is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, norm, rotation, radius = model
    rows = rows.where(F.size("v") == d)
    # -0.0 and 0.0 are one value to a grouping; an entry is named by its smallest identifier, which no other has unless identifiers repeat
    grouped = smallest_ids(rows, k).select(F.xxhash64("v", F.col("ids")[0]).alias("entry"), "ids", "v")
    entries = stored(grouped.mapInArrow(_coded(rotation, norm, d), "entry long, ids array<long>, v array<double>, code long, asks_code long"), "ann-entries")
    asked = rows.where("asks").select(F.col("id").alias("query_id"), "v").groupBy("query_id", "v").agg(F.count("*").alias("copies"))
    queries = stored(asked.mapInArrow(_coded(rotation, norm, d), "query_id long, v array<double>, copies long, code long, asks_code long").select("query_id", "v", F.col("asks_code").alias("code")), "ann-queries")
    n_rows, n_queries = entries.count(), queries.count()

    def ranked(pairs: DataFrame) -> DataFrame:
        """The k best identifiers of each query's entries, by products of the original vectors added up in order."""
        a = queries.select("query_id", F.col("v").alias("qv"))
        b = entries.select("entry", "ids", F.col("v").alias("rv"))
        product = F.expr("aggregate(zip_with(qv, rv, (x, y) -> x * y), 0D, (s, x) -> s + x)")
        met = pairs.join(b, "entry").join(a, "query_id").select("query_id", product.alias("score"), F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
        # a row whose identifier repeats with another vector is found once, at its best
        met = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return met.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    masks = probe_masks(radius)
    if masks is None:
        pairs = _scanned(queries, entries, n_queries, n_rows, k, d, radius)
    else:
        pairs = candidates(queries, indexed(entries), radius, masks)
    first = stored(ranked(pairs), "ann-found")
    full = min(k, rows.select("id").distinct().count() - 1)
    short = queries.join(first.groupBy("query_id").count().where(F.col("count") >= full).select("query_id"), "query_id", "left_anti")
    n_short = short.count()
    if not n_short or not full:
        return first
    again = ranked(_scanned(short, entries, n_short, n_rows, k, d, BITS))
    return first.join(short.select("query_id").distinct(), "query_id", "left_anti").unionByName(again)
