"""Near-duplicate detection: MinHash with tensored banding, exact verification, components.

A document is the set of its distinct w-word shingles. Two collections of SIDE band hashes each (a
band is ROWS minima) are computed; every pair of one band from either collection is a table key, so
SIDE * SIDE tables cost 2 * SIDE bands of minima instead of SIDE * SIDE.

Equal sets are one node. Buckets of a table are never expanded into pairs:

1. every row of a bucket is verified against the bucket's first row (a star), on the full sets;
2. links make components, and what a bucket holds outside its largest component is all that is left
   to test: against that component, and among itself. Small buckets do so pair by pair; in large ones
   the remaining rows are met, as a query set in blocks of bounded size, with the members.

Every pair that shares a bucket is thus verified or already connected; none is dropped. A pair with
similarity s shares none with probability 1 - (1 - (1 - s^ROWS)^SIDE)^2: under 2e-4 for s = 0.8. A pair
at 0.1 shares one with probability 1.7e-4, at 0.05 with 2.6e-6: what unlike texts add stays small.

Defined results: null and empty texts and texts of white space have no shingles and are linked with
nothing; texts shorter than w words are one shingle; a null identifier is linked with nothing and its
component is null; repeated rows and identical texts are one component, as are rows that share an
identifier; an empty table gives an empty result; extra columns are ignored, or kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, slices, small_batches, stored, trimmed

SIDE, ROWS = 13, 3
#: Links: 100 * intersection >= THRESHOLD * union.
THRESHOLD = 80
#: Rows of a bucket, or of what is left of it, up to which pairs are made one by one.
SMALL = 32
#: Sets and queries in one block of the others.
MEMBERS, QUERIES = 256, 1024
#: What may be broadcast of (node, k1, k2), and what such a row takes in a hash table; more is joined by a shuffle.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 64

#: Word hashes that a worker keeps, and texts that it holds as Python strings.
KNOWN_WORDS, SLICE = 100_000, 256

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, width: int, hashes: _WordHashes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles. ``bytes`` knows the white space and the letters that are meant."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, np.uint64(min(len(h), width)))
    for j in range(min(width, len(h))):
        out = _mixed(out * _GOLD + h[j : j + n])
    return np.unique(out)


def _seeds() -> np.ndarray:
    return _mixed(np.arange(1, 2 * SIDE * ROWS + 1, dtype=np.uint64) * _GOLD) | np.uint64(1)


def bands(s: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """2 * SIDE band hashes of one set; either half is a collection."""
    least = np.empty(len(seeds), np.uint64)
    for i, m in enumerate(seeds):
        least[i] = (s * m).min()  # shingles are mixed hashes: an odd factor orders them anew
    both = least.reshape(2 * SIDE, ROWS)
    out = np.arange(2 * SIDE, dtype=np.uint64)
    for j in range(ROWS):
        out = _mixed(out * _GOLD + both[:, j])
    return out


def _key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    import xxhash

    d = xxhash.xxh128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def sketches(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, k1, k2, bands): one row per document."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seeds = _WordHashes(), _seeds()
        with np.errstate(over="ignore"):
            for b in slices(batches, SLICE):
                n, k1, k2, out = [], [], [], []
                for t in b.column("text").to_pylist():
                    s = shingles(t, width, hashes)
                    n.append(len(s))
                    a, z = _key(s) if len(s) else (None, None)
                    k1.append(a)
                    k2.append(z)
                    out.append(bands(s, seeds).view(np.int64) if len(s) else None)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["id", "n", "k1", "k2", "bands"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(trimmed(sketch), "id long, n long, k1 long, k2 long, bands array<long>")


#: Bucket rows that one task makes; it counts them by key in memory.
TASK_ROWS = 1 << 20


def buckets(nodes: DataFrame) -> DataFrame:
    """(key, node, n, lead, rows): rows of buckets with two nodes or more; lead is the bucket's smallest node."""
    pair = f"flatten(transform(sequence(0, {SIDE - 1}), i -> transform(sequence({SIDE}, {2 * SIDE - 1}), j -> xxhash64(bands[i], bands[j]))))"
    # a reader gives a small table few tasks, each of which becomes SIDE * SIDE as large and would spill
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), nodes.count() * SIDE * SIDE // TASK_ROWS)
    rows = nodes.select("node", "n", "bands").repartition(tasks, "node").select("node", "n", F.explode(F.expr(pair)).alias("key"))
    many = rows.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("rows")).where("rows > 1")
    return rows.join(many.hint("merge"), "key")  # sizes are underrated behind an explode: not to be broadcast


def _sets(docs: DataFrame, needed: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(node, n, s): the full sets of the needed nodes (node, k1, k2), made again from their texts."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        with np.errstate(over="ignore"):
            for b in slices(batches, SLICE):
                sets = [shingles(t, width, hashes) for t in b.column("text").to_pylist()]
                right = [_key(s) == (x, y) for s, x, y in zip(sets, b.column("k1").to_pylist(), b.column("k2").to_pylist(), strict=True)]
                at = np.flatnonzero(right)
                for i in range(0, len(at), SLICE):
                    some = at[i : i + SLICE]
                    yield pa.RecordBatch.from_arrays([b.column("node").take(pa.array(some)), pa.array([len(sets[k]) for k in some], pa.int64()), pa.array([sets[k].view(np.int64) for k in some], pa.list_(pa.int64()))], names=["node", "n", "s"])

    src = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    small = F.broadcast(needed) if needed.count() * ROW_BYTES <= BROADCAST_BYTES else needed.hint("merge")
    return src.join(small, "node").mapInArrow(trimmed(make), "node long, n long, s array<long>")


def _ratio(a: str, b: str, threshold: int) -> str:
    """Sets of such sizes may be linked."""
    return f"100 * least({a}, {b}) >= {threshold} * greatest({a}, {b})"


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that are linked, by their full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
    both = F.expr("size(array_intersect(sa, sb))")
    return pairs.join(left, "a").join(right, "b").where(100 * both >= threshold * (F.col("na") + F.col("nb") - both)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of the nodes that edges (a, b) touch; comp is the smallest node reachable.

    Each round takes the least label around and then the label of the label, so chains shorten by
    half; every round is written, and only a count comes to the driver.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("around"))
        step = labels.drop("old").join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "around").alias("comp"))
        up = step.select(F.col("node").alias("comp"), F.col("comp").alias("upper"))
        new = stored(step.join(up, "comp").select("node", "old", F.col("upper").alias("comp")), "labels")
        moved = new.where("old != comp").limit(1).count()
        forget(labels)
        labels = new
        if not moved:
            forget(both)
            found = labels.drop("old")
            found.stored_path = labels.stored_path
            return found


def _blocked(queries: DataFrame, members: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) between queries (g, x) and members (g, y) of the same group, in blocks of bounded size."""
    size = members.groupBy("g").agg(F.count("*").alias("n_members")).join(queries.groupBy("g").agg(F.count("*").alias("n_queries")), "g")
    size = size.select("g", F.ceil(F.col("n_members") / MEMBERS).cast("long").alias("mb"), F.ceil(F.col("n_queries") / QUERIES).cast("long").alias("qb"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n, v: F.pmod(F.xxhash64(v), F.col(n))
    m = members.join(size, "g").select("g", F.col("y").alias("node"), own("mb", "y").alias("i"), every("qb").alias("j")).join(sets, "node").select("g", "node", "i", "j", "n", "s")
    q = queries.join(size, "g").select("g", F.col("x").alias("node"), every("mb").alias("i"), own("qb", "x").alias("j")).join(sets, "node").select("g", "node", "i", "j", "n", "s")
    q = q.toDF("g", "node", "i", "j", "n", "s")  # names of its own, apart from the members'

    def meet(members: pa.Table, queries: pa.Table) -> pa.Table:
        a, b = [], []
        if members.num_rows and queries.num_rows:
            node, count = members["node"].to_numpy(), members["n"].to_numpy()
            s = members["s"].combine_chunks()
            values, owner = s.flatten().to_numpy(), np.repeat(np.arange(len(node)), count)
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            top = {}

            def root(v):
                while top.setdefault(v, v) != v:
                    top[v] = v = top[top[v]]
                return v

            sq = queries["s"].combine_chunks()
            for i, x in enumerate(queries["node"].to_pylist()):
                mine = sq[i].values.to_numpy()
                lo, hi = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
                n = hi - lo
                at = np.repeat(hi - np.cumsum(n), n) + np.arange(int(n.sum()))
                shared = np.bincount(owner[at], minlength=len(node))
                for k in np.flatnonzero((100 * shared >= threshold * (len(mine) + count - shared)) & (node != x)):
                    y = int(node[k])
                    if root(x) != root(y):  # a spanning forest of the block's links says the same
                        top[root(x)] = root(y)
                        a.append(x)
                        b.append(y)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return m.groupBy("g", "i", "j").cogroup(q.groupBy("g", "i", "j")).applyInArrow(meet, "a long, b long")


def _rest(rows: DataFrame, labels: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links between nodes that share a bucket, are not connected yet, and are not both in a tested star; stored."""
    rows = rows.where("rows > 2").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key")
    rows = found = stored(rows.join(mixed, "key").select("key", "node", "n", "lead", "comp"), "mixed")
    per = rows.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("comp", F.struct("c", -F.col("comp"))).alias("main"), F.max("c").alias("n_main"), F.sum("c").alias("n_all"))
    rows = stored(rows.join(per, "key"), "mixed")
    left = rows.where("comp != main").withColumn("n_left", F.col("n_all") - F.col("n_main"))
    x = left.select("key", F.col("node").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), "lead", "n_main", "n_left")
    few_main = rows.where(f"comp = main and n_main <= {SMALL}").select("key", F.col("node").alias("b"), F.col("n").alias("nb"))
    few_left = left.where(f"n_left <= {SMALL}").select("key", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
    may = F.expr(_ratio("na", "nb", threshold) + " and a != lead and b != lead")
    pairs = x.where(f"n_main <= {SMALL}").join(few_main, "key").where(may).select("a", "b").union(x.where(f"n_left <= {SMALL}").join(few_left, "key").where(may & (F.col("ca") != F.col("cb")) & (F.col("a") < F.col("b"))).select("a", "b"))
    links = _verified(pairs.distinct(), sets, threshold)
    # large ones: the rest of a bucket against its main component, and against itself
    to_main = x.where(f"n_main > {SMALL}").join(per.select("key", "main"), "key").select(F.col("main").alias("g"), F.col("a").alias("x")).distinct()
    in_main = rows.where(f"comp = main and n_main > {SMALL}").select(F.col("main").alias("g"), F.col("node").alias("y")).distinct()
    among = left.where(f"n_left > {SMALL}")
    every = links.unionByName(_blocked(to_main, in_main, sets, threshold)).unionByName(_blocked(among.select(F.col("key").alias("g"), F.col("node").alias("x")), among.select(F.col("key").alias("g"), F.col("node").alias("y")), sets, threshold))
    out = stored(every, "links")
    forget(found, rows)
    return out


def near_dedup(docs: DataFrame, width: int = 5, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept."""
    small_batches(docs.sparkSession)
    every = stored(sketches(docs, width, id_col, text_col), "sketches")
    some = every.where("n > 0 and id is not null")
    # equal sets are one node, named by its smallest document
    nodes = stored(some.groupBy("k1", "k2").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands")), "nodes")
    # rows that share an identifier belong together
    same = some.join(nodes.select("k1", "k2", "node"), ["k1", "k2"]).where("id != node").select("id", "node")
    rows = stored(buckets(nodes), "buckets")
    needed = stored(rows.select("node").distinct().join(nodes.select("node", "k1", "k2"), "node"), "needed")
    sets = stored(_sets(docs, needed, width, id_col, text_col), "sets")
    star = rows.where("node != lead").select(F.col("lead").alias("a"), F.col("node").alias("b"), "n").distinct()
    star = star.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("n_lead")), "a").where(_ratio("n", "n_lead", threshold)).select("a", "b")
    links = stored(_verified(star, sets, threshold), "links")
    starred = components(links)
    more = _rest(rows, starred, sets, threshold)
    repeated = some.select("id", "k1", "k2").distinct().groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id")
    tied = same.join(repeated, "id", "left_semi").select(F.col("id").alias("a"), F.col("node").alias("b"))
    found = components(links.unionByName(more).unionByName(tied))
    forget(rows, needed, sets, links, starred, more)
    out = every.join(nodes.select("k1", "k2", "node"), ["k1", "k2"], "left").join(found, "node", "left")
    comp = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("comp", "node", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest identifier."""
    gone = near_dedup(docs, width, threshold, id_col, text_col).where("not kept").select(F.col(id_col).cast("long").alias("_gone")).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col("_gone"), "left_anti")
