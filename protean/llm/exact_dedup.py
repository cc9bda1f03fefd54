"""Exact deduplication by content sort.

Sampled splitters range-partition the rows by normalised content, each partition is sorted
externally so that equal texts are adjacent, and each text is compared in full with its neighbour.
A run of equal texts keeps the row with the smallest identifier.

Splitters are drawn over (the text's first PREFIX characters, its SHA-256, identifier): a sample stays
small however long the texts are, and a text that a third of all rows share is cut into several
partitions by identifier. Texts that are alike for longer than PREFIX stand next to each other too, in
the order of their hashes; neighbours are compared in full all the same. Runs that continue over a partition's edge are put together from one
record per partition, again after a full comparison of the two texts.

Defined results
  * null text: the same as the empty text, one group with it;
  * null identifier: sorted last, so it is kept only if no row of the group has an identifier;
  * repeated rows (equal identifier and text): one group; exactly one row has ``kept``;
  * empty table: empty result; extra columns of any name are ignored, or carried unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_RUN, small_batches, stored, trimmed

#: Characters of a text that order it before the hash does; they bound the splitters' sample, 1 KB a row.
PREFIX = 1024


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def _sorted(docs: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    small_batches(docs.sparkSession)
    cols = [F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("norm")]
    if carry:
        cols.append(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    keyed = docs.select(*cols).withColumn("sha", F.sha2("norm", 256))
    order = [F.substring("norm", 1, PREFIX).asc(), F.asc("sha"), F.asc_nulls_last("id")]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order)


def _starts(norm: pa.Array, before: str | None) -> np.ndarray:
    """True where a text differs from the one before it, compared in full."""
    out = np.ones(len(norm), dtype=bool)
    if len(norm) > 1:
        out[1:] = ~np.asarray(pc.equal(norm[1:], norm[:-1]).to_numpy(zero_copy_only=False), dtype=bool)
    if before is not None and len(norm):
        out[0] = norm[0].as_py() != before
    return out


DECISION = "id long, sha string, keep_id long, group_size long, lead boolean, part int, edge int, edge_text string"
_DECISION = pa.schema([("id", pa.int64()), ("sha", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("lead", pa.bool_()), ("part", pa.int32()), ("edge", pa.int32()), ("edge_text", pa.string())])


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring comparisons of one sorted partition; holds its identifiers, not its texts."""
    ids, shas, begins, before, first_text = [], [], [], None, None
    for b in batches:
        if not b.num_rows:
            continue
        norm = b.column("norm")
        begins.append(_starts(norm, before))
        before = norm[len(norm) - 1].as_py()
        if first_text is None:
            first_text = norm[0].as_py()
        ids.append(b.column("id"))
        shas.append(b.column("sha"))
    if not ids:
        return
    part = TaskContext.get().partitionId()
    begin = np.concatenate(begins)
    begin[0] = True
    run = np.cumsum(begin) - 1
    at = np.flatnonzero(begin)
    size = np.diff(np.append(at, len(begin)))
    id_all = pa.concat_arrays(ids)
    keep = id_all.take(pa.array(at))
    edge = np.zeros(len(at), dtype=np.int32)
    edge[0] |= 1
    edge[-1] |= 2
    done = 0
    for k, x in enumerate(ids):
        r = run[done : done + len(x)]
        text: list[str | None] = [None] * len(x)
        if k == len(ids) - 1:
            text[-1] = before
        if k == 0:
            text[0] = first_text
        yield pa.RecordBatch.from_arrays(
            [x, shas[k], keep.take(pa.array(r)), pa.array(size[r].astype(np.int64)), pa.array(begin[done : done + len(x)]), pa.array(np.full(len(x), part, dtype=np.int32)), pa.array(edge[r]), pa.array(text, pa.string())],
            schema=_DECISION,
        )
        done += len(x)


def _joined_edges(dec: DataFrame) -> list[tuple[int, int, int | None, int, bool]]:
    """(part, edge, keep_id, group_size, continues) of runs that go over an edge. At most two per partition."""
    one = (
        dec.where("edge_text is not null")
        .groupBy("part")
        .agg(
            F.max(F.when(F.col("edge").bitwiseAND(1) > 0, F.struct("edge", "keep_id", "group_size", F.col("edge_text").alias("t")))).alias("a"),
            F.max(F.when(F.col("edge").bitwiseAND(2) > 0, F.struct("edge", "keep_id", "group_size", F.col("edge_text").alias("t")))).alias("z"),
        )
    )
    # One row per partition: the only place where rows of all partitions meet.
    w = Window.orderBy("part")
    rows = one.select("part", F.struct("a.edge", "a.keep_id", "a.group_size").alias("a"), F.struct("z.edge", "z.keep_id", "z.group_size").alias("z"), F.coalesce(F.col("a.t") == F.lag("z.t").over(w), F.lit(False)).alias("same")).orderBy("part").collect()
    chains: list[list[tuple[int, int, int | None, int]]] = []
    for r in rows:
        a = (r.part, r.a.edge, r.a.keep_id, r.a.group_size)
        if r.same:
            chains[-1].append(a)
        else:
            chains.append([a])
        if r.a.edge != 3:
            chains.append([(r.part, r.z.edge, r.z.keep_id, r.z.group_size)])
    out = []
    for c in chains:
        if len(c) > 1:
            known = [x[2] for x in c if x[2] is not None]
            out += [(p, e, min(known) if known else None, sum(x[3] for x in c), k > 0) for k, (p, e, _, _) in enumerate(c)]
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    dec = stored(_sorted(docs, id_col, text_col, False).mapInArrow(trimmed(_decide), DECISION), "exact")
    edges = _joined_edges(dec)
    fix = docs.sparkSession.createDataFrame(edges, "part int, edge int, fix_id long, fix_size long, continues boolean")
    out = dec.drop("edge_text").join(F.broadcast(fix), ["part", "edge"], "left")  # two rows a partition at most
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("fix_size").isNull(), F.col("keep_id")).otherwise(F.col("fix_id")).alias("keep_id"),
        F.coalesce("fix_size", "group_size").alias("group_size"),
        (F.col("lead") & ~F.coalesce("continues", F.lit(False))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, whole and with their own columns."""
    src = _sorted(docs, id_col, text_col, True)
    schema = src.select("row", F.lit(0).alias("part"), F.lit(True).alias("opens"), F.lit(True).alias("closes"), F.lit(None).cast("string").alias("edge_text")).schema

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, last, opened = TaskContext.get().partitionId(), None, None, False
        for b in batches:
            if not b.num_rows:
                continue
            norm, begin = b.column("norm"), _starts(b.column("norm"), before)
            first_text = None if opened else norm[0].as_py()
            before = norm[len(norm) - 1].as_py()
            last = b.slice(b.num_rows - 1)
            kept = b.filter(pa.array(begin))
            n = kept.num_rows
            if n:
                text = [None] * n
                opens = np.zeros(n, dtype=bool)
                if first_text is not None:
                    text[0], opens[0], opened = first_text, True, True
                yield pa.RecordBatch.from_arrays([kept.column("row"), pa.array(np.full(n, part, dtype=np.int32)), pa.array(opens), pa.array(np.zeros(n, dtype=bool)), pa.array(text, pa.string())], names=["row", "part", "opens", "closes", "edge_text"])
        if last is not None:  # the text that ends the partition, as a record of its own
            yield pa.RecordBatch.from_arrays([last.column("row"), pa.array([part], pa.int32()), pa.array([False]), pa.array([True]), pa.array([before])], names=["row", "part", "opens", "closes", "edge_text"])

    dec = stored(src.mapInArrow(trimmed(leads), schema), "exact-rows")
    w = Window.orderBy("part")
    ends = dec.where("edge_text is not null").groupBy("part").agg(F.max(F.when(F.col("opens"), F.col("edge_text"))).alias("a"), F.max(F.when(F.col("closes"), F.col("edge_text"))).alias("z"))
    again = [r.part for r in ends.select("part", (F.col("a") == F.lag("z").over(w)).alias("same")).where("same").collect()]
    fix = docs.sparkSession.createDataFrame([(p, True) for p in again], "part int, opens boolean")
    return dec.where("not closes").join(F.broadcast(fix), ["part", "opens"], "left_anti").select("row.*")
