"""Mixing sources to target weights, in DataFrame functions only.

Each source's documents stand one after the other in a stream of tokens (words) that is cut into
blocks of a fixed length. Output shards have a fixed number of slots. Each shard draws its source
counts from a multinomial (a hash of its slots against the sources' shares); as draws miss the totals
by about a square root, a source's surplus is taken evenly from its slots over all shards and dealt, by
a permutation, to the sources that got too few. Counts are summed over the shards, which numbers a
source's slots; its n-th slot takes the block to which a permutation of that source's block indices
sends n, and the blocks are joined by (source, index). A source with more slots than blocks starts a
second permutation, so no block is taken more than twice. The last slot of a source takes only the
words that are still due. What the mix takes, its documents and its blocks all come from these slots.

Permutations are swap-or-not shuffles on [0, n): a bijection for every n, evaluated per row, with no
sort and no state. Positions in a stream come from two-level prefix sums over (source, bucket), so
a source with a third of all rows is summed in many tasks.

Defined results: null and empty texts have size 0 and are never taken; null sources are one source,
which comes last; repeated rows are separate documents; null identifiers are sorted last; a source of
size 0 has target 0; an empty table gives an empty result; extra columns of any name are ignored, or
kept by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

#: The weights of sources in order, repeating, and the share of all sizes that they get.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
#: No source gives more than so many times its size.
MOST = 2
#: Words in a block, slots in an output shard, documents in a bucket of the prefix sums.
BLOCK = 64
SHARD = 4096
BUCKET = 20_000
#: Shards in one part of the sums over shards; cells of the sources' intervals; sources whose intervals may be broadcast (50 bytes a row).
SHARDS_IN_PART, CELLS, BROADCAST_SOURCES = 1024, 4096, 100_000
ROUNDS = 40


def permuted(x: str, n: str, seed: str, rounds: int = ROUNDS, inverse: bool = False) -> str:
    """SQL of a swap-or-not permutation of [0, n)."""
    order = f"sequence({rounds}, 1)" if inverse else f"sequence(1, {rounds})"
    partner = f"pmod(pmod(xxhash64({seed}, r), {n}) - v, {n})"
    return f"aggregate({order}, bigint({x}), (v, r) -> if(xxhash64({seed}, r, greatest(v, {partner})) % 2 = 0, v, {partner}))"


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, h, source, size): what the mix is computed from; h is a hash of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), F.col(source_col).cast("string").alias("source"), F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long").alias("size"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(s, source, source_size, target): a row for each source.

    The excess over ``most`` times a size is reshared by weight until none is above. That is a common
    level times each weight, cut at each cap, found by one pass over the sources in order of cap by weight.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # windows over sources, not documents
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.array(*[F.lit(float(w)) for w in weights])
    t = by.withColumn("s", place.cast("long")).withColumn("weight", F.element_at(weight, (F.col("s") % len(weights) + 1).cast("int"))).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    ratio = Window.orderBy(F.col("cap") / F.col("weight"), "s")
    every = Window.partitionBy()
    t = t.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(every)).withColumn("before", F.coalesce(F.sum("cap").over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("left", F.sum("weight").over(ratio.rowsBetween(0, Window.unboundedFollowing)))
    # the level rises while caps are below it and falls once they are not, so the right one is the highest
    t = t.withColumn("rest", F.col("total") - F.col("before")).withColumn("at", F.max_by(F.struct("rest", "left"), F.col("rest") / F.col("left")).over(every))
    return t.select("s", "source", "source_size", F.least("cap", F.col("at.rest") * F.col("weight") / F.col("at.left")).alias("target"))


def placed(sizes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``sizes`` with the first place of each document in its source's stream (offset)."""
    n = max(1, -(-sizes.count() // bucket))
    keyed = sizes.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(n)))
    key = [F.coalesce("source", F.lit("")).alias("k"), F.col("source").isNull().alias("none"), "bucket"]
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("all"))
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*key, F.coalesce(F.sum("all").over(w), F.lit(0)).alias("base"))
    inner = Window.partitionBy("source", "bucket").orderBy(F.asc_nulls_last("id"), "h").rowsBetween(Window.unboundedPreceding, -1)
    within = keyed.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0))).withColumn("k", F.coalesce("source", F.lit(""))).withColumn("none", F.col("source").isNull())
    return within.join(starts, ["k", "none", "bucket"]).withColumn("offset", F.col("base") + F.col("inner")).drop("k", "none", "bucket", "base", "inner")


def slot_plan(plan: DataFrame, seed: int, block: int = BLOCK) -> DataFrame:
    """A row for each source with a size: its blocks n, slots in either epoch (k0, k1), and the first of its slots among all."""
    t = plan.where("source_size > 0").select(
        "s", "source_size", F.round("target").cast("long").alias("due"), F.ceil(F.col("source_size") / block).cast("long").alias("n")
    )
    last = f"(source_size - (n - 1) * {block}L)"
    # where the short last block comes up in the source's permutation of each epoch
    for e in (0, 1):
        t = t.withColumn(f"q{e}", F.expr(permuted("n - 1", "n", f"{seed}L, s, {e}L", inverse=True)))

    def slots_for(words: str, q: str) -> str:
        """Slots until ``words`` are reached in an epoch whose short block stands at ``q``."""
        return f"if({words} <= 0, 0L, if({words} <= {q} * {block}L, ceil({words} / {block}), greatest({q} + 1, ceil(({words} + {block}L - {last}) / {block}))))"

    t = t.withColumn("k0", F.expr(slots_for("least(due, source_size)", "q0")).cast("long")).withColumn("k1", F.expr(slots_for("greatest(due - source_size, 0L)", "q1")).cast("long"))
    before = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)  # over sources, not documents
    t = t.withColumn("slots", F.col("k0") + F.col("k1")).where("slots > 0")
    return t.withColumn("begin", F.coalesce(F.sum("slots").over(before), F.lit(0)))


def shard_draw(t: DataFrame, total: int, n_sources: int, seed: int, shard: int = SHARD) -> DataFrame:
    """(shard, s, places): the slots of each shard that its draw gives to each source, before the totals are met."""
    spark = t.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = spark.range(-(-total // shard)).select(F.col("id").alias("shard")).repartition(parts, "shard")
    dealt = shards.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(shard), F.lit(total) - F.col("shard") * shard) - 1)))
    dealt = dealt.withColumn("u", F.pmod(F.xxhash64(F.lit(seed), F.lit(-1), "shard", "place"), F.lit(total).cast("long")))
    # u lies in the interval of one source; intervals are found by cells, of which each holds few
    cell = total // CELLS + 1
    lookup = t.select("s", "begin", "slots", F.explode(F.sequence(F.expr(f"begin div {cell}L"), F.expr(f"(begin + slots - 1) div {cell}L"))).alias("cell"))
    lookup = F.broadcast(lookup) if n_sources <= BROADCAST_SOURCES else lookup.hint("merge")  # CELLS + n_sources rows
    met = dealt.withColumn("cell", F.expr(f"u div {cell}L")).join(lookup, "cell").where("u >= begin and u < begin + slots")
    return met.groupBy("shard", "s").agg(F.sort_array(F.collect_list(F.col("place").cast("int"))).alias("places"))


def slots(plan: DataFrame, seed: int, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(s, index, epoch, take, shard, slot): the block that each output slot takes, and where it stands."""
    t = stored(slot_plan(plan, seed, block), "mix-slots")
    total, n_sources = t.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count("*")).first()
    if not total:
        return plan.sparkSession.createDataFrame([], "s long, index long, epoch long, take long, shard long, slot long")
    draw = stored(shard_draw(t, total, n_sources, seed, shard), "mix-draw").withColumn("c", F.size("places").cast("long")).withColumn("part", F.expr(f"shard div {SHARDS_IN_PART}L"))
    # numbers of a source's slots over all shards: sums in two levels
    sums = draw.groupBy("s", "part").agg(F.sum("c").alias("all"))
    w = Window.partitionBy("s").orderBy("part")
    starts = sums.select("s", "part", F.coalesce(F.sum("all").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    drawn = sums.groupBy("s").agg(F.sum("all").alias("drawn"))
    inner = Window.partitionBy("s", "part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    numbered = draw.withColumn("inner", F.coalesce(F.sum("c").over(inner), F.lit(0))).join(starts, ["s", "part"]).withColumn("start", F.col("base") + F.col("inner"))
    # what each source has drawn too much or too little
    before = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    t = t.join(drawn, "s", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0))).withColumn("over", F.greatest(F.col("drawn") - F.col("slots"), F.lit(0))).withColumn("under", F.greatest(F.col("slots") - F.col("drawn"), F.lit(0)))
    t = stored(t.withColumn("over_at", F.coalesce(F.sum("over").over(before), F.lit(0))).withColumn("under_at", F.coalesce(F.sum("under").over(before), F.lit(0))), "mix-slots")
    free = t.agg(F.sum("over")).first()[0]
    own = ["s", "source_size", "due", "n", "q0", "q1", "k0"]
    # in a given number of tasks, as an adaptive reader would put a few large arrays into one
    parts = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = numbered.select("s", "shard", "start", "places").repartition(parts, "shard", "s").join(t, "s")
    rows = rows.select(*own, "shard", "drawn", "over", "over_at", "start", F.posexplode("places").alias("i", "slot")).withColumn("at", F.col("start") + F.col("i"))
    gone = "(at + 1) * over div drawn > at * over div drawn"
    kept = rows.where(f"not ({gone})").select(*own, "shard", "slot", F.expr("at - at * over div drawn").alias("k"))
    if free:
        extra = t.where("under > 0").withColumn("e", F.explode(F.sequence(F.lit(0).cast("long"), F.col("under") - 1))).withColumn("f", F.expr(permuted("under_at + e", f"{free}L", f"{seed}L, -2L")))
        extra = extra.select(*own, "f", (F.col("drawn") + F.col("e")).alias("k"))
        freed = rows.where(gone).select("shard", "slot", F.expr("over_at + at * over div drawn").alias("f"))
        kept = kept.unionByName(freed.join(extra.hint("merge"), "f").select(*own, "shard", "slot", "k"))
    last = f"(source_size - (n - 1) * {block}L)"
    words = "if(epoch = 0, least(due, source_size), greatest(due - source_size, 0L))"
    wide = kept.withColumn("epoch", (F.col("k") >= F.col("k0")).cast("long")).withColumn("j", F.when(F.col("epoch") == 0, F.col("k")).otherwise(F.col("k") - F.col("k0")))
    wide = wide.withColumn("index", F.expr(permuted("j", "n", f"{seed}L, s, epoch")))
    # words before slot j of its epoch, then what the slot may still take
    done = F.expr(f"j * {block}L - if(j > if(epoch = 0, q0, q1), {block}L - {last}, 0L)")
    full = F.expr(f"if(index = n - 1, {last}, {block}L)")
    return wide.select("s", "index", "epoch", F.least(full, F.expr(words) - done).alias("take"), "shard", F.col("slot").cast("long").alias("slot"))


def shard_counts(slot_table: DataFrame) -> DataFrame:
    """Slots of each source in each output shard."""
    return slot_table.groupBy("shard", "s").agg(F.count("*").alias("n_slots"))


def _segments(at: DataFrame, slot_table: DataFrame, block: int) -> DataFrame:
    """(s, offset, epoch, lo, n, shard, slot, begin): words [lo, lo + n) of a document, which a slot takes as its own from ``begin`` on."""
    parts = at.where("size > 0").select("s", "offset", "size", F.explode(F.sequence(F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("size") - 1) / block))).alias("index"))
    parts = parts.withColumn("lo", F.greatest(F.col("offset"), F.col("index") * block)).withColumn("hi", F.least(F.col("offset") + F.col("size"), (F.col("index") + 1) * block))
    # slots are made from a few rows of the plan, so their size is underrated: never broadcast them
    met = parts.join(slot_table.hint("merge"), ["s", "index"])
    n = F.least("hi", F.col("index") * block + F.col("take")) - F.col("lo")
    return met.select("s", "offset", "epoch", (F.col("lo") - F.col("offset")).alias("lo"), n.alias("n"), "shard", "slot", (F.col("lo") - F.col("index") * block).alias("begin")).where("n > 0")


def _with_plan(sizes: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """The sizes with places and targets, and the plan of the sources; both written once."""
    plan = stored(targets(sizes, **options), "mix-plan")
    at = placed(sizes)
    p = plan.withColumn("k", F.coalesce("source", F.lit(""))).withColumn("none", F.col("source").isNull()).drop("source")
    at = at.withColumn("k", F.coalesce("source", F.lit(""))).withColumn("none", F.col("source").isNull()).join(p, ["k", "none"]).drop("k", "none")
    return stored(at, "mix-places"), plan


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 20240229, block: int = BLOCK, **options) -> DataFrame:
    """One row per document: id, size, source_size, target, taken."""
    at, plan = _with_plan(stored(sized(docs, id_col, text_col, source_col), "mix-sizes"), **options)
    taken = _segments(at, slots(plan, seed, block), block).groupBy("s", "offset").agg(F.sum("n").alias("got"))
    # documents of size 0 share a place with the next one; they take nothing
    out = at.withColumn("real", F.col("size") > 0).join(taken.withColumn("real", F.lit(True)), ["s", "offset", "real"], "left")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("got", F.lit(0)).alias("taken"))


_KEY = ("id", "h", "source", "copy")


def _taken_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, block: int, options: dict) -> DataFrame:
    """(row, w, k_text, epoch, parts, got): the documents' rows with what each epoch takes of them."""
    at, plan = _with_plan(stored(sized(docs, id_col, text_col, source_col), "mix-sizes"), **options)
    real = at.where("size > 0")
    # rows equal in identifier, text and source have places of their own: they are numbered, if there are any
    again = real.groupBy("id", "h", "source").agg(F.count("*").alias("c")).where("c > 1").limit(1).count() > 0
    number = (lambda *order: F.row_number().over(Window.partitionBy("id", "h", "source").orderBy(*order))) if again else lambda *order: F.lit(1)
    owner = real.withColumn("copy", number("offset")).select("id", "h", "source", "copy", "s", "offset")
    piece = F.struct("lo", "n", "shard", "slot", "begin")
    parts = _segments(at, slots(plan, seed, block), block).groupBy("s", "offset", "epoch").agg(F.array_sort(F.collect_list(piece)).alias("parts"), F.sum("n").alias("got"))
    found = owner.join(parts, ["s", "offset"]).select(*[F.col(c).alias(f"o_{c}") for c in _KEY], "epoch", "parts", "got")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), F.col(source_col).cast("string").alias("source"), text.alias("k_text"))
    keyed = keyed.withColumn("copy", number(F.xxhash64("row")))
    met = keyed.join(found, F.col("id").eqNullSafe(F.col("o_id")) & (F.col("h") == F.col("o_h")) & F.col("source").eqNullSafe(F.col("o_source")) & (F.col("copy") == F.col("o_copy")))
    return met.select("row", "source", "k_text", "epoch", "parts", "got", F.regexp_extract_all("k_text", F.lit(WORD), F.lit(0)).alias("w"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 20240229, block: int = BLOCK, where: bool = False, **options) -> DataFrame:
    """The mix as documents, with the columns of ``docs``.

    A document has a row for each epoch that takes words of it: its text as it is where the epoch
    takes it whole, else the words taken, in order, with a space between. ``n_chars``, if there is
    such a column, is the new length. With ``where`` two more columns, mix_shard and mix_slot, tell
    where its first word stands in the output.
    """
    met = _taken_rows(docs, id_col, text_col, source_col, seed, block, options)
    some = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice("w", (p["lo"] + 1).cast("int"), p["n"].cast("int")))), " ")
    new = F.when(F.col("got") == F.size("w"), F.col("k_text")).otherwise(some)
    met = met.select("row", new.alias("k_text"), F.col("parts")[0]["shard"].alias("shard"), F.col("parts")[0]["slot"].alias("slot"))
    cols = []
    for f in docs.schema.fields:
        c = F.col("row")[f.name]
        if f.name == text_col:
            c = F.col("k_text")
        elif f.name == "n_chars":
            c = F.length("k_text").cast(f.dataType)
        cols.append(c.alias(f.name))
    return met.select(*cols, *([F.col("shard").alias("mix_shard"), F.col("slot").alias("mix_slot")] if where else []))


def mixed_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 20240229, block: int = BLOCK, **options) -> DataFrame:
    """(shard, slot, source, n_words, text): the output shards, a row for each slot with the words of the block it takes."""
    met = _taken_rows(docs, id_col, text_col, source_col, seed, block, options)
    pieces = met.select("source", F.explode("parts").alias("p"), "w").select("source", "p.shard", "p.slot", "p.begin", "p.n", F.slice("w", (F.col("p.lo") + 1).cast("int"), F.col("p.n").cast("int")).alias("w"))
    joined = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("begin", "w"))), lambda p: p["w"])), " ")
    return pieces.groupBy("shard", "slot", "source").agg(F.sum("n").alias("n_words"), joined.alias("text"))
