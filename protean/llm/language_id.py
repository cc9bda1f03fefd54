"""Language identification by compression.

For each language a raw-content dictionary is made of a bounded sample of labelled texts, the whole of
it, however little other languages have; totals are compared as they are, whatever the sizes. A text is
lower-cased, what is between its letters becomes one space, and the whole of it is compressed, block
by block, with every dictionary; the smallest total wins. Where the best two totals are close, the
text is rejected.

Defined results: null texts and texts without a letter are ``und``, score 0, rejected; texts are
treated whole, however long; ties between languages go to the first in text order; null languages
are not learned; repeated rows and null identifiers pass
through; an empty table, or one without labels, gives ``und`` throughout; extra columns are ignored by ``identify`` and kept by ``keep_known``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Fresh, slices, small_batches, stored, trimmed

#: The fitting sample: per language at most so many texts, of each at most so many characters from its middle.
SAMPLE_TEXTS, SAMPLE_CHARS = 96, 1200
#: At most so many languages, those with the most labelled texts: the dictionaries travel with the function, 115 kB each.
MAX_LANGUAGES = 512
#: Texts are compressed in blocks of so many bytes, as a long text's own content would outweigh a dictionary.
BLOCK = 2048
#: Matches from three bytes on: words here share short endings more than long stems.
MIN_MATCH, WINDOW_LOG = 3, 18
#: Totals closer than this share of the second are too close to tell.
MIN_MARGIN = 0.01

#: Texts that a worker holds as Python strings.
SLICE = 256

UNKNOWN = "und"
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id's text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_languages: int = MAX_LANGUAGES) -> dict[str, bytes]:
    """Dictionaries by language.

    The sample is, in each of SAMPLE_TEXTS bins of a language, the text that fills a piece best (of
    these the one with the smallest hash), so short texts are learned from where a language has no
    others. One pre-aggregated pass over small columns: a language of any size sends a bounded number
    of rows. Beyond ``max_languages`` those with the most labelled texts are learned, ties in text order.
    """
    cand = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    keyed = cand.select(
        F.col(lang_col).cast("string").alias("lang"),
        F.pmod(F.xxhash64(F.col(id_col), F.lit(1)), F.lit(SAMPLE_TEXTS)).alias("bin"),
        (F.shiftleft((F.lit(SAMPLE_CHARS) - F.least(F.length(text_col), F.lit(SAMPLE_CHARS))).cast("long"), 40) + F.pmod(F.xxhash64(F.col(id_col), F.lit(2)), F.lit(1 << 40))).alias("h"),
        F.col(text_col).alias("text"),
    )
    least = keyed.groupBy("lang", "bin").agg(F.min("h").alias("h"), F.count("*").alias("n"))
    by_size = least.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).select("lang")
    least = stored(least.drop("n").join(F.broadcast(by_size), "lang", "left_semi"), "language-bins")  # at most max_languages * SAMPLE_TEXTS rows
    start = F.greatest(F.lit(1), F.floor((F.length("text") - SAMPLE_CHARS) / 2).cast("int"))
    piece = F.substring(F.col("text"), start, F.lit(SAMPLE_CHARS))
    rows = keyed.join(F.broadcast(least), ["lang", "bin", "h"], "left_semi").groupBy("lang", "bin").agg(F.min(piece).alias("t")).orderBy("lang", "bin").limit(max_languages * SAMPLE_TEXTS).collect()
    texts: dict[str, list[bytes]] = {}
    for r in rows:
        texts.setdefault(r.lang, []).append(letters(r.t))
    # each keeps its whole sample: sizes differ, and a rare label takes nothing from the others
    return {k: b"\n".join(v).ljust(8) for k, v in sorted(texts.items())}


_BETWEEN = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """What is compressed of a text: its letters (numerals like ``\u2167`` and ``\u00bd`` are none), runs of other characters as one space."""
    kept = _BETWEEN.sub(" ", text.lower())
    if not kept.isascii() and any(not c.isalpha() for c in set(kept) - {" "}):
        kept = " ".join("".join(c if c.isalpha() else " " for c in kept).split())
    return kept.strip().encode("utf-8", "replace")


_READY = Fresh()


def _compressors(model: dict[str, bytes]) -> list:
    import zstandard as zstd

    key = hash(tuple(model.items()))
    if key not in _READY:
        how = zstd.ZstdCompressionParameters.from_level(3, min_match=MIN_MATCH, window_log=WINDOW_LOG, strategy=zstd.STRATEGY_BTLAZY2, write_content_size=False)
        ready = []
        for lang, raw in model.items():
            d = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            ready.append((lang, zstd.ZstdCompressor(dict_data=d, compression_params=how)))
        _READY.clear()
        _READY[key] = ready
    return _READY[key]


def predict(text: str | None, ready: list) -> tuple[str, float, float]:
    """(language, score, margin) of one whole text."""
    raw = letters(text) if text and ready else b""
    if not raw:
        return UNKNOWN, 0.0, 0.0
    blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
    totals = [sum(len(c.compress(b)) for b in blocks) for _, c in ready]
    best = int(np.argmin(totals))
    rest = [t for i, t in enumerate(totals) if i != best]
    if not rest:
        return ready[best][0], 1.0, 1.0
    second = min(rest)
    margin = (second - totals[best]) / second
    return ready[best][0], float(1 / (1 + np.exp(-40 * margin))), float(margin)


def identify(docs: DataFrame, model: dict[str, bytes] | None = None, id_col: str = "doc_id", text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score, margin, rejected."""
    model = fit(docs, id_col, text_col) if model is None else model
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # MAX_LANGUAGES dictionaries at most
    src = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    schema = src.select("id", "held_out", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("margin")).schema

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = _compressors(sent.value)
        for b in slices(batches, SLICE):
            found = [predict(t, ready) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64())], names=schema.names)

    out = src.mapInArrow(trimmed(classify), schema)
    return out.select(F.col("id").alias(id_col), "held_out", "lang_pred", "score", "margin", ((F.col("lang_pred") == UNKNOWN) | (F.col("margin") < min_margin)).alias("rejected"))


def keep_known(docs: DataFrame, model: dict[str, bytes] | None = None, id_col: str = "doc_id", text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of ``docs`` that are not rejected, in the same pass and with their own columns."""
    model = fit(docs, id_col, text_col) if model is None else model
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.col(text_col).alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = _compressors(sent.value)
        for b in slices(batches, SLICE):
            found = [predict(t, ready) for t in b.column("text").to_pylist()]
            yield b.select(["row"]).filter(pa.array([f[0] != UNKNOWN and f[2] >= min_margin for f in found], pa.bool_()))

    return src.mapInArrow(trimmed(keep), src.select("row").schema).select("row.*")
