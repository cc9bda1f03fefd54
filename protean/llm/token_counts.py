"""Token counts by batch encoding.

Arrow batches are cut into groups of about equal bytes, texts over a limit are cut at places where
no token can reach across, and only the lengths come back.

Defined results: null and empty texts have no bytes and no tokens; identifiers pass through as they
are, null or repeated; very long texts give the same count as uncut; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load_tokenizer, small_batches, trimmed

#: Characters in one encoding call, and in one piece of a long text.
GROUP_CHARS = 1 << 19
PIECE_CHARS = 1 << 16

#: A pre-token has white space at its start only, so it never reaches over the place before white
#: space that follows something else; nor over the place between an ASCII letter and a digit.
_SAFE = re.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \n])|(?<=[a-zA-Z])(?=[0-9])")


def pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """``text`` cut at safe places after every ``size`` characters or later; uncut where it has none."""
    out, at = [], 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if not m or m.start() >= len(text):
            break
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load_tokenizer(path)
        for b in batches:
            texts = b.column("text").to_pylist()
            n_tokens, group, owner, held = [0] * len(texts), [], [], 0

            def flush():
                for k, e in zip(owner, tok.encode_batch_fast(group, add_special_tokens=False), strict=True):
                    n_tokens[k] += len(e)
                group.clear()
                owner.clear()

            for k, t in enumerate(texts):
                for p in pieces(t):
                    group.append(p)
                    owner.append(k)
                    held += len(p)
                    if held >= GROUP_CHARS:
                        flush()
                        held = 0
            flush()
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), pa.array(n_tokens, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return src.mapInArrow(trimmed(count), "id long, n_bytes long, n_tokens long").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
