"""Shared plumbing: intermediate tables, text normalisation, tokenizer access."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word and normalisation rules.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Made here only where the session has none and runs on this machine alone (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        folder = "file://" + tempfile.mkdtemp(prefix="protean-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    Cuts lineage: what follows reads files that outlive any executor, and a nondeterministic
    step (sampled splitters, packed blocks) is evaluated once only.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/protean/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again: all that was made of them is stored itself."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.stored_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of documents in one Arrow batch: a few megabytes beside the heap of an executor, not a few hundred.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Batches of long rows are made small, unless the session has its own setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def trimmed(function):
    """A batch function that gives freed memory back when a task ends; idle workers stay small beside an executor's heap."""

    def run(batches):
        try:
            yield from function(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run


def slices(batches, rows: int):
    """Arrow batches in parts of few rows, so that few texts are Python strings at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def sampled(df: DataFrame, key: Column, rows: int, total: int) -> DataFrame:
    """About ``rows`` of ``total`` rows, those whose key has a small hash: a filter, whatever the size."""
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit(77)), F.lit(1 << 32)) < int((1 << 32) * rows / total))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; never copied into the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Fresh(dict):
    """A cache that travels empty: what a worker makes for itself is not sent to others."""

    def __reduce__(self):
        return Fresh, ()


_LOADED = Fresh()


def load_tokenizer(path: str):
    """One tokenizer per Python worker."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _LOADED[path] = t
    return _LOADED[path]
