"""Sequence files as (file, at, name, description, sequence[, quality]) tables, and back to text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is read as a number.
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"

RECORD = "file string, at int, name string, description string, sequence string, quality string"
_ARROW = pa.schema([("file", pa.string()), ("at", pa.int32()), ("name", pa.string()), ("description", pa.string()), ("sequence", pa.string()), ("quality", pa.string())])


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records of FASTA, A3M and A2M files; a record is a row as soon as it is read, however long the file."""
    d = spark.read.option("lineSep", "\n>").text(path).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("value").alias("v"))
    head = F.regexp_replace(F.regexp_extract("v", r"(?s)^>?([^\r\n]*)", 1), "^>", "")
    body = F.regexp_replace(F.regexp_extract("v", r"(?s)^[^\n]*\n(.*)$", 1), r"\s", "")
    return d.where(F.trim("v") != "").select("file", F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.regexp_extract(head, r"^\S*\s+(.*)$", 1).alias("description"), body.alias("sequence"))


def _parsed(spark: SparkSession, path: str, parse: Callable[[str], Iterator[tuple]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f, t in zip(b.column("file").to_pylist(), b.column("value").to_pylist(), strict=True):
                rows = [(f, i, *r) for i, r in enumerate(parse(t))]
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows[at : at + 10_000], strict=True), _ARROW, strict=True)], schema=_ARROW)

    d = spark.read.text(path, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), "value")
    return d.mapInArrow(run, RECORD)


def _fastq(text: str) -> Iterator[tuple]:
    lines, i = text.splitlines(), 0
    while i < len(lines):
        if not lines[i].strip():
            i += 1
            continue
        if not lines[i].startswith("@"):
            raise ValueError("a FASTQ record begins with @")
        name, _, desc = lines[i][1:].partition(" ")
        i, seq = i + 1, ""
        while i < len(lines) and not lines[i].startswith("+"):
            seq, i = seq + lines[i].strip(), i + 1
        i, quality = i + 1, ""
        while i < len(lines) and len(quality) < len(seq):
            quality, i = quality + lines[i].strip(), i + 1
        if len(quality) != len(seq):
            raise ValueError(f"record {name!r} is cut short")
        yield name, desc, seq, quality


def _blocks(text: str, skip: Callable[[str], bool]) -> Iterator[tuple]:
    """Interleaved alignments: pieces of a name in the order of its first piece."""
    found: dict[str, str] = {}
    for line in text.splitlines():
        if not line.strip() or skip(line):
            continue
        f = line.split()
        if len(f) >= 2:
            found[f[0]] = found.get(f[0], "") + f[1]
    for k, v in found.items():
        yield k, "", v, None


def _clustal(text: str) -> Iterator[tuple]:
    return _blocks(text, lambda x: x.upper().startswith(("CLUSTAL", "MUSCLE")) or x[0].isspace())


def _stockholm(text: str) -> Iterator[tuple]:
    return _blocks(text, lambda x: x.startswith(("#", "//")))


def _phylip(text: str) -> Iterator[tuple]:
    lines = [x for x in text.splitlines() if x.strip()]
    n, length = map(int, lines[0].split()[:2])
    i = 1
    for _ in range(n):
        name, _, seq = lines[i].strip().partition(" ")
        i, seq = i + 1, re.sub(r"\s", "", seq)
        while len(seq) < length and i < len(lines):
            seq, i = seq + re.sub(r"\s", "", lines[i]), i + 1
        if len(seq) != length:
            raise ValueError(f"{name!r} has {len(seq)} columns, not {length}")
        yield name, "", seq, None


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    return _parsed(spark, path, _fastq)


def read_clustal(spark: SparkSession, path: str) -> DataFrame:
    return _parsed(spark, path, _clustal)


def read_stockholm(spark: SparkSession, path: str) -> DataFrame:
    return _parsed(spark, path, _stockholm)


def read_phylip(spark: SparkSession, path: str) -> DataFrame:
    return _parsed(spark, path, _phylip)


def fasta_text(records: DataFrame, width: int = 60) -> DataFrame:
    """(name, value): FASTA text of each record, wrapped."""
    head = F.concat(F.lit(">"), F.concat_ws(" ", "name", F.when(F.col("description") != "", F.col("description"))))
    return records.select("name", F.concat_ws("\n", head, F.regexp_extract_all("sequence", F.lit(f".{{1,{width}}}"), F.lit(0))).alias("value"))


def fastq_text(records: DataFrame) -> DataFrame:
    """(name, value): four lines for each record."""
    return records.select("name", F.concat_ws("\n", F.concat(F.lit("@"), "name"), "sequence", F.lit("+"), "quality").alias("value"))


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, wild, number, mutant, values) of comma- or tab-delimited tables; the first column holds substitutions, ``:`` between several."""
    from ..operators.sequence import parse_substitution

    d = spark.read.text(path, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.split("value", "\r?\n").alias("lines"))
    cut = lambda c: split_row(c)
    head = d.withColumn("names", cut(F.element_at("lines", 1)))
    rows = head.select("file", "names", F.posexplode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("row", "line")).where(F.trim("line") != "").withColumn("cells", cut(F.col("line")))
    changes = F.split(F.element_at("cells", 1), ":")
    s = parse_substitution(F.when(F.size(changes) == 1, F.element_at("cells", 1)))
    values = F.map_from_arrays(F.slice("names", 2, F.size("names")), F.transform(F.slice("cells", 2, F.size("names")), lambda v: F.when(v.rlike(NUMBER), v).cast("double")))
    return rows.where(F.size("cells") == F.size("names")).select("file", "row", s["wild"].alias("wild"), s["number"].alias("number"), s["mutant"].alias("mutant"), F.size(changes).alias("substitutions"), values.alias("values"))


def split_row(line):
    """Cells of a delimited row, a tab's if it has one, else a comma's; delimiters in double quotes do not count."""
    line = F.col(line) if isinstance(line, str) else line
    outside = r'(?=(?:[^"]*"[^"]*")*[^"]*$)'
    cells = F.when(line.contains("\t"), F.split(line, "\t" + outside)).otherwise(F.split(line, "," + outside))
    return F.transform(cells, lambda c: F.regexp_replace(F.trim(c), '^"(.*)"$', "$1"))


def _put(records: DataFrame, head, line, tail) -> DataFrame:
    """(file, value): one text of the records (file, at, name, sequence) of a file."""
    g = records.groupBy("file").agg(F.count("*").alias("n"), F.max(F.length("sequence")).alias("columns"), F.min(F.length("sequence")).alias("least"), F.max(F.length("name")).alias("wide"), F.array_sort(F.collect_list(F.struct("at", "name", "sequence"))).alias("r"))
    g = g.withColumn("r", F.when(F.col("columns") == F.col("least"), F.col("r")).otherwise(F.raise_error(F.concat(F.lit("rows of an alignment differ in length: "), "file"))))
    return g.select("file", F.concat(F.concat_ws("\n", head, F.array_join(F.transform("r", line), "\n"), tail), F.lit("\n")).alias("value"))


def clustal_text(records: DataFrame) -> DataFrame:
    """One block under the usual first line."""
    return _put(records, F.lit("CLUSTAL W multiple sequence alignment\n"), lambda r: F.concat(F.rpad(r["name"], F.col("wide") + 1, " "), r["sequence"]), F.lit(None).cast("string"))


def stockholm_text(records: DataFrame) -> DataFrame:
    return _put(records, F.lit("# STOCKHOLM 1.0"), lambda r: F.concat(F.rpad(r["name"], F.col("wide") + 1, " "), r["sequence"]), F.lit("//"))


def phylip_text(records: DataFrame) -> DataFrame:
    """Relaxed sequential PHYLIP."""
    return _put(records, F.concat_ws(" ", F.col("n").cast("string"), F.col("columns").cast("string")), lambda r: F.concat_ws(" ", r["name"], r["sequence"]), F.lit(None).cast("string"))


def a3m_text(records: DataFrame, a2m: bool = False) -> DataFrame:
    """(file, value) of A3M or A2M records (file, at, name, sequence); rows must agree in their match columns."""
    checked = records.withColumn("matches", F.length(F.regexp_replace("sequence", "[a-z.]", ""))).withColumn("odd", ~F.col("sequence").rlike(r"^[A-Za-z*.-]*$"))
    g = checked.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", "name", "sequence"))).alias("r"), F.min("matches").alias("lo"), F.max("matches").alias("hi"), F.max("odd").alias("odd"))
    text = F.concat(F.array_join(F.transform("r", lambda r: F.concat(F.lit(">"), r["name"], F.lit("\n"), r["sequence"] if a2m else F.regexp_replace(r["sequence"], "[.]", ""))), "\n"), F.lit("\n"))
    return g.select("file", F.when(F.col("odd"), F.raise_error(F.lit("a symbol that is no residue, gap or insertion"))).when(F.col("lo") != F.col("hi"), F.raise_error(F.lit("rows differ in their match columns"))).otherwise(text).alias("value"))


_READERS = {"fasta": read_fasta, "a3m": read_fasta, "a2m": read_fasta, "fastq": read_fastq, "clustal": read_clustal, "stockholm": read_stockholm, "phylip": read_phylip}
_WRITERS = {"clustal": clustal_text, "stockholm": stockholm_text, "phylip": phylip_text, "a3m": a3m_text, "a2m": lambda r: a3m_text(r, True), "fasta": fasta_text, "fastq": fastq_text}


def read_sequences(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Records of files of one format."""
    return _READERS[kind](spark, path)


def sequences_text(records: DataFrame, kind: str) -> DataFrame:
    """The text of records in one format."""
    return _WRITERS[kind](records)
