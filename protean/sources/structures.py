"""Structure files as atom tables.

A file is one row (``wholetext``), so any store that Spark reads will do and files are parsed in
parallel. Fixed-column formats are cut by SQL functions; free formats are parsed in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ATOMS = (
    "structure_id string, model int, atom_index long, record_type string, atom_site_id long, atom_name string, altloc string, label_comp_id string, label_asym_id string, auth_asym_id string, "
    "label_seq_id int, auth_seq_id int, ins_code string, x double, y double, z double, occupancy double, b_factor double, element_symbol string, formal_charge int, charge double, radius double"
)
_NAMES = [c.split()[0] for c in ATOMS.split(", ")]


def _files(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.text(path, wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return d.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("structure_id"), F.col("value").alias("text"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(structure_id, at, line)."""
    return _files(spark, path).select("structure_id", F.posexplode(F.split("text", "\r?\n")).alias("at", "line"))


def _whole(df: DataFrame) -> DataFrame:
    """All columns of ATOMS, null where the format has none."""
    kinds = dict(c.split() for c in ATOMS.split(", "))
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in _NAMES])


def read_pdb(spark: SparkSession, path: str) -> DataFrame:
    """ATOM and HETATM records; the atom index counts within a model."""
    cut = lambda a, n: F.trim(F.substring("line", a, n))
    none = lambda c: F.when(c != "", c)
    number = lambda a, n, t: none(cut(a, n)).try_cast(t)
    w = Window.partitionBy("structure_id").orderBy("at")
    d = _lines(spark, path).where(F.substring("line", 1, 6).isin("ATOM  ", "HETATM", "MODEL ") | F.rtrim("line").isin("MODEL"))
    d = d.withColumn("model", F.greatest(F.lit(1), F.sum(F.col("line").startswith("MODEL").cast("int")).over(w))).where(~F.col("line").startswith("MODEL"))
    m = Window.partitionBy("structure_id", "model").orderBy("at")
    element = F.when(cut(77, 2) != "", F.upper(cut(77, 2))).otherwise(F.upper(F.regexp_extract(cut(13, 4), r"^[0-9]*([A-Za-z])", 1)))
    sign = cut(79, 2)
    return _whole(
        d.select(
            "structure_id", "model", (F.row_number().over(m) - 1).alias("atom_index"), cut(1, 6).alias("record_type"), number(7, 5, "long").alias("atom_site_id"), cut(13, 4).alias("atom_name"), cut(17, 1).alias("altloc"),
            cut(18, 3).alias("label_comp_id"), cut(22, 1).alias("label_asym_id"), cut(22, 1).alias("auth_asym_id"), number(23, 4, "int").alias("label_seq_id"), number(23, 4, "int").alias("auth_seq_id"), cut(27, 1).alias("ins_code"),
            number(31, 8, "double").alias("x"), number(39, 8, "double").alias("y"), number(47, 8, "double").alias("z"), number(55, 6, "double").alias("occupancy"), number(61, 6, "double").alias("b_factor"), element.alias("element_symbol"),
            F.when(sign.rlike(r"^\d[+-]$"), F.concat(F.substring(sign, 2, 1), F.substring(sign, 1, 1))).try_cast("int").alias("formal_charge"),
        )
    )


def read_gro(spark: SparkSession, path: str) -> DataFrame:
    """One-frame GRO files; nanometres become angstroms."""
    cut = lambda a, n: F.trim(F.substring("line", a, n))
    d = _files(spark, path).withColumn("lines", F.split("text", "\r?\n"))
    n = F.trim(F.element_at("lines", 2)).try_cast("int")
    d = d.select("structure_id", F.posexplode(F.slice("lines", F.lit(3), n)).alias("atom_index", "line"))
    xyz = [(cut(a, 8).try_cast("double") * 10).alias(c) for a, c in ((21, "x"), (29, "y"), (37, "z"))]
    return _whole(d.select("structure_id", F.lit(1).alias("model"), "atom_index", cut(1, 5).try_cast("int").alias("auth_seq_id"), cut(1, 5).try_cast("int").alias("label_seq_id"), cut(6, 5).alias("label_comp_id"), cut(11, 5).alias("atom_name"), cut(16, 5).try_cast("long").alias("atom_site_id"), *xyz))


def _parsed(spark: SparkSession, path: str, parse: Callable[[str], Iterator[dict]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for sid, text in zip(b.column("structure_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                rows: list[dict] = []
                for r in parse(text):
                    rows.append({"structure_id": sid, **r})
                    if len(rows) == 20_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return _files(spark, path).mapInArrow(run, ATOMS)


_ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[c.split()[1]]) for c in ATOMS.split(", ")])


def _xyz(text: str) -> Iterator[dict]:
    lines, at, model = text.splitlines(), 0, 1
    while at < len(lines) and lines[at].strip():
        n = int(lines[at].split()[0])
        for i, line in enumerate(lines[at + 2 : at + 2 + n]):
            e, x, y, z = line.split()[:4]
            yield {"model": model, "atom_index": i, "element_symbol": e.upper(), "atom_name": e, "x": float(x), "y": float(y), "z": float(z)}
        at, model = at + 2 + n, model + 1


def _pqr(text: str) -> Iterator[dict]:
    i = 0
    for line in text.splitlines():
        if line.startswith(("ATOM", "HETATM")):
            f = line.split()
            chain, rest = (f[4], f[5:]) if len(f) == 11 else ("", f[4:])
            yield {"model": 1, "atom_index": i, "record_type": f[0], "atom_site_id": int(f[1]), "atom_name": f[2], "label_comp_id": f[3], "label_asym_id": chain, "auth_asym_id": chain, "label_seq_id": int(rest[0]), "auth_seq_id": int(rest[0]), "x": float(rest[1]), "y": float(rest[2]), "z": float(rest[3]), "charge": float(rest[4]), "radius": float(rest[5]), "element_symbol": re.sub(r"[^A-Za-z]", "", f[2])[:1].upper()}
            i += 1


_CIF = re.compile(r"^;(.*?)^;|'((?:[^'\n]|'(?=\S))*)'(?=\s|$)|\"((?:[^\"\n]|\"(?=\S))*)\"(?=\s|$)|#[^\n]*|(\S+)", re.M | re.S)


def cif_tokens(text: str) -> Iterator[tuple[bool, str]]:
    """(quoted, value)."""
    for m in _CIF.finditer(text):
        if m[0].startswith("#"):
            continue
        for i in (1, 2, 3):
            if m[i] is not None:
                yield True, m[i]
                break
        else:
            yield False, m[4]


def cif_category(text: str, name: str) -> Iterator[dict[str, str | None]]:
    """Rows of a category of the first block; ``.`` and ``?`` stay as they are unless quoted."""
    prefix, it, row = name + ".", cif_tokens(text), {}
    pending, blocks = None, 0
    while True:
        q, t = pending or next(it, (False, None))
        pending = None
        if t is None:
            break
        if not q and t.lower().startswith("data_"):
            blocks += 1
            if blocks > 1:
                break
        elif not q and t.lower() == "loop_":
            cols = []
            q, t = next(it, (False, None))
            while t is not None and not q and t.startswith("_"):
                cols.append(t)
                q, t = next(it, (False, None))
            values: list[str] = []
            mine = [c[len(prefix) :] for c in cols] if cols and cols[0].startswith(prefix) else None
            while t is not None and not (not q and (t.startswith("_") or t.lower() in ("loop_",) or t.lower().startswith("data_"))):
                if mine is not None:
                    values.append(t)
                    if len(values) == len(mine):
                        yield dict(zip(mine, values, strict=True))
                        values = []
                q, t = next(it, (False, None))
            pending = (q, t)
        elif not q and t.startswith(prefix):
            row[t[len(prefix) :]] = next(it, (False, None))[1]
        elif not q and t.startswith("_"):
            next(it, None)
    if row:
        yield row


def _mmcif(text: str) -> Iterator[dict]:
    real = lambda v: None if v in (None, ".", "?") else v
    number = lambda v, t: None if real(v) is None else t(v)
    seen: dict[int, int] = {}
    for r in cif_category(text, "_atom_site"):
        g = lambda k, r=r: real(r.get(k))
        model = number(r.get("pdbx_PDB_model_num"), int) or 1
        seen[model] = seen.get(model, -1) + 1
        yield {
            "model": model, "atom_index": seen[model], "record_type": g("group_PDB"), "atom_site_id": number(r.get("id"), int), "atom_name": g("label_atom_id"), "altloc": g("label_alt_id") or "", "label_comp_id": g("label_comp_id"),
            "label_asym_id": g("label_asym_id"), "auth_asym_id": g("auth_asym_id"), "label_seq_id": number(r.get("label_seq_id"), int), "auth_seq_id": number(r.get("auth_seq_id"), int), "ins_code": g("pdbx_PDB_ins_code") or "",
            "x": number(r.get("Cartn_x"), float), "y": number(r.get("Cartn_y"), float), "z": number(r.get("Cartn_z"), float), "occupancy": number(r.get("occupancy"), float), "b_factor": number(r.get("B_iso_or_equiv"), float),
            "element_symbol": (g("type_symbol") or "").upper(), "formal_charge": number(r.get("pdbx_formal_charge"), int),
        }


def _lammps(text: str) -> Iterator[dict]:
    lines, at, model = text.splitlines(), 0, 0
    n, low, side = 0, [0.0] * 3, [1.0] * 3
    while at < len(lines):
        head = lines[at]
        if head.startswith("ITEM: NUMBER OF ATOMS"):
            n, at = int(lines[at + 1]), at + 2
        elif head.startswith("ITEM: BOX BOUNDS"):
            box = [list(map(float, x.split()[:2])) for x in lines[at + 1 : at + 4]]
            low, side, at = [b[0] for b in box], [b[1] - b[0] for b in box], at + 4
        elif head.startswith("ITEM: ATOMS"):
            cols, model = head.split()[2:], model + 1
            for i, line in enumerate(lines[at + 1 : at + 1 + n]):
                v = dict(zip(cols, line.split(), strict=False))
                xyz = [float(v[c]) if c in v else low[k] + side[k] * float(v[c + "s"]) for k, c in enumerate("xyz")]
                yield {"model": model, "atom_index": i, "atom_site_id": int(v["id"]), "atom_name": v.get("element", v.get("type")), "x": xyz[0], "y": xyz[1], "z": xyz[2], "charge": float(v["q"]) if "q" in v else None}
            at += 1 + n
        else:
            at += 1


def _sdf(text: str) -> Iterator[dict]:
    for model, block in enumerate(b for b in re.split(r"(?m)^\$\$\$\$\s*$", text) if b.strip()):
        lines = block.lstrip("\n").splitlines() if model else block.splitlines()
        for i in range(int(lines[3][:3])):
            s = lines[4 + i]
            yield {"model": model + 1, "atom_index": i, "atom_name": s[31:34].strip(), "element_symbol": s[31:34].strip().upper(), "x": float(s[:10]), "y": float(s[10:20]), "z": float(s[20:30])}


def _mol2(text: str) -> Iterator[dict]:
    model, i, inside = 0, 0, False
    for line in text.splitlines():
        if line.startswith("@<TRIPOS>"):
            inside = line.startswith("@<TRIPOS>ATOM")
            if line.startswith("@<TRIPOS>MOLECULE"):
                model, i = model + 1, 0
        elif inside and line.strip():
            f = line.split()
            yield {"model": max(1, model), "atom_index": i, "atom_site_id": int(f[0]), "atom_name": f[1], "x": float(f[2]), "y": float(f[3]), "z": float(f[4]), "element_symbol": f[5].split(".")[0].upper(), "label_comp_id": f[7] if len(f) > 7 else None, "charge": float(f[8]) if len(f) > 8 else None}
            i += 1


_FORMATS = {"xyz": _xyz, "pqr": _pqr, "cif": _mmcif, "mmcif": _mmcif, "lammpstrj": _lammps, "sdf": _sdf, "mol": _sdf, "mol2": _mol2}


def read_structures(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Atoms of files of one format, by suffix if no ``kind`` is given."""
    kind = kind or re.sub(r"[*/].*$", "", path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if kind in ("pdb", "ent", "pdbqt"):
        return read_pdb(spark, path)
    if kind == "gro":
        return read_gro(spark, path)
    if kind not in _FORMATS:
        raise ValueError(f"unknown format {kind!r}")
    return _parsed(spark, path, _FORMATS[kind])


def pdb_lines(atoms: DataFrame) -> DataFrame:
    """(structure_id, model, atom_index, value): one record for each atom, by format_string."""
    name = F.when((F.length("atom_name") < 4) & (F.length(F.coalesce("element_symbol", F.lit(""))) < 2), F.concat(F.lit(" "), "atom_name")).otherwise(F.col("atom_name"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    cols = [F.rpad(blank("record_type"), 6, " "), F.lpad(F.coalesce(F.col("atom_site_id"), F.col("atom_index") + 1).cast("string"), 5, " "), F.lit(" "), F.rpad(name, 4, " "), F.rpad(blank("altloc"), 1, " "), F.lpad(blank("label_comp_id"), 3, " "), F.lit(" "), F.rpad(blank("auth_asym_id"), 1, " "), F.lpad(F.coalesce(F.col("auth_seq_id").cast("string"), F.lit("")), 4, " "), F.rpad(blank("ins_code"), 1, " "), F.lit("   ")]
    cols += [F.format_string("%8.3f", c) for c in "xyz"] + [F.format_string("%6.2f", F.coalesce(c, F.lit(d))) for c, d in (("occupancy", 1.0), ("b_factor", 0.0))] + [F.lit(" " * 10), F.lpad(blank("element_symbol"), 2, " ")]
    return atoms.select("structure_id", "model", "atom_index", F.concat(*cols).alias("value"))


def xyz_text(atoms: DataFrame) -> DataFrame:
    """(structure_id, model, value): XYZ text of each model; a model is one row."""
    line = F.concat_ws(" ", F.coalesce("element_symbol", F.lit("X")), *[F.format_string("%.6f", c) for c in "xyz"])
    g = atoms.groupBy("structure_id", "model").agg(F.array_sort(F.collect_list(F.struct("atom_index", line.alias("l")))).alias("a"))
    return g.select("structure_id", "model", F.concat_ws("\n", F.size("a").cast("string"), "structure_id", F.transform("a", lambda s: s["l"])).alias("value"))
