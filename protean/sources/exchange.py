"""Text formats of structures and snapshots, written from atom tables and read back.

A writer is one Column for an atom's record, a head and a tail; a structure's records are put
together in order of its models and atoms, one row a file. Readers parse whole texts in Arrow
batches. Structures of any size are written as parts, each a file of its own, and read back from them. Lengths are angstroms in tables; formats in nanometres are converted.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .structures import _ARROW, _FORMATS, ATOMS, _files, cif_category

NL = "\n"


def quoted(c: Column) -> Column:
    """A CIF value: as it is, in quotes, or as a text field; null is ``?`` and empty is ``.``."""
    plain = c.rlike(r"""^[^\s'"#$_;\[\]][^\s]*$""") & ~F.lower(c).rlike("^(data_|save_|loop_|stop_|global_)") & ~c.isin(".", "?")
    one = ~c.contains(NL)
    return (
        F.when(c.isNull(), "?").when(c == "", ".").when(plain, c)
        .when(one & ~c.rlike(r"'(\s|$)"), F.concat(F.lit("'"), c, F.lit("'")))
        .when(one & ~c.rlike('"(\\s|$)'), F.concat(F.lit('"'), c, F.lit('"')))
        .otherwise(F.concat(F.lit(NL + ";"), c, F.lit(NL + ";" + NL)))
    )


def _f(pattern: str, *cols) -> Column:
    return F.format_string(pattern, *cols)


def _or(name: str, value) -> Column:
    return F.coalesce(F.col(name), F.lit(value))


@functools.cache
def _spec() -> tuple[dict, dict, dict]:
    """(records, heads, tails) by format. Columns are made on the driver only, where there is a session."""
    text = lambda name: _or(name, "")
    serial = F.coalesce(F.col("atom_site_id"), F.col("atom_index") + 1)
    items = {
        "group_PDB": F.coalesce(F.col("record_type"), F.lit("ATOM")), "id": F.col("atom_site_id").cast("string"), "type_symbol": F.col("element_symbol"), "label_atom_id": F.col("atom_name"), "label_alt_id": F.col("altloc"),
        "label_comp_id": F.col("label_comp_id"), "label_asym_id": F.col("label_asym_id"), "label_seq_id": F.col("label_seq_id").cast("string"), "pdbx_PDB_ins_code": F.col("ins_code"),
        "Cartn_x": _f("%.3f", "x"), "Cartn_y": _f("%.3f", "y"), "Cartn_z": _f("%.3f", "z"), "occupancy": _f("%.2f", "occupancy"), "B_iso_or_equiv": _f("%.2f", "b_factor"), "pdbx_formal_charge": F.col("formal_charge").cast("string"),
        "auth_asym_id": F.col("auth_asym_id"), "auth_seq_id": F.col("auth_seq_id").cast("string"), "pdbx_PDB_model_num": F.col("model").cast("string"),
    }
    numbers = ("Cartn_x", "Cartn_y", "Cartn_z", "occupancy", "B_iso_or_equiv")
    source = {"Cartn_x": "x", "Cartn_y": "y", "Cartn_z": "z", "occupancy": "occupancy", "B_iso_or_equiv": "b_factor"}

    def _cif_line() -> Column:
        return F.concat_ws(" ", *[F.when(F.col(source[k]).isNull(), "?").otherwise(v) if k in numbers else quoted(v) for k, v in items.items()])

    element = F.initcap(F.coalesce(F.when(F.col("element_symbol") != "", F.col("element_symbol")), F.lit("X")))

    #: Record of an atom, by format; ``n`` and ``title`` of heads and tails are columns of the model.
    lines = {
        "gro": _f("%5d%-5s%5s%5d%8.3f%8.3f%8.3f", _or("auth_seq_id", 0), text("label_comp_id"), text("atom_name"), serial % 100000, F.col("x") / 10, F.col("y") / 10, F.col("z") / 10),
        "pqr": _f("%-6s%5d %-4s %3s %s%4d    %s %7.4f %6.4f", F.coalesce(F.col("record_type"), F.lit("ATOM")), serial, text("atom_name"), text("label_comp_id"), text("auth_asym_id"), _or("auth_seq_id", 0), _f("%.3f %.3f %.3f", "x", "y", "z"), _or("charge", 0.0), _or("radius", 0.0)),
        "aims": _f("atom %.8f %.8f %.8f %s", "x", "y", "z", element),
        "crd": _f("%10d%10d  %-8s  %-8s%20.10f%20.10f%20.10f  %-8s  %-8s%20.10f", serial, _or("auth_seq_id", 0), text("label_comp_id"), text("atom_name"), "x", "y", "z", _or("auth_asym_id", "-"), _or("auth_seq_id", 0).cast("string"), _or("b_factor", 0.0)),
        "config": _f("%-8s%10d" + NL + "%20.10f%20.10f%20.10f", F.coalesce(F.col("atom_name"), element), F.col("atom_index") + 1, "x", "y", "z"),
        "history": _f("%-8s%10d%12.6f%12.6f" + NL + "%20.10f%20.10f%20.10f", F.coalesce(F.col("atom_name"), element), F.col("atom_index") + 1, F.lit(0.0), _or("charge", 0.0), "x", "y", "z"),
        "txyz": _f("%6d %-3s %14.8f %14.8f %14.8f %5d", F.col("atom_index") + 1, F.coalesce(F.col("atom_name"), element), "x", "y", "z", F.lit(0)),
        "sdf": _f("%10.4f%10.4f%10.4f %-3s 0  0  0  0  0  0  0  0  0  0  0  0", "x", "y", "z", element),
        "mol2": _f("%7d %-8s %12.4f %12.4f %12.4f %-5s %5d %-8s %10.4f", F.col("atom_index") + 1, F.coalesce(F.col("atom_name"), element), "x", "y", "z", element, _or("auth_seq_id", 1), _or("label_comp_id", "UNK"), _or("charge", 0.0)),
        "lammpstrj": _f("%d %s %.6f %.6f %.6f", F.col("atom_index") + 1, F.coalesce(F.col("atom_name"), element), "x", "y", "z"),
        "cif": _cif_line(),
        "rst7": F.concat(*[_f("%12.7f", c) for c in "xyz"]),
        "mdcrd": F.concat(*[_f("%8.3f", c) for c in "xyz"]),
    }

    n, title, model = F.col("n"), F.col("structure_id"), F.col("model")
    heads = {
        "gro": _f("%s" + NL + "%5d", title, n),
        "crd": _f("* %s" + NL + "*" + NL + "%10d  EXT", title, n),
        "config": _f("%s" + NL + "%10d%10d", title, F.lit(0), F.lit(0)),
        "history": F.when(model == 1, _f("%s" + NL + "%10d%10d" + NL + "timestep%10d%10d%10d%10d%12.6f", title, F.lit(0), F.lit(0), model, n, F.lit(0), F.lit(0), F.lit(0.001))).otherwise(_f("timestep%10d%10d%10d%10d%12.6f", model, n, F.lit(0), F.lit(0), F.lit(0.001))),
        "txyz": _f("%6d  %s", n, title),
        "sdf": _f("%s" + NL + "  protean" + NL + NL + "%3d  0  0  0  0  0  0  0  0  0999 V2000", title, n),
        "mol2": _f("@<TRIPOS>MOLECULE" + NL + "%s" + NL + "%d 0 1 0 0" + NL + "SMALL" + NL + "USER_CHARGES" + NL + "@<TRIPOS>ATOM", title, n),
        "lammpstrj": _f("ITEM: TIMESTEP" + NL + "%d" + NL + "ITEM: NUMBER OF ATOMS" + NL + "%d" + NL + "ITEM: BOX BOUNDS pp pp pp" + NL + "0.0 1.0" + NL + "0.0 1.0" + NL + "0.0 1.0" + NL + "ITEM: ATOMS id element x y z", model, n),
        "rst7": _f("%s" + NL + "%6d", title, n),
        "mdcrd": F.when(model == 1, title),
        "cif": F.when(model == 1, F.concat(F.lit("data_"), F.regexp_replace("structure_id", r"\s", "_"), F.lit(NL + "loop_" + NL + NL.join("_atom_site." + k for k in items)))),
    }
    tails = {"gro": F.lit("   0.00000   0.00000   0.00000"), "sdf": F.lit("M  END" + NL + "$$$$")}
    return lines, heads, tails


#: Records that flow on over fixed numbers of fields in a line: characters of a field, fields.
_FLOWS = {"rst7": (12, 6), "mdcrd": (8, 10)}
#: Most atoms of formats whose counts have few columns.
_MOST = {"sdf": 999}
KINDS = ("gro", "pqr", "aims", "crd", "config", "history", "txyz", "sdf", "mol2", "lammpstrj", "cif", "rst7", "mdcrd")


#: Atoms of a part of a structure's text.
PART = 5000


def _bodies(atoms: DataFrame, kind: str, keys: list[str], more=()) -> DataFrame:
    """(keys, n, more, t): records in order of atoms between the head and the tail, a row for each group of ``keys``."""
    if kind not in KINDS:
        raise ValueError(f"unknown format {kind!r}")
    records, heads, tails = _spec()
    g = atoms.groupBy(*keys).agg(F.count("*").alias("n"), *more, F.transform(F.array_sort(F.collect_list(F.struct("atom_index", records[kind].alias("l")))), lambda a: a["l"]).alias("lines"))
    if kind in _MOST:
        g = g.withColumn("n", F.when(F.col("n") > _MOST[kind], F.raise_error(F.concat(F.lit(f"more than {_MOST[kind]} atoms in "), "structure_id"))).otherwise(F.col("n")))
    if kind in _FLOWS:
        wide = _FLOWS[kind][0] * _FLOWS[kind][1]
        body = F.regexp_replace(F.array_join("lines", ""), f"(.{{{wide}}})(?=.)", "$1" + NL)
    else:
        body = F.array_join("lines", NL)
    return g.withColumn("t", F.concat_ws(NL, heads.get(kind, F.lit(None)), body, tails.get(kind, F.lit(None)))).drop("lines")


def _full(atoms: DataFrame) -> DataFrame:
    full = atoms.select(*[(F.col(c) if c in atoms.columns else F.lit(None)).cast(t).alias(c) for c, t in (x.split() for x in ATOMS.split(", "))])
    return full.withColumn("model", F.coalesce("model", F.lit(1)))


def text_of(atoms: DataFrame, kind: str) -> DataFrame:
    """(structure_id, value): the text of each structure; models follow each other.

    A structure's text is one value, so it takes an executor's memory; ``text_parts`` is for structures of any size.
    """
    m = _bodies(_full(atoms), kind, ["structure_id", "model"]).groupBy("structure_id").agg(F.array_sort(F.collect_list(F.struct("model", "t"))).alias("m"))
    return m.select("structure_id", F.concat(F.array_join(F.transform("m", lambda a: a["t"]), NL), F.lit(NL)).alias("value"))


def text_parts(atoms: DataFrame, kind: str, most: int = PART) -> DataFrame:
    """(structure_id, number, begin, value): texts of at most ``most`` atoms each, whole files of their own with one model.

    ``number`` is the model and ``begin`` the index of a part's first atom; ``parsed`` puts both back. Indexes are places
    from 0 on in the model, and gaps are an error.
    """
    full = _full(atoms).withColumn("number", F.col("model")).withColumn("model", F.lit(1))
    part = F.floor(F.col("atom_index") / min(most, _MOST.get(kind, most))).alias("part")
    low, high = F.min("atom_index").alias("begin"), F.max("atom_index").alias("end")
    g = _bodies(full.select("*", part), kind, ["structure_id", "number", "model", "part"], (low, high))
    sound = F.col("end") - F.col("begin") + 1 == F.col("n")
    value = F.when(sound, F.concat("t", F.lit(NL))).otherwise(F.raise_error(F.concat(F.lit("atom indexes are not places in "), "structure_id")))
    return g.select("structure_id", "number", "begin", value.alias("value"))


def _atom(model: int, i: int, name: str, xyz, **more) -> dict:
    x, y, z = map(float, xyz)
    return {"model": model, "atom_index": i, "atom_name": name, "x": x, "y": y, "z": z, **more}


def _gro(text: str) -> Iterator[dict]:
    lines, at, model = text.splitlines(), 0, 1
    while at + 1 < len(lines) and lines[at + 1].strip():
        n = int(lines[at + 1])
        for i, s in enumerate(lines[at + 2 : at + 2 + n]):
            # decimal points of neighbouring fields are a field apart
            first = s.index(".", 20)
            w = s.index(".", first + 1) - first
            yield _atom(model, i, s[10:15].strip(), [10 * float(s[20 + k * w : 20 + (k + 1) * w]) for k in range(3)], auth_seq_id=int(s[:5]), label_seq_id=int(s[:5]), label_comp_id=s[5:10].strip(), atom_site_id=int(s[15:20]))
        at, model = at + 3 + n, model + 1


def _aims(text: str) -> Iterator[dict]:
    rows = [line.split("#")[0].split() for line in text.splitlines()]
    cell = [[float(v) for v in r[1:4]] for r in rows if r and r[0] == "lattice_vector"]
    i = 0
    for r in rows:
        if r and r[0] in ("atom", "atom_frac"):
            p = [float(v) for v in r[1:4]]
            if r[0] == "atom_frac":
                if len(cell) != 3:
                    raise ValueError("fractional atoms need three lattice vectors")
                p = [sum(p[k] * cell[k][c] for k in range(3)) for c in range(3)]
            yield _atom(1, i, r[4], p, element_symbol=r[4].upper())
            i += 1


def _fields(text: str, width: int) -> list[float]:
    return [float(line[k : k + width]) for line in text.splitlines() for k in range(0, len(line.rstrip()), width)]


def _rst7(text: str) -> Iterator[dict]:
    _, head, *rest = text.split("\n", 2)
    n, v = int(head.split()[0]), _fields(rest[0] if rest else "", 12)
    if len(v) < 3 * n:
        raise ValueError("coordinates are missing")
    for i in range(n):
        yield _atom(1, i, "", v[3 * i : 3 * i + 3])


def amber_frames(text: str, n: int, box: bool = False) -> Iterator[dict]:
    """Frames of an AMBER trajectory of ``n`` atoms; with ``box`` three more numbers a frame."""
    v = _fields(text.split("\n", 1)[1], 8)
    size = 3 * n + 3 * box
    if len(v) % size:
        raise ValueError(f"{len(v)} numbers are not whole frames of {size}")
    for f in range(len(v) // size):
        for i in range(n):
            yield _atom(f + 1, i, "", v[f * size + 3 * i : f * size + 3 * i + 3])


def _crd(text: str) -> Iterator[dict]:
    lines = [x for x in text.splitlines() if x.strip() and not x.startswith("*")]
    n = int(lines[0].split()[0])
    for i, line in enumerate(lines[1 : n + 1]):
        f = line.split()
        yield _atom(1, i, f[3], f[4:7], atom_site_id=int(f[0]), label_comp_id=f[2], auth_asym_id=f[7], auth_seq_id=int(re.sub(r"\D", "", f[8]) or 0), b_factor=float(f[9]))


def _dlpoly_atoms(lines: list[str], at: int, n: int | None, extra: int, model: int) -> Iterator[dict]:
    i = 0
    while at + 1 < len(lines) and (n is None or i < n) and lines[at].strip():
        f = lines[at].split()
        yield _atom(model, i, f[0], lines[at + 1].split()[:3], charge=float(f[3]) if len(f) > 3 else None)
        at, i = at + 2 + extra, i + 1


def _config(text: str) -> Iterator[dict]:
    lines = text.splitlines()
    level, images = map(int, lines[1].split()[:2])
    yield from _dlpoly_atoms(lines, 2 + 3 * (images > 0), None, level, 1)


def _history(text: str) -> Iterator[dict]:
    lines, at, model = text.splitlines(), 2, 0
    while at < len(lines) and lines[at].startswith("timestep"):
        _, _, n, level, images = lines[at].split()[:5]
        model, begin = model + 1, at + 1 + 3 * (int(images) > 0)
        yield from _dlpoly_atoms(lines, begin, int(n), int(level), model)
        at = begin + int(n) * (2 + int(level))


def _txyz(text: str) -> Iterator[dict]:
    lines, at, model = text.splitlines(), 0, 1
    while at < len(lines) and lines[at].strip():
        n, begin = int(lines[at].split()[0]), at + 1
        if begin < len(lines) and re.match(r"^\s*[\d.]+(\s+[\d.]+){5}\s*$", lines[begin]):  # a box
            begin += 1
        for i, line in enumerate(lines[begin : begin + n]):
            f = line.split()
            yield _atom(model, i, f[1], f[2:5], atom_site_id=int(f[0]))
        at, model = begin + n, model + 1


def _trc(text: str) -> Iterator[dict]:
    """GROMOS POSITIONRED blocks, in nanometres."""
    for model, m in enumerate(re.finditer(r"(?ms)^POSITIONRED\s*$(.*?)^END\s*$", text), 1):
        rows = [x.split() for x in m[1].splitlines() if x.strip() and not x.lstrip().startswith("#")]
        for i, r in enumerate(rows):
            yield _atom(model, i, "", [10 * float(v) for v in r[:3]])


def _psf(text: str) -> Iterator[dict]:
    lines = text.splitlines()
    at = next(i for i, x in enumerate(lines) if "!NATOM" in x)
    for i, line in enumerate(lines[at + 1 : at + 1 + int(lines[at].split()[0])]):
        f = line.split()
        yield {"model": 1, "atom_index": i, "atom_site_id": int(f[0]), "auth_asym_id": f[1], "auth_seq_id": int(re.sub(r"\D", "", f[2]) or 0), "label_comp_id": f[3], "atom_name": f[4], "charge": float(f[6])}


def psf_bonds(text: str) -> Iterator[tuple[int, int]]:
    """Pairs of atom indexes of the !NBOND section."""
    lines = text.splitlines()
    at = next((i for i, x in enumerate(lines) if "!NBOND" in x), None)
    if at is not None:
        n, v = int(lines[at].split()[0]), []
        for line in lines[at + 1 :]:
            if len(v) >= 2 * n:
                break
            v += [int(x) - 1 for x in line.split()]
        yield from zip(v[0 : 2 * n : 2], v[1 : 2 * n : 2], strict=True)


def _prmtop(text: str) -> Iterator[dict]:
    """Names, charges and residues of an AMBER topology; charges in electrons."""
    part = {}
    for m in re.finditer(r"(?ms)^%FLAG\s+(\S+)[^\n]*\n(?:%COMMENT[^\n]*\n)*%FORMAT\((\d+)([aAIE])(\d+)[^)]*\)[^\n]*\n(.*?)(?=^%FLAG|\Z)", text):
        w = int(m[4])
        part[m[1]] = [line[k : k + w].strip() for line in m[5].splitlines() for k in range(0, len(line.rstrip()), w)]
    n = int(part["POINTERS"][0])
    begins = [int(v) - 1 for v in part.get("RESIDUE_POINTER", ["1"])] + [n]
    owner = [k for k in range(len(begins) - 1) for _ in range(begins[k + 1] - begins[k])]
    for i in range(n):
        yield {"model": 1, "atom_index": i, "atom_name": part["ATOM_NAME"][i], "charge": float(part["CHARGE"][i]) / 18.2223 if "CHARGE" in part else None, "auth_seq_id": owner[i] + 1, "label_comp_id": part["RESIDUE_LABEL"][owner[i]] if "RESIDUE_LABEL" in part else None}


def _lammps_data(text: str) -> Iterator[dict]:
    """Atoms of a LAMMPS data file; the style is read from the section's comment (full without one)."""
    m = re.search(r"(?ms)^Atoms[ \t]*(?:#[ \t]*(\w+))?[^\n]*\n\s*\n(.*?)(?=^\s*\n[A-Z]|\Z)", text)
    columns = {"atomic": (None, 2), "charge": (2, 3), "molecular": (None, 3), "full": (3, 4)}
    if not m:
        return
    q, at = columns[m[1] or "full"]
    for i, line in enumerate(x for x in m[2].splitlines() if x.strip()):
        f = line.split("#")[0].split()
        yield _atom(1, i, f[at - 1 if q is None else q - 1], f[at : at + 3], atom_site_id=int(f[0]), charge=None if q is None else float(f[q]))


def _itp(text: str) -> Iterator[dict]:
    """The [ atoms ] section of a GROMACS molecule."""
    m = re.search(r"(?ms)^\[\s*atoms\s*\][^\n]*\n(.*?)(?=^\[|\Z)", text)
    rows = [x.split(";")[0].split() for x in m[1].splitlines()] if m else []
    for i, f in enumerate(r for r in rows if r and not r[0].startswith("#")):
        yield {"model": 1, "atom_index": i, "atom_site_id": int(f[0]), "auth_seq_id": int(f[2]), "label_comp_id": f[3], "atom_name": f[4], "charge": float(f[6]) if len(f) > 6 else None}


PARSERS = _FORMATS | {
    "gro": _gro, "aims": _aims, "rst7": _rst7, "crd": _crd, "config": _config, "history": _history, "txyz": _txyz, "arc": _txyz, "trc": _trc, "psf": _psf, "prmtop": _prmtop, "lammps": _lammps_data, "itp": _itp,
}


def parsed(texts: DataFrame, kind: str, atoms: int | None = None, box: bool = False) -> DataFrame:
    """Atoms of texts (structure_id, value), or of the parts of ``text_parts``. An AMBER trajectory (``mdcrd``) needs the number of atoms."""
    parse = (lambda t: amber_frames(t, atoms, box)) if kind == "mdcrd" else PARSERS[kind]
    if kind == "mdcrd" and not atoms:
        raise ValueError("an AMBER trajectory does not tell its number of atoms")
    parts = {"number", "begin"} <= set(texts.columns)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for k in range(b.num_rows):
                sid, text = b.column("structure_id")[k].as_py(), b.column("value")[k].as_py()
                if parts:
                    number, begin = b.column("number")[k].as_py(), b.column("begin")[k].as_py()
                    for r in parse(text):
                        yield {"structure_id": sid, **r, "model": number, "atom_index": begin + r["atom_index"]}
                else:
                    for r in parse(text):
                        yield {"structure_id": sid, **r}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # batches of rows run over texts: many texts have few atoms
        rows = read(batches)
        while some := list(itertools.islice(rows, 10_000)):
            there = set().union(*some)  # the format's own columns; the others are null
            yield pa.RecordBatch.from_arrays([pa.array([r.get(c.name) for r in some], c.type) if c.name in there else pa.nulls(len(some), c.type) for c in _ARROW], schema=_ARROW)

    return texts.select("structure_id", "value", *(("number", "begin") if parts else ())).mapInArrow(run, ATOMS)


def read_text(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """Atoms of the files at ``path``."""
    return parsed(_files(spark, path).withColumnRenamed("text", "value"), kind, **options)


def cif_table(texts: DataFrame, category: str) -> DataFrame:
    """(structure_id, row, items): any category of CIF texts as maps; values ``.`` and ``?`` stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.string())
        for b in batches:
            for sid, text in zip(b.column("structure_id").to_pylist(), b.column("value").to_pylist(), strict=True):
                rows = list(cif_category(text, category))
                yield pa.RecordBatch.from_arrays([pa.array([sid] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int32()), pa.array([list(r.items()) for r in rows], kind)], names=["structure_id", "row", "items"])

    return texts.select("structure_id", "value").mapInArrow(run, "structure_id string, row int, items map<string, string>")


def read_xvg(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, values) of the numbers of XVG files; comments and directives go."""
    d = _files(spark, path).select(F.col("structure_id").alias("file"), F.posexplode(F.split("text", "\r?\n")).alias("row", "line"))
    return d.where((F.trim("line") != "") & ~F.trim("line").rlike("^[#@&]")).select("file", "row", F.transform(F.split(F.trim("line"), r"\s+"), lambda v: v.cast("double")).alias("values"))


def obj_text(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh, value): Wavefront OBJ of vertices (mesh, vertex, x, y, z) and faces (mesh, a, b, c) of vertex numbers from 0."""
    rank = lambda c: F.array_sort(F.collect_list(c))
    v = vertices.groupBy("mesh").agg(rank(F.struct("vertex", _f("v %.6f %.6f %.6f", "x", "y", "z").alias("l"))).alias("v"))
    f = faces.groupBy("mesh").agg(rank(F.struct("a", "b", "c")).alias("f"))
    face = F.transform(F.coalesce("f", F.expr("cast(array() as array<struct<a:bigint,b:bigint,c:bigint>>)")), lambda t: F.concat_ws(" ", F.lit("f"), (t["a"] + 1).cast("string"), (t["b"] + 1).cast("string"), (t["c"] + 1).cast("string")))
    return v.join(f, "mesh", "left").select("mesh", F.concat(F.array_join(F.concat(F.transform("v", lambda s: s["l"]), face), NL), F.lit(NL)).alias("value"))
