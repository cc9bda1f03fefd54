"""The atom-selection language: lexer, parser, canonical printer, and compiler to DataFrames.

``or`` binds weaker than ``and``, that weaker than ``not`` and ``global``, then come the modifiers
(``byres``, ``same K as``, ``bonded [n]``, geometry) and the primaries. Predicates on an atom's own
columns become one Column; what needs other atoms becomes a semi-join on keys or a cell join, so a
selection is one lazy plan and columns and filters reach the scan.
"""

from __future__ import annotations

import hashlib
import re
import warnings
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import spatial

TEXT = {
    "chain": "label_asym_id", "label_chain": "label_asym_id", "auth_chain": "auth_asym_id", "resname": "label_comp_id", "label_resname": "label_comp_id", "auth_resname": "auth_comp_id",
    "name": "atom_name", "label_name": "atom_name", "auth_name": "auth_atom_name", "altloc": "altloc", "segid": "segid", "icode": "ins_code", "record_type": "record_type", "element": "element_symbol", "entity_type": "entity_type", "chirality": "chirality",
}
NUMBER = {
    "index": "atom_index", "bynum": "atom_index", "id": "atom_site_id", "resindex": "residue_index", "chainindex": "chain_index", "modelindex": "model_index", "model": "model", "entity": "entity_index", "resid": "label_seq_id", "label_resid": "label_seq_id", "auth_resid": "auth_seq_id",
    "x": "x", "y": "y", "z": "z", "mass": "mass", "charge": "charge", "formalcharge": "formal_charge", "radius": "radius", "bfactor": "b_factor", "tempfactor": "b_factor", "occupancy": "occupancy", "plddt": "plddt", "pae": "pae",
}
SAME = {"residue": ("residue_index",), "chain": ("chain_index",), "entity": ("entity_index",), "segment": ("segid",)}

#: Components and names behind the macros, for tables without a kind column.
AMINO = "ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL MSE SEC PYL".split()
NUCLEIC = "A C G U I DA DC DG DT DI".split()
WATER = "HOH DOD WAT H2O".split()
IONS = "NA K CL MG CA ZN MN FE CU NI CO CD".split()
BACKBONE = "N CA C O OXT".split()
NUCLEIC_BACKBONE = "P OP1 OP2 O5' C5' C4' C3' O3'".split()
STATES = {"alpha_helix": ("H",), "helix_310": ("G",), "pi_helix": ("I",), "polyproline": ("P",), "helix": ("H", "G", "I"), "strand": ("E",), "bridge": ("B",), "sheet": ("E", "B"), "turn": ("T",), "bend": ("S",), "coil": ("C",)}
BANDS = {"plddt_very_high": (90, None), "plddt_confident": (70, 90), "plddt_low": (50, 70), "plddt_very_low": (None, 50)}
MACROS = {"protein", "backbone", "sidechain", "nucleic", "nucleicbackbone", "water", "ion", "hetero", "hydrogen", "heavy", "polymer", "ligand", *STATES, *BANDS}


class SelectionError(ValueError):
    """A selection that cannot be read, or that asks for a column the table lacks."""


class SelectionWarning(UserWarning):
    """W4001 mixed and/or, W4002 equality of fractions, W4003 unknown group."""


@dataclass(frozen=True)
class Node:
    """``op`` and its arguments; ``kids`` are selections."""

    op: str
    args: tuple = ()
    kids: tuple[Node, ...] = ()

    def __and__(self, other: Node) -> Node:
        return Node("and", (), (self, other))

    def __or__(self, other: Node) -> Node:
        return Node("or", (), (self, other))

    def __invert__(self) -> Node:
        return Node("not", (), (self,))

    def __str__(self) -> str:
        return show(self)

    def fingerprint(self) -> str:
        return hashlib.sha256(show(self).encode()).hexdigest()


_TOKEN = re.compile(r"\s*(?:(?P<op><=|>=|!=|==|[()<>=])|(?P<quoted>'[^']*'|\"[^\"]*\")|(?P<word>[^\s()<>=!'\"]+))")
_NUMBER = re.compile(r"^-?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$")
_RANGE = re.compile(r"^(-?\d+)([A-Za-z]?)(?::|-)(-?\d+)([A-Za-z]?)$")
KEYWORDS = {"and", "or", "not", "global", "byres", "same", "bonded", "within", "around", "beyond", "sphzone", "sphlayer", "isolayer", "cyzone", "cylayer", "point", "prop", "group", "all", "none", "of", "as"}


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SelectionError(f"cannot read {text[at:]!r}")
        kind = m.lastgroup
        value = m.group(kind)
        out.append((kind, value[1:-1] if kind == "quoted" else value))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.t, self.i = tokens(text), 0

    def peek(self) -> str:
        return self.t[self.i][1].lower() if self.i < len(self.t) and self.t[self.i][0] != "quoted" else ""

    def take(self) -> str:
        if self.i >= len(self.t):
            raise SelectionError("the selection ends too early")
        self.i += 1
        return self.t[self.i - 1][1]

    def number(self) -> float:
        v = self.take()
        if not _NUMBER.match(v):
            raise SelectionError(f"a number is wanted, not {v!r}")
        return float(v)

    def expect(self, word: str) -> None:
        if self.take().lower() != word:
            raise SelectionError(f"{word!r} is wanted")

    def whole(self) -> Node:
        n = self.either()
        if self.i < len(self.t):
            raise SelectionError(f"unexpected {self.t[self.i][1]!r}")
        return n

    def either(self) -> Node:
        first = self.both()
        kids, mixed = [first], first.op == "and" and not getattr(self, "_closed", False)
        while self.peek() == "or":
            self.take()
            n = self.both()
            mixed |= n.op == "and" and not self._closed
            kids.append(n)
        if len(kids) > 1 and mixed:
            warnings.warn("W4001: 'and' and 'or' without parentheses", SelectionWarning, stacklevel=4)
        return reduce(lambda a, b: Node("or", (), (a, b)), kids)

    def both(self) -> Node:
        n = self.unary()
        self._closed = self.i > 0 and self.t[self.i - 1][1] == ")"
        while self.peek() == "and":
            self.take()
            n = Node("and", (), (n, self.unary()))
            self._closed = False
        return n

    def unary(self) -> Node:
        w = self.peek()
        if w in ("not", "global", "byres"):
            self.take()
            return Node(w, (), (self.unary(),))
        if w == "same":
            self.take()
            key = self.take().lower()
            self.expect("as")
            return Node("same", (key,), (self.unary(),))
        if w == "bonded":
            self.take()
            depth = int(self.number()) if _NUMBER.match(self.peek()) else 1
            return Node("bonded", (depth,), (self.unary(),))
        if w in ("within", "beyond"):
            self.take()
            r = self.number()
            self.expect("of")
            return Node(w, (r,), (self.unary(),))
        sizes = {"around": 1, "sphzone": 1, "sphlayer": 2, "isolayer": 2, "cyzone": 3, "cylayer": 4}
        if w in sizes:
            self.take()
            return Node(w, tuple(self.number() for _ in range(sizes[w])), (self.unary(),))
        return self.primary()

    def primary(self) -> Node:
        w = self.peek()
        if w == "(":
            self.take()
            n = self.either()
            self.expect(")")
            self._closed = True
            return n
        if w in ("all", "none"):
            self.take()
            return Node(w)
        if w == "point":
            self.take()
            return Node("point", tuple(self.number() for _ in range(4)))
        if w == "group" or w.startswith("$"):
            name = self.take()
            return Node("group", (self.take() if w == "group" else name[1:],))
        if w == "atom":
            self.take()
            return Node("atom", (self.take(), self.take(), self.take()))
        absolute = False
        if w == "prop":
            self.take()
            if self.peek() == "abs":
                self.take()
                absolute = True
            w = self.peek()
        if _NUMBER.match(w) and self.i + 1 < len(self.t) and self.t[self.i + 1][1] in ("<", "<=", ">", ">=", "=", "==", "!="):
            v, op, col = self.number(), self.take(), self.take().lower()
            flip = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
            return self.compare(col, flip.get(op, op), v, absolute)
        if w in MACROS:
            self.take()
            return Node("macro", (w,))
        if w in TEXT or w in NUMBER:
            self.take()
            if self.peek() in ("<", "<=", ">", ">=", "=", "==", "!="):
                return self.compare(w, self.take(), self.number(), absolute)
            values = []
            while self.i < len(self.t) and self.t[self.i][0] != "op" and not (self.t[self.i][0] == "word" and self.peek() in KEYWORDS and not (w == "altloc" and self.peek() == "none")):
                values.append(self.take())
            if not values:
                raise SelectionError(f"{w!r} needs values")
            return Node("values", (w, *values))
        raise SelectionError(f"unknown word {w!r}" if w else "the selection ends too early")

    def compare(self, col: str, op: str, v: float, absolute: bool) -> Node:
        if col not in NUMBER:
            raise SelectionError(f"{col!r} is not a numeric column")
        if op in ("=", "==", "!=") and not float(v).is_integer():
            warnings.warn("W4002: equality of fractions", SelectionWarning, stacklevel=5)
        return Node("compare", (col, "=" if op == "==" else op, v, absolute))


def parse(text: str) -> Node:
    return _Parser(text).whole()


def show(n: Node) -> str:
    """Canonical text; parsing it gives the same tree."""
    num = lambda v: str(int(v)) if float(v).is_integer() else repr(float(v))
    word = lambda v: f"'{v}'" if re.search(r"[\s()<>=!]", v) or v.lower() in KEYWORDS else v
    k = [show(c) if c.op not in ("and", "or") else f"({show(c)})" for c in n.kids]
    if n.op in ("and", "or"):
        return f"{k[0]} {n.op} {k[1]}"
    if n.op in ("not", "global", "byres"):
        return f"{n.op} {k[0]}"
    if n.op == "same":
        return f"same {n.args[0]} as {k[0]}"
    if n.op in ("within", "beyond"):
        return f"{n.op} {num(n.args[0])} of {k[0]}"
    if n.op in ("bonded", "around", "sphzone", "sphlayer", "isolayer", "cyzone", "cylayer"):
        return " ".join([n.op, *map(num, n.args), k[0]])
    if n.op == "point":
        return " ".join(["point", *map(num, n.args)])
    if n.op == "compare":
        c, op, v, a = n.args
        return f"prop abs {c} {op} {num(v)}" if a else f"{c} {op} {num(v)}"
    if n.op == "values":
        return " ".join([n.args[0], *(v if n.args[0] == "altloc" and v == "none" else word(v) for v in n.args[1:])])
    if n.op in ("group", "atom"):
        return " ".join([n.op, *n.args])
    return n.args[0] if n.op == "macro" else n.op


def glob(pattern: str) -> str | None:
    """A regular expression for a pattern with ``* ? [a-z] [!a-z] \\x``; None for a plain value."""
    if not re.search(r"[*?\[\\]", pattern):
        return None
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", end + 1
        else:
            out, i = out + {"*": ".*", "?": "."}.get(c, re.escape(c)), i + 1
    return f"^{out}$"


@dataclass
class Aliases:
    """Named selections that other selections can use as ``$name``."""

    texts: dict[str, str] = field(default_factory=dict)

    def define(self, name: str, text: str) -> None:
        self.texts[name] = text

    def resolve(self, node: Node, seen: tuple[str, ...] = ()) -> Node:
        if node.op == "group" and node.args[0] in self.texts:
            name = node.args[0]
            if name in seen:
                raise SelectionError(f"alias {name!r} refers to itself")
            return self.resolve(parse(self.texts[name]), (*seen, name))
        return Node(node.op, node.args, tuple(self.resolve(k, seen) for k in node.kids))


_LOCAL = {"all", "none", "values", "compare", "macro", "point", "atom"}


def is_local(n: Node) -> bool:
    """Decided by an atom's own columns."""
    return n.op in _LOCAL or n.op in ("and", "or", "not") and all(map(is_local, n.kids))


def has_negation(n: Node) -> bool:
    return n.op == "not" or any(map(has_negation, n.kids))


class Selector:
    """Compiles selections against an ``atoms`` table (atom_index, x, y, z, ...) and a ``bonds`` table (atom_a, atom_b)."""

    def __init__(self, atoms: DataFrame, bonds: DataFrame | None = None, groups: dict[str, DataFrame] | None = None, aliases: Aliases | None = None, rel_tol: float = 1e-9, abs_tol: float = 1e-12):
        self.atoms, self.bonds, self.groups, self.aliases, self.rel, self.abs = atoms, bonds, groups or {}, aliases or Aliases(), rel_tol, abs_tol

    def select(self, selection: str | Node) -> DataFrame:
        node = self.aliases.resolve(parse(selection) if isinstance(selection, str) else selection)
        return self._rows(node, self.atoms)

    def _col(self, name: str) -> Column:
        real = TEXT.get(name) or NUMBER.get(name) or name
        if real not in self.atoms.columns:
            raise SelectionError(f"E4003: the table has no column {real!r}")
        return F.col(real) + 1 if name == "bynum" else F.col(real)

    def predicate(self, n: Node) -> Column:
        """The Column of a local selection; missing values never match."""
        return F.coalesce(self._predicate(n), F.lit(False))

    def _predicate(self, n: Node) -> Column:
        if n.op in ("all", "none"):
            return F.lit(n.op == "all")
        if n.op == "and":
            return self.predicate(n.kids[0]) & self.predicate(n.kids[1])
        if n.op == "or":
            return self.predicate(n.kids[0]) | self.predicate(n.kids[1])
        if n.op == "not":
            return ~self.predicate(n.kids[0])
        if n.op == "point":
            d = sum(((F.col(c) - F.lit(v)) * (F.col(c) - F.lit(v)) for c, v in zip("xyz", n.args, strict=False)), F.lit(0.0))
            return d <= F.lit(n.args[3]) * F.lit(n.args[3])
        if n.op == "atom":
            seg, res, name = n.args
            return (self._col("segid") == seg) & (self._col("resid") == int(res)) & (self._col("name") == name)
        if n.op == "compare":
            name, op, v, absolute = n.args
            c = F.abs(self._col(name)) if absolute else self._col(name)
            tol = self.abs + self.rel * abs(v)
            return {"<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v, "=": F.abs(c - v) <= tol, "!=": F.abs(c - v) > tol}[op]
        return self._macro(n.args[0]) if n.op == "macro" else self._values(n.args[0], n.args[1:])

    def _values(self, name: str, values: tuple[str, ...]) -> Column:
        c = self._col(name)
        out = F.lit(False)
        if name in TEXT:
            if name == "element":
                c, values = F.upper(c), tuple(v.upper() for v in values)
            plain = [v for v in values if glob(v) is None and not (name == "altloc" and v == "none")]
            if plain:
                out = out | c.isin(*plain)
            for v in values:
                if name == "altloc" and v == "none":
                    out = out | c.isNull() | (c == "") | (c == ".")
                elif glob(v) is not None:
                    out = out | c.rlike(glob(v))
            return out
        for v in values:
            m = _RANGE.match(v)
            if m:
                lo, hi = sorted((int(m[1]), int(m[3])))
                inside = c.between(lo, hi)
                if name.endswith("resid") and "ins_code" in self.atoms.columns and (m[2] or m[4]):
                    at = F.struct(c.alias("n"), F.coalesce(F.col("ins_code"), F.lit("")).alias("i"))
                    inside = (at >= F.struct(F.lit(int(m[1])).alias("n"), F.lit(m[2]).alias("i"))) & (at <= F.struct(F.lit(int(m[3])).alias("n"), F.lit(m[4]).alias("i")))
                out = out | inside
            elif _NUMBER.match(v):
                out = out | (F.abs(c - float(v)) <= self.abs + self.rel * abs(float(v)))
            elif name.endswith("resid") and re.match(r"^-?\d+[A-Za-z]$", v):
                out = out | ((c == int(v[:-1])) & (F.col("ins_code") == v[-1]))
            else:
                raise SelectionError(f"{v!r} is not a number or range")
        return out

    def _macro(self, name: str) -> Column:
        if name in STATES:
            return self._col("secondary").isin(*STATES[name])
        if name in BANDS:
            lo, hi = BANDS[name]
            c = self._col("plddt")
            return (F.lit(True) if lo is None else c >= lo) & (F.lit(True) if hi is None else c < hi)
        comp, atom, element = (lambda: self._col("resname")), (lambda: self._col("name")), (lambda: F.upper(self._col("element")))
        if name == "protein":
            return comp().isin(*AMINO)
        if name == "backbone":
            return comp().isin(*AMINO) & atom().isin(*BACKBONE)
        if name == "sidechain":
            return comp().isin(*AMINO) & ~atom().isin(*BACKBONE) & ~element().isin("H", "D")
        if name == "nucleic":
            return comp().isin(*NUCLEIC)
        if name == "nucleicbackbone":
            return comp().isin(*NUCLEIC) & atom().isin(*NUCLEIC_BACKBONE)
        if name == "water":
            return comp().isin(*WATER)
        if name == "ion":
            return comp().isin(*IONS)
        if name == "hetero":
            return ~comp().isin(*AMINO, *NUCLEIC)
        if name == "polymer":
            return comp().isin(*AMINO, *NUCLEIC)
        if name == "ligand":
            return ~comp().isin(*AMINO, *NUCLEIC, *WATER, *IONS)
        return element().isin("H", "D") if name == "hydrogen" else ~element().isin("H", "D")

    def _points(self, df: DataFrame) -> DataFrame:
        return df.select(F.col("atom_index").alias("atom"), "x", "y", "z")

    def _semi(self, universe: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
        """Rows of ``universe`` by a one-column key table ``atom``."""
        return universe.join(keys.select(F.col("atom").alias("atom_index")), "atom_index", how)

    def _rows(self, n: Node, universe: DataFrame) -> DataFrame:
        """The selected rows of ``universe``."""
        if is_local(n):
            return universe.where(self.predicate(n))
        if n.op == "and":
            left, right = n.kids
            if is_local(right):
                return self._rows(left, universe).where(self.predicate(right))
            if has_negation(left):  # the right side sees the left side's atoms only
                return self._rows(right, self._rows(left, universe))
            found = self._rows(right, universe)
            return found.where(self.predicate(left)) if is_local(left) else self._semi(found, self._points(self._rows(left, universe)))
        if n.op == "or":
            a, b = (self._rows(k, universe).select(F.col("atom_index").alias("atom")) for k in n.kids)
            return self._semi(universe, a.union(b).distinct())
        kid = n.kids[0] if n.kids else None
        if n.op == "not":
            return self._semi(universe, self._points(self._rows(kid, universe)), "left_anti")
        if n.op == "global":
            return self._semi(universe, self._points(self._rows(kid, self.atoms)))
        if n.op == "group":
            if n.args[0] not in self.groups:
                warnings.warn(f"W4003: no group {n.args[0]!r}", SelectionWarning, stacklevel=2)
                return universe.where(F.lit(False))
            return universe.join(self.groups[n.args[0]].select("atom_index").distinct(), "atom_index", "left_semi")
        target = self._rows(kid, universe)
        if n.op in ("byres", "same"):
            key = SAME["residue"] if n.op == "byres" else SAME.get(n.args[0], (TEXT.get(n.args[0]) or NUMBER.get(n.args[0]) or n.args[0],))
            if n.op == "same" and n.args[0] == "fragment":
                return self._fragment(universe, target)
            for c in key:
                self._col(c)
            return universe.join(target.select(*key).distinct(), list(key), "left_semi")
        if n.op == "bonded":
            return self._bonded(universe, target, n.args[0])
        if n.op in ("within", "around", "beyond"):
            near = getattr(spatial, n.op)(self._points(universe), self._points(target), n.args[0])
            return self._semi(universe, near)
        if n.op == "isolayer":
            near = spatial.cross_pairs(self._points(universe), self._points(target), n.args[1]).groupBy(F.col("first").alias("atom")).agg(F.min("distance").alias("d"))
            return self._semi(universe, near.where(F.col("d").between(n.args[0], n.args[1])))
        return self._about(n, universe, target)

    def _about(self, n: Node, universe: DataFrame, target: DataFrame) -> DataFrame:
        """Zones about the mean of the target's coordinates: one row, whose size is fixed."""
        c = target.agg(*[F.avg(k).alias(f"m{k}") for k in "xyz"])
        at = universe.join(F.broadcast(c))
        dx, dy, dz = (F.col(k) - F.col(f"m{k}") for k in "xyz")
        flat, all3 = dx * dx + dy * dy, dx * dx + dy * dy + dz * dz
        sq = lambda v: F.lit(v) * F.lit(v)
        a = n.args
        keep = {
            "sphzone": lambda: all3 <= sq(a[0]),
            "sphlayer": lambda: (all3 >= sq(a[0])) & (all3 <= sq(a[1])),
            "cyzone": lambda: (flat <= sq(a[0])) & dz.between(a[2], a[1]),
            "cylayer": lambda: (flat >= sq(a[0])) & (flat <= sq(a[1])) & dz.between(a[3], a[2]),
        }[n.op]()
        return at.where(keep).select(*universe.columns)

    def _edges(self) -> DataFrame:
        if self.bonds is None:
            raise SelectionError("E4003: bonds are needed")
        b = self.bonds
        return b.select(F.col("atom_a").alias("u"), F.col("atom_b").alias("v")).union(b.select(F.col("atom_b").alias("u"), F.col("atom_a").alias("v")))

    def _bonded(self, universe: DataFrame, target: DataFrame, depth: int) -> DataFrame:
        edges, seen = self._edges(), target.select(F.col("atom_index").alias("atom"))
        for _ in range(depth):
            seen = seen.union(seen.join(edges, F.col("atom") == F.col("u")).select(F.col("v").alias("atom"))).distinct()
        return self._semi(universe, seen)

    def _fragment(self, universe: DataFrame, target: DataFrame) -> DataFrame:
        from ..functions.graph import components

        labels = components(self._edges().select(F.col("u").alias("a"), F.col("v").alias("b")))
        touched = target.select(F.col("atom_index").alias("node")).join(labels, "node").select("comp").distinct()
        inside = labels.join(touched, "comp", "left_semi").select(F.col("node").alias("atom"))
        return self._semi(universe, inside.union(target.select(F.col("atom_index").alias("atom"))).distinct())


class _Builder:
    """``sel.name("CA") & ~sel.chain("A")``."""

    def __getattr__(self, name: str):
        if name in MACROS:
            return Node("macro", (name,))
        if name in TEXT or name in NUMBER:
            return lambda *v: Node("values", (name, *map(str, v)))
        raise AttributeError(name)

    all, none = Node("all"), Node("none")

    @staticmethod
    def compare(column: str, op: str, value: float) -> Node:
        return Node("compare", (column, op, float(value), False))

    @staticmethod
    def within(radius: float, target: Node) -> Node:
        return Node("within", (float(radius),), (target,))

    @staticmethod
    def by_residue(target: Node) -> Node:
        return Node("byres", (), (target,))

    @staticmethod
    def bonded(depth: int, target: Node) -> Node:
        return Node("bonded", (depth,), (target,))

    @staticmethod
    def point(x: float, y: float, z: float, r: float) -> Node:
        return Node("point", (float(x), float(y), float(z), float(r)))


sel = _Builder()


def complete(text: str) -> list[str]:
    """Words that may go on from the end of ``text``."""
    last = re.search(r"([^\s()]*)$", text)[1].lower()
    words = sorted(KEYWORDS | MACROS | set(TEXT) | set(NUMBER))
    return [w for w in words if w.startswith(last)]


def compact_ranges(numbers: DataFrame, keys=()) -> DataFrame:
    """(keys, ranges): integers ``n`` as '20-22,25'."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("n")
    d = numbers.select(*keys, "n").distinct().withColumn("run", F.col("n") - F.row_number().over(w))
    runs = d.groupBy(*keys, "run").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    text = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", "lo", "hi"))
    return runs.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("lo"), text.alias("t")))), lambda s: s["t"]), ",").alias("ranges"))
