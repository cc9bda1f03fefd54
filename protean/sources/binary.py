"""Binary containers: DCD trajectories, MRC maps and merged MTZ reflections.

Files come through Spark's ``binaryFile`` source; rows leave in Arrow batches of bounded size.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME = "trajectory string, frame int, atom int, x double, y double, z double"
VOXEL = "grid_id string, ix int, iy int, iz int, value double"
BATCH = 1 << 16


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "content")


def _records(data: bytes, order: str, at: int = 0) -> Iterator[bytes]:
    """Unformatted records: a length before and after each."""
    while at < len(data):
        (n,) = struct.unpack_from(order + "i", data, at)
        if n < 0 or at + 8 + n > len(data) or struct.unpack_from(order + "i", data, at + 4 + n)[0] != n:
            raise ValueError("a record's lengths do not agree")
        yield data[at + 4 : at + 4 + n]
        at += 8 + n


def dcd_frames(data: bytes) -> Iterator[np.ndarray]:
    """(atoms, 3) coordinates of each frame, in either byte order; no fixed atoms."""
    order = "<" if struct.unpack_from("<i", data)[0] == 84 else ">"
    it = _records(data, order)
    head = next(it)
    if head[:4] not in (b"CORD", b"VELD"):
        raise ValueError("no DCD file")
    control = struct.unpack(order + "20i", head[4:84])
    if control[8]:
        raise ValueError("fixed atoms are not read")
    next(it)
    (n,) = struct.unpack(order + "i", next(it)[:4])
    while True:
        first = next(it, None)
        if first is None:
            return
        x = next(it) if control[10] else first  # a cell record goes before, if there is one
        yield np.stack([np.frombuffer(r, order + "f4", n) for r in (x, next(it), next(it))], axis=1).astype(float)


def dcd_bytes(frames: np.ndarray) -> bytes:
    """A DCD file of (frames, atoms, 3) coordinates."""
    rec = lambda b: struct.pack("<i", len(b)) + b + struct.pack("<i", len(b))
    control = [len(frames), 0, 1, len(frames)] + [0] * 15 + [24]
    title = b"coordinates".ljust(80)
    out = [rec(b"CORD" + struct.pack("<20i", *control)), rec(struct.pack("<i", 1) + title), rec(struct.pack("<i", frames.shape[1]))]
    for f in frames:
        out += [rec(np.ascontiguousarray(f[:, k], "<f4").tobytes()) for k in range(3)]
    return b"".join(out)


def read_dcd(spark: SparkSession, path: str) -> DataFrame:
    """(trajectory, frame, atom, x, y, z)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("name").to_pylist(), b.column("content").to_pylist(), strict=True):
                for i, xyz in enumerate(dcd_frames(data)):
                    for at in range(0, len(xyz), BATCH):
                        p = xyz[at : at + BATCH]
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(p)), pa.array(np.full(len(p), i, np.int32)), pa.array(np.arange(at, at + len(p), dtype=np.int32)), *[pa.array(p[:, k].copy()) for k in range(3)]], names=["trajectory", "frame", "atom", "x", "y", "z"])

    return _files(spark, path).mapInArrow(run, FRAME)


_MODES = {0: "i1", 1: "i2", 2: "f4", 6: "u2", 12: "f2"}


def mrc_grid(data: bytes) -> tuple[np.ndarray, tuple[float, ...]]:
    """Values by (x, y, z) whatever the axis order, and the cell."""
    order = "<" if data[212] in (0x44, 0) else ">"
    nc, nr, ns, mode = struct.unpack_from(order + "4i", data)
    cell = struct.unpack_from(order + "6f", data, 40)
    axes = struct.unpack_from(order + "3i", data, 64)
    (extra,) = struct.unpack_from(order + "i", data, 92)
    v = np.frombuffer(data, order + _MODES[mode], nc * nr * ns, 1024 + extra).reshape(ns, nr, nc)
    by = {a: i for a, i in zip(axes if sorted(axes) == [1, 2, 3] else (1, 2, 3), (2, 1, 0), strict=True)}
    return v.transpose(by[1], by[2], by[3]).astype(float), cell


def mrc_bytes(values: np.ndarray, cell: tuple[float, ...]) -> bytes:
    nx, ny, nz = values.shape
    head = bytearray(1024)
    struct.pack_into("<10i", head, 0, nx, ny, nz, 2, 0, 0, 0, nx, ny, nz)
    struct.pack_into("<6f3i3f", head, 40, *cell, 1, 2, 3, values.min(), values.max(), values.mean())
    head[208:212], head[212:216] = b"MAP ", bytes([0x44, 0x44, 0, 0])
    return bytes(head) + np.ascontiguousarray(values.transpose(2, 1, 0), "<f4").tobytes()


def read_mrc(spark: SparkSession, path: str) -> DataFrame:
    """(grid_id, ix, iy, iz, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("name").to_pylist(), b.column("content").to_pylist(), strict=True):
                v, _ = mrc_grid(data)
                flat = v.ravel()
                for at in range(0, len(flat), BATCH):
                    p = flat[at : at + BATCH]
                    i = np.unravel_index(np.arange(at, at + len(p)), v.shape)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(p)), *[pa.array(k.astype(np.int32)) for k in i], pa.array(p)], names=["grid_id", "ix", "iy", "iz", "value"])

    return _files(spark, path).mapInArrow(run, VOXEL)


def mtz_table(data: bytes) -> tuple[list[str], np.ndarray, tuple[float, ...]]:
    """Column names, values (missing ones are NaN) and the cell of a merged MTZ file."""
    if data[:4] != b"MTZ ":
        raise ValueError("no MTZ file")
    order = "<" if data[8] >> 4 == 4 else ">"
    (at,) = struct.unpack_from(order + "i", data, 4)
    names, cell, n_cols, n_rows, missing = [], (), 0, 0, None
    for k in range(4 * (at - 1), len(data), 80):
        f = data[k : k + 80].decode("ascii", "replace").split()
        if not f or f[0] == "END":
            break
        if f[0] == "NCOL":
            n_cols, n_rows = int(f[1]), int(f[2])
        elif f[0] == "CELL":
            cell = tuple(map(float, f[1:7]))
        elif f[0] == "COLUMN":
            names.append(f[1])
        elif f[0] == "VALM" and f[1].upper() != "NAN":
            missing = float(f[1])
    v = np.frombuffer(data, order + "f4", n_cols * n_rows, 80).reshape(n_rows, n_cols).astype(float)
    if missing is not None:
        v = np.where(v == np.float32(missing), np.nan, v)
    return names, v, cell


def mtz_bytes(names: list[str], kinds: str, values: np.ndarray, cell: tuple[float, ...]) -> bytes:
    """A merged little-endian MTZ file; ``kinds`` is a letter for each column (H index, F amplitude, ...)."""
    body = np.ascontiguousarray(values, "<f4").tobytes()
    lines = ["VERS MTZ:V1.1", f"NCOL {len(names)} {len(values)} 0", "CELL " + " ".join(f"{c:.4f}" for c in cell), "SORT 0 0 0 0 0", "VALM NAN"]
    lines += [f"COLUMN {n} {k} {np.nanmin(values[:, i]):.4f} {np.nanmax(values[:, i]):.4f} 1" for i, (n, k) in enumerate(zip(names, kinds, strict=True))] + ["END", "MTZENDOFHEADERS"]
    head = b"MTZ " + struct.pack("<i", 21 + len(body) // 4) + bytes([0x44, 0x41, 0, 0])
    return head.ljust(80, b"\0") + body + b"".join(x.encode().ljust(80) for x in lines)


def read_mtz(spark: SparkSession, path: str, columns: tuple[str, ...] = ("H", "K", "L", "F")) -> DataFrame:
    """(file, one column for each name); null where a file has no value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("name").to_pylist(), b.column("content").to_pylist(), strict=True):
                names, v, _ = mtz_table(data)
                for at in range(0, len(v), BATCH):
                    p = v[at : at + BATCH]
                    cols = [pa.array(p[:, names.index(c)].copy(), from_pandas=True) if c in names else pa.nulls(len(p), pa.float64()) for c in columns]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(p)), *cols], names=["file", *columns])

    return _files(spark, path).mapInArrow(run, "file string, " + ", ".join(f"`{c}` double" for c in columns))
