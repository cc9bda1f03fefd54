"""Scalar grids (cube, OpenDX) as voxel tables (grid_id, ix, iy, iz, x, y, z, value)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOXEL = "grid_id string, ix int, iy int, iz int, x double, y double, z double, value double"
#: Angstroms in a bohr.
BOHR = 0.529177210903


def _cube(text: str):
    lines = text.splitlines()
    f = lines[2].split()
    n_atoms, origin = abs(int(f[0])), np.array(list(map(float, f[1:4])))
    rows = [lines[i].split() for i in (3, 4, 5)]
    shape = [abs(int(r[0])) for r in rows]
    axes = np.array([list(map(float, r[1:4])) for r in rows])
    scale = BOHR if int(rows[0][0]) > 0 else 1.0
    start = 6 + n_atoms + (1 if int(f[0]) < 0 else 0)
    return shape, origin * scale, axes * scale, np.array(" ".join(lines[start:]).split(), dtype=float)


def _dx(text: str):
    shape, origin, axes, values = None, np.zeros(3), [], []
    for line in text.splitlines():
        f = line.split()
        if line.startswith("object 1"):
            shape = list(map(int, f[-3:]))
        elif line.startswith("origin"):
            origin = np.array(list(map(float, f[1:4])))
        elif line.startswith("delta"):
            axes.append(list(map(float, f[1:4])))
        elif f and line[0] not in "#oac":
            values += f
    return shape, origin, np.array(axes), np.array(values, dtype=float)


def read_grid(spark: SparkSession, path: str, kind: str) -> DataFrame:
    parse = {"cube": _cube, "dx": _dx}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, text in zip(b.column("grid_id").to_pylist(), b.column("value").to_pylist(), strict=True):
                shape, origin, axes, values = parse(text)
                if len(values) != np.prod(shape):
                    raise ValueError(f"{name}: {len(values)} values for {shape}")
                for at in range(0, len(values), 1 << 16):
                    v = values[at : at + (1 << 16)]
                    i = np.stack(np.unravel_index(np.arange(at, at + len(v)), shape), axis=1)
                    p = origin + i @ axes
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(v)), *[pa.array(i[:, k], pa.int32()) for k in range(3)], *[pa.array(p[:, k]) for k in range(3)], pa.array(v)], names=["grid_id", "ix", "iy", "iz", "x", "y", "z", "value"])

    d = spark.read.text(path, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("grid_id"), "value")
    return d.mapInArrow(run, VOXEL)
