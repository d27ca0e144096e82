"""Row-generating transforms of cells: strain, Bain path, shear and supercells, as columns only.

A lattice is an array of three rows of three doubles.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def determinant(m: Column) -> Column:
    """Determinant of a 3 x 3 lattice."""
    a = [[m[i][j] for j in range(3)] for i in range(3)]
    return a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])


def scan(low: float, high: float, step: float) -> list[float]:
    """Inclusive range of parameter values."""
    n = int(round((high - low) / step)) if step else 0
    return [round(low + i * step, 12) for i in range(n + 1)]


def _scaled(lattice: Column, factors: list[Column]) -> Column:
    def row(i: int) -> Column:
        return F.transform(lattice[i], lambda x: x * factors[i])

    return F.array(*map(row, range(3)))


def strain(df: DataFrame, x: tuple, y: tuple, z: tuple, lattice: str = "lattice") -> DataFrame:
    """Every combination of percentages along the three lattice rows."""
    grid = F.array(*(F.struct(*(F.lit(float(v)).alias(n) for n, v in zip("xyz", p))) for p in product(scan(*x), scan(*y), scan(*z))))
    rows = df.withColumn("strain", F.explode(grid))
    return rows.withColumn(lattice, _scaled(F.col(lattice), [1 + F.col(f"strain.{a}") / 100 for a in "xyz"]))


def bain_path(df: DataFrame, ratios: tuple, lattice: str = "lattice") -> DataFrame:
    """c/a ratios along the third row at constant volume: c r^(2/3), others r^(-1/3)."""
    rows = df.withColumn("ca", F.explode(F.array(*(F.lit(float(v)) for v in scan(*ratios)))))
    other = F.pow("ca", F.lit(-1 / 3))
    return rows.withColumn(lattice, _scaled(F.col(lattice), [other, other, F.pow("ca", F.lit(2 / 3))]))


def shear(df: DataFrame, xy: tuple, yz: tuple, xz: tuple, lattice: str = "lattice") -> DataFrame:
    """Lattice times (identity + shear), percentages on a full grid."""
    grid = F.array(*(F.struct(*(F.lit(v / 100).alias(n) for n, v in zip(("xy", "yz", "xz"), p))) for p in product(scan(*xy), scan(*yz), scan(*xz))))
    rows, s = df.withColumn("shear", F.explode(grid)), lambda n: F.col(f"shear.{n}")
    row = lambda r: F.array(r[0], r[0] * s("xy") + r[1], r[0] * s("xz") + r[1] * s("yz") + r[2])
    return rows.withColumn(lattice, F.array(*(row(F.col(lattice)[i]) for i in range(3))))


def supercell(atoms: DataFrame, na: int, nb: int, nc: int) -> DataFrame:
    """Images ``ia, ib, ic`` of every atom row."""
    out = atoms
    for name, n in (("ia", na), ("ib", nb), ("ic", nc)):
        out = out.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out
