"""Magnetic order of structures with moments: evidence, labels, layered subtypes, inventory.

The rule that turns evidence into a label is a column over the evidence's numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.operators.audit import symbols_point
from framelake.operators.neighbors import by_size, frame_arrays, nearest_many, pieces, read_vectors

LOW = 1e-7  # moments below count as none
FIELDS = ("active", "mean_moment", "moment_std", "net_ratio", "collinearity", "coplanarity", "correlation", "abs_correlation", "parallel", "antiparallel", "q_peak")


def _peaks(pos: np.ndarray, cells: np.ndarray, pbc: np.ndarray, spins: np.ndarray, total: np.ndarray, q_max: int) -> tuple[np.ndarray, np.ndarray]:
    """Strength and wave vector of the strongest wave of each structure; the first one if several are equal."""
    peak, best = np.zeros(len(pos)), np.zeros((len(pos), 3), np.int32)
    turn = np.exp(2j * np.pi * (pos @ np.linalg.inv(cells)))
    powers = [np.ones_like(turn)]
    for _ in range(q_max):
        powers.append(powers[-1] * turn)
    powers = np.stack([*(np.conj(p) for p in powers[:0:-1]), *powers], 3)
    for flags in np.unique(pbc, axis=0):
        if not flags.any():
            continue
        at, begun, ranges = np.flatnonzero((pbc == flags).all(1)), False, []
        for p in flags:  # one of every pair q and -q, by the sign of the first index that is not 0
            ranges.append(range(0 if not begun else -q_max, q_max + 1) if p else range(1))
            begun |= bool(p)
        qs = np.array(list(product(*ranges)))
        kept = np.array([any(q) and next(x for x in q if x) > 0 for q in qs])
        x, y, z = (powers[at][:, :, i, r.start + q_max : r.stop + q_max] for i, r in enumerate(ranges))
        left = (x[:, :, :, None] * y[:, :, None, :]).reshape(len(at), pos.shape[1], -1)
        right = (z[:, :, :, None] * spins[at][:, :, None, :]).reshape(len(at), pos.shape[1], -1)
        wave = (left.transpose(0, 2, 1) @ right).reshape(len(at), len(qs), 3)[:, kept]
        strength = np.minimum(1.0, 2 * (wave.real**2 + wave.imag**2).sum(2) / total[at, None] ** 2)
        peak[at] = strength.max(1)
        best[at] = qs[kept][(strength >= peak[at, None] - 1e-9).argmax(1)]
    return peak, best


def evidence_many(pos: np.ndarray, cells: np.ndarray, pbc: np.ndarray, spins: np.ndarray, k: int = 12, q_max: int = 3) -> dict[str, np.ndarray]:
    """Numbers that describe the order of the moments of structures with the same number of atoms."""
    b, n = pos.shape[:2]
    size = np.linalg.norm(spins, axis=2)
    active, total = size > LOW, size.sum(1)
    some = active.sum(1)
    out = {f: np.zeros(b) for f in FIELDS} | {"active": some, "mean_moment": size.mean(1), "moment_std": size.std(1), "q": np.zeros((b, 3), np.int32)}
    live = np.flatnonzero(total > LOW)
    if not len(live):
        return out
    pos, cells, pbc, spins, size, active, total, some = (x[live] for x in (pos, cells, pbc, spins, size, active, total, some))
    unit = np.where(active[..., None], spins / np.where(active, size, 1.0)[..., None], 0.0)
    out["net_ratio"][live] = np.linalg.norm(spins.sum(1), axis=1) / total
    w = np.linalg.eigvalsh(unit.transpose(0, 2, 1) @ unit / np.maximum(some, 1)[:, None, None])
    out["collinearity"][live], out["coplanarity"][live] = np.clip(w[:, 2], 0, 1), np.clip(1 - 3 * w[:, 0], 0, 1)
    pair = np.flatnonzero(some > 1)
    if len(pair):
        found, j, _, _ = nearest_many(pos[pair], cells[pair], pbc[pair], min(k, n - 1))
        pair, j = pair[found], j[found]
        row = pair[:, None, None]
        both = active[pair][:, :, None] & active[row, j]
        length = np.where(both, size[pair][:, :, None] * size[row, j], 1.0)
        dot = np.clip(np.einsum("bik,bijk->bij", spins[pair], spins[row, j]) / length, -1, 1)
        count = both.sum((1, 2))
        mean = lambda x: np.where(both, x, 0.0).sum((1, 2)) / np.maximum(count, 1)
        for name, value in (("correlation", dot), ("abs_correlation", np.abs(dot)), ("parallel", dot >= 0.8), ("antiparallel", dot <= -0.8)):
            out[name][live[pair]] = mean(value)
    if n > 1:
        regular = np.flatnonzero(np.abs(np.linalg.det(cells)) > 1e-12)
        out["q_peak"][live[regular]], out["q"][live[regular]] = _peaks(pos[regular], cells[regular], pbc[regular], spins[regular], total[regular], q_max)
    return out


def evidence(pos: np.ndarray, cell: np.ndarray | None, pbc: np.ndarray, spins: np.ndarray, k: int = 12, q_max: int = 3) -> dict:
    """The same of one structure."""
    cells = np.full((1, 3, 3), np.nan) if cell is None else cell[None]
    return {f: x[0].tolist() for f, x in evidence_many(pos[None], cells, np.asarray(pbc, bool)[None], spins[None], k, q_max).items()}


def order_rule() -> tuple[Column, Column]:
    """Label and strength from the evidence's columns."""
    c = F.col
    line = c("collinearity") >= 0.90
    fm = line & (c("net_ratio") >= 0.82) & (c("correlation") >= 0.20)
    cancels = line & ~fm & (c("net_ratio") <= 0.20)
    afm = cancels & ((c("q_peak") >= 0.45) | (c("correlation") <= -0.25) | (c("antiparallel") >= 0.20))
    ferri = line & ~fm & ~afm & (c("net_ratio") < 0.82) & (c("antiparallel") >= 0.20) & ((c("q_peak") >= 0.35) | (c("correlation") < -0.05))
    planar = ~line & (c("q_peak") >= 0.45) & (c("coplanarity") >= 0.72)
    other = ~line & ~planar & ((c("q_peak") >= 0.32) | (F.abs("correlation") >= 0.30))
    pm = ~line & ~planar & ~other & (c("net_ratio") <= 0.25) & (c("q_peak") <= 0.22) & (F.abs("correlation") <= 0.15)
    few = c("active") < 2
    label = F.when(c("active") == 0, "low_moment").when(few, "unresolved").when(fm, "fm").when(afm, "afm").when(ferri, "ferrimagnetic").when(planar | other, "noncollinear").when(pm, "pm_like").otherwise("unresolved")
    strength = (
        F.when(c("active") == 0, "strong").when(few, "unresolved").when(fm, F.when(c("net_ratio") >= 0.92, "strong").otherwise("mixed"))
        .when(afm, F.when((c("q_peak") >= 0.45) & (c("antiparallel") >= 0.20), "strong").otherwise("mixed")).when(ferri, "strong")
        .when(planar, F.when(c("q_peak") >= 0.70, "strong").otherwise("mixed")).when(other, "mixed").when(pm, "strong").otherwise("unresolved")
    )
    return label, strength


def periodic_layers(values: np.ndarray, tolerance: float = 0.025) -> list[np.ndarray]:
    """Atoms of each plane along a periodic fractional coordinate, begun behind the widest gap."""
    x = np.mod(values, 1.0)
    order = np.argsort(x, kind="stable")
    gaps = np.diff(np.r_[x[order], x[order[0]] + 1.0])
    order = np.roll(order, -(int(gaps.argmax()) + 1))
    along = np.mod(x[order] - x[order[0]] + 1e-12, 1.0)
    return np.split(order, np.flatnonzero(np.diff(along) > tolerance) + 1)


def layer_subtype(pos: np.ndarray, cell: np.ndarray, pbc: np.ndarray, spins: np.ndarray) -> str:
    """``layered`` (+ -) or ``double_layered`` (+ + - -) along a periodic axis, or nothing; every layer at least 0.8 polarised."""
    size = np.linalg.norm(spins, axis=1)
    active = size > LOW
    if active.sum() < 4 or abs(np.linalg.det(cell)) < 1e-12:
        return ""
    first = int(np.flatnonzero(active)[0])
    along = spins @ (spins[first] / size[first])
    frac, found = pos @ np.linalg.inv(cell), []
    for axis in np.flatnonzero(pbc):
        signs, weights = [], []
        for layer in periodic_layers(frac[:, axis]):
            layer = layer[active[layer]]
            whole = float(np.abs(along[layer]).sum())
            part = float(along[layer].sum()) / whole if whole > 1e-12 else 0.0
            if abs(part) < 0.8:
                break
            signs.append(1 if part > 0 else -1)
            weights.append(abs(part))
        else:
            s = np.array(signs)
            for rank, (name, pattern) in enumerate((("layered", [1, -1]), ("double_layered", [1, 1, -1, -1]))):
                n = len(pattern)
                if len(s) >= n and len(s) % n == 0 and any((s == np.tile(np.roll(pattern, r), len(s) // n)).all() for r in range(n)):
                    found.append((float(np.mean(weights)), rank, name))
    return max(found, default=(0.0, -1, ""))[2]


def magnetic_evidence(df: DataFrame, key: str = "structure_id", spin: str = "spin", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, columns to keep, the evidence, ``label, strength, subtype`` of every structure with one moment per atom."""
    names = [key, *keep, *FIELDS, "q", "subtype", "natoms"]

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        n, pos, cells, pbc = frame_arrays(b)
        held, spins, _ = read_vectors(b[spin])
        chosen = (n > 0) & (held == n)
        owner = np.repeat(np.arange(b.num_rows), held)
        chosen[owner[~np.isfinite(spins).all(1)]] = False
        spins, pos = spins[chosen[owner]], pos[chosen[np.repeat(np.arange(b.num_rows), n)]]
        n = np.where(chosen, n, 0)
        out = {f: np.zeros(b.num_rows) for f in FIELDS} | {"q": np.zeros((b.num_rows, 3), np.int32)}
        subtype = np.full(b.num_rows, "", object)
        for rows, atoms in by_size(n, chosen):
            for f, x in evidence_many(pos[atoms], cells[rows], pbc[rows], spins[atoms]).items():
                out[f][rows] = x
            layered = (out["collinearity"][rows] >= 0.9) & (out["active"][rows] >= 4) & (np.abs(np.linalg.det(cells[rows])) >= 1e-12)
            for r, a in zip(rows[layered], atoms[layered]):
                subtype[r] = layer_subtype(pos[a], cells[r], pbc[r], spins[a])
        at = np.flatnonzero(chosen)
        q = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * 3, pa.int32()), pa.array(out["q"][at].ravel()))
        columns = [b[c].take(pa.array(at)) for c in (key, *keep)]
        return pa.record_batch([*columns, pa.array(out["active"][at].astype(np.int64)), *(pa.array(out[f][at]) for f in FIELDS[1:]), q, pa.array(subtype[at], pa.string()), pa.array(n[at], pa.int32())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from map(one, pieces(b))

    kept = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in (key, *keep))
    schema = f"{kept}active bigint, " + ", ".join(f"{f} double" for f in FIELDS[1:]) + ", q array<int>, subtype string, natoms int"
    out = df.select(key, *keep, "pos", "lattice", "pbc", spin).mapInArrow(run, schema)
    label, strength = order_rule()
    return out.withColumn("label", label).withColumn("strength", strength)


def partition_label() -> Column:
    """The label, with confirmed layered subtypes of antiferromagnets."""
    return F.when((F.col("label") == "afm") & (F.col("subtype") != ""), F.concat(F.lit("afm_"), F.col("subtype"))).otherwise(F.col("label"))


def magnetic_inventory(evidence_: DataFrame, points: DataFrame | None = None, key: str = "structure_id") -> DataFrame:
    """Per composition point and label: structures, atoms and the atoms' share; point ``*`` sums all.

    Without ``points`` the evidence has a column ``symbols`` (:func:`symbols_key`).
    """
    both = F.explode(F.array("point", F.lit("*"))).alias("point")
    if points is None:
        rows = evidence_.groupBy("symbols", partition_label().alias("label")).agg(F.count("*").alias("n"), F.sum("natoms").alias("natoms"))
        rows = rows.withColumn("point", symbols_point(F.col("symbols"))).select("label", "n", "natoms", both)
    else:
        rows = evidence_.join(points.select(key, "point"), key).select(partition_label().alias("label"), F.lit(1).alias("n"), "natoms", both)
    sums = rows.groupBy("point", "label").agg(F.sum("n").alias("structures"), F.sum("natoms").alias("atoms"))
    return sums.join(sums.groupBy("point").agg(F.sum("atoms").alias("all")), "point").select("point", "label", "structures", "atoms", (F.col("atoms") / F.col("all")).alias("share"))


def element_moments(df: DataFrame, spin: str = "spin") -> DataFrame:
    """``element, atoms, mean, std, max`` of the moments' sizes."""
    size = lambda s: F.sqrt(s[0] * s[0] + s[1] * s[1] + s[2] * s[2])
    rows = df.where(F.size(spin) == F.size("species")).select(F.explode(F.arrays_zip(F.col("species").alias("e"), F.transform(spin, size).alias("m"))).alias("a"))
    return rows.groupBy(F.col("a.e").alias("element")).agg(F.count("*").alias("atoms"), F.avg("a.m").alias("mean"), F.stddev_pop("a.m").alias("std"), F.max("a.m").alias("max"))


def pair_alignment(df: DataFrame, cutoff: float, key: str = "structure_id", spin: str = "spin") -> DataFrame:
    """``a, b, pairs, mean, parallel, antiparallel`` of the moments of neighbouring elements within a cutoff."""
    from framelake.operators.neighbors import neighbor_pairs  # noqa: PLC0415

    spins = df.select(F.col(key), F.posexplode(spin).alias("atom", "s"))
    p = neighbor_pairs(df, cutoff, key).where("centre <> neighbour")
    both = p.join(spins.withColumnsRenamed({"atom": "centre", "s": "sa"}), [key, "centre"]).join(spins.withColumnsRenamed({"atom": "neighbour", "s": "sb"}), [key, "neighbour"])
    dot = lambda x, y: F.col(x)[0] * F.col(y)[0] + F.col(x)[1] * F.col(y)[1] + F.col(x)[2] * F.col(y)[2]
    size = F.sqrt(dot("sa", "sa") * dot("sb", "sb"))
    both = both.where(size > LOW).withColumn("c", dot("sa", "sb") / size)
    pair = [F.least("centre_species", "neighbour_species").alias("a"), F.greatest("centre_species", "neighbour_species").alias("b")]
    return both.groupBy(*pair).agg(F.count("*").alias("pairs"), F.avg("c").alias("mean"), F.avg((F.col("c") >= 0.8).cast("double")).alias("parallel"), F.avg((F.col("c") <= -0.8).cast("double")).alias("antiparallel"))
