"""Data-quality contracts, geometry filters and inspection of structures.

Rules are columns; only distances go through the neighbour kernel, and only for
rows whose geometry passed the cheaper rules.  A structure may fail several
rules.  Columns: ``structure_id, species, pos, lattice, pbc`` and the optional
labels ``energy, forces, virial``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import structure as S
from framelake.functions.elements import SYMBOLS
from framelake.operators.neighbors import cell_status, minimum_distances, with_short_pairs
from framelake.runtime import materialize

SHORT_DISTANCE = 0.5  # angstrom
TOLERANCE = {"energy": 1e-5, "forces": 1e-5, "virial": 1e-4}
RULES = ("empty_structure", "nonfinite_geometry", "invalid_pbc", "invalid_cell", "unknown_elements", "invalid_label_shape", "nonfinite_labels", "short_distance", "label_conflicts", "exact_duplicates")
BLOCKERS = RULES[:9]


def _all_finite(values: Column) -> Column:
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(values, good), F.lit(False))


def _vectors(v: Column) -> Column:
    return F.coalesce(F.forall(v, lambda p: F.coalesce(F.size(p) == 3, F.lit(False))), F.lit(False))


def flags(pbc: Column) -> Column:
    """Three flags: missing or malformed ones are periodic, one flag stands for all directions."""
    full = F.array(*[F.lit(True)] * 3)
    return F.when(F.size(pbc) == 3, pbc).when(F.size(pbc) == 1, F.array_repeat(pbc[0], 3)).otherwise(full)


def _label_shapes(n: Column) -> dict[str, Column]:
    return {
        "energy": F.lit(True),
        "forces": (F.size("forces") == n) & _vectors(F.col("forces")),
        "virial": F.size("virial").isin(6, 9),
    }


def contracts(df: DataFrame) -> DataFrame:
    """``df`` with ``issues``, the structure's own failures in the order of the rules, and ``geometry_ok``."""
    for name, kind in (("energy", "double"), ("forces", "array<array<double>>"), ("virial", "array<double>")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    pos, lattice, species = F.col("pos"), F.col("lattice"), F.col("species")
    shaped = pos.isNotNull() & _vectors(pos)
    n = F.when(shaped, F.size(pos)).otherwise(0)
    cell_shaped = F.coalesce((F.size(lattice) == 3) & _vectors(lattice), F.lit(False))
    finite = shaped & _all_finite(F.flatten(pos)) & cell_shaped & _all_finite(F.flatten(lattice))
    pbc_ok = F.col("pbc").isNull() | (F.size("pbc").isin(1, 3) & F.forall("pbc", lambda b: b.isNotNull()))
    safe = F.when(cell_shaped, lattice)
    # columns of their own, so that they are not written out anew at every use
    df = df.withColumn("_cell", safe).withColumn("_flags", F.when(pbc_ok, flags(F.col("pbc"))).otherwise(F.array(*[F.lit(True)] * 3)))
    df = df.withColumn("_status", cell_status(F.col("_cell"), F.col("_flags")))
    cell_ok = F.coalesce(F.col("_status").bitwiseAND(F.lit(1)) == 1, F.lit(False))
    known = F.coalesce((F.size(species) == n) & F.forall(species, lambda s: F.coalesce(s.isin(*SYMBOLS), F.lit(False))), F.lit(False))
    shapes = _label_shapes(n)
    bad_shape = reduce(lambda a, b: a | b, (F.col(k).isNotNull() & ~F.coalesce(ok, F.lit(False)) for k, ok in shapes.items()))
    flat = {"energy": F.array("energy"), "forces": F.flatten("forces"), "virial": F.col("virial")}
    nonfinite = reduce(lambda a, b: a | b, (F.col(k).isNotNull() & F.coalesce(shapes[k], F.lit(False)) & ~_all_finite(flat[k]) for k in shapes))
    tests = {"empty_structure": n <= 0, "nonfinite_geometry": ~finite, "invalid_pbc": ~pbc_ok, "invalid_cell": ~cell_ok, "unknown_elements": ~known, "invalid_label_shape": bad_shape, "nonfinite_labels": nonfinite}
    issues = F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(True)), F.lit(r)) for r, t in tests.items())))
    ok = finite & cell_ok & pbc_ok & known
    return df.withColumn("issues", issues).withColumn("geometry_ok", F.coalesce(ok, F.lit(False))).drop("_cell", "_flags", "_status")


def geometry_key(decimals: int = 8) -> Column:
    """Digest of ordered elements, periodicity, cell and positions after rounding."""
    rounded = lambda c: F.transform(F.flatten(c), lambda x: F.bround(x, decimals) + F.lit(0.0))
    return F.sha2(F.to_json(F.struct(F.col("species"), flags(F.col("pbc")).alias("p"), rounded(F.col("lattice")).alias("c"), rounded(F.col("pos")).alias("x"))), 256)


def duplicate_geometries(checked: DataFrame, key: str = "structure_id") -> DataFrame:
    """``key, group, members, conflicting`` of structures that share their geometry with others; the group is its smallest id.

    Labels are compared with the first member that has them.  Group sizes and first labels are
    aggregates per digest, so a group of any size is combined before it is shuffled.
    """
    labelled = {k: F.when(F.coalesce(ok, F.lit(False)), F.flatten(k) if k == "forces" else F.array(k) if k == "energy" else F.col(k)) for k, ok in _label_shapes(F.size("pos")).items()}
    rows = checked.where("geometry_ok").select(F.col(key), geometry_key().alias("digest"), *(v.alias(k) for k, v in labelled.items()))
    rows = materialize(rows, "geometry")
    first = lambda k: F.min(F.when(F.col(k).isNotNull(), F.struct(key, k))).alias(f"first_{k}")
    groups = rows.groupBy("digest").agg(F.min(key).alias("group"), F.count("*").alias("members"), *(first(k) for k in labelled)).where("members > 1")
    both = rows.join(groups, "digest")
    differs = []
    for k, tol in TOLERANCE.items():
        mine, ref = F.col(k), F.col(f"first_{k}.{k}")
        apart = F.exists(F.zip_with(mine, ref, lambda a, b: F.abs(a - b)), lambda x: x > F.lit(tol))  # noqa: B023 - used at once
        comparable = mine.isNotNull() & (F.size(mine) == F.size(ref)) & _all_finite(mine) & _all_finite(ref)
        differs.append((F.coalesce(comparable & apart, F.lit(False)), F.col(f"first_{k}.{key}")))
    out = both.select(key, "digest", "group", "members", *(d.alias(f"d{i}") for i, (d, _) in enumerate(differs)), *(r.alias(f"r{i}") for i, (_, r) in enumerate(differs)))
    # the reference of a label conflicts as soon as any member differs from it
    hit = out.groupBy("digest").agg(*(F.max(f"d{i}").alias(f"any{i}") for i in range(3)))
    conflicting = reduce(lambda a, b: a | b, (F.col(f"d{i}") | (F.col(f"any{i}") & (F.col(key) == F.col(f"r{i}"))) for i in range(3)))
    return out.join(hit, "digest").select(key, "group", "members", F.coalesce(conflicting, F.lit(False)).alias("conflicting"))


def quality_issues(df: DataFrame, key: str = "structure_id") -> DataFrame:
    """``rule, structure_id``: every failed contract of every structure."""
    checked = materialize(contracts(df), "contracts")
    close = with_short_pairs(checked.where("geometry_ok").select(key, "species", "pos", "lattice", flags(F.col("pbc")).alias("pbc")), cutoff=SHORT_DISTANCE, strict=False)
    repeated = duplicate_geometries(checked, key)
    parts = [
        checked.select(F.explode("issues").alias("rule"), key),
        close.where("short").select(F.lit("short_distance").alias("rule"), key),
        repeated.where("conflicting").select(F.lit("label_conflicts").alias("rule"), key),
        repeated.select(F.lit("exact_duplicates").alias("rule"), key),
    ]
    return reduce(DataFrame.unionByName, parts)


def quality_findings(df: DataFrame, key: str = "structure_id") -> DataFrame:
    """``rule, kind, structures``: one row per rule that fails anywhere."""
    kind = F.when(F.col("rule").isin(*BLOCKERS), "blocker").otherwise("review")
    return quality_issues(df, key).groupBy("rule", kind.alias("kind")).agg(F.count_distinct(key).alias("structures"))


@dataclass(frozen=True)
class GeometryLimits:
    """Bounds of the geometry filter; 0 disables one."""

    min_pair_distance: float = 0.0
    min_volume_per_atom: float = 0.0
    max_volume_per_atom: float = 0.0
    min_density: float = 0.0
    max_density: float = 0.0
    require_cell: bool = True

    def __post_init__(self) -> None:
        for name in ("min_pair_distance", "min_volume_per_atom", "max_volume_per_atom", "min_density", "max_density"):
            v = getattr(self, name)
            if not 0 <= v < float("inf"):
                raise ValueError(f"{name} must be finite and not negative")
        for name in ("volume_per_atom", "density"):
            lo, hi = getattr(self, f"min_{name}"), getattr(self, f"max_{name}")
            if hi and lo > hi:
                raise ValueError(f"the least {name} must not exceed the largest")


def rejection_reasons(df: DataFrame, limits: GeometryLimits) -> DataFrame:
    """``df`` with ``reason``, the first failed check of each structure, or null.

    The cheap checks come first; distances are computed only for what they leave.
    """
    n = F.size("pos")
    volume = F.coalesce(S.volume(F.col("lattice")), F.lit(0.0))
    cell = F.coalesce(_all_finite(F.flatten("lattice")) & (F.size("lattice") == 3) & (volume > 1e-12), F.lit(False))
    per_atom, mass = volume / n, S.density(F.col("species"), volume)
    needs_cell = limits.require_cell or any((limits.min_volume_per_atom, limits.max_volume_per_atom, limits.min_density, limits.max_density))
    early = F.when(F.coalesce(n, F.lit(0)) <= 0, "empty").when(~(_vectors(F.col("pos")) & _all_finite(F.flatten("pos"))), "nonfinite_positions")
    if needs_cell:
        early = early.when(~cell, "invalid_cell")
    off = lambda v, lo, hi: (v < lo if lo else F.lit(False)) | (v > hi if hi else F.lit(False))
    late = F.when(cell & off(per_atom, limits.min_volume_per_atom, limits.max_volume_per_atom), "volume_per_atom")
    late = late.when(cell & off(mass, limits.min_density, limits.max_density), "density")
    df = df.withColumn("reason", early)
    if limits.min_pair_distance > 0:
        hide = lambda c: F.when(F.col("reason").isNull(), F.col(c)).alias(c)
        # rows that failed already carry no geometry into the kernel
        slim = df.select(*(F.col(c) for c in df.columns if c not in ("pos", "pbc")), hide("pos"), flags(F.col("pbc")).alias("pbc"), F.col("pos").alias("_pos"), F.col("pbc").alias("_pbc"))
        flagged = with_short_pairs(slim, cutoff=limits.min_pair_distance, out="_short")
        df = flagged.withColumn("reason", F.coalesce("reason", F.when(F.col("_short"), "pair_distance"))).drop("pos", "pbc", "_short").withColumnsRenamed({"_pos": "pos", "_pbc": "pbc"})
    return df.withColumn("reason", F.coalesce("reason", late))


def geometry_filter(df: DataFrame, limits: GeometryLimits) -> DataFrame:
    """Structures that pass all checks."""
    return rejection_reasons(df, limits).where("reason IS NULL").drop("reason")


def geometry_summary(df: DataFrame, limits: GeometryLimits) -> DataFrame:
    """``reason, n``: structures by first failed check, ``kept`` for those that pass."""
    return rejection_reasons(df, limits).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def nonphysical(df: DataFrame, coefficient: float = 0.7, key: str = "structure_id") -> DataFrame:
    """Ids of structures with a pair closer than ``coefficient`` times the sum of covalent radii."""
    return with_short_pairs(df.select(key, "species", "pos", "lattice", flags(F.col("pbc")).alias("pbc")), coefficient=coefficient).where("short").select(key)


def reasonable(df: DataFrame, coefficient: float = 0.7, key: str = "structure_id") -> DataFrame:
    """``key, ok``: whether the least distance of every pair of elements reaches ``coefficient`` times their radii."""
    from framelake.functions.elements import RADIUS  # noqa: PLC0415

    near = minimum_distances(df, key)
    limit = coefficient * (S.lookup(RADIUS, F.col("a"), "double") + S.lookup(RADIUS, F.col("b"), "double"))
    bad = near.where(F.col("distance") < limit).select(key).distinct().withColumn("bad", F.lit(True))
    return df.select(key).join(bad, key, "left").select(key, F.col("bad").isNull().alias("ok"))


def unbalanced(df: DataFrame, threshold: float, key: str = "structure_id", vectors: str = "forces") -> DataFrame:
    """``key, net``: structures whose vectors do not cancel."""
    total = S.norm(S.net(F.col(vectors)))
    return df.select(key, total.alias("net")).where(F.col("net") > threshold)


def unbalanced_rows(rows: DataFrame, threshold: float, key: str, x: Column, y: Column, z: Column) -> DataFrame:
    """The same over one row per atom."""
    total = F.sqrt(F.pow(F.sum(x), F.lit(2)) + F.pow(F.sum(y), F.lit(2)) + F.pow(F.sum(z), F.lit(2)))
    return rows.groupBy(key).agg(total.alias("net")).where(F.col("net") > threshold)


def inspect(df: DataFrame, coefficient: float = 0.7, key: str = "structure_id") -> DataFrame:
    """Volume, density, energies, forces, the shortest pair and the number of short element pairs of each structure."""
    from framelake.functions.elements import RADIUS  # noqa: PLC0415

    near = minimum_distances(df, key)
    limit = coefficient * (S.lookup(RADIUS, F.col("a"), "double") + S.lookup(RADIUS, F.col("b"), "double"))
    shortest = near.groupBy(key).agg(F.min("distance").alias("shortest_pair"), F.count_if(F.col("distance") < limit).alias("short_contacts"))
    volume = S.volume(F.col("lattice"))
    facts = df.select(
        key, S.num_atoms(F.col("species")).alias("natoms"), S.formula(F.col("species")).alias("formula"), volume.alias("volume"), S.density(F.col("species"), volume).alias("density"),
        "energy", S.per_atom(F.col("energy"), F.size("species")).alias("energy_per_atom"),
        S.max_norm(F.col("forces")).alias("max_force"), S.rms_norm(F.col("forces")).alias("rms_force"), S.norm(S.net(F.col("forces"))).alias("net_force"),
    )
    return facts.join(shortest, key, "left")

