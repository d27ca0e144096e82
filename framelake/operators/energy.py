"""Energy baselines: per-element reference energies by group, fitted from moments and applied as columns.

A group's fit depends on its data only through the Gram matrix of element counts
and its products with the energies, which are ordinary sums; the optimisers run
on those on the driver and cost the same for any number of structures.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import structure as S

MODES = ("reference_mean", "zero", "prediction")


@dataclass
class Baseline:
    """Reference energies per group, and how a config type finds its group."""

    elements: list[str]
    group_to_ref: dict[str, list[float]]
    config_to_group: dict[str, str] = field(default_factory=dict)
    group_patterns: list[str] = field(default_factory=list)
    mode: str = "reference_mean"
    metadata: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Baseline:
        return Baseline(**json.loads(text))


class BaselineStore:
    """Named baselines, one JSON file each."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def _path(self, name: str) -> str:
        if not re.fullmatch(r"[\w .\-]+", name) or name.startswith("."):
            raise ValueError(f"not a name: {name!r}")
        return os.path.join(self.folder, f"{name}.json")

    def save(self, name: str, baseline: Baseline) -> None:
        os.makedirs(self.folder, exist_ok=True)
        path = self._path(name)
        with open(f"{path}.part", "w", encoding="utf-8") as f:
            f.write(baseline.to_json())
        os.replace(f"{path}.part", path)

    def load(self, name: str) -> Baseline:
        with open(self._path(name), encoding="utf-8") as f:
            return Baseline.from_json(f.read())

    def names(self) -> list[str]:
        return sorted(f[:-5] for f in os.listdir(self.folder) if f.endswith(".json")) if os.path.isdir(self.folder) else []

    def delete(self, name: str) -> bool:
        path = self._path(name)
        if os.path.exists(path):
            os.remove(path)
            return True
        return False

    def clear(self) -> None:
        for name in self.names():
            self.delete(name)


def _matches(pattern: str, c: Column) -> Column:
    """Whether a pattern matches from the start."""
    return c.rlike(f"^(?:{pattern})")


def _valid(patterns: list[str]) -> list[str]:
    out = []
    for p in patterns:
        try:
            re.compile(p)
        except re.error:
            continue
        out.append(p)
    return out


def group_of(config_type: Column, baseline: Baseline) -> Column:
    """Group of a config type: the stored one, else the first matching pattern, else itself."""
    out = S.lookup(baseline.config_to_group, config_type, "string") if baseline.config_to_group else F.lit(None).cast("string")
    for p in _valid(baseline.group_patterns):
        out = F.coalesce(out, F.when(_matches(p, config_type), F.lit(p)))
    return F.coalesce(out, config_type)


def counts_vector(species: Column, elements: list[str]) -> Column:
    number = lambda e: F.size(F.filter(species, lambda s: s == F.lit(e))).cast("double")
    return F.array(*map(number, elements))


def apply_baseline(df: DataFrame, baseline: Baseline) -> DataFrame:
    """``df`` with shifted ``energy``, ``energy_original`` (kept once) and ``baseline``: what happened to the row.

    ``baseline`` is shifted, no_energy, no_group or no_elements.
    """
    tag = F.coalesce("config_type", F.lit(""))
    if not baseline.elements or not baseline.group_to_ref:
        return df.withColumn("baseline", F.lit("no_group"))
    ref = F.try_element_at(F.create_map(*(x for g, v in baseline.group_to_ref.items() for x in (F.lit(g), F.array(*(F.lit(float(r)) for r in v))))), group_of(tag, baseline))
    counts = counts_vector(F.col("species"), baseline.elements)
    dot = F.aggregate(F.zip_with(counts, ref, lambda c, r: c * r), F.lit(0.0), lambda a, x: a + x)
    state = F.when(F.col("energy").isNull(), "no_energy").when(ref.isNull(), "no_group").when(F.forall(counts, lambda c: c == 0), "no_elements").otherwise("shifted")
    original = F.col("energy_original") if "energy_original" in df.columns else F.lit(None).cast("double")
    moved = F.col("baseline") == "shifted"
    out = df.withColumn("baseline", state).withColumn("energy_original", F.when(moved, F.coalesce(original, F.col("energy"))).otherwise(original))
    return out.withColumn("energy", F.when(moved, F.col("energy") - dot).otherwise(F.col("energy")))


def apply_counters(applied: DataFrame) -> dict:
    """Numbers of rows by what happened, and config types without a group."""
    counts = {r["baseline"]: r["n"] for r in applied.groupBy("baseline").agg(F.count("*").alias("n")).collect()}
    lost = [r[0] for r in applied.where("baseline = 'no_group'").select(F.coalesce("config_type", F.lit(""))).distinct().orderBy(F.lit(1)).collect()]
    return {"total": sum(counts.values()), **{k: counts.get(k, 0) for k in ("shifted", "no_energy", "no_group", "no_elements")}, "unmatched": lost}


def suggest_patterns(config_types: list[str], least: int = 2, prefix: int = 3) -> list[str]:
    """Patterns for config types that share at least ``prefix`` leading characters with the first of their group, in sorted order."""
    left, out = sorted(set(config_types)), []
    while left:
        base = left.pop(0)
        mine = [base, *(t for t in left if len(os.path.commonprefix([base, t])) >= prefix)]
        left = [t for t in left if t not in mine]
        if len(mine) >= least:
            out.append(re.escape(os.path.commonprefix(mine)) + ".*")
        else:
            out += map(re.escape, mine)
    return sorted(out)


def moments(df: DataFrame, elements: list[str], group: Column, target: Column) -> dict[str, tuple[int, np.ndarray, np.ndarray, float]]:
    """Per group: number, Gram matrix of the element counts, their products with energy minus target, and its square sum."""
    k = len(elements)
    rows = df.where("energy IS NOT NULL").select(group.alias("g"), counts_vector(F.col("species"), elements).alias("c"), (F.col("energy") - target).alias("y"))
    sums = [F.sum(F.col("c")[i] * F.col("c")[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(F.col("c")[i] * F.col("y")).alias(f"b{i}") for i in range(k)]
    out = {}
    for r in rows.groupBy("g").agg(F.count("*").alias("n"), F.sum(F.col("y") * F.col("y")).alias("s"), *sums).collect():
        gram = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                gram[i, j] = gram[j, i] = r[f"g{i}_{j}"]
        out[r["g"]] = (r["n"], gram, np.array([r[f"b{i}"] for i in range(k)]), r["s"])
    return out


def evolve(n: int, gram: np.ndarray, products: np.ndarray, square: float, *, generations: int = 100_000, population: int = 40, tolerance: float = 1e-8, seed: int = 42) -> np.ndarray:
    """Minimiser of the mean squared rest by a separable natural evolution strategy.

    Candidates are drawn around a mean with a spread per element; both follow the
    rank-weighted draws; ends when the best value changes by less than ``tolerance``.
    """
    rng, k = np.random.default_rng(seed), len(products)
    centre, spread = -rng.random(k), np.full(k, 0.1)
    raw = np.maximum(0.0, np.log(population / 2 + 1) - np.log(np.arange(population) + 1.0))
    utility = raw / raw.sum() - 1 / population
    rate = (3 + np.log(k)) / (5 * np.sqrt(k)) / 2
    last, best = np.inf, centre
    for _ in range(generations):
        step = rng.standard_normal((population, k))
        x = centre + spread * step
        cost = (np.einsum("pi,ij,pj->p", x, gram, x) - 2 * x @ products + square) / max(n, 1)
        order = np.argsort(cost, kind="stable")
        best, step = x[order[0]], step[order]
        if abs(cost[order[0]] - last) < tolerance:
            break
        last = cost[order[0]]
        centre = centre + spread * (utility @ step)
        spread = spread * np.exp(rate * (utility @ (step**2 - 1)))
    return best


def fit_baseline(df: DataFrame, *, mode: str = "reference_mean", reference: DataFrame | None = None, patterns: list[str] | None = None, method: str = "evolution", **options) -> Baseline:
    """Reference energies of every group of config types.

    Targets: the mean energy of ``reference``, zero, or ``predicted_energy`` (per atom) times the atoms.
    ``method`` ``exact`` solves the normal equations instead.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    elements = sorted(r[0] for r in df.select(F.explode(S.elements(F.col("species")))).distinct().collect())
    target = F.lit(0.0)
    if mode == "reference_mean":
        mean = reference.agg(F.avg("energy")).first()[0] if reference is not None else None
        if mean is None:
            raise ValueError("a reference with energies is needed")
        target = F.lit(mean)
    elif mode == "prediction":
        target = F.col("predicted_energy") * F.size("species")
    shape = Baseline(elements, {}, {}, list(patterns or []), mode)
    tag = F.coalesce("config_type", F.lit(""))
    groups = {r[0]: r[1] for r in df.select(tag, group_of(tag, shape)).distinct().collect()}
    for g, (n, gram, products, square) in sorted(moments(df, elements, group_of(tag, shape), target).items()):
        x = np.linalg.lstsq(gram, products, rcond=None)[0] if method == "exact" else evolve(n, gram, products, square, **options)
        shape.group_to_ref[g] = [float(v) for v in x]
    shape.config_to_group = groups
    return shape


def shift_dataset(df: DataFrame, **options) -> tuple[DataFrame, Baseline]:
    """Fit and apply in one."""
    baseline = fit_baseline(df, **options)
    return apply_baseline(df, baseline), baseline


def group_statistics(df: DataFrame, baseline: Baseline) -> DataFrame:
    """``group, structures, mean_energy, counts``: the summed element counts of every group."""
    g = group_of(F.coalesce("config_type", F.lit("")), baseline)
    c = counts_vector(F.col("species"), baseline.elements)
    sums = F.map_from_arrays(F.array(*map(F.lit, baseline.elements)), F.array(*(F.sum(F.col("c")[i]) for i in range(len(baseline.elements)))))
    return df.select(g.alias("group"), "energy", c.alias("c")).groupBy("group").agg(F.count("*").alias("structures"), F.avg("energy").alias("mean_energy"), sums.alias("counts"))


def add_correction(df: DataFrame, corrections: DataFrame, sign: int = 1, key: str = "structure_id") -> DataFrame:
    """Energies, forces and virials plus (or minus) those of a correction table; rows without one stay."""
    c = corrections.select(key, *(F.col(x).alias(f"_{x}") for x in ("energy", "forces", "virial") if x in corrections.columns))
    out = df.join(c, key, "left")
    vector = lambda a, b: F.zip_with(a, b, lambda x, y: x + sign * y)
    sums = {"energy": lambda: F.col("energy") + sign * F.col("_energy"), "virial": lambda: vector(F.col("virial"), F.col("_virial")), "forces": lambda: F.zip_with("forces", "_forces", vector)}
    for x, make in sums.items():
        if f"_{x}" in out.columns:
            out = out.withColumn(x, F.when(F.col(f"_{x}").isNotNull(), make()).otherwise(F.col(x))).drop(f"_{x}")
    return out


Predictor = Callable[[list[dict]], list[dict]]


def predict(df: DataFrame, factory: Callable[[], Predictor], *, max_atoms: int = 50_000, key: str = "structure_id") -> DataFrame:
    """``key, predicted_energy`` (per atom)``, predicted_forces, predicted_virial, descriptor`` by a user's predictor.

    The factory runs once per task; structures go in chunks of at most ``max_atoms``
    atoms, and a chunk that runs out of memory is halved down to single structures.
    """
    names = [key, "predicted_energy", "predicted_forces", "predicted_virial", "descriptor"]
    vec = pa.list_(pa.float64())

    def call(model: Predictor, chunk: list[dict]) -> list[dict]:
        try:
            return model(chunk)
        except MemoryError:
            if len(chunk) == 1:
                raise
            half = len(chunk) // 2
            return call(model, chunk[:half]) + call(model, chunk[half:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for b in batches:
            rows, chunk, atoms, out = b.to_pylist(), [], 0, []
            for r in rows:
                n = len(r["species"] or [])
                if chunk and atoms + n > max_atoms:
                    out += call(model, chunk)
                    chunk, atoms = [], 0
                chunk.append(r)
                atoms += n
            if chunk:
                out += call(model, chunk)
            if len(out) != len(rows):
                raise ValueError(f"the predictor gave {len(out)} results for {len(rows)} structures")
            kinds = [pa.float64(), pa.list_(vec), vec, vec]
            yield pa.record_batch([b[key], *(pa.array([o.get(x) for o in out], t) for x, t in zip(("energy", "forces", "virial", "descriptor"), kinds))], names)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "species", "pos", "lattice", "pbc").mapInArrow(run, f"`{key}` {kind}, predicted_energy double, predicted_forces array<array<double>>, predicted_virial array<double>, descriptor array<double>")
