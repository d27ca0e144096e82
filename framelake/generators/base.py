"""Registry and execution of generating operations, pipelines and groups.

A structure operation is a function ``(Frame, Params) -> iterable of Frame``, a
dataset operation maps a DataFrame, a generator makes frames from parameters.
Random numbers depend on the structure's content and the seed only, so results
do not depend on partitions, order or retries.  Every result appends its tag to
``config_type`` and keeps ``structure_id`` with a running ``variant``.
"""

from __future__ import annotations

import importlib.util
import json
import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from framelake.functions.elements import NUMBER
from framelake.functions.structure import content_hash, sanitize_tag, seeded
from framelake.generators.batches import batch_form, run_batch
from framelake.operators.neighbors import pieces, read_vectors

SCHEMA = (
    "structure_id bigint, variant bigint, species array<string>, pos array<array<double>>, lattice array<array<double>>, pbc array<boolean>, "
    "config_type string, spin array<array<double>>, grp array<string>, energy double, forces array<array<double>>"
)
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_VEC = pa.list_(pa.list_(pa.float64()))
_KINDS = [pa.int64(), pa.int64(), pa.list_(pa.string()), _VEC, _VEC, pa.list_(pa.bool_()), pa.string(), _VEC, pa.list_(pa.string()), pa.float64(), _VEC]


class OperationError(ValueError):
    """Parameters or a structure that an operation cannot take."""


@lru_cache(maxsize=65_536)
def _with_tag(config_type: str, tag: str) -> str:
    tags, tag = config_type.replace("|", " ").split(), sanitize_tag(tag)
    if tag and tag not in tags:
        tags.append(tag)
    text = "|".join(tags)
    if len(text) > 200 and len(tags) > 2:
        text = f"{tags[0]}|...+{len(tags) - 2}|{tags[-1]}"
    return text[:200]


@dataclass
class Frame:
    """One structure as arrays; ``spin`` and ``grp`` may be missing."""

    species: list[str]
    pos: np.ndarray
    lattice: np.ndarray
    pbc: np.ndarray
    config_type: str = ""
    spin: np.ndarray | None = None
    grp: list[str] | None = None
    structure_id: int = 0

    def __len__(self) -> int:
        return len(self.species)

    @property
    def volume(self) -> float:
        return abs(float(np.linalg.det(self.lattice)))

    def fractional(self) -> np.ndarray:
        if self.volume < 1e-12:
            raise OperationError("the cell is flat")
        return self.pos @ np.linalg.inv(self.lattice)

    def seeds(self) -> Callable[[int, str], np.random.Generator]:
        """Generators of the content as it is now, for a seed and a salt."""
        h = content_hash([NUMBER.get(s, 0) for s in self.species], self.pos, self.lattice, self.pbc)
        return lambda seed, salt: seeded(h, self.grp, self.config_type + salt, seed)

    def rng(self, seed: int = 0, salt: str = "") -> np.random.Generator:
        return self.seeds()(seed, salt)

    def tagged(self, tag: str, **changes) -> Frame:
        """A copy with changes and one more tag."""
        out = object.__new__(Frame)
        out.__dict__.update(self.__dict__, config_type=_with_tag(self.config_type, tag), **changes)
        return out

    def pick(self, keep: Iterable[int], tag: str) -> Frame:
        """The atoms at ``keep``."""
        at = list(keep)
        return self.tagged(tag, species=[self.species[i] for i in at], pos=self.pos[at], spin=None if self.spin is None else self.spin[at], grp=None if self.grp is None else [self.grp[i] for i in at])

    def with_atoms(self, species: list[str], pos: np.ndarray, tag: str) -> Frame:
        """More atoms at the end."""
        pos = np.asarray(pos, float).reshape(-1, 3)
        spin = None if self.spin is None else np.vstack([self.spin, np.zeros((len(pos), 3))])
        return self.tagged(tag, species=[*self.species, *species], pos=np.vstack([self.pos, pos]), spin=spin, grp=None if self.grp is None else [*self.grp, *[""] * len(pos)])

    def wrapped(self) -> np.ndarray:
        frac = self.fractional()
        frac[:, self.pbc] -= np.floor(frac[:, self.pbc])
        return frac @ self.lattice


@dataclass
class Operation:
    """A registered operation with its kind (structure, dataset, generator) and default parameters."""

    name: str
    kind: str
    run: Callable
    defaults: dict = field(default_factory=dict)


OPERATIONS: dict[str, Operation] = {}


def operation(name: str, kind: str = "structure", **defaults):
    """Register a function as an operation."""

    def add(f: Callable) -> Callable:
        if name in OPERATIONS:
            raise OperationError(f"{name} is registered already")
        OPERATIONS[name] = Operation(name, kind, f, defaults)
        return f

    return add


def load_plugins(folder: str) -> list[str]:
    """Import every module of a folder; modules register their operations. Names of those that are new."""
    before = set(OPERATIONS)
    for file in sorted(os.listdir(folder)):
        if file.endswith(".py") and not file.startswith("_"):
            spec = importlib.util.spec_from_file_location(f"framelake_plugin_{file[:-3]}", os.path.join(folder, file))
            spec.loader.exec_module(importlib.util.module_from_spec(spec))
    return sorted(set(OPERATIONS) - before)


def parameters(op: Operation, given: dict) -> dict:
    unknown = set(given) - set(op.defaults)
    if unknown:
        raise OperationError(f"{op.name} has no parameter {sorted(unknown)}")
    return {**op.defaults, **given}


def run_one(name: str, frame: Frame, **params) -> list[Frame]:
    """Results of a structure operation for one structure."""
    op = OPERATIONS[name]
    return list(op.run(frame, parameters(op, params)))


def _arrays(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors of every row, None for null."""
    n, flat, good = read_vectors(column)
    known = column.is_valid().to_numpy(zero_copy_only=False)
    if not (good | (pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False) == 0)).all():
        return [None if r is None else np.array(r, float).reshape(-1, 3) for r in column.to_pylist()]
    flat, ends = flat.copy(), np.cumsum(n)
    return [flat[e - k : e] if ok else None for e, k, ok in zip(ends.tolist(), n.tolist(), known.tolist())]


def _frames(b: pa.RecordBatch) -> Iterator[Frame]:
    rows = {n: [None] * b.num_rows if n not in b.schema.names else _arrays(b[n]) if n in ("pos", "lattice", "spin") else b[n].to_pylist() for n in NAMES if n not in ("variant", "energy", "forces")}
    none = np.zeros((0, 3))
    for species, pos, cell, pbc, tag, spin, grp, key in zip(*(rows[n] for n in ("species", "pos", "lattice", "pbc", "config_type", "spin", "grp", "structure_id"))):
        yield Frame(
            species or [], none.copy() if pos is None else pos, np.zeros((3, 3)) if cell is None else cell,
            np.array(pbc if pbc is not None else [cell is not None] * 3, bool), tag or "", spin, grp, key,
        )


def _nested(arrays: list[np.ndarray | None]) -> pa.Array:
    """Lists of 3-vectors."""
    if any(x is None or x.ndim != 2 or x.shape[1] != 3 for x in arrays):
        return pa.array([None if x is None else x.tolist() for x in arrays], _VEC)
    flat = np.ascontiguousarray(np.concatenate(arrays), float)
    inner = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * 3, pa.int32()), pa.array(flat.ravel()))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), inner)


def to_batch(frames: list[tuple[int, Frame]]) -> pa.RecordBatch:
    held = [f for _, f in frames]
    if not held:
        return pa.record_batch([pa.array([], t) for t in _KINDS], NAMES)
    species = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(f.species) for f in held)]), pa.int32()), pa.array(list(chain.from_iterable(f.species for f in held)), pa.string()))
    plain = [[f.structure_id for f in held], [v for v, _ in frames], [f.pbc.tolist() for f in held], [f.config_type for f in held], [f.grp for f in held]]
    key, variant, pbc, tag, grp = (pa.array(c, _KINDS[NAMES.index(n)]) for c, n in zip(plain, ("structure_id", "variant", "pbc", "config_type", "grp")))
    spin = pa.nulls(len(held), _VEC) if all(f.spin is None for f in held) else _nested([f.spin for f in held])
    return pa.record_batch([key, variant, species, _nested([f.pos for f in held]), _nested([f.lattice for f in held]), pbc, tag, spin, grp, pa.nulls(len(held), _KINDS[9]), pa.nulls(len(held), _VEC)], NAMES)


def apply(df: DataFrame, name: str, **params) -> DataFrame:
    """Results of an operation over a table of structures; labels are gone, since they no longer hold."""
    op = OPERATIONS[name]
    params = parameters(op, params)
    if op.kind == "generator":
        raise OperationError(f"{name} makes structures from parameters; use generate()")
    if op.kind == "dataset":
        return op.run(df, params)
    columns = [c for c in NAMES if c in df.columns and c not in ("variant", "energy", "forces")]
    run_op, form = op.run, batch_form(name, params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for b in batches for part in (pieces(b, 5_000) if form else [b])):
            made = run_batch(b, form, params, _with_tag, NAMES, _KINDS) if form else None
            if made is not None:
                yield from (made.slice(x, 10_000) for x in range(0, made.num_rows, 10_000))
                continue
            held: list[tuple[int, Frame]] = []
            for frame in _frames(b):
                for variant, result in enumerate(run_op(frame, params)):
                    held.append((variant, result))
                    if len(held) == 512:
                        yield to_batch(held)
                        held = []
            if held:
                yield to_batch(held)

    return df.select(*columns).mapInArrow(run, SCHEMA)


def generate(spark: SparkSession, name: str, **params) -> DataFrame:
    """Structures that a generator makes, numbered in order."""
    op = OPERATIONS[name]
    frames = list(op.run(parameters(op, params)))
    rows = to_batch([(0, replace(f, structure_id=i)) for i, f in enumerate(frames)]).to_pylist()
    return spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], SCHEMA)


def pipeline(df: DataFrame, steps: list[dict] | str) -> DataFrame:
    """Enabled steps one after the other: ``{"name", "params", "enabled"}``, or ``{"group": [...], "filter": {...}}``; also as JSON."""
    steps = json.loads(steps) if isinstance(steps, str) else steps
    for step in steps:
        if not step.get("enabled", True):
            continue
        if "group" in step:
            df = branches(df, step["group"], step.get("filter"))
        else:
            if step.get("name") not in OPERATIONS:
                raise OperationError(f"unknown operation {step.get('name')!r}")
            df = apply(df, step["name"], **step.get("params", {}))
    return df


def branches(df: DataFrame, steps: list[dict], after: dict | None = None) -> DataFrame:
    """Enabled branches over the same input, their results together, optionally filtered; without any the input passes."""
    live = [s for s in steps if s.get("enabled", True)]
    if not live:
        return df
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (pipeline(df, [s]) for s in live))
    return pipeline(out, [after]) if after and after.get("enabled", True) else out


def scan(bounds: tuple[float, float, float] | list | float) -> list[float]:
    """Values of an inclusive range ``(low, high, step)``, or of a list, or one value."""
    if isinstance(bounds, (int, float)):
        return [float(bounds)]
    if len(bounds) != 3:
        return [float(v) for v in bounds]
    lo, hi, step = map(float, bounds)
    if step <= 0 or hi <= lo:
        return [lo]
    return [round(lo + i * step, 12) for i in range(int((hi - lo) / step + 1e-9) + 1)]


def unit_samples(rng: np.random.Generator, n: int, dims: int, engine: str = "uniform") -> np.ndarray:
    """``n`` points of the unit cube: uniform, or a Sobol sequence with a random shift (up to 10 dimensions)."""
    if engine == "uniform":
        return rng.random((n, dims))
    if engine != "sobol" or dims > 10:
        raise OperationError(f"no {engine} points in {dims} dimensions")
    # fixed values: degree, coefficient and first direction numbers of the Sobol sequence (Joe and Kuo 2008)
    table = [(1, 0, (1,)), (2, 1, (1, 3)), (3, 1, (1, 3, 1)), (3, 2, (1, 1, 1)), (4, 1, (1, 1, 3, 3)), (4, 4, (1, 3, 5, 13)), (5, 2, (1, 1, 5, 5, 17)), (5, 4, (1, 1, 5, 5, 5)), (5, 7, (1, 1, 7, 11, 19))]
    bits = 32
    out = np.zeros((n, dims))
    index = np.arange(n, dtype=np.uint64)
    gray = index ^ (index >> np.uint64(1))
    for d in range(dims):
        if d == 0:
            v = [1 << (bits - 1 - i) for i in range(bits)]
        else:
            s, a, m = table[d - 1]
            v = [m[i] << (bits - 1 - i) for i in range(s)]
            for i in range(s, bits):
                x = v[i - s] ^ (v[i - s] >> s)
                for k in range(1, s):
                    x ^= ((a >> (s - 1 - k)) & 1) * v[i - k]
                v.append(x)
        x = np.zeros(n, np.uint64)
        for i in range(bits):
            x ^= np.where((gray >> np.uint64(i)) & np.uint64(1), np.uint64(v[i]), np.uint64(0))
        out[:, d] = x / 2.0**bits
    return (out + rng.random(dims)) % 1.0
