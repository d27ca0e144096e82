"""Names of the expression language over a data set: built-in values, element statistics, paired fields and per-atom columns.

Only what an expression names is computed: built-in values are columns over the
frames, paired fields one aggregate over the rows of the data sets that occur.
Atom-wise values count by their largest magnitude (the length first, for
``norm``); fields with one row per structure by that row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import structure as S
from framelake.functions.expression import ExpressionError, compile_predicate
from framelake.operators.filters import symbol

_COMPONENTS = {"value": (0, 1), "x": (0, 3), "y": (1, 3), "z": (2, 3), **{n: (i, 6) for i, n in enumerate(("xx", "yy", "zz", "xy", "yz", "zx"))}}


def alias(title: str) -> str:
    """A data set's name in expressions: lower case, other characters as underscores."""
    return re.sub(r"\W+", "_", title.strip().lower()).strip("_")


def builtins(frames: DataFrame) -> dict[str, Column]:
    """Built-in names and their columns."""
    species, lattice = F.col("species"), F.col("lattice")
    n = F.size(species)
    lengths, angles = S.lengths(lattice), S.angles(lattice)
    has = lambda c: F.col(c).isNotNull() if c in frames.columns else F.lit(False)
    energy = F.col("energy") if "energy" in frames.columns else F.lit(None).cast("double")
    out = {"natoms": n, "n_atoms": n, "volume": S.volume(lattice), "energy": energy, "energy_per_atom": S.per_atom(energy, n)}
    out |= {name: lengths[i] for i, name in enumerate("abc")} | {name: angles[i] for i, name in enumerate(("alpha", "beta", "gamma"))}
    out["spin_natoms"] = S.spin_count(F.col("force_mag")) if "force_mag" in frames.columns else F.lit(0)
    return out | {"has_energy": has("energy"), "has_forces": has("forces"), "has_virial": has("virial") if "stress" not in frames.columns else has("virial") | has("stress"), "has_bec": has("bec")}


def _element(name: str) -> Column | None:
    kind, _, element = name.partition(".")
    if kind not in ("count", "frac", "has") or not element:
        return None
    s = symbol(element)
    if s is None:
        raise ExpressionError(f"unknown element {element}")
    count = F.size(F.filter("species", lambda x: x == F.lit(s)))
    return {"count": count, "frac": F.try_divide(count, F.size("species")), "has": count > 0}[kind]


def _part(value: Column, name: str | None) -> Column:
    """A component by name or number-free position, the length, or the only value."""
    if name == "norm":
        return S.norm(value)
    if name is None:
        return F.when(F.size(value) == 1, F.get(value, F.lit(0)))
    if name in _COMPONENTS:
        at, size = _COMPONENTS[name]
        return F.when(F.size(value) == size, F.get(value, F.lit(at)))
    if re.fullmatch(r"c\d+", name):
        return F.get(value, F.lit(int(name[1:])))
    raise ExpressionError(f"unknown component {name}")


def select(frames: DataFrame, text: str, metrics: DataFrame | None = None, key: str = "structure_id") -> DataFrame:
    """Rows of ``frames`` that an expression selects; ``metrics`` holds paired fields (``dataset, structure_id, row_no, pred, ref``)."""
    built, wanted = builtins(frames), {}
    names = {} if metrics is None else {alias(r[0]): r[0] for r in metrics.select("dataset").distinct().collect()}
    sizes = {} if metrics is None else {r[0]: (r[1], r[2]) for r in metrics.groupBy("dataset").agg(F.max("row_no"), F.max(F.size("ref"))).collect()}

    def find(name: str) -> Column | None:
        head, *rest = name.split(".")
        viewed = bool(rest) and rest[0] in ("ref", "pred", "err")
        if name in built:
            return built[name]
        got = _element(name)
        if got is not None:
            return got
        if head == "atomic" and rest:
            if rest[0] not in frames.columns or len(rest) > 2:
                return None
            scalar = dict(frames.dtypes)[rest[0]].count("array") == 1
            rows = F.transform(rest[0], lambda v: F.array(v.cast("double")) if scalar else v)
            return F.array_max(F.transform(rows, lambda v: F.abs(_part(v, rest[1] if len(rest) > 1 else None))))
        if head not in names or len(rest) > 2 or (len(rest) == 2 and not viewed):
            return None
        part = rest[1] if len(rest) == 2 else (rest[0] if rest and not viewed else None)
        if part is None and sizes[names[head]][1] > 1:
            raise ExpressionError(f"{head} needs a component or norm")
        column = f"_f{len(wanted)}" if name not in wanted else wanted[name][0]
        wanted[name] = (column, names[head], rest[0] if viewed else "ref", part)
        return F.col(column)

    test = compile_predicate(text, find)
    if wanted:
        sums = []
        for column, dataset, view, part in wanted.values():
            value = _part(S.view(F.col("pred"), F.col("ref"), view), part)
            value = F.when((F.col("dataset") == dataset) & ~F.isnan(value), value)
            sums.append((F.max(F.abs(value)) if sizes[dataset][0] > 0 else F.max(F.when(F.col("row_no") == 0, value))).alias(column))
        used = sorted({d for _, d, _, _ in wanted.values()})
        table = metrics.where(F.col("dataset").isin(used)).groupBy(key).agg(*sums)
        return frames.join(table, key, "left").where(test).drop(*(w[0] for w in wanted.values()))
    return frames.where(test)


def completions(frames: DataFrame, metrics: DataFrame | None = None, limit: int = 50) -> DataFrame:
    """``token, structures``: names an expression may use, with the structures that have them, most frequent first."""
    built = builtins(frames)
    tests = [F.struct(F.lit(n).alias("token"), (c if n.startswith("has_") else c.isNotNull()).alias("ok")) for n, c in built.items()]
    rows = frames.select(F.explode(F.array(*tests)).alias("t")).where("t.ok").select("t.token")
    per = frames.select(F.explode(F.flatten(F.array(*(F.transform(S.elements(F.col("species")), lambda e: F.concat(F.lit(k), e)) for k in ("count.", "frac.", "has."))))).alias("token"))  # noqa: B023 - used at once
    counts = rows.unionByName(per).groupBy("token").agg(F.count("*").alias("structures"))
    if metrics is not None:
        counts = counts.unionByName(metrics.groupBy(F.regexp_replace(F.lower(F.trim("dataset")), r"\W+", "_").alias("token")).agg(F.count_distinct("structure_id").alias("structures")))
    return counts.orderBy(F.desc("structures"), "token").limit(limit)
