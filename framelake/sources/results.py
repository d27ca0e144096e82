"""Results of models beside their structures: loaders that find the files of a training or prediction and pair them up.

A loader gives ``structures`` (with ``structure_id``), ``metrics`` (``dataset,
structure_id, row_no, pred, ref``) and, if there are any, ``descriptors``.  File
rows belong to structures by position; numbers of rows are checked.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators.selection import attach_rows
from framelake.sources.formats import FormatError
from framelake.sources.npy import read_npy
from framelake.sources.structures import import_structures, read_extxyz, with_ids
from framelake.sources.tables import read_out

#: Kind of rows and number of components of each dataset's file.
LAYOUT = {"energy": ("structure", 1), "virial": ("structure", 6), "stress": ("structure", 6), "force": ("atom", 3), "mforce": ("spin", 3), "bec": ("atom", 9), "charge": ("atom", 1), "dipole": ("structure", 3), "polarizability": ("structure", 6)}


@dataclass
class Results:
    """A loaded data set."""

    structures: DataFrame
    metrics: DataFrame | None = None
    descriptors: DataFrame | None = None
    missing: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Loader:
    name: str
    matches: Callable[[str], bool]
    load: Callable[[SparkSession, str], Results]


LOADERS: list[Loader] = []


def register_loader(loader: Loader) -> None:
    """Add a loader; earlier ones are asked first."""
    if any(x.name == loader.name for x in LOADERS):
        raise ValueError(f"{loader.name} is registered already")
    LOADERS.append(loader)


def load_results(spark: SparkSession, path: str) -> Results:
    """By the first loader that takes the path, else only the structures."""
    for loader in LOADERS:
        if loader.matches(path):
            return loader.load(spark, path)
    return Results(with_ids(import_structures(spark, path)))


def model_kind(folder: str) -> int | None:
    """0 or 3 potential, 1 dipole, 2 polarizability, by the model file's header; None without one."""
    path = os.path.join(folder, "nep.txt")
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        head = f.readline().split()
    if not head or not head[0].startswith("nep"):
        return None
    return 1 if head[0].endswith("dipole") else 2 if head[0].endswith("polarizability") else 0


def _paired(rows: DataFrame, dataset: str, n: int, prediction_first: bool = True, select: list[int] | None = None) -> DataFrame:
    """Rows of 2 n columns as prediction and reference; NaN references take the prediction; n columns are predictions only."""
    at = select or list(range(n))
    part = lambda shift: F.array(*(F.get("values", F.lit(i + shift)) for i in at))
    both = F.size("values") >= 2 * n
    pred = part(0) if prediction_first else F.when(both, part(n)).otherwise(part(0))
    ref = F.when(both, part(n) if prediction_first else part(0))
    known = F.zip_with(F.coalesce(ref, pred), pred, lambda r, p: F.when(~F.isnan(r), r).otherwise(p))
    return rows.select(F.lit(dataset).alias("dataset"), "structure_id", "row_no", pred.alias("pred"), known.alias("ref"))


def _rows(spark: SparkSession, path: str, structures: DataFrame, kind: str) -> DataFrame:
    """Rows of a file with the structure they belong to."""
    counts: dict[str, Column] = {"structure": F.lit(1), "atom": F.size("species"), "spin": F.size(F.filter(F.coalesce("force_mag", F.array()), lambda v: F.exists(v, lambda x: x != 0)))}
    rows = read_out(spark, path)
    if kind == "spin":
        # spin files hold magnetic atoms only, or all
        all_atoms = structures.agg(F.sum(F.size("species"))).first()[0]
        kind = "atom" if rows.count() == all_atoms else "spin"
    return attach_rows(structures, rows, counts[kind])


def _collect(spark: SparkSession, structures: DataFrame, files: dict[str, str], prediction_first: bool = True) -> tuple[DataFrame | None, list[str]]:
    parts, missing = [], []
    for dataset, path in files.items():
        if not os.path.exists(path):
            missing.append(dataset)
            continue
        kind, n = LAYOUT[dataset]
        parts.append(_paired(_rows(spark, path, structures, kind), dataset, n, prediction_first))
    return (reduce(DataFrame.unionByName, parts) if parts else None), missing


def _descriptors(spark: SparkSession, path: str, structures: DataFrame) -> DataFrame | None:
    """One vector per structure; rows per atom are averaged."""
    if not os.path.exists(path):
        return None
    rows = read_out(spark, path)
    n = structures.count()
    if rows.count() == n:
        return attach_rows(structures, rows, F.lit(1)).select("structure_id", F.col("values").alias("vec"))
    per_atom = attach_rows(structures, rows, F.size("species"))
    means = per_atom.select("structure_id", F.posexplode("values").alias("i", "x")).groupBy("structure_id", "i").agg(F.avg("x").alias("x"))
    return means.groupBy("structure_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("vec"))


def _base(path: str) -> tuple[str, str]:
    folder = os.path.dirname(path)
    return folder, os.path.splitext(os.path.basename(path))[0]


def load_training(spark: SparkSession, path: str) -> Results:
    """``<stem>.xyz`` with ``energy_<stem>.out`` and the like; predictions come first in the files."""
    folder, stem = _base(path)
    s = with_ids(read_extxyz(spark, path))
    files = {d: os.path.join(folder, f"{d}_{stem}.out") for d in ("energy", "force", "virial", "stress", "charge", "bec", "mforce")}
    metrics, missing = _collect(spark, s, files)
    return Results(s, metrics, _descriptors(spark, os.path.join(folder, f"descriptor_{stem}.out"), s), missing)


def load_dipole(spark: SparkSession, path: str) -> Results:
    folder, stem = _base(path)
    s = with_ids(read_extxyz(spark, path))
    metrics, missing = _collect(spark, s, {"dipole": os.path.join(folder, f"dipole_{stem}.out")})
    return Results(s, metrics, _descriptors(spark, os.path.join(folder, f"descriptor_{stem}.out"), s), missing)


def load_polarizability(spark: SparkSession, path: str) -> Results:
    """Six components as two datasets, diagonal and off the diagonal."""
    folder, stem = _base(path)
    s = with_ids(read_extxyz(spark, path))
    file = os.path.join(folder, f"polarizability_{stem}.out")
    if not os.path.exists(file):
        return Results(s, None, None, ["polarizability"])
    rows = _rows(spark, file, s, "structure")
    parts = [_paired(rows, name, 6, True, at) for name, at in (("polarizability_diagonal", [0, 1, 2]), ("polarizability_off_diagonal", [3, 4, 5]))]
    return Results(s, parts[0].unionByName(parts[1]), _descriptors(spark, os.path.join(folder, f"descriptor_{stem}.out"), s))


def _deepmd_prefix(path: str) -> tuple[str, str] | None:
    for folder in (path, os.path.dirname(path.rstrip("/"))):
        found = sorted(f for f in os.listdir(folder) if f.endswith(".e_peratom.out")) if os.path.isdir(folder) else []
        if found:
            return folder, found[0][: -len(".e_peratom.out")]
    return None


def load_deepmd(spark: SparkSession, path: str) -> Results:
    """A folder of arrays with ``*.e_peratom.out``, ``*.fr.out`` (or ``.f.out``), ``*.v_peratom.out``, ``*.fm.out``; references come first."""
    s = with_ids(read_npy(spark, path))
    at = _deepmd_prefix(path)
    if at is None:
        return Results(s, None, None, ["energy", "force", "virial"])
    folder, stem = at
    force = next((f for f in (f"{stem}.fr.out", f"{stem}.f.out") if os.path.exists(os.path.join(folder, f))), f"{stem}.f.out")
    files = {"energy": f"{stem}.e_peratom.out", "force": force, "mforce": f"{stem}.fm.out"}
    metrics, missing = _collect(spark, s, {d: os.path.join(folder, f) for d, f in files.items()}, prediction_first=False)
    virial = os.path.join(folder, f"{stem}.v_peratom.out")
    if os.path.exists(virial):
        # nine components, of which the six of the upper triangle are kept
        rows = _rows(spark, virial, s, "structure")
        six = _paired(rows, "virial", 9, False, [0, 4, 8, 1, 5, 6])
        metrics = six if metrics is None else metrics.unionByName(six)
    else:
        missing.append("virial")
    return Results(s, metrics, _descriptors(spark, os.path.join(folder, "descriptor.out"), s), missing)


def load_predictions(spark: SparkSession, path: str) -> Results:
    """Predictions inside the frames: ``TACE_energy`` and the like against the frame's own labels.

    Magnetic forces count only if every frame has both sides.
    """
    s = with_ids(read_extxyz(spark, path))
    text = lambda k: F.try_element_at("extra", F.lit(k))
    vector = lambda k: F.transform(F.filter(F.split(F.trim(text(k)), r"\s+"), lambda t: t != ""), lambda t: t.cast("double"))
    n = F.size("species")
    one = s.select(F.lit("energy").alias("dataset"), "structure_id", F.lit(0).alias("row_no"), F.array(text("TACE_energy").cast("double") / n).alias("pred"), F.array(F.col("energy") / n).alias("ref"))
    from framelake.functions.structure import virial_per_atom  # noqa: PLC0415

    virial = s.select(F.lit("virial").alias("dataset"), "structure_id", F.lit(0).alias("row_no"), virial_per_atom(vector("TACE_virials"), n).alias("pred"), virial_per_atom(F.col("virial"), n).alias("ref"))

    def atoms(name: str, pred: Column, ref: Column) -> DataFrame:
        zipped = F.posexplode(F.arrays_zip(pred.alias("p"), ref.alias("r")))
        return s.select("structure_id", zipped.alias("row_no", "z")).select(F.lit(name).alias("dataset"), "structure_id", "row_no", F.col("z.p").alias("pred"), F.col("z.r").alias("ref"))

    prop = lambda k: F.try_element_at("props", F.lit(k))
    parts = [one, virial, atoms("force", prop("TACE_forces"), F.col("forces"))]
    magnetic = prop("TACE_noncollinear_magnetic_forces")
    if s.agg(F.coalesce(F.bool_and(magnetic.isNotNull() & F.col("force_mag").isNotNull()), F.lit(False))).first()[0]:
        parts.append(atoms("mforce", magnetic, F.col("force_mag")))
    metrics = reduce(DataFrame.unionByName, parts).where("pred[0] IS NOT NULL OR ref[0] IS NOT NULL")
    folder, stem = _base(path)
    return Results(s, metrics, _descriptors(spark, os.path.join(folder, f"descriptor_tace_{stem}.out"), s))


def _has_predictions(path: str) -> bool:
    if not (path.endswith((".xyz", ".extxyz")) and os.path.isfile(path)):
        return False
    with open(path, encoding="utf-8") as f:
        f.readline()
        return "TACE_" in f.readline()


def _is_xyz(path: str, kinds: tuple) -> bool:
    return path.endswith((".xyz", ".extxyz")) and model_kind(os.path.dirname(path)) in kinds


def _is_npy(path: str) -> bool:
    return os.path.isdir(path) and any("type.raw" in files for _, _, files in os.walk(path))


register_loader(Loader("deepmd", _is_npy, load_deepmd))
register_loader(Loader("predictions", _has_predictions, load_predictions))
register_loader(Loader("training", lambda p: _is_xyz(p, (0, 3)), load_training))
register_loader(Loader("dipole", lambda p: _is_xyz(p, (1,)), load_dipole))
register_loader(Loader("polarizability", lambda p: _is_xyz(p, (2,)), load_polarizability))


def write_predictions(metrics: DataFrame, folder: str, fingerprint: str) -> None:
    """Metrics as Parquet by dataset, with a manifest that names what they were computed from."""
    metrics.write.mode("overwrite").partitionBy("dataset").parquet(f"{folder}/metrics")
    counts = {r["dataset"]: r["count"] for r in metrics.groupBy("dataset").count().collect()}
    spark = metrics.sparkSession
    spark.createDataFrame([(json.dumps({"fingerprint": fingerprint, "rows": counts}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")


def read_predictions(spark: SparkSession, folder: str, fingerprint: str) -> DataFrame:
    """Metrics written before; another fingerprint is an error."""
    manifest = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
    if manifest["fingerprint"] != fingerprint:
        raise FormatError("the predictions belong to other data")
    return spark.read.parquet(f"{folder}/metrics")
