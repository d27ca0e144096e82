"""DeepMD folders of numpy arrays: systems of equal atoms with one array per property and set."""

from __future__ import annotations

import io
import os
import re
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.sources.formats import EMPTY, FormatError
from framelake.sources.structures import _KINDS, _NAMES, STRUCTURES

#: Arrays of a set and the shape of one frame, by number of atoms.
_SHAPES = {"box": lambda n: (3, 3), "coord": lambda n: (n, 3), "energy": lambda n: (), "force": lambda n: (n, 3), "virial": lambda n: (9,), "spin": lambda n: (n, 3), "force_mag": lambda n: (n, 3), "real_atom_types": lambda n: (n,)}


def frames_of(files: dict[str, bytes], config_type: str) -> Iterator[dict]:
    """Frames of one system from its files by relative name; all sets in order of name."""
    if "type.raw" not in files:
        return
    types = np.array(files["type.raw"].decode().split(), int)
    names = files["type_map.raw"].decode().split() if "type_map.raw" in files else [f"X{i}" for i in range(int(types.max(initial=0)) + 1)]
    if types.max(initial=0) >= len(names):
        raise FormatError(f"{config_type}: a type without a name")
    n, periodic = len(types), "nopbc" not in files
    for folder in sorted({k.split("/")[0] for k in files if "/" in k and k.split("/")[0].startswith("set.")}):
        arrays = {}
        for key, shape in _SHAPES.items():
            data = files.get(f"{folder}/{key}.npy")
            if data is not None:
                a = np.load(io.BytesIO(data))
                arrays[key] = a.reshape(len(a), *shape(n))
        if "coord" not in arrays or (periodic and "box" not in arrays):
            raise FormatError(f"{config_type}/{folder}: no coordinates or boxes")
        count = len(arrays["coord"])
        if any(len(a) != count for a in arrays.values()):
            raise FormatError(f"{config_type}/{folder}: arrays of different numbers of frames")
        for i in range(count):
            kinds = arrays["real_atom_types"][i].astype(int) if "real_atom_types" in arrays else types
            keep = kinds >= 0  # mixed systems are padded
            pick = lambda k: arrays[k][i][keep].tolist() if k in arrays else None  # noqa: B023, E731
            yield {
                **EMPTY, "natoms": int(keep.sum()), "species": [names[t] for t in kinds[keep]], "pos": pick("coord"), "forces": pick("force"), "spin": pick("spin"), "force_mag": pick("force_mag"),
                "lattice": arrays["box"][i].tolist() if "box" in arrays else None, "pbc": [periodic] * 3, "energy": float(arrays["energy"][i]) if "energy" in arrays else None,
                "virial": arrays["virial"][i].tolist() if "virial" in arrays else None, "config_type": config_type,
            }


def read_npy(spark: SparkSession, path: str, order: list[str] | None = None) -> DataFrame:
    """Frames of all systems below ``path``; the config type is the folder's relative name; one task per system.

    ``order`` lists systems that come first, in that order (column ``source`` is then prefixed by its place).
    """
    root = path.rstrip("/").removeprefix("file://")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    parts = r"^(?:(.*)/)?((?:set[.][^/]*/)?[^/]+)$"
    name = F.regexp_extract("path", rf"{re.escape(root)}/(.*)$", 1)
    # the folder is as short as it can be without its set
    named = files.select(F.regexp_replace(name, r"/(set[.][^/]*/[^/]+)$", "//$1").alias("n"), "content")
    split = F.when(F.col("n").contains("//"), F.split("n", "//")).otherwise(F.array(F.regexp_extract("n", parts, 1), F.regexp_extract("n", r"([^/]+)$", 1)))
    # a system at the root has no folder before its set
    rows = named.select(F.when(F.col("n").rlike(r"^set[.][^/]*/[^/]+$"), F.array(F.lit(""), F.col("n"))).otherwise(split).alias("s"), "content").select(F.col("s")[0].alias("system"), F.col("s")[1].alias("file"), "content")
    places = {s: k for k, s in enumerate(order or [])}

    def run(key: tuple, t: pa.Table) -> pa.Table:
        system = key[0].as_py()
        label = system or os.path.basename(root)
        source = f"{places[system]:08d}:{label}" if system in places else label
        held = [{"source": source, "frame": i, **f} for i, f in enumerate(frames_of(dict(zip(t["file"].to_pylist(), t["content"].to_pylist())), label))]
        return pa.table([pa.array([h[n] for h in held], k) for n, k in zip(_NAMES, _KINDS)], _NAMES)

    return rows.groupBy("system").applyInArrow(run, STRUCTURES)


def write_npy(df: DataFrame, folder: str, hierarchy: bool = True, set_size: int = 5000) -> DataFrame:
    """Write one system per config type, atoms sorted by type, and return ``config_type, frames``.

    Frames of a system must agree in atoms, periodicity and the labels they have; otherwise nothing is written.
    The new folder replaces the old one at the end.
    """
    tag = F.coalesce(F.nullif(F.trim("config_type"), F.lit("")), F.lit("default"))
    safe = F.regexp_replace(tag, r"[^\w.\-/]+" if hierarchy else r"[^\w.\-]+", "_")
    safe = F.regexp_replace(safe, r"(^|/)\.+(?=/|$)", "$1_")
    columns = [c for c in ("forces", "virial", "energy", "spin", "force_mag") if c in df.columns]
    contract = F.to_json(F.struct(F.array_sort("species").alias("s"), F.col("pbc").alias("p"), *(F.col(c).isNotNull().alias(c) for c in columns)))
    rows = df.select(safe.alias("system"), contract.alias("contract"), "species", "pos", "lattice", "pbc", *columns, *(["structure_id"] if "structure_id" in df.columns else []))
    bad = [r[0] for r in rows.groupBy("system").agg(F.count_distinct("contract").alias("n")).where("n > 1").orderBy("system").limit(20).collect()]
    if bad:
        raise FormatError(f"frames of {bad} differ in atoms, periodicity or labels")
    stage = f"{folder.rstrip('/')}.part-{uuid.uuid4().hex}"

    # a set is one task, so a system of any size is written by many
    sizes = rows.groupBy("system").agg(F.ceil(F.count("*") / set_size).alias("sets"))
    salt = F.xxhash64("structure_id") if "structure_id" in df.columns else F.xxhash64(F.to_json(F.struct("pos", "species")))
    rows = rows.join(sizes, "system").withColumn("set", F.pmod(salt, F.col("sets")).cast("int")).drop("sets", "contract")

    def write(g: pd.DataFrame) -> pd.DataFrame:
        system = g["system"].iloc[0]
        if "structure_id" in g:
            g = g.sort_values("structure_id")
        where = os.path.join(stage, system)
        names = sorted(set(g["species"].iloc[0]))
        os.makedirs(where, exist_ok=True)
        order = [sorted(range(len(s)), key=lambda i, s=s: (names.index(s[i]), i)) for s in g["species"]]
        types = [names.index(g["species"].iloc[0][i]) for i in order[0]]
        for file, lines in (("type.raw", types), ("type_map.raw", names)):  # the same from every set
            part = os.path.join(where, f"{file}.{g['set'].iloc[0]}")
            with open(part, "w", encoding="utf-8") as f:
                f.write("\n".join(map(str, lines)) + "\n")
            os.replace(part, os.path.join(where, file))
        periodic = bool(all(g["pbc"].iloc[0]))
        if not periodic:
            open(os.path.join(where, "nopbc"), "w").close()
        stack = lambda v: np.array([[np.asarray(x, float) for x in row] for row in v])
        per_atom = {"coord": "pos", "force": "forces", "spin": "spin", "force_mag": "force_mag"}
        arrays = {k: np.array([stack([v])[0][o] for v, o in zip(g[c], order)]).reshape(len(g), -1) for k, c in per_atom.items() if c in g and g[c].iloc[0] is not None}
        if g["lattice"].iloc[0] is not None:
            arrays["box"] = stack(g["lattice"]).reshape(len(g), 9)
        if "energy" in g and pd.notna(g["energy"].iloc[0]):
            arrays["energy"] = g["energy"].to_numpy(float)
        if "virial" in g and g["virial"].iloc[0] is not None:
            v = np.array([np.asarray(x, float) for x in g["virial"]])
            arrays["virial"] = v if v.shape[1] == 9 else v[:, [0, 3, 5, 3, 1, 4, 5, 4, 2]]
        part = os.path.join(where, f"set.{g['set'].iloc[0]:03d}")
        os.makedirs(part, exist_ok=True)  # a task that is run again writes the same
        for k, a in arrays.items():
            np.save(os.path.join(part, f"{k}.npy"), a)
        return pd.DataFrame({"config_type": [system], "frames": [len(g)]})

    try:
        written = rows.groupBy("system", "set").applyInPandas(write, "config_type string, frames bigint").groupBy("config_type").agg(F.sum("frames").alias("frames")).collect()
        old = f"{stage}.old"
        if os.path.exists(folder):
            os.replace(folder, old)
        try:
            os.replace(stage, folder)
        except OSError:
            if os.path.exists(old):
                os.replace(old, folder)
            raise
        shutil.rmtree(old, ignore_errors=True)
    finally:
        shutil.rmtree(stage, ignore_errors=True)
    return df.sparkSession.createDataFrame([tuple(r) for r in written], "config_type string, frames bigint")
