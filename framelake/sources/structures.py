"""Readers and writers of structure files, with a registry of formats.

Extended XYZ, LAMMPS dumps and n2p2 files are split at their frames: lines are
read in blocks, each block's frames are counted, and a frame that lies on a
block's border is put together from both, so that one file of any size is read
by many tasks.  Other formats carry state from frame to frame and are one task a
file (a file must then fit into a row of 2 GB).
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.sources import formats
from framelake.sources.formats import FormatError
from framelake.sources.tables import numbered_lines, read_out  # noqa: F401 - also read from here

STRUCTURES = (
    "source string, frame bigint, natoms int, species array<string>, pos array<array<double>>, forces array<array<double>>, spin array<array<double>>, force_mag array<array<double>>, "
    "props map<string,array<array<double>>>, labels map<string,array<string>>, lattice array<array<double>>, pbc array<boolean>, energy double, virial array<double>, stress array<double>, "
    "config_type string, extra map<string,string>"
)
_NAMES = [c.split()[0] for c in STRUCTURES.split(", ")]
_VEC = pa.list_(pa.list_(pa.float64()))
_NUM = pa.list_(pa.float64())
_KINDS = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string()), _VEC, _VEC, _VEC, _VEC, pa.map_(pa.string(), _VEC), pa.map_(pa.string(), pa.list_(pa.string())), _VEC, pa.list_(pa.bool_()), pa.float64(), _NUM, _NUM, pa.string(), pa.map_(pa.string(), pa.string())]


@dataclass(frozen=True)
class Format:
    """A structure format: its parser, the line that begins a frame (None: not splittable) and the file names it takes."""

    name: str
    parse: Callable[..., Iterator[dict]]
    names: tuple[str, ...]
    start: str | None = None


FORMATS: list[Format] = []


def register_format(f: Format) -> None:
    """Add a format; earlier ones are tried first."""
    if any(g.name == f.name for g in FORMATS):
        raise ValueError(f"{f.name} is registered already")
    FORMATS.append(f)


for _f in (
    Format("extxyz", formats.extxyz, (".xyz", ".extxyz"), r"^\s*\d+\s*$"), Format("xdatcar", formats.xdatcar, ("XDATCAR",)), Format("outcar", formats.outcar, ("OUTCAR",)),
    Format("lammps", formats.lammps, (".dump", ".lammpstrj"), r"^ITEM: TIMESTEP"), Format("n2p2", formats.n2p2, ("input.data",), r"^\s*begin\b"), Format("cp2k", formats.cp2k, (".out", ".log")),
):
    register_format(_f)


def format_of(path: str) -> Format:
    """The first format that takes a file of this name."""
    base = os.path.basename(path.rstrip("/"))
    for f in FORMATS:
        if any(base.lower().endswith(n) if n.startswith(".") else n in base for n in f.names):
            return f
    raise FormatError(f"no format takes {base}")


def _batches(texts: Iterator[tuple[str, int, str]], parse: Callable) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    batch = lambda: pa.RecordBatch.from_arrays([pa.array([h[n] for h in held], k) for n, k in zip(_NAMES, _KINDS)], _NAMES)
    for source, first, text in texts:
        for i, frame in enumerate(parse(iter(text.splitlines()))):
            held.append({"source": source, "frame": first + i, **frame})
            if len(held) == 256:
                yield batch()
                held = []
    if held:
        yield batch()


def frame_texts(lines: DataFrame, start: str) -> DataFrame:
    """``source, frame, value``: the text of every frame; blank files and blank heads give none."""
    begins = F.col("value").rlike(start).cast("int")
    local = F.sum(begins).over(Window.partitionBy("source", "block").orderBy("seq"))
    counts = lines.groupBy("source", "block").agg(F.sum(begins).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("source", "block", before.alias("before"))  # one row per block of a file
    # lines before a block's first start continue the last frame of the blocks before
    rows = lines.withColumn("local", local).join(offsets, ["source", "block"]).withColumn("frame", F.col("local") + F.col("before") - 1)
    odd = F.col("frame") < 0
    rows = rows.where(~(odd & (F.trim("value") == "")))
    parts = rows.groupBy("source", "frame").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "value"))).alias("l"))
    return parts.select("source", "frame", F.array_join(F.transform("l", lambda x: x["value"]), "\n").alias("value"))


def read_structures(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """One row per frame of all files under ``path``; frames are numbered within their file."""
    f = next((g for g in FORMATS if g.name == format), None) if format else format_of(path)
    if f is None:
        raise FormatError(f"unknown format {format}")
    parse = (lambda lines: f.parse(lines, **options)) if options else f.parse

    if f.start is None:
        whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.lit(0).cast("bigint").alias("frame"), "value").where(F.trim("value") != "")
    else:
        whole = frame_texts(numbered_lines(spark, path), f.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(((s, i, t) for b in batches for s, i, t in zip(b["source"].to_pylist(), b["frame"].to_pylist(), b["value"].to_pylist())), parse)

    return whole.mapInArrow(run, STRUCTURES)


def import_structures(spark: SparkSession, path: str, **options) -> DataFrame:
    """Try the formats that take the file's name in order, then all others; the first that gives a frame wins, all errors are reported."""
    errors = []
    named = [f for f in FORMATS if any(os.path.basename(path).lower().endswith(n) if n.startswith(".") else n in os.path.basename(path) for n in f.names)]
    if not spark.read.text(path).where(F.trim("value") != "").limit(1).count():
        return spark.createDataFrame([], STRUCTURES)
    for f in [*named, *(g for g in FORMATS if g not in named)]:
        try:
            df = read_structures(spark, path, f.name, **options)
            if df.limit(1).count():
                return df
            errors.append(f"{f.name}: no frame")
        except Exception as e:  # noqa: BLE001 - every format's reason is part of the message
            errors.append(f"{f.name}: {str(e).strip().splitlines()[-1][:200]}")
    raise FormatError("; ".join(errors))


def read_extxyz(spark: SparkSession, path: str) -> DataFrame:
    """Frames of all extended XYZ files under ``path``."""
    return read_structures(spark, path, "extxyz")


def read_lammps(spark: SparkSession, path: str, elements: dict[int, str] | None = None) -> DataFrame:
    """Frames of all LAMMPS dumps under ``path``."""
    return read_structures(spark, path, "lammps", elements=elements)


def with_ids(df: DataFrame) -> DataFrame:
    """``df`` with ``structure_id`` in order of file and frame."""
    counts = df.groupBy("source").agg((F.max("frame") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per file
    return df.join(counts.select("source", before.alias("before")), "source").withColumn("structure_id", F.col("before") + F.col("frame")).drop("before")


def extxyz_text(df: DataFrame, digits: int | None = None) -> DataFrame:
    """``value``: each row as extended XYZ; ``digits`` rounds per-atom numbers, numbers of a frame keep all digits."""
    full = lambda x: x.cast("string")
    atom = full if digits is None else lambda x: F.format_string(f"%.{digits}f", x)
    row = lambda v, f=full: F.array_join(F.transform(v, f), " ")
    has = lambda c: F.col(c).isNotNull() if c in df.columns else F.lit(False)
    cell = F.concat(F.lit('Lattice="'), row(F.flatten("lattice")), F.lit('" '))
    vectors = [("forces", "force"), ("spin", "spin"), ("force_mag", "force_mag")]
    kind = F.concat(F.lit("Properties=species:S:1:pos:R:3"), *(F.when(has(c), f":{name}:R:3").otherwise("") for c, name in vectors))
    quoted = lambda c, name: F.when(has(c), F.concat(F.lit(f' {name}="'), row(F.col(c)) if c in ("virial", "stress") else F.col(c), F.lit('"'))) if c in df.columns else F.lit(None)
    more = [F.when(F.col("energy").isNotNull(), F.concat(F.lit(" energy="), full(F.col("energy")))), quoted("virial", "virial"), quoted("stress", "stress"), quoted("config_type", "Config_type")]
    if "extra" in df.columns:
        more.append(F.concat(F.lit(""), F.array_join(F.transform(F.map_entries("extra"), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), F.regexp_replace(e["value"], '"', r'\\"'), F.lit('"'))), "")))
    pbc = F.concat(F.lit(' pbc="'), F.array_join(F.transform("pbc", lambda b: F.when(b, "T").otherwise("F")), " "), F.lit('"'))
    head = F.concat(F.coalesce(cell, F.lit("")), kind, *(F.coalesce(m, F.lit("")) for m in more), F.coalesce(pbc, F.lit("")))
    parts = lambda i: [F.coalesce(F.concat(F.lit(" "), row(F.get(c, i), atom)), F.lit("")) for c, _ in vectors if c in df.columns]
    atoms = F.transform(F.sequence(F.lit(0), F.size("species") - 1), lambda i: F.concat(F.get("species", i), F.lit(" "), row(F.get("pos", i), atom), *parts(i)))
    body = F.when(F.size("species") > 0, F.array_join(atoms, "\n"))
    return df.select(F.concat_ws("\n", F.size("species").cast("string"), head, body).alias("value"))


def write_extxyz(df: DataFrame, path: str, digits: int | None = None, mode: str = "errorifexists") -> None:
    """Write structures as extended XYZ, one part file per partition; Spark's committer makes the folder appear as a whole."""
    extxyz_text(df, digits).write.mode(mode).text(path)


def write_single(df: DataFrame, path: str, digits: int | None = None, order: list[str] | None = None) -> None:
    """One local file in order, written beside its place and renamed, so that readers see the old or the new one."""
    text = extxyz_text(df.orderBy(*order) if order else df, digits)
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as f:
        for r in text.toLocalIterator():
            f.write(r[0] + "\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)
