"""Exports by scope, descriptor tables, the evidence cache and the audit report."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators.selection import State
from framelake.sources.formats import FormatError
from framelake.sources.npy import write_npy
from framelake.sources.structures import write_extxyz


def export(state: State, path: str, scope: str = "active", format: str = "extxyz", ids: DataFrame | None = None) -> int:
    """Write the structures of a scope (active, selected, removed, custom) and return their number."""
    rows = state.inactive() if scope == "removed" else state.base.join(state.scope(scope, ids), "structure_id", "left_semi")
    if format == "extxyz":
        write_extxyz(rows, path)
    elif format == "npy":
        write_npy(rows, path)
    else:
        raise FormatError(f"unknown format {format}")
    return rows.count()


def _short(x: Column) -> Column:
    """Six significant digits without trailing zeros."""
    text = F.regexp_replace(F.format_string("%.6g", x), r"(\.\d*?)0+(?=e|$)", "$1")
    return F.when(x.isNotNull(), F.regexp_replace(text, r"\.(?=e|$)", ""))


def export_descriptors(descriptors: DataFrame, ids: DataFrame, path: str, energies: DataFrame | None = None) -> None:
    """Tab-separated vectors of chosen structures with six digits, the energy at the end if given."""
    rows = descriptors.join(ids.select("structure_id").distinct(), "structure_id", "left_semi")
    parts = F.transform("vec", lambda x: _short(x.cast("double")))
    if energies is not None:
        rows = rows.join(energies.select("structure_id", "energy"), "structure_id", "left")
        parts = F.concat(parts, F.array(F.coalesce(_short(F.col("energy")), F.lit(""))))
    rows.orderBy("structure_id").select(F.array_join(parts, "\t").alias("value")).write.text(path)


def write_evidence(evidence: DataFrame, path: str, fingerprints: dict[str, str]) -> None:
    """Evidence as compressed JSON lines under its fingerprints' digest."""
    spark = evidence.sparkSession
    header = json.dumps(fingerprints, sort_keys=True)
    evidence.write.mode("overwrite").option("compression", "gzip").json(f"{path}/records")
    spark.createDataFrame([(header, evidence.schema.json())], "fingerprints string, fields string").coalesce(1).write.mode("overwrite").json(f"{path}/header")


def read_evidence(spark: SparkSession, path: str, fingerprints: dict[str, str]) -> DataFrame | None:
    """The cached evidence, or None if it was computed from anything else."""
    from pyspark.sql.types import StructType  # noqa: PLC0415

    head = spark.read.json(f"{path}/header").first()
    if head is None or json.loads(head["fingerprints"]) != fingerprints:
        return None
    return spark.read.schema(StructType.fromJson(json.loads(head["fields"]))).json(f"{path}/records")


def _table(df: DataFrame, title: str, rows: int) -> str:
    cells = [r.asDict() for r in df.limit(rows).collect()]
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else f'{v:.6g}' if isinstance(v, float) else str(v))}</td>" for v in r.values()) + "</tr>" for r in cells)
    return f"<section><h2>{html.escape(title)}</h2><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table></section>"


def report(tables: dict[str, DataFrame], title: str = "Dataset audit", rows: int = 200) -> str:
    """An HTML page with the first ``rows`` rows of each result table."""
    parts = "".join(_table(df, name, rows) for name, df in tables.items())
    style = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 8px;text-align:left}"
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1>{parts}</body></html>"
