"""Dataset operations: farthest-point and geometry filters as steps of a pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions import structure as S
from framelake.generators.base import operation
from framelake.operators.quality import GeometryLimits, geometry_filter
from framelake.operators.vectors import balanced_points, farthest_points


@operation("geometry_filter", kind="dataset", min_pair_distance=0.0, min_volume_per_atom=0.0, max_volume_per_atom=0.0, min_density=0.0, max_density=0.0, require_cell=True)
def filter_geometry(df: DataFrame, p: dict) -> DataFrame:
    """Structures that pass the geometry filter."""
    return geometry_filter(df, GeometryLimits(**p))


def composition_descriptor(df: DataFrame, elements: list[str]) -> DataFrame:
    """Shares of the elements as a vector, for when no descriptor column is given."""
    n = F.size("species")
    return df.withColumn("descriptor", F.array(*((F.size(F.filter("species", lambda s: s == F.lit(e))) / n) for e in elements)))  # noqa: B023 - used at once


@operation("fps_filter", kind="dataset", count=100, min_distance=0.0, strategy="global", descriptor="descriptor", existing=None)
def filter_farthest(df: DataFrame, p: dict) -> DataFrame:
    """A varied subset by farthest points over descriptors, of all structures or balanced by element set; ``existing`` warms it."""
    if p["descriptor"] not in df.columns:
        elements = sorted(r[0] for r in df.select(F.explode("species")).distinct().collect())
        df = composition_descriptor(df, elements)
    keyed = df.withColumn("_k", F.xxhash64("structure_id", "variant") if "variant" in df.columns else F.col("structure_id"))
    if p["strategy"] == "element_set":
        rows = keyed.withColumn("_g", S.element_set_key(F.col("species")))
        existing = p["existing"]
        warm = None if existing is None else existing.withColumn("_g", S.element_set_key(F.col("species")))
        keys = balanced_points(rows, "_k", p["descriptor"], "_g", p["count"], p["min_distance"], selected=warm).select("_k")
    else:
        ids = farthest_points(keyed, "_k", p["descriptor"], p["count"], p["min_distance"], selected=p["existing"])
        keys = df.sparkSession.createDataFrame([(i,) for i in ids], "_k bigint")
    return keyed.join(keys, "_k", "left_semi").drop("_k")
