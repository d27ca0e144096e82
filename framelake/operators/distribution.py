"""Distributions of paired fields: series by formula, element, value view or own groups; histograms, statistics, curves, bins to ids.

``metrics`` has ``dataset, structure_id, row_no, pred, ref`` (arrays of a dataset's
components; ``pred`` null for a field without predictions), ``structures`` has
``structure_id, formula, species`` and what custom groups need.  Samples are one
narrow row per component and series; everything after is an aggregate.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import structure as S

VIEWS = {"reference": "ref", "prediction": "pred", "error": "err"}
SKIPPED = ("species", "species_id", "pos")


@dataclass(frozen=True)
class Request:
    """What to show; numbers are brought into their bounds."""

    fields: tuple[str, ...] = ()
    include_norm: bool = True
    view: str = "reference"
    group: str = "formula"  # formula, element, value_view, custom
    bins: int = 120
    series: tuple[str, ...] = ()
    curve: str = "kde"  # none, kde, normal
    points: int = 240
    views: tuple[str, ...] = ()
    custom: dict[str, Column] = field(default_factory=dict)

    def __post_init__(self) -> None:
        object.__setattr__(self, "bins", min(5000, max(2, int(self.bins or 120))))
        object.__setattr__(self, "points", min(1024, max(64, int(self.points or 240))))
        object.__setattr__(self, "views", tuple(v for v in self.views if v in VIEWS))


def discover(metrics: DataFrame) -> DataFrame:
    """``dataset, components, shape, paired`` of fields whose number of components is the same in every row."""
    size = F.size(F.coalesce("ref", "pred"))
    found = metrics.where(~F.col("dataset").isin(*SKIPPED)).groupBy("dataset").agg(F.min(size).alias("lo"), F.max(size).alias("hi"), F.max(F.col("pred").isNotNull() & F.col("ref").isNotNull()).alias("paired"))
    shape = F.when(F.col("lo") == 1, "scalar").when(F.col("lo") == 3, "vector3").otherwise("vectorn")
    return found.where("lo = hi AND lo > 0").select("dataset", F.col("lo").alias("components"), shape.alias("shape"), "paired")


def atomic_metrics(frames: DataFrame, columns: list[str], key: str = "structure_id") -> DataFrame:
    """Numeric per-atom columns as metrics without predictions; a number counts as one component."""
    kinds = dict(frames.dtypes)
    parts = []
    for c in columns:
        if c in SKIPPED:
            continue
        value = F.transform(c, lambda v: F.array(v.cast("double"))) if kinds[c].count("array") == 1 else F.col(c).cast("array<array<double>>")
        parts.append(F.struct(F.lit(f"atomic:{c}").alias("dataset"), value.alias("rows")))
    long = frames.select(F.col(key).alias("structure_id"), F.explode(F.array(*parts)).alias("p")).select("structure_id", "p.dataset", F.posexplode("p.rows").alias("row_no", "ref"))
    return long.select("dataset", "structure_id", "row_no", F.lit(None).cast("array<double>").alias("pred"), "ref")


def _components(metrics: DataFrame, request: Request) -> DataFrame:
    """``dataset, structure_id, row_no, view, part, v``."""
    wanted = request.views if request.group in ("value_view", "custom") and request.views else (("reference",) if request.group == "value_view" else (request.view,))
    paired = F.col("pred").isNotNull() & F.col("ref").isNotNull()
    # a field without a pair shows what it has under the first view only
    views = [F.when(paired, F.struct(F.lit(v).alias("view"), S.view(F.col("pred"), F.col("ref"), VIEWS[v]).alias("value"))) for v in wanted]
    views.append(F.when(~paired, F.struct(F.lit("reference").alias("view"), F.coalesce("ref", "pred").alias("value"))))
    rows = metrics.select("dataset", "structure_id", "row_no", F.explode(F.array_compact(F.array(*views))).alias("s")).select("dataset", "structure_id", "row_no", "s.*")
    size = F.size("value")
    names = F.when(size == 1, F.array(F.lit("value")))
    for n in (3, 6):
        names = names.when(size == n, F.array(*map(F.lit, S.component_names(n))))
    names = names.otherwise(F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda i: F.concat(F.lit("c"), i.cast("string"))))
    parts = F.arrays_zip(names.alias("part"), F.col("value").cast("array<double>").alias("v"))
    if request.include_norm:
        whole = F.array(F.struct(F.lit("norm").alias("part"), S.norm(F.col("value").cast("array<double>")).alias("v")))
        parts = F.when(size > 1, F.concat(parts, whole)).otherwise(parts)
    rows = rows.select("dataset", "structure_id", "row_no", "view", F.explode(parts).alias("p"))
    good = ~F.isnan("p.v") & (F.abs("p.v") < float("inf"))
    return rows.select("dataset", "structure_id", "row_no", "view", "p.part", "p.v").where(good)


def samples(metrics: DataFrame, structures: DataFrame, request: Request) -> DataFrame:
    """``metric, series, structure_id, v``: one row per finite value and series it belongs to.

    By element, rows of an atom-wise field take their atom's element; if a dataset's
    rows are not one per atom everywhere, each row stands for every element of its structure.
    """
    fields = request.fields
    if fields:
        chosen = metrics.where(F.col("dataset").isin(*fields))
        metrics = chosen if chosen.limit(1).count() else metrics.where(F.col("dataset") == F.lit(metrics.agg(F.min("dataset")).first()[0]))
    rows = _components(metrics, request).withColumn("metric", F.concat_ws("|", "dataset", "part"))
    if request.group == "value_view":
        out = rows.join(structures.select("structure_id"), "structure_id", "left_semi").withColumn("series", F.col("view"))
    elif request.group == "formula":
        out = rows.join(structures.select("structure_id", F.col("formula").alias("series")), "structure_id")
    elif request.group == "element":
        counts = metrics.groupBy("dataset", "structure_id").agg(F.count("*").alias("n")).join(structures.select("structure_id", F.size("species").alias("atoms")), "structure_id")
        atomwise = counts.groupBy("dataset").agg((F.min(F.col("n") == F.col("atoms")) & (F.max("n") > 1)).alias("atomwise"))
        out = rows.join(F.broadcast(atomwise), "dataset").join(structures.select("structure_id", "species"), "structure_id")  # one row per field
        series = F.when(F.col("atomwise"), F.array(F.get("species", F.col("row_no")))).otherwise(S.elements(F.col("species")))
        out = out.withColumn("series", F.explode(series))
    else:
        labels = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in request.custom.items()))) if request.custom else F.array().cast("array<string>")
        held = structures.select("structure_id", labels.alias("labels")).where(F.size("labels") > 0)
        out = rows.join(held, "structure_id")
        out = out.withColumn("series", F.col("view")) if request.views else out.withColumn("series", F.explode("labels"))
    out = out.where(F.trim("series") != "")
    if request.series:
        out = out.where(F.col("series").isin(*request.series))
    return out.select("metric", F.trim("series").alias("series"), "structure_id", "v")


def ranges(rows: DataFrame) -> DataFrame:
    """``metric, lo, hi`` over all series; a range of no width is widened a little."""
    span = rows.groupBy("metric").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    pad = F.when(F.col("hi") > F.col("lo"), 0.0).otherwise(F.greatest(F.lit(1e-12), F.abs("lo") * 1e-9 + 1e-12))
    return span.select("metric", (F.col("lo") - pad).alias("lo"), (F.col("hi") + pad).alias("hi"))


def binned(rows: DataFrame, bins: int) -> DataFrame:
    """``rows`` with ``lo, hi, bin``; the last bin holds its upper end."""
    # one row per metric
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.least(F.greatest(F.floor((F.col("v") - F.col("lo")) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    return rows.join(F.broadcast(ranges(rows)), "metric").withColumn("bin", place)


def histogram(rows: DataFrame, bins: int) -> DataFrame:
    """``metric, series, bin, n``."""
    return binned(rows, bins).groupBy("metric", "series", "bin").agg(F.count("*").alias("n"))


def bin_ids(rows: DataFrame, bins: int) -> DataFrame:
    """``metric, series, bin, ids``: the structures behind every bin."""
    return binned(rows, bins).groupBy("metric", "series", "bin").agg(F.array_sort(F.collect_set("structure_id")).alias("ids"))


def pick_bin(rows: DataFrame, bins: int, metric: str, series: str, bin_no: int) -> DataFrame:
    """Ids of one bin, in order; numbers beyond the ends mean the end bins."""
    at = min(max(bin_no, 0), bins - 1)
    return binned(rows, bins).where((F.col("metric") == metric) & (F.col("series") == series) & (F.col("bin") == at)).select("structure_id").distinct().orderBy("structure_id")


def statistics(rows: DataFrame) -> DataFrame:
    """``metric, series, total, min, max, mean, std`` (of the population)."""
    return rows.groupBy("metric", "series").agg(F.count("*").alias("total"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def curves(rows: DataFrame, request: Request) -> DataFrame:
    """``metric, series, point, x, y`` of a normal or kernel density, scaled to counts per bin.

    The kernel density has Scott's bandwidth and takes every value: values are first
    counted on a grid of a sixteenth of the bandwidth, so that a point costs as many
    terms as the grid has cells in reach, whatever the number of values (relative
    error under 0.001).  Series of fewer than two values or without spread have no curve.
    """
    if request.curve == "none":
        return rows.sparkSession.createDataFrame([], "metric string, series string, point int, x double, y double")
    stats = rows.groupBy("metric", "series").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.stddev_samp("v").alias("sd"))
    stats = stats.where("n >= 2 AND std > 1e-15").join(F.broadcast(ranges(rows)), "metric")
    step = (F.col("hi") - F.col("lo")) / (request.points - 1)
    grid = F.explode(F.sequence(F.lit(0), F.lit(request.points - 1)))
    at = stats.withColumn("point", grid).withColumn("x", F.col("lo") + F.col("point") * step)
    scale = F.col("n") * (F.col("hi") - F.col("lo")) / request.bins
    if request.curve == "normal":
        z = (F.col("x") - F.col("mean")) / F.col("std")
        y = F.exp(-0.5 * z * z) / (F.col("std") * math.sqrt(2 * math.pi)) * scale
        return at.select("metric", "series", "point", "x", y.alias("y"))
    h = F.col("sd") * F.pow("n", F.lit(-0.2))
    cell = h / 16
    held = rows.join(stats.select("metric", "series", h.alias("h")), ["metric", "series"])
    counts = held.groupBy("metric", "series", F.floor(F.col("v") / (F.col("h") / 16)).alias("c")).agg(F.count("*").alias("k"), F.avg("v").alias("v"), F.first("h").alias("h"))
    # a cell reaches the points within eight bandwidths
    reach = F.col("h") * 8
    near = counts.join(stats.select("metric", "series", "lo", "hi", "n"), ["metric", "series"])
    first = F.greatest(F.ceil((F.col("v") - reach - F.col("lo")) / step), F.lit(0))
    last = F.least(F.floor((F.col("v") + reach - F.col("lo")) / step), F.lit(request.points - 1))
    spread = near.where(first <= last).withColumn("point", F.explode(F.sequence(first, last)))
    x = F.col("lo") + F.col("point") * step
    z = (x - F.col("v")) / F.col("h")
    dense = spread.groupBy("metric", "series", "point").agg(F.sum(F.col("k") * F.exp(-0.5 * z * z) / (F.col("h") * math.sqrt(2 * math.pi))).alias("d"))
    out = at.join(dense.withColumn("point", F.col("point").cast("int")), ["metric", "series", "point"], "left")
    return out.select("metric", "series", "point", "x", (F.coalesce("d", F.lit(0.0)) * (F.col("hi") - F.col("lo")) / request.bins).alias("y"))
