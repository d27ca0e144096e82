"""Dataset audit: records, inventory of compositions, support of targets, label ranges, findings.

Audit records have ``structure_id, formula, natoms, composition`` (map of symbol
to count), ``config_type, energy_per_atom, max_force, virial_norm``.  Everything
is an aggregate with a map-side part; lists of ids are sorted arrays per group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import structure as S

COMPOSITION_EDGES = (0.05, 0.2, 0.4, 0.6, 0.8, 0.95)


def finite(c: Column) -> Column:
    """The number if it is finite, else null."""
    return F.when(~F.isnan(c.cast("double")) & (F.abs(c) < float("inf")), c.cast("double"))


def audit_records(frames: DataFrame, key: str = "structure_id") -> DataFrame:
    """One compact record per structure."""
    species = F.col("species")
    return frames.select(
        F.col(key).alias("structure_id"), S.formula(species).alias("formula"), F.size(species).alias("natoms"), S.element_counts(species).alias("composition"),
        F.coalesce("config_type", F.lit("")).alias("config_type"), S.per_atom(F.col("energy"), F.size(species)).alias("energy_per_atom"),
        S.max_norm(F.col("forces")).alias("max_force"), S.norm(F.col("virial")).alias("virial_norm"),
    )


def _gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor by Euclid's steps; 45 are enough for any 32-bit counts."""
    steps = F.sequence(F.lit(1), F.lit(45))
    pair = F.aggregate(steps, F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b"))))
    return pair["a"]


def gcd_of(values: Column) -> Column:
    """Greatest common divisor of an array of counts."""
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, v: _gcd(acc, v))


def reduced_counts(composition: Column) -> Column:
    """Sorted ``symbol:count`` pairs of a composition with the counts divided by their common divisor."""
    counts = F.array_sort(F.filter(F.map_entries(composition), lambda e: e["value"] > 0))
    g = gcd_of(F.transform(counts, lambda e: e["value"].cast("bigint")))
    return F.transform(counts, lambda e: F.struct(e["key"].alias("symbol"), (e["value"].cast("bigint") / g).cast("bigint").alias("count")))


def point_key(composition: Column) -> Column:
    """Text of the reduced composition, such as ``Fe:1|O:2``."""
    return F.array_join(F.transform(reduced_counts(composition), lambda e: F.concat_ws(":", e["symbol"], e["count"].cast("string"))), "|")


def symbols_key(species: Column) -> Column:
    """The symbols of all atoms in order, as one text: a cheap key that fixes the composition."""
    return F.array_join(F.array_sort(species), " ")


def symbols_point(key: Column) -> Column:
    """:func:`point_key` from :func:`symbols_key`; it costs far more, so sum over equal keys before."""
    return point_key(S.element_counts(F.split(key, " ")))


def _nested(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Counts of ``value`` within each point as a sorted array of structs."""
    counts = rows.where(F.col(value).isNotNull()).groupBy("point", value).agg(F.count("*").alias("n"))
    return counts.groupBy("point").agg(F.array_sort(F.collect_list(F.struct(F.col(value).alias("value"), "n"))).alias(out))


def inventory(records: DataFrame) -> DataFrame:
    """One row per exact reduced composition: counts, share, ids, atom counts, formulas, config types and how many lack one."""
    label = F.nullif(F.trim("config_type"), F.lit(""))
    rows = records.select("structure_id", "natoms", "formula", label.alias("config_type"), "composition").withColumn("point", point_key(F.col("composition")))
    whole = rows.agg(F.count("*").alias("total"))
    points = rows.groupBy("point").agg(F.count("*").alias("structures"), F.array_sort(F.collect_list("structure_id")).alias("ids"), F.count_if(F.col("config_type").isNull()).alias("missing_config_type"))
    parts = [_nested(rows, "natoms", "atom_counts"), _nested(rows, "formula", "formulas"), _nested(rows, "config_type", "config_types")]
    out = reduce(lambda a, b: a.join(b, "point", "left"), parts, points)
    return out.crossJoin(F.broadcast(whole)).withColumn("share", F.col("structures") / F.col("total")).drop("total")  # one row of totals


def composition_bins(records: DataFrame) -> DataFrame:
    """``element, bin, structures, share, sparse, severity``: every structure counts for every element, an absent one as zero."""
    total = F.map_values("composition")
    rows = records.select("structure_id", F.explode("composition").alias("element", "count"), F.aggregate(total, F.lit(0.0), lambda a, x: a + x).alias("total"))
    fraction = F.col("count") / F.col("total")
    place = reduce(lambda a, b: a + b, ((fraction >= e).cast("int") for e in COMPOSITION_EDGES))
    held = rows.groupBy("element", place.alias("bin")).agg(F.count("*").alias("n"))
    whole = records.agg(F.count("*").alias("all"))
    # structures without the element are what the others leave of the total
    absent = held.groupBy("element").agg(F.sum("n").alias("with")).crossJoin(F.broadcast(whole)).select("element", F.lit(0).alias("bin"), (F.col("all") - F.col("with")).alias("n"))
    counts = held.unionByName(absent).groupBy("element", "bin").agg(F.sum("n").alias("structures")).where("structures > 0")
    share = F.col("structures") / F.col("all")
    severity = F.when(share < 0.03, "high").when(share < 0.08, "medium").when(share < 0.10, "low")
    return counts.crossJoin(F.broadcast(whole)).select("element", "bin", "structures", share.alias("share"), (share < 0.10).alias("sparse"), severity.alias("severity"))


def config_types(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Label counts in order, the structures without a label, and the state: available, partial or unavailable."""
    label = F.nullif(F.trim("config_type"), F.lit(""))
    counts = records.select(label.alias("label")).where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")
    missing = records.where(label.isNull()).select("structure_id").orderBy("structure_id")
    n = F.count(label)
    state = records.agg(F.when(n == 0, "unavailable").when(n < F.count("*"), "partial").otherwise("available").alias("state"))
    return counts, missing, state


def target_support(records: DataFrame, element: str, points: list[float], *, low: float = 0.0, high: float = 1.0, least: int | None = None, config_types: list[str] = (), tolerance: float = 1e-8) -> DataFrame:
    """``target, config_type, status, observed, nearest, missing_config_type`` for each wanted fraction of ``element``.

    Status: supported, thin, no_sample, no_config_type, or unjudgeable (element absent, or too few labelled while others lack a label).
    """
    spark = records.sparkSession
    wanted = list(dict.fromkeys(c.strip() for c in config_types if c.strip())) or [""]
    total = F.aggregate(F.map_values("composition"), F.lit(0.0), lambda a, x: a + x)
    share = F.round(F.coalesce(F.try_element_at("composition", F.lit(element)), F.lit(0)) / total, 12)
    label = F.lower(F.nullif(F.trim("config_type"), F.lit("")))
    rows = records.select(share.alias("f"), label.alias("label"), F.coalesce(F.try_element_at("composition", F.lit(element)) > 0, F.lit(False)).alias("there"))
    if not rows.agg(F.max("there")).first()[0]:
        return spark.createDataFrame([(float(t), c, "unjudgeable", 0, None, 0) for t in points for c in wanted], "target double, config_type string, status string, observed bigint, nearest double, missing_config_type bigint")
    # one row per fraction and label, before the few targets meet them
    held = rows.where(F.col("f").between(low - tolerance, high + tolerance)).groupBy("f", "label").agg(F.count("*").alias("n"))
    targets = F.array(*(F.lit(float(t)) for t in points))
    met = held.withColumn("target", F.explode(targets)).withColumn("away", F.abs(F.col("f") - F.col("target")))
    nearest = met.groupBy("target").agg(F.min(F.struct("away", "f")).alias("near"))
    at = met.join(nearest, "target").where(F.col("f") == F.col("near.f"))
    per = [F.sum(F.when((F.col("label") == c.lower()) if c else F.lit(True), F.col("n"))).alias(f"n{i}") for i, c in enumerate(wanted)]
    sums = at.groupBy("target").agg(F.first("near").alias("near"), F.sum(F.when(F.col("label").isNull(), F.col("n")).otherwise(0)).alias("missing"), *per)
    every = spark.createDataFrame([(float(t),) for t in points], "target double").distinct().join(sums, "target", "left")
    every = every.select("target", "near", "missing", F.posexplode(F.array(*(F.coalesce(f"n{i}", F.lit(0)) for i in range(len(wanted))))).alias("i", "n"))
    hit = F.coalesce(F.col("near.away") <= tolerance, F.lit(False))
    name = F.element_at(F.array(*map(F.lit, wanted)), F.col("i") + 1)
    lacks = F.col("missing") > 0
    few = F.lit(False) if least is None else F.col("n") < least
    status = F.when(~hit, "no_sample").when((name != "") & (F.col("n") == 0), F.when(lacks, "unjudgeable").otherwise("no_config_type"))
    status = status.when(few & lacks & (name != ""), "unjudgeable").when(few, "thin").otherwise("supported")
    return every.select("target", name.alias("config_type"), status.alias("status"), F.when(hit, F.col("n")).otherwise(0).alias("observed"), F.col("near.f").alias("nearest"), F.when(hit, F.col("missing")).otherwise(0).alias("missing_config_type"))


LABELS = ("energy_per_atom", "max_force", "virial_norm")


def label_histograms(records: DataFrame, labels: tuple[str, ...] = LABELS, bins: int = 20) -> DataFrame:
    """``label, bin, low, high, structures, ids``: at most ``bins`` equal bins over each label's finite values; the last holds its upper end."""
    long = records.select("structure_id", F.explode(F.array(*(F.struct(F.lit(x).alias("label"), finite(F.col(x)).alias("v")) for x in labels))).alias("s")).select("structure_id", "s.*").where("v IS NOT NULL")
    span = long.groupBy("label").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    span = span.select("label", F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"), F.least("n", F.lit(bins)).alias("k"))
    width = (F.col("hi") - F.col("lo")) / F.col("k")
    place = F.least(F.floor((F.col("v") - F.col("lo")) / width), F.col("k") - 1).cast("int")
    rows = long.join(F.broadcast(span), "label").withColumn("bin", place)  # one row per label
    return rows.groupBy("label", "bin").agg((F.first("lo") + F.col("bin") * F.first(width)).alias("low"), (F.first("lo") + (F.col("bin") + 1) * F.first(width)).alias("high"), F.count("*").alias("structures"), F.array_sort(F.collect_list("structure_id")).alias("ids"))


def exact_quantile(df: DataFrame, column: str, q: float) -> float | None:
    """Linear-interpolated quantile without bringing values together: ranks are narrowed by counts per bin.

    Each pass counts 4,096 bins of the range that holds the two ranks wanted; it
    ends when these are so few that they can be fetched.
    """
    rows = df.select(finite(F.col(column)).alias("v")).where("v IS NOT NULL")
    n, lo, hi = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    at = q * (n - 1)
    first, second, before = int(at), min(int(at) + 1, n - 1), 0
    while True:
        inside = rows.where(F.col("v").between(lo, hi))
        width = (hi - lo) / 4096
        if width <= 0 or lo + width == lo:
            return lo
        place = F.least(F.floor((F.col("v") - lo) / width), F.lit(4095)).cast("int")
        bins = sorted(inside.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect(), key=lambda r: r["b"])
        held, taken, start = before, [], None
        for r in bins:
            if held + r["n"] > first and held <= second:
                taken.append(r)
                start = held if start is None else start
            held += r["n"]
        lo, hi, before = taken[0]["lo"], taken[-1]["hi"], start
        if lo == hi:
            return lo
        if sum(r["n"] for r in taken) <= 10_000:
            values = sorted(r[0] for r in rows.where(F.col("v").between(lo, hi)).collect())
            a, b = values[first - before], values[second - before]
            return a + (b - a) * (at - first)
        if len(taken) > 1:  # the two ranks lie in different bins: the end of one and the start of the next
            return taken[0]["hi"] + (taken[-1]["lo"] - taken[0]["hi"]) * (at - first)


def label_tails(records: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """``label, structure_id, value, threshold, share, severity``: values above their label's quantile; labels with fewer than four finite values have no tail."""
    spark, out = records.sparkSession, []
    for label, q in (limits or {"max_force": 0.90, "energy_per_atom": 0.95}).items():
        rows = records.select("structure_id", finite(F.col(label)).alias("value")).where("value IS NOT NULL")
        n = rows.count()
        if n < 4:
            continue
        threshold = exact_quantile(rows, "value", q)
        tail = rows.where(F.col("value") > threshold)
        share = tail.count() / max(1, records.count())
        out.append(tail.select(F.lit(label).alias("label"), "structure_id", "value", F.lit(threshold).alias("threshold"), F.lit(share).alias("share"), F.lit("high" if share >= 0.2 else "medium").alias("severity")))
    if not out:
        return spark.createDataFrame([], "label string, structure_id bigint, value double, threshold double, share double, severity string")
    return reduce(DataFrame.unionByName, out)


def label_coverage(records: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """``label, labelled, total``: structures with a finite value."""
    sums = records.agg(F.count("*").alias("total"), *(F.count(finite(F.col(x))).alias(x) for x in labels))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(x).alias("label"), F.col(x).alias("labelled")) for x in labels))).alias("s"), "total").select("s.label", "s.labelled", "total")


def severity_counts(slices: DataFrame) -> DataFrame:
    """``severity, n`` of slices of evidence."""
    return slices.groupBy("severity").agg(F.count("*").alias("n"))


_PRIORITY = {"blocker": 0, "review": 1, "evidence": 2, "unavailable": 3}


def consolidate(slices: DataFrame) -> DataFrame:
    """Findings from ``id, dimension, kind, observed, ids``: slices of one plot become one, with the union of their ids.

    Local-chemistry slices are grouped by the first three parts of their id, composition slices by two, others stand alone.
    """
    parts = F.split("id", ":")
    keep = F.when(F.col("dimension") == "local_chemistry", 3).when(F.col("dimension") == "composition", 2)
    group = F.when(keep.isNull(), F.col("id")).otherwise(F.array_join(F.slice(parts, F.lit(1), F.least(F.coalesce(keep, F.lit(1)), F.size(parts))), ":"))
    rank = S.lookup(_PRIORITY, F.col("kind"), "int")
    found = slices.withColumn("finding", group).groupBy("finding").agg(
        F.min(F.struct("id", "dimension", "kind", "observed")).alias("f"), F.count("*").alias("slices"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"), F.min(rank).alias("priority")
    )
    return found.select("finding", "f.dimension", "f.kind", "f.observed", "slices", "ids", "priority").orderBy("priority", "finding")


def fingerprint(df: DataFrame, key: str, columns: list[str] | None = None, fan: int = 4096) -> str:
    """SHA-256 of a dataset's content that does not depend on its partitions: rows in order of ``key`` inside buckets, then the buckets."""
    row = F.sha2(F.to_json(F.struct(*(columns or sorted(df.columns))), {"ignoreNullFields": "false"}), 256)
    leaves = df.select(F.pmod(F.xxhash64(key), F.lit(fan)).alias("b"), F.struct(F.col(key).alias("k"), row.alias("h")).alias("r"))
    # rows of a bucket are digests already; buckets grow with the data, so their number is a parameter
    buckets = leaves.groupBy("b").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["h"]), ""), 256).alias("h"))
    return buckets.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda r: r["h"]), ""), 256)).first()[0]


def scope_fingerprint(kind: str, total: int, ids: DataFrame) -> str:
    """Digest of an audit's scope."""
    column = ids.columns[0]
    import hashlib  # noqa: PLC0415

    return hashlib.sha256(f"{kind}:{total}:{fingerprint(ids, column)}".encode()).hexdigest()


def ids_per_group(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """Sorted distinct ids of every group."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_set(key)).alias("ids"))


def top_errors(rows: DataFrame, key: str, error: Column, n: int) -> DataFrame:
    """``key, error`` of the ``n`` structures with the largest row error, ties by key."""
    return rows.select(F.col(key), error.alias("error")).groupBy(key).agg(F.max("error").alias("error")).orderBy(F.desc("error"), key).limit(n)


def rmse(rows: DataFrame, pred: Column, ref: Column, by: list[str] = (), scale: float = 1.0) -> DataFrame:
    """Root mean square error over all components of paired arrays (or numbers), times ``scale``."""
    total = rows.select(*by, pred.alias("p"), ref.alias("r"))
    if dict(total.dtypes)["p"].startswith("array"):
        total = total.select(*by, F.explode(F.arrays_zip("p", "r")).alias("z")).select(*by, "z.p", "z.r")
    return total.groupBy(*by).agg((F.sqrt(F.avg(F.pow(F.col("p") - F.col("r"), F.lit(2)))) * scale).alias("rmse"))


def completions(records: DataFrame, n: int, fields: list[str] = ()) -> DataFrame:
    """``kind, token, structures``: tags, formulas, elements and fields with the structures that have them, the ``n`` most frequent of each kind."""
    structs = lambda kind, values: F.transform(F.array_distinct(values), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("token")))
    present = F.array_compact(F.array(*(F.when(F.col(f).isNotNull(), F.lit(f)) for f in fields))) if fields else F.array().cast("array<string>")
    every = F.concat(structs("tag", S.tags(F.col("config_type"))), structs("formula", F.array_compact(F.array("formula"))), structs("element", F.map_keys(F.map_filter("composition", lambda _, v: v > 0))), structs("field", present))
    counts = records.select(F.explode(every).alias("t")).groupBy("t.kind", "t.token").agg(F.count("*").alias("structures"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("structures"), "token"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")
