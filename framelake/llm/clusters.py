"""Similarity clusters by bisecting k-means.

Records become points whose coordinates are scaled so that two records are
similar exactly if they have the same elements and every coordinate differs by
less than one (maximum metric).  The element set is the first cut.  A node that
is not compact is split in two by 2-means, the one with the largest dispersion
first, until every leaf spans less than one in each coordinate, so all members
of a leaf are similar to each other.  Nodes above ``max_rows`` are split by
distributed passes over all rows; smaller ones are finished in parallel tasks.

A split may cut through a group of similar records, so leaves are compared by
their bounding boxes: boxes whose union is compact are similar as a whole,
boxes at least one apart are not, and only the rest is compared point by point.
A group is a set of leaves that are all similar to each other and of which no
member is similar to a record outside.

Defined results: records with a null, NaN or out-of-range value, without any
positive share, or without atoms take no part; repeated record ids count once;
ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.runtime import materialize

#: Differences of one, but for rounding, count as not similar.
LIMIT = 1 - 1e-9
TYPICAL = 3
_OUT = "leaf bigint, record_id bigint, elements string, n bigint, first_id bigint, lo array<double>, hi array<double>, centre array<double>, typical array<bigint>"


def audit_points(df: DataFrame, share: float = 0.12, energy: float = 0.25, atoms: float = 4 / 3, low: float = -20.0, high: float = 0.0) -> DataFrame:
    """``record_id, elements, x``: scaled shares by element, energy and logarithm of the atom count."""
    entries = F.array_sort(F.map_entries(F.map_filter("composition", lambda k, v: (v > 0) & ~F.isnan(v))))
    rows = df.where(F.col("energy_per_atom").between(low, high) & ~F.isnan("energy_per_atom") & (F.col("num_atoms") > 0))
    rows = rows.select(F.col("record_id").cast("bigint").alias("record_id"), entries.alias("c"), F.col("energy_per_atom").cast("double").alias("e"), F.col("num_atoms").cast("double").alias("a"))
    rows = rows.where(F.size("c") > 0).withColumn("total", F.aggregate("c", F.lit(0.0), lambda s, c: s + c["value"]))
    x = F.concat(F.transform("c", lambda c: c["value"] / F.col("total") / share), F.array(F.col("e") / energy, F.log("a") / math.log(atoms)))
    return rows.select("record_id", F.array_join(F.transform("c", lambda c: c["key"]), "-").alias("elements"), x.alias("x")).dropDuplicates(["record_id"])


#: Steps of every 2-means, in one task and over the cluster alike.
STEPS = 3


def _two_means(x: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Side of each point; both sides hold points as ``x`` is not constant.

    The same rule as for nodes that are split over the cluster: it starts a standard
    deviation on both sides of the mean, along the coordinate of largest variance.
    """
    mean, var = x.mean(0), x.var(0)
    shift = np.zeros(len(mean))
    shift[int(np.argmax(var))] = np.sqrt(var.max())
    a, b = mean - shift, mean + shift
    for step in range(steps + 1):
        side = ((x - b) ** 2).sum(1) < ((x - a) ** 2).sum(1)
        if side.all() or not side.any():
            break
        if step < steps:
            a, b = x[~side].mean(0), x[side].mean(0)
    if side.all() or not side.any():  # numbers too near each other to tell apart
        wide = int(np.argmax(x.max(0) - x.min(0)))
        side = x[:, wide] > (x[:, wide].max() + x[:, wide].min()) / 2
    return side


def bisect(x: np.ndarray) -> list[np.ndarray]:
    """Row numbers of the leaves of bisecting k-means on ``x``."""
    leaves, heap, serial = [], [(0.0, 0, np.arange(len(x)))], 1
    while heap:
        _, _, at = heapq.heappop(heap)
        y = x[at]
        if (y.max(0) - y.min(0)).max() < LIMIT:
            leaves.append(at)
            continue
        side = _two_means(y)
        for part in (at[~side], at[side]):
            z = x[part]
            heapq.heappush(heap, (-float(((z - z.mean(0)) ** 2).sum()), serial, part))
            serial += 1
    return leaves


def _leaf_id(elements: str, first_id: int) -> int:
    """A leaf's number follows from its elements and smallest record, however it was split off."""
    return int(hashlib.sha1(f"{elements}|{first_id}".encode()).hexdigest()[:15], 16)


def _split_node(key: tuple, t: pa.Table) -> pa.Table:
    node = key[0].as_py()
    ids = t["record_id"].to_numpy()
    lists = t["x"].combine_chunks()
    x = lists.flatten().to_numpy().reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    leaf_of = np.empty(len(ids), np.int64)
    summary: dict[str, list] = {k: [] for k in ("leaf", "n", "first_id", "lo", "hi", "centre", "typical")}
    for at in sorted(bisect(x), key=lambda a: a[0]):
        y, leaf = x[at], _leaf_id(node.split("/")[0], int(ids[at[0]]))
        leaf_of[at] = leaf
        centre = y.mean(0)
        near = np.lexsort((ids[at], ((y - centre) ** 2).sum(1)))[:TYPICAL]
        for k, v in zip(summary, (leaf, len(at), int(ids[at[0]]), y.min(0).tolist(), y.max(0).tolist(), centre.tolist(), ids[at][near].tolist())):
            summary[k].append(v)
    m, s = len(ids), len(summary["leaf"])
    vec = pa.list_(pa.float64())

    def both(values: list, kind: pa.DataType) -> pa.ChunkedArray:
        return pa.chunked_array([pa.nulls(m, kind), pa.array(values, kind)])

    return pa.table({
        "leaf": pa.chunked_array([pa.array(leaf_of), pa.array(summary["leaf"], pa.int64())]),
        "record_id": pa.chunked_array([pa.array(ids, pa.int64()), pa.nulls(s, pa.int64())]),
        "elements": both([node.split("/")[0]] * s, pa.string()),
        "n": both(summary["n"], pa.int64()), "first_id": both(summary["first_id"], pa.int64()),
        "lo": both(summary["lo"], vec), "hi": both(summary["hi"], vec), "centre": both(summary["centre"], vec),
        "typical": both(summary["typical"], pa.list_(pa.int64())),
    })


def _stats(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per node: count and arrays of minimum, maximum, mean and variance by coordinate."""
    dims = rows.select(*by, "record_id", F.posexplode("x").alias("dim", "v")).groupBy(*by, "dim").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"), F.var_pop("v").alias("var"), F.count("v").alias("n"), F.min("record_id").alias("first_id")
    )
    packed = dims.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("dim", "lo", "hi", "mean", "var"))).alias("s"), F.max("n").alias("n"), F.min("first_id").alias("first_id"))
    return packed.select(*by, "n", "first_id", *(F.col(f"s.{c}").alias(c) for c in ("lo", "hi", "mean", "var")))


def _far(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, d: s + d)


def _extent(lo: str, hi: str) -> Column:
    return F.array_max(F.zip_with(hi, lo, lambda p, q: p - q))


def _split_large(rows: DataFrame, max_rows: int, steps: int = STEPS) -> tuple[DataFrame, list[DataFrame]]:
    """Split nodes above ``max_rows`` over the whole cluster; (small nodes, compact large leaves)."""
    done: list[DataFrame] = []
    small: list[DataFrame] = []
    while True:
        sizes = materialize(rows.groupBy("node").count(), "cluster-sizes")
        large = sizes.where(F.col("count") > max_rows).select("node")
        if large.isEmpty():
            small.append(rows)
            return _union(small), done
        small.append(rows.join(large, "node", "left_anti"))
        big = materialize(rows.join(large, "node", "left_semi"), "cluster-large")
        stats = materialize(_stats(big, ["node"]), "cluster-stats")
        compact = _extent("lo", "hi") < LIMIT
        done.append(big.join(stats.where(compact).select("node"), "node", "left_semi"))
        # start on both sides of the mean along the widest coordinate
        wide = F.array_position(F.transform("var", lambda v: (v == F.array_max("var")).cast("int")), 1) - 1
        shifted = lambda sign: F.transform("mean", lambda m, i: m + F.when(i == wide, sign * F.sqrt(F.array_max("var"))).otherwise(0.0))
        centres = stats.where(~compact).select("node", shifted(-1).alias("a"), shifted(1).alias("b"))
        todo = big.join(stats.where(~compact).select("node"), "node", "left_semi")
        for _ in range(steps):
            sided = todo.join(centres, "node").withColumn("side", (_far("x", "b") < _far("x", "a")).cast("int"))
            means = _stats(sided, ["node", "side"]).groupBy("node").agg(F.max(F.when(F.col("side") == 0, F.col("mean"))).alias("a2"), F.max(F.when(F.col("side") == 1, F.col("mean"))).alias("b2"))
            centres = materialize(centres.join(means, "node").select("node", F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b")), "cluster-centres")
        sided = todo.join(centres, "node").withColumn("side", (_far("x", "b") < _far("x", "a")).cast("string"))
        rows = materialize(sided.select("record_id", F.concat("node", F.when(F.instr("node", "/") > 0, "").otherwise("/"), "side").alias("node"), "x"), "cluster-nodes")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _large_leaves(rows: DataFrame) -> DataFrame:
    """Leaves too large for one task: the same columns, by aggregation only."""
    stats = _stats(rows, ["node"])
    elements = F.substring_index("node", "/", 1)
    named = stats.select("node", F.conv(F.substring(F.sha1(F.concat_ws("|", elements, F.col("first_id").cast("string"))), 1, 15), 16, 10).cast("bigint").alias("leaf"))
    away = rows.join(stats.select("node", "mean"), "node").select("node", "record_id", _far("x", "mean").alias("d"))
    best = Window.partitionBy("node", "salt").orderBy("d", "record_id")
    top = away.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(256))).withColumn("r", F.row_number().over(best)).where(F.col("r") <= TYPICAL)
    top = top.groupBy("node").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("d", "record_id"))), 1, TYPICAL), lambda s: s["record_id"]).alias("typical"))
    none = lambda kind: F.lit(None).cast(kind)
    vec, ids = "array<double>", "array<bigint>"
    head = stats.join(top, "node").join(named, "node").select("leaf", none("bigint").alias("record_id"), F.substring_index("node", "/", 1).alias("elements"), "n", "first_id", "lo", "hi", F.col("mean").alias("centre"), "typical")
    body = rows.join(named, "node").select("leaf", "record_id", none("string").alias("elements"), none("bigint").alias("n"), none("bigint").alias("first_id"), none(vec).alias("lo"), none(vec).alias("hi"), none(vec).alias("centre"), none(ids).alias("typical"))
    return head.unionByName(body)


def _touching(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Whether any point of one side is similar to any of the other, in blocks."""
    a, b = (t[c].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) for t, c in ((left, "xa"), (right, "xb")))
    hit = any((np.abs(a[i : i + 64, None, :] - b[None, j : j + 4096, :]).max(2) < LIMIT).any() for i in range(0, len(a), 64) for j in range(0, len(b), 4096))
    return pa.table({"la": [key[0].as_py()] * hit, "lb": [key[1].as_py()] * hit}, schema=pa.schema([("la", pa.int64()), ("lb", pa.int64())]))


def similarity_clusters(points: DataFrame, max_rows: int = 200_000, part_rows: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(leaves, members): ``leaf, grp, isolated, n, size, first_id, ...`` and ``record_id, leaf``.

    ``grp`` is the smallest leaf of the leaf's group; ``isolated`` says that the
    group is a whole one.  ``points`` has ``record_id, elements, x``.
    """
    points = materialize(points, "points")
    start = points.select("record_id", F.col("elements").alias("node"), "x")
    small, done = _split_large(start, max_rows)
    cut = small.groupBy("node").applyInArrow(_split_node, _OUT)
    cut = materialize(_union([cut, *map(_large_leaves, done)]), "leaves")
    members = cut.where(F.col("record_id").isNotNull()).select("record_id", "leaf")
    leaves = materialize(cut.where(F.col("n").isNotNull()).drop("record_id"), "leaf-boxes")

    # boxes that are less than one apart lie at most one grid step of two apart
    d = F.size("lo")
    keys = [F.floor(F.element_at("lo", i) / 2) for i in (d, d - 1, F.lit(1))]
    cells = leaves.select("leaf", "elements", "lo", "hi", *(k.alias(f"c{i}") for i, k in enumerate(keys)))
    around = cells.select(F.col("leaf").alias("lb"), "elements", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), *(f"c{i}" for i in range(3)))
    for i in range(3):
        around = around.withColumn(f"c{i}", F.explode(F.array(*(F.col(f"c{i}") + s for s in (-1, 0, 1)))))
    near = cells.withColumnRenamed("leaf", "la").join(around, ["elements", "c0", "c1", "c2"]).where(F.col("la") != F.col("lb"))
    gap = F.array_max(F.zip_with(F.zip_with("lo", "hi2", lambda p, q: p - q), F.zip_with("lo2", "hi", lambda p, q: p - q), lambda p, q: F.greatest(p, q)))
    span = F.array_max(F.zip_with(F.zip_with("hi", "hi2", lambda p, q: F.greatest(p, q)), F.zip_with("lo", "lo2", lambda p, q: F.least(p, q)), lambda p, q: p - q))
    near = materialize(near.where(gap < LIMIT).select("la", "lb", (span < LIMIT).alias("sure")), "leaf-pairs")

    sure = near.where("sure")
    low = sure.groupBy(F.col("la").alias("leaf")).agg(F.min("lb").alias("least"), F.count("*").alias("links"))
    named = leaves.join(low, "leaf", "left").withColumn("grp", F.least("leaf", F.coalesce("least", "leaf"))).withColumn("links", F.coalesce("links", F.lit(0)))
    label = named.select("leaf", "grp")
    mixed = sure.join(label.withColumnsRenamed({"leaf": "la", "grp": "ga"}), "la").join(label.withColumnsRenamed({"leaf": "lb", "grp": "gb"}), "lb").where(F.col("ga") != F.col("gb"))
    broken = mixed.select(F.col("ga").alias("grp")).union(mixed.select(F.col("gb").alias("grp"))).distinct()
    whole = named.groupBy("grp").agg(F.count("*").alias("m"), F.min("links").alias("least_links"), F.sum("n").alias("size"), F.min("first_id").alias("group_first"))
    whole = whole.where(F.col("least_links") == F.col("m") - 1).join(broken, "grp", "left_anti")

    # the open pairs that touch a whole group are compared point by point
    of = label.join(whole.select("grp"), "grp", "left_semi").select(F.col("leaf").alias("la"), "grp")
    boxes = leaves.select("leaf", "n", "lo", "hi")
    open_ = near.where("NOT sure").join(of, "la").join(boxes.toDF("la", "na", "loa", "hia"), "la").join(boxes.toDF("lb", "nb", "lob", "hib"), "lb")
    open_ = open_.withColumns({"ka": F.ceil(F.col("na") / part_rows), "kb": F.ceil(F.col("nb") / part_rows)})
    whole = materialize(whole, "whole-groups")
    if not open_.isEmpty():
        at = members.join(points.select("record_id", "x"), "record_id")
        piece = lambda k: F.pmod(F.xxhash64("record_id"), F.col(k))
        every = lambda k: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(k) - 1))
        # only points less than one from the other leaf's box can be similar to a point in it
        beside = lambda lo, hi: F.array_max(F.zip_with(F.zip_with("x", hi, lambda p, q: p - q), F.zip_with(lo, "x", lambda p, q: p - q), lambda p, q: F.greatest(p, q))) < LIMIT
        one = open_.join(at.withColumnRenamed("leaf", "la"), "la").where(beside("lob", "hib"))
        one = one.select(F.col("la").alias("a1"), F.col("lb").alias("b1"), piece("ka").alias("i1"), every("kb").alias("j1"), F.col("x").alias("xa"))
        two = open_.join(at.withColumnRenamed("leaf", "lb"), "lb").where(beside("loa", "hia"))
        two = two.select(F.col("la").alias("a2"), F.col("lb").alias("b2"), every("ka").alias("i2"), piece("kb").alias("j2"), F.col("x").alias("xb"))
        hit = one.groupBy("a1", "b1", "i1", "j1").cogroup(two.groupBy("a2", "b2", "i2", "j2")).applyInArrow(_touching, "la bigint, lb bigint")
        whole = materialize(whole.join(hit.join(of, "la").select("grp").distinct(), "grp", "left_anti"), "isolated-groups")
    out = named.join(whole.select("grp", "size", "group_first"), "grp", "left").withColumn("isolated", F.col("size").isNotNull())
    return out, members


def similar_groups(points: DataFrame, min_size: int = 5, **how: int) -> DataFrame:
    """``first_record_id, record_id`` of every group of at least ``min_size`` records."""
    leaves, members = similarity_clusters(points, **how)
    first = leaves.where(F.col("isolated") & (F.col("size") >= min_size)).select("leaf", F.col("group_first").alias("first_record_id"))
    return members.join(first, "leaf").where(F.col("record_id") != F.col("first_record_id")).select("first_record_id", "record_id")
