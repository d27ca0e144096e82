"""Vector analytics: distances, principal components, farthest-point sampling, quotas and draws.

Rows with a null key or vector take no part.  Farthest-point sampling keeps the
nearest selected distance of every row in the table, not on the driver: a pass
brings only the farthest few rows of each group to the driver, which picks on as
long as the next pick must lie among them; picks are exact, ties go to the
smaller key.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, gcd, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.runtime import materialize


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    square = lambda p, q: F.pow(p.cast("double") - q.cast("double"), F.lit(2))
    return F.sqrt(F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda s, d: s + d))


def _blocks(df: DataFrame, key: str, vec: str, block_rows: int) -> tuple[DataFrame, int]:
    n = max(1, -(-df.count() // block_rows))
    rows = df.select(F.col(key).cast("bigint").alias("k"), F.col(vec).cast("array<double>").alias("v"))
    return rows.groupBy(F.pmod(F.xxhash64("k"), F.lit(n)).alias("block")).agg(F.collect_list(F.struct("k", "v")).alias("rows")), n


def pairwise_distances(df: DataFrame, key: str, vec: str, block_rows: int = 256) -> DataFrame:
    """``i, j, d`` for every ordered pair of rows, a pair of blocks at a time; the distance to a null vector is null."""
    spark = df.sparkSession
    blocks, n = _blocks(df, key, vec, block_rows)

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for left, right in zip(b["a"].to_pylist(), b["b"].to_pylist()):
                x = [r["v"] for r in left]
                j, others = np.array([r["k"] for r in right]), [r["v"] for r in right]
                there = np.array([v is not None for v in others])
                y = np.array([v for v in others if v is not None])
                for r, v in zip(left, x):
                    d = np.zeros(len(j))
                    if v is not None and len(y):
                        d[there] = np.sqrt(((y - np.array(v)) ** 2).sum(1))
                    gone = ~there if v is not None else np.ones(len(j), bool)
                    yield pa.record_batch({"i": np.full(len(j), r["k"]), "j": j, "d": pa.array(d, pa.float64(), mask=gone)})

    left = blocks.select(F.col("rows").alias("a")).repartition(min(n, 3 * spark.sparkContext.defaultParallelism))
    return left.crossJoin(blocks.select(F.col("rows").alias("b"))).mapInArrow(distances, "i bigint, j bigint, d double")


def nearest_distances(df: DataFrame, chosen: DataFrame, key: str, vec: str, *, chosen_vec: str | None = None, block_rows: int = 512) -> DataFrame:
    """``key, d``: distance of each row to the nearest vector of a stated set, a pair of blocks at a time."""
    left, n = _blocks(df.where(F.col(vec).isNotNull()), key, vec, block_rows)
    right, _ = _blocks(chosen.select(F.monotonically_increasing_id().alias("k"), F.col(chosen_vec or vec).alias("v")).where("v IS NOT NULL"), "k", "v", block_rows)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one, other in zip(b["a"].to_pylist(), b["b"].to_pylist()):
                y = np.array([r["v"] for r in other])
                yield pa.record_batch({"k": [r["k"] for r in one], "d": [float(np.sqrt(((y - np.array(r["v"])) ** 2).sum(1).min())) for r in one]})

    pairs = left.select(F.col("rows").alias("a")).repartition(min(n, 3 * df.sparkSession.sparkContext.defaultParallelism)).crossJoin(right.select(F.col("rows").alias("b")))
    return pairs.mapInArrow(least, "k bigint, d double").groupBy(F.col("k").alias(key)).agg(F.min("d").alias("d"))


def _sums(df: DataFrame, vec: str, center: np.ndarray | None) -> tuple[int, np.ndarray, np.ndarray | None]:
    """Number and sum of the vectors, or with ``center`` also the sum of outer products, added up per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            x = np.array([v for v in b["v"].to_pylist() if v is not None], float)
            if not len(x):
                continue
            n += len(x)
            part = x.sum(0) if center is None else (x - center).T @ (x - center)
            total = part if total is None else total + part
        if n:
            flat = np.r_[n, total.ravel()]
            yield pa.record_batch({"c": np.arange(len(flat)), "x": flat})

    cells = df.select(F.col(vec).cast("array<double>").alias("v")).mapInArrow(run, "c bigint, x double").groupBy("c").agg(F.sum("x").alias("x")).orderBy("c").toPandas()
    if not len(cells):
        return 0, np.zeros(0), None
    flat = cells["x"].to_numpy()
    if center is None:
        return int(flat[0]), flat[1:], None
    return int(flat[0]), np.zeros(0), flat[1:].reshape(len(center), len(center))


def principal_axes(df: DataFrame, vec: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, variances and axes (rows) of the first ``k`` components; each axis points to its largest part's positive side."""
    n, total, _ = _sums(df, vec, None)
    if n < 2:
        return (total / n if n else total), np.zeros(0), np.zeros((0, len(total)))
    mean = total / n
    w, v = np.linalg.eigh(_sums(df, vec, mean)[2] / (n - 1))
    w, axes = w[::-1][:k], v[:, ::-1][:, :k].T
    return mean, np.maximum(w, 0.0), axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]


def principal_variances(df: DataFrame, vec: str, k: int) -> DataFrame:
    """``component, variance`` of the first ``k``."""
    values = principal_axes(df, vec, k)[1]
    return df.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "component int, variance double")


def project(df: DataFrame, vec: str, k: int, out: str = "projection", axes: tuple | None = None) -> DataFrame:
    """``df`` with its vectors' first ``k`` principal coordinates, as columns only."""
    mean, _, rows = axes or principal_axes(df, vec, k)
    parts = []
    for a in rows:
        at = F.array(*(F.lit(float(x)) for x in a))
        dot = F.aggregate(F.zip_with(F.col(vec), at, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, x: s + x)
        parts.append(dot - float(mean @ a))
    return df.withColumn(out, F.when(F.col(vec).isNotNull(), F.array(*parts)))


def _sampling(rows: DataFrame, quotas: dict, min_distance: float, start, stop=None, least: int = 64, fold: int = 256) -> dict:
    """Picks per group over ``rows(g, k, v, d)``; ``d`` is the distance to what is selected already (null: nothing).

    ``start`` holds each group's first pick ``(key, vector)``, or nothing for a group that is warm.
    """
    picked: dict = {g: list(start.get(g, [])) for g in quotas}
    fresh: dict = {g: list(p) for g, p in picked.items()}
    live = {g for g, q in quotas.items() if len(picked[g]) < q}
    if stop is not None:
        live -= {g for g in live if picked[g] and stop(g, picked[g])}
    while live:
        need = {g: min(least, 2 * (quotas[g] - len(picked[g])) + 1) for g in live}
        vectors = {g: np.array([v for _, v in p]) for g, p in fresh.items() if p}
        keys = {g: {k for k, _ in p} for g, p in picked.items()}

        def update(batches: Iterator[pa.RecordBatch], vectors=vectors, live=frozenset(live), keys=keys) -> Iterator[pa.RecordBatch]:
            for b in batches:
                g, k, d = b["g"].to_pylist(), b["k"].to_pylist(), b["d"].to_pylist()
                v = b["v"]
                keep = [i for i in range(len(g)) if g[i] in live and k[i] not in keys[g[i]]]
                new = []
                for i in keep:
                    old = np.inf if d[i] is None else d[i]
                    if g[i] in vectors:
                        x = np.array(v[i].as_py(), float)
                        old = min(old, float(np.sqrt(((vectors[g[i]] - x) ** 2).sum(1).min())))
                    new.append(old)
                at = pa.array(keep, pa.int64())
                yield pa.record_batch([b["g"].take(at), b["k"].take(at), v.take(at), pa.array(new, pa.float64())], ["g", "k", "v", "d"])

        now = rows.mapInArrow(update, "g string, k bigint, v array<double>, d double")
        if sum(map(len, fresh.values())) >= fold:
            now = rows = materialize(now, "nearest")
            fresh = {g: [] for g in picked}
        top = F.element_at(F.create_map(*(F.lit(x) for g, n in need.items() for x in (g, n))), F.col("g"))
        rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("d"), "k"))
        found: dict = {}
        for r in now.withColumn("r", rank).where(F.col("r") <= top).drop("r").collect():
            found.setdefault(r["g"], []).append((r["d"], r["k"], np.array(r["v"], float)))
        for g in list(live):
            rest = sorted(found.get(g, []), key=lambda c: (-c[0], c[1]))
            bound = rest[-1][0] if len(rest) >= need[g] else -1.0  # rows that did not come are no farther
            first = True
            while True:
                if not rest or not np.isfinite(rest[0][0]) or rest[0][0] < min_distance or len(picked[g]) >= quotas[g]:
                    live.discard(g)
                    break
                if not first and rest[0][0] <= bound:
                    break
                _, k, v = rest.pop(0)
                picked[g].append((k, v))
                fresh[g].append((k, v))
                first = False
                if stop is not None and stop(g, picked[g]):
                    live.discard(g)
                    break
                rest = sorted(((min(d, float(np.linalg.norm(x - v))), j, x) for d, j, x in rest), key=lambda c: (-c[0], c[1]))
    return {g: [k for k, _ in p] for g, p in picked.items()}


def _prepare(df: DataFrame, key: str, vec: str, group: str | None, selected: DataFrame | None, selected_vec: str | None) -> DataFrame:
    rows = df.select(F.lit("").alias("g") if group is None else F.col(group).cast("string").alias("g"), F.col(key).cast("bigint").alias("k"), F.col(vec).cast("array<double>").alias("v"))
    rows = rows.where("g IS NOT NULL AND k IS NOT NULL AND v IS NOT NULL")
    if selected is None:
        return materialize(rows.withColumn("d", F.lit(None).cast("double")), "sampling")
    near = nearest_distances(rows, selected, "k", "v", chosen_vec=selected_vec or vec)
    return materialize(rows.join(near, "k", "left"), "sampling")


def _first_at(rows: DataFrame, center: dict | None) -> dict:
    """First pick of each cold group: the smallest key, or the row nearest the group's mean."""
    cold = rows.groupBy("g").agg(F.count("d").alias("warm")).where("warm = 0").select("g")
    rows = rows.join(cold, "g")
    order = F.struct("k", "v")
    if center is not None:
        if not center:
            return {}
        mean = F.element_at(F.create_map(*(x for g, c in center.items() for x in (F.lit(g), F.array(*map(F.lit, map(float, c)))))), F.col("g"))
        order = F.struct(distance(F.col("v"), mean).alias("away"), "k", "v")
    return {r["g"]: [(r["b"]["k"], np.array(r["b"]["v"], float))] for r in rows.groupBy("g").agg(F.min(order).alias("b")).collect()}


def group_means(rows: DataFrame) -> dict:
    """Mean vector of every group of ``rows(g, v)``."""
    parts = rows.select("g", F.posexplode("v").alias("i", "x")).groupBy("g", "i").agg(F.avg("x").alias("m"))
    return {r["g"]: [x["m"] for x in r["c"]] for r in parts.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")).collect()}


def farthest_points(df: DataFrame, key: str, vec: str, n: int, min_distance: float = 0.1, *, selected: DataFrame | None = None, selected_vec: str | None = None) -> list[int]:
    """Keys in order of selection: from the smallest key, or as far as possible from ``selected``; stops below ``min_distance``."""
    if n < 1:
        return []
    rows = _prepare(df, key, vec, None, selected, selected_vec)
    return _sampling(rows, {"": n}, min_distance, _first_at(rows, None)).get("", [])


def centered_points(df: DataFrame, key: str, vec: str, n: int, min_distance: float = 0.1, *, selected: DataFrame | None = None) -> list[int]:
    """As :func:`farthest_points`, from the row nearest the mean; a warm start takes precedence."""
    if n < 1:
        return []
    rows = _prepare(df, key, vec, None, selected, None)
    return _sampling(rows, {"": n}, min_distance, _first_at(rows, group_means(rows))).get("", [])


def explained_points(df: DataFrame, key: str, vec: str, threshold: float, n: int | None = None, min_distance: float = 0.1, *, selected: DataFrame | None = None) -> tuple[list[int], float]:
    """Farthest points until their squared distance from the mean reaches ``threshold`` of the total; the keys and that share."""
    rows = _prepare(df, key, vec, None, selected, None)
    means = group_means(rows)
    if not means:
        return [], 0.0
    mean = np.array(means[""])
    lit = F.array(*map(F.lit, map(float, mean)))
    count, total = rows.agg(F.count("*"), F.sum(F.pow(distance(F.col("v"), lit), F.lit(2)))).first()
    share = lambda picks: 1.0 if total <= 0 else sum(float(((v - mean) ** 2).sum()) for _, v in picks) / total
    kept: list = []

    def stop(_, picks) -> bool:
        kept[:] = picks
        return share(picks) >= threshold

    out = _sampling(rows, {"": min(n, count) if n and n > 0 else count}, min_distance, _first_at(rows, None), stop)[""]
    kept = kept[: len(out)]
    return out, (share(kept) if kept or total <= 0 else 0.0)


def sqrt_quotas(sizes: dict, n: int) -> dict:
    """One slot per group that is not empty, the rest in proportion to the square root of its size, by largest remainder."""
    sizes = {g: int(s) for g, s in sizes.items() if s > 0}
    if not sizes or n <= 0:
        return {}
    n = min(n, sum(sizes.values()))
    if n < len(sizes):
        raise ValueError(f"{n} slots are fewer than {len(sizes)} groups")
    out = dict.fromkeys(sizes, 1)
    left = n - len(out)
    while left > 0:
        room = {g: s - out[g] for g, s in sizes.items() if s > out[g]}
        total = sum(sqrt(sizes[g]) for g in room)
        share = {g: left * sqrt(sizes[g]) / total for g in room}
        for g in room:
            add = min(room[g], floor(share[g]))
            out[g] += add
            left -= add
        # remainders are those of this round's shares
        for g in sorted(room, key=lambda g: (floor(share[g]) - share[g], -sizes[g], repr(g))):
            if left > 0 and out[g] < sizes[g]:
                out[g] += 1
                left -= 1
    return out


def balanced_points(df: DataFrame, key: str, vec: str, group: str, n: int, min_distance: float = 0.1, *, selected: DataFrame | None = None) -> DataFrame:
    """``group, key, step``: square-root quotas per group, farthest points from each group's centre inside.

    ``selected`` (same columns) warms only the groups it holds; groups are sampled side by side.
    """
    spark = df.sparkSession
    sizes = {str(r[0]): r[1] for r in df.where(F.col(vec).isNotNull() & F.col(group).isNotNull()).groupBy(group).count().collect()}
    quotas = sqrt_quotas(sizes, n)
    rows = _prepare(df, key, vec, group, None, None)
    if selected is not None:
        other = selected.select(F.col(group).cast("string").alias("g"), F.col(vec).cast("array<double>").alias("w")).where("g IS NOT NULL AND w IS NOT NULL")
        near = _grouped_nearest(rows, other)
        rows = materialize(rows.drop("d").join(near, "k", "left"), "sampling")
    got = _sampling(rows, quotas, min_distance, _first_at(rows, group_means(rows))) if quotas else {}
    return spark.createDataFrame([(g, k, i) for g, ks in got.items() for i, k in enumerate(ks)], f"`{group}` string, `{key}` bigint, step int")


def _grouped_nearest(rows: DataFrame, other: DataFrame, block_rows: int = 512) -> DataFrame:
    """Distance of each row to the nearest chosen vector of its own group, block against block."""
    cut = lambda df, salt, item: df.groupBy("g", F.pmod(F.xxhash64(*salt), F.ceil(F.col("n") / block_rows)).alias("b")).agg(F.collect_list(item).alias("rows"))
    sized = lambda df: df.join(df.groupBy("g").agg(F.count("*").alias("n")), "g")
    left = cut(sized(rows.select("g", "k", "v")), ["k"], F.struct("k", "v")).select("g", F.col("rows").alias("a"))
    right = cut(sized(other), ["w"], F.col("w")).select("g", F.col("rows").alias("b"))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one, two in zip(b["a"].to_pylist(), b["b"].to_pylist()):
                y = np.array(two)
                yield pa.record_batch({"k": [r["k"] for r in one], "d": [float(np.sqrt(((y - np.array(r["v"])) ** 2).sum(1).min())) for r in one]})

    return left.join(right, "g").select("a", "b").mapInArrow(least, "k bigint, d double").groupBy("k").agg(F.min("d").alias("d"))


def sparse_sample(
    df: DataFrame, key: str, vec: str, n: int, min_distance: float = 0.1, *, strategy: str = "count", group: str | None = None,
    components: int | None = None, within: DataFrame | None = None, training: DataFrame | None = None, threshold: float = 0.9,
) -> tuple[list[int], bool]:
    """Keys of a sample and whether they are to be taken out of the selection (``reverse``) rather than added.

    ``strategy`` is ``count``, ``r2`` or ``element_set``; ``components`` projects to principal axes first, those
    of both sets together with ``training``, which warms the sampling; ``within`` restricts to a selection.
    """
    reverse = within is not None
    if reverse:
        df = df.join(within.select(key).distinct(), key, "left_semi")
    if components:
        both = df.select(vec) if training is None else df.select(vec).unionByName(training.select(vec))
        axes = principal_axes(both, vec, components)
        df = project(df, vec, components, vec, axes)
        training = None if training is None else project(training, vec, components, vec, axes)
    if strategy == "element_set":
        rows = balanced_points(df, key, vec, group, n, min_distance, selected=training)
        return [r[1] for r in rows.orderBy(group, "step").collect()], reverse
    if strategy == "r2":
        return explained_points(df, key, vec, threshold, n, min_distance, selected=training)[0], reverse
    return farthest_points(df, key, vec, n, min_distance, selected=training), reverse


def sampling_plan(df: DataFrame, vec: str, n: int, group: str | None = None) -> DataFrame:
    """``group, size, quota`` of a sampling before it runs."""
    name = group or "all"
    sizes = {str(r[0]): r[1] for r in df.where(F.col(vec).isNotNull()).groupBy(F.col(group) if group else F.lit("all")).count().collect()}
    quotas = sqrt_quotas(sizes, n) if group else {g: min(n, s) for g, s in sizes.items()}
    return df.sparkSession.createDataFrame([(g, s, quotas.get(g, 0)) for g, s in sorted(sizes.items())], f"`{name}` string, size bigint, quota bigint")


def spread_slots(total: int, n: int) -> list[int]:
    """``n`` of ``total`` slots, evenly spread: a stride near the golden section that is coprime to the total."""
    if total <= 0 or n <= 0:
        return []
    if n >= total:
        return list(range(total))
    stride = max(1, round(total * 0.6180339887498949))
    while gcd(stride, total) != 1:
        stride += 1
    return [(i * stride) % total for i in range(n)]


def reservoir(df: DataFrame, n: int, by: list[str], key: str, seed: int = 0) -> DataFrame:
    """``n`` rows of every group, drawn by hash of the key and seed: repeatable, and no group is collected."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key))
    return df.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")
