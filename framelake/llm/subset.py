"""A varied subset of given size: mini-batch k-means, quotas per cluster, farthest patterns within quotas.

Records are reduced to distinct (composition, config type) patterns first, so
that the model sees variety rather than frequency.  Every pattern gives one
record before any gives a second, and so on: a request takes up to ``level``
records of every pattern, the highest level that fits, and one more of as many
patterns as slots are left.  These are chosen for variety:

* patterns are split by mini-batch k-means into as many clusters as the square
  root of their number, at least ``clusters``.  Every partition runs it over all
  its patterns from the shared centres; the copies are merged by their counts
  after each pass.  Seeds come from ``seed_rows`` patterns with the smallest
  hashes (a documented bound);
* each cluster gets one slot, and the rest goes by the square root of its number
  of patterns (strategy ``global``) or equally (``element_set``); slots a cluster
  cannot fill go to the others;
* inside a cluster every slot goes to the pattern farthest from those chosen so
  far.  Clusters of more than ``chunk_rows`` patterns are cut by hash into parts
  of about that many, each with its share of the slots;
* with fewer slots than clusters, the slots go to the patterns farthest from each
  other among the first ``FEW`` of every part, for which all patterns were read.

The records of a pattern are taken in the order of their hashes.

Defined results: a null or non-positive size gives no rows; a size above the
number of records gives all of them; null compositions and config types are
patterns of their own; repeated record ids count once; unknown strategies are
read as ``global``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.runtime import materialize

ELEMENT_DIMS, KIND_DIMS, TAG_DIMS = 256, 32, 16
DIMS = ELEMENT_DIMS + KIND_DIMS + TAG_DIMS
FEW = 8


def config_key(c: Column) -> Column:
    """Lower-case tags joined by ``|``; blank is null."""
    key = F.array_join(F.filter(F.split(F.lower(c), r"[\s|]+"), lambda t: t != ""), "|")
    return F.when(key != "", key)


def vectors(elements: list, shares: list, configs: list) -> np.ndarray:
    """Feature vectors: element shares, first tag and other tags, the names hashed to fixed places."""
    x = np.zeros((len(configs), DIMS))
    place = lambda name, dims: zlib.crc32(name.encode()) % dims
    known: dict[str, int] = {}
    for i, (es, ss, c) in enumerate(zip(elements, shares, configs)):
        for e, s in zip(es or (), ss or ()):
            x[i, known[e] if e in known else known.setdefault(e, place(e, ELEMENT_DIMS))] += s
        for j, tag in enumerate((c or "").split("|")):
            if j == 0:
                x[i, ELEMENT_DIMS + place(tag, KIND_DIMS)] += 0.7
            else:
                x[i, ELEMENT_DIMS + KIND_DIMS + place(tag, TAG_DIMS)] += 0.3
    return x


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)


def _batch(b: pa.RecordBatch) -> np.ndarray:
    return vectors(b["elements"].to_pylist(), b["shares"].to_pylist(), b["config"].to_pylist())


def seed_centres(x: np.ndarray, k: int) -> np.ndarray:
    """k-means++ with a fixed seed."""
    rng = np.random.default_rng(11)
    centres = [x[0]]
    d = ((x - x[0]) ** 2).sum(1)
    while len(centres) < min(k, len(x)) and d.max() > 1e-12:
        c = x[np.searchsorted(np.cumsum(d), rng.random() * d.sum())]
        centres.append(c)
        d = np.minimum(d, ((x - c) ** 2).sum(1))
    return np.array(centres)


def fit(patterns: DataFrame, k: int, passes: int, seed_rows: int, batch: int = 1024) -> np.ndarray:
    """Centres of parallel mini-batch k-means over ``patterns``."""
    seeds = patterns.orderBy("sig").limit(seed_rows).toArrow()
    if not seeds.num_rows:
        return np.zeros((1, DIMS))
    centres = seed_centres(vectors(seeds["elements"].to_pylist(), seeds["shares"].to_pylist(), seeds["config"].to_pylist()), k)

    def one_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, n = centres.copy(), np.zeros(len(centres))
        for b in batches:
            for i in range(0, b.num_rows, batch):
                x = _batch(b.slice(i, batch))
                at = _nearest(x, c)
                m = np.bincount(at, minlength=len(c))
                total = np.zeros_like(c)
                np.add.at(total, at, x)
                n += m
                hit = m > 0
                # each centre moves towards its batch mean by its share of all points seen
                c[hit] += (total[hit] / m[hit, None] - c[hit]) * (m[hit] / n[hit])[:, None]
        yield pa.record_batch({"cluster": np.flatnonzero(n), "n": n[n > 0], "c": pa.array(list(c[n > 0]), pa.list_(pa.float64()))})

    for _ in range(passes):
        got = patterns.select("elements", "shares", "config").mapInArrow(one_pass, "cluster bigint, n double, c array<double>")
        # merged by element, so the driver gets one row per cluster and dimension
        merged = got.select("cluster", "n", F.posexplode("c").alias("d", "v")).groupBy("cluster", "d").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v")).toPandas()
        centres[merged["cluster"], merged["d"]] = merged["v"]
    return centres


def quotas(sizes: np.ndarray, n: int, equal: bool) -> np.ndarray:
    """One slot per cluster if there are enough, then by weight, capped by size, unused slots redistributed."""
    n = min(n, int(sizes.sum()))
    take = (sizes > 0).astype(np.int64) if n >= (sizes > 0).sum() else np.zeros(len(sizes), np.int64)
    while (left := n - int(take.sum())) > 0:
        room = sizes - take
        weight = np.where(room > 0, 1.0 if equal else np.sqrt(sizes), 0.0)
        share = left * weight / weight.sum()
        add = np.minimum(np.floor(share).astype(np.int64), room)
        if not add.any():
            order = np.lexsort((np.arange(len(sizes)), -sizes, -(share - np.floor(share)), room <= 0))[:left]
            add[order[room[order] > 0]] = 1
        take += add
    return take


def level(counts: np.ndarray, times: np.ndarray, n: int) -> tuple[int, int]:
    """Records that every pattern can give within ``n``, and slots left; ``times`` patterns have ``counts`` records."""
    lo, hi = 0, int(counts.max(initial=0))
    used = lambda k: int((np.minimum(counts, k) * times).sum())
    if used(hi) <= n:
        return hi, 0
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if used(mid) <= n else (lo, mid)
    return lo, n - used(lo)


def farthest(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows of ``x`` in order: the one nearest the mean, then always the farthest from those before."""
    x = x.astype(np.float32)
    square = (x**2).sum(1)
    at = int(np.argmin(((x - x.mean(0)) ** 2).sum(1)))
    d, picked = np.full(len(x), np.inf, np.float32), []
    for _ in range(min(n, len(x))):
        picked.append(at)
        d = np.minimum(d, np.maximum(square - 2 * (x @ x[at]) + square[at], 0))
        d[picked] = -1
        at = int(np.argmax(d))
    return np.array(picked, np.int64)


def _order(t: pa.Table) -> pa.Table:
    """Patterns of one group with their turn, as far as the largest request goes."""
    t = t.sort_by("sig")
    at = farthest(vectors(t["elements"].to_pylist(), t["shares"].to_pylist(), t["config"].to_pylist()), t["most"][0].as_py())
    return t.drop_columns(["most"]).take(pa.array(at)).append_column("turn", pa.array(np.arange(len(at)), pa.int64()))


def varied_subsets(records: DataFrame, requests: list[dict], *, clusters: int = 64, passes: int = 3, seed_rows: int = 4096, chunk_rows: int = 2048) -> DataFrame:
    """``params_id, record_id, cluster`` for each request (``params_id, n_samples, strategy, source``)."""
    spark = records.sparkSession
    share = F.map_filter("composition", lambda k, v: (v > 0) & ~F.isnan(v))
    rows = records.select(F.col("record_id").cast("bigint").alias("record_id"), "source", F.array_sort(F.map_entries(share)).alias("c"), config_key(F.col("config_type")).alias("config"))
    rows = rows.withColumn("total", F.aggregate("c", F.lit(0.0), lambda s, e: s + e["value"])).select(
        "record_id", "source", "config",
        F.transform("c", lambda e: e["key"]).alias("elements"),
        F.transform("c", lambda e: F.bround(e["value"] / F.col("total"), 2)).alias("shares"),
    )
    rows = rows.withColumn("sig", F.xxhash64("elements", "shares", "config")).withColumn("h", F.xxhash64(F.lit("subset"), "record_id"))
    rows = materialize(rows.dropDuplicates(["record_id"]), "subset-rows")
    # patterns are few bytes and much work
    parts = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = None
    wanted = [r for r in requests if (r["n_samples"] or 0) > 0]
    for scope in sorted({r["source"] for r in wanted}, key=lambda s: (s is not None, s or "")):
        mine = rows if scope is None else rows.where(F.col("source") == scope)
        patterns = mine.groupBy("sig").agg(*(F.first(c).alias(c) for c in ("elements", "shares", "config")), F.count("*").alias("n"), F.min_by("record_id", F.struct("h", "record_id")).alias("first_id"))
        patterns = materialize(patterns.repartition(parts, "sig"), "subset-patterns")
        times = patterns.groupBy("n").count().toPandas()
        centres = fit(patterns, max(clusters, int(np.ceil(np.sqrt(times["count"].sum())))), passes, seed_rows)

        def assign(batches: Iterator[pa.RecordBatch], centres: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.append_column("cluster", pa.array(_nearest(_batch(b), centres), pa.int32()))

        placed = materialize(patterns.mapInArrow(assign, patterns.withColumn("cluster", F.lit(0)).schema), "subset-placed")
        levels: dict[int, list[tuple[dict, int]]] = {}
        for r in (r for r in wanted if r["source"] == scope):
            k, left = level(times["n"].to_numpy(), times["count"].to_numpy(), int(r["n_samples"]))
            levels.setdefault(k, []).append((r, left))
        for k, asked in sorted(levels.items()):
            part = None
            if any(left for _, left in asked):
                open_ = placed.where(F.col("n") > k)
                chunks = open_.groupBy("cluster").agg(F.ceil(F.count("*") / chunk_rows).alias("chunks"))
                open_ = open_.join(F.broadcast(chunks), "cluster").withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), "sig"), F.col("chunks")))
                held = open_.groupBy("cluster", "chunk").count().orderBy("cluster", "chunk").toPandas()
                cluster, size = held["cluster"].to_numpy(), held["count"].to_numpy()
                total = np.bincount(cluster, size, len(centres)).astype(np.int64)
                kinds = int((total > 0).sum())
                small = [(r["params_id"], left) for r, left in asked if 0 < left < kinds]
                plan, most = [], np.full(len(held), FEW if small else 0, np.int64)
                for r, left in ((r, left) for r, left in asked if left >= kinds):
                    take = quotas(total, left, (r["strategy"] or "").strip().lower() == "element_set")
                    slots = np.zeros(len(held), np.int64)
                    for c in np.flatnonzero(take):
                        slots[cluster == c] = quotas(size[cluster == c], int(take[c]), False)
                    most = np.maximum(most, slots)
                    plan += [(r["params_id"], int(cluster[i]), int(held["chunk"][i]), int(slots[i])) for i in np.flatnonzero(slots)]
                # a row per request and part of a cluster, so both may be broadcast
                plan_df = spark.createDataFrame(plan, "params_id bigint, cluster int, chunk bigint, slots bigint")
                need = spark.createDataFrame([(int(cluster[i]), int(held["chunk"][i]), int(most[i])) for i in np.flatnonzero(most)], "cluster int, chunk bigint, most bigint")
                turns = open_.join(F.broadcast(need), ["cluster", "chunk"]).select("sig", "elements", "shares", "config", "first_id", "cluster", "chunk", "most")
                kept = turns.drop("most").withColumn("turn", F.lit(0).cast("bigint")).schema
                turns = materialize(turns.repartition(parts, "cluster", "chunk").groupBy("cluster", "chunk").applyInArrow(_order, kept), "subset-turns")
                part = turns.join(F.broadcast(plan_df), ["cluster", "chunk"]).where(F.col("turn") < F.col("slots")).select("params_id", "sig", "first_id", "cluster")
                if small:
                    firsts = turns.where(F.col("turn") < FEW).drop("turn").withColumn("most", F.lit(max(left for _, left in small)).cast("bigint"))
                    ask_df = spark.createDataFrame(small, "params_id bigint, slots bigint")
                    firsts = firsts.groupBy().applyInArrow(_order, kept).join(F.broadcast(ask_df), F.col("turn") < F.col("slots"))
                    part = part.unionByName(firsts.select("params_id", "sig", "first_id", "cluster"))
            if k == 0:
                part = part.select("params_id", F.col("first_id").alias("record_id"), "cluster")
            else:
                full = k >= times["n"].max()
                ranked = mine.select("record_id", "sig", "h").withColumn("rank", F.lit(1) if full else F.row_number().over(Window.partitionBy("sig").orderBy("h", "record_id")))
                ranked = ranked.where(F.col("rank") <= k + 1)
                base = ranked.where(F.col("rank") <= k).join(placed.select("sig", "cluster"), "sig")
                base = base.select(F.explode(F.array(*(F.lit(r["params_id"]).cast("bigint") for r, _ in asked))).alias("params_id"), "record_id", "cluster")
                more = None if part is None else ranked.where(F.col("rank") == k + 1).join(part.select("params_id", "sig", "cluster"), "sig").select("params_id", "record_id", "cluster")
                part = base if more is None else base.unionByName(more)
            out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "params_id bigint, record_id bigint, cluster int")
