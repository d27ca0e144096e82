"""Filling containers of fixed capacity with items, from the histogram of their lengths.

Only the histogram (one count per length up to the capacity) comes to the
driver.  There, combinations of a few lengths that fill a window below the
capacity are enumerated, non-negative least squares finds how often to repeat
each so that together they use up the histogram, the counts are rounded down,
and what is left is packed greedily (largest first, best fit).  The plan gives
each rank within a length its container, so the assignment is one lookup per
item, in parallel; ranks are counted per salted part of a length.

An item above the capacity is cut into full containers and a rest.  Defined
results: null and empty texts have size 0 and share container 0; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.runtime import materialize

TOKEN = r"[A-Za-z0-9]+|[^A-Za-z0-9 \t\r\n]"
SALTS = 64


def token_count(text: Column) -> Column:
    """Number of matches of :data:`TOKEN` in ``text``; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("bigint")


def combinations(lengths: np.ndarray, capacity: int, window: float = 0.01, depth: int = 4, fan: int = 6) -> list[tuple[int, ...]]:
    """Descending combinations of up to ``depth`` lengths with a sum in the window below ``capacity``."""
    low, found = capacity - max(1, int(window * capacity)), set()
    lengths = np.sort(lengths)

    def extend(chosen: tuple[int, ...], room: int) -> None:
        if capacity - room >= low:
            found.add(chosen)
        if len(chosen) == depth:
            return
        top = int(np.searchsorted(lengths, min(room, chosen[-1]), side="right"))
        if not top:
            return
        # the best fits, and for deeper ones lengths spread over what fits
        picks = {*range(max(0, top - 3), top)}
        if len(chosen) < depth - 1:
            picks |= set(np.linspace(0, top - 1, fan).astype(int).tolist())
        for i in picks:
            extend((*chosen, int(lengths[i])), room - int(lengths[i]))

    for a in lengths:
        extend((int(a),), capacity - int(a))
    return sorted(found)


def least_squares(combos: list[tuple[int, ...]], hist: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative repeats of ``combos`` whose use of each length comes closest to ``hist``."""
    if not combos:
        return np.zeros(0)
    col = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    row = np.concatenate([np.array(c) for c in combos])
    used = lambda x: np.bincount(row, x[col], len(hist))
    back = lambda r: np.bincount(col, r[row], len(combos))
    # largest eigenvalue by power iteration, then accelerated projected gradient
    v = np.ones(len(combos))
    for _ in range(20):
        v = back(used(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(used(y) - hist) / (norm * 1.05))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan(hist: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats), using up ``hist`` exactly."""
    left = hist.copy()
    left[0] = 0
    combos = combinations(np.flatnonzero(left), capacity)
    repeats = least_squares(combos, left.astype(float))
    out: list[tuple[tuple[int, ...], int]] = []
    for i in np.lexsort((np.arange(len(combos)), -repeats)):
        lens, copies = np.unique(combos[i], return_counts=True)
        times = int(min(np.floor(repeats[i] + 1e-6), (left[lens] // copies).min()))
        if times > 0:
            left[lens] -= copies * times
            out.append((combos[i], times))
    # greedy: the longest item, then always the longest that still fits
    while left.any():
        have = left.copy()
        room, chosen = capacity, []
        while True:
            fit = np.flatnonzero(have[: room + 1])
            if not len(fit):
                break
            chosen.append(int(fit[-1]))
            have[fit[-1]] -= 1
            room -= int(fit[-1])
        lens, copies = np.unique(chosen, return_counts=True)
        times = int((left[lens] // copies).min())
        left[lens] -= copies * times
        out.append((tuple(chosen), times))
    return out


def lookup(plans: list[tuple[tuple[int, ...], int]], length_count: int) -> tuple[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
    """Per length: first ranks, first containers and copies per container; and the number of containers."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    seen = np.zeros(length_count, np.int64)
    first = 0
    for combo, times in plans:
        for length, copies in zip(*np.unique(combo, return_counts=True)):
            rows.setdefault(int(length), []).append((int(seen[length]), first, int(copies)))
            seen[length] += int(copies) * times
        first += times
    return {k: tuple(np.array(v).T) for k, v in rows.items()}, first


def pack(docs: DataFrame, containers: list[tuple[str, int]], *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``container, bin, doc_id, piece, pieces, tokens, start``: where each document or piece of one goes."""
    spark = docs.sparkSession
    sizes = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), token_count(F.col(f"`{text}`")).alias("size"))
    kinds = F.array(*(F.struct(F.lit(n).alias("container"), F.lit(c).cast("bigint").alias("capacity")) for n, c in containers))
    items = sizes.withColumn("k", F.explode(kinds)).select("doc_id", "size", "k.container", "k.capacity")
    items = items.withColumn("rest", F.when(F.col("size") > F.col("capacity"), F.col("size") % F.col("capacity")).otherwise(F.col("size")))
    items = items.withColumn("full", F.when(F.col("size") > F.col("capacity"), F.floor(F.col("size") / F.col("capacity"))).otherwise(0).cast("bigint"))
    items = items.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    items = materialize(items, "pack-items")
    rest = items.where((F.col("rest") > 0) | (F.col("full") == 0))
    counts = materialize(rest.groupBy("container", "rest", "salt").count(), "pack-counts")
    hist = counts.groupBy("container", "rest").agg(F.sum("count").alias("n")).toPandas()
    tables, bins = {}, {}
    for name, capacity in containers:
        h = np.zeros(capacity + 1, np.int64)
        part = hist[hist["container"] == name]
        h[part["rest"].to_numpy(np.int64)] = part["n"].to_numpy(np.int64)
        tables[name], bins[name] = lookup(plan(h, capacity), capacity + 1)
    before = Window.partitionBy("container", "rest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    local = F.row_number().over(Window.partitionBy("container", "rest", "salt").orderBy("doc_id")) - 1
    ranked = rest.withColumn("local", local).join(offsets, ["container", "rest", "salt"]).withColumn("rank", F.col("local") + F.col("offset"))
    number = {n: i for i, (n, _) in enumerate(containers)}
    shared = spark.sparkContext.broadcast(tables)  # bounded by the capacities, not by the rows

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, length, rank = b["container"].to_pylist(), b["rest"].to_numpy(), b["rank"].to_numpy()
            where = np.zeros(len(rank), np.int64)
            group = np.array([number[n] for n in names], np.int64) * (1 << 32) + length
            for g in np.unique(group):
                at = np.flatnonzero(group == g)
                rows = shared.value[names[at[0]]].get(int(length[at[0]]))
                if rows is None:  # size 0
                    continue
                start, first, copies = rows
                i = np.searchsorted(start, rank[at], side="right") - 1
                where[at] = first[i] + (rank[at] - start[i]) // copies[i]
            yield pa.RecordBatch.from_arrays([b["container"], pa.array(where), b["doc_id"], b["full"], b["full"], b["rest"], b["capacity"]], ["container", "bin", "doc_id", "piece", "full", "tokens", "capacity"])

    placed = ranked.select("container", "doc_id", "full", "rest", "capacity", "rank").mapInArrow(place, "container string, bin bigint, doc_id bigint, piece bigint, full bigint, tokens bigint, capacity bigint")
    # full pieces fill containers of their own, numbered behind the others by document
    split = items.where(F.col("full") > 0)
    per = materialize(split.groupBy("container", "salt").agg(F.sum("full").alias("n")), "pack-full")
    base = F.element_at(F.create_map(*(x for n, b in bins.items() for x in (F.lit(n), F.lit(b)))), F.col("container")).cast("bigint")
    start = per.withColumn("base", base + F.coalesce(F.sum("n").over(Window.partitionBy("container").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ahead = F.coalesce(F.sum("full").over(Window.partitionBy("container", "salt").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = split.withColumn("ahead", ahead).join(start, ["container", "salt"])
    whole = whole.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)))
    whole = whole.select("container", (F.col("base") + F.col("ahead") + F.col("piece")).alias("bin"), "doc_id", "piece", "full", F.col("capacity").alias("tokens"), "capacity", "rest")
    ends = placed.withColumn("rest", F.col("tokens"))
    out = ends.unionByName(whole).withColumn("pieces", F.col("full") + (F.col("rest") > 0).cast("bigint"))
    return out.select("container", "bin", "doc_id", "piece", F.greatest("pieces", F.lit(1)).alias("pieces"), "tokens", (F.col("piece") * F.col("capacity")).alias("start"))
