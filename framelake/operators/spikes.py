"""Implausible readings per source: invalid, stuck, and spikes.

Every source is cut into blocks of consecutive frame positions (bounded, so a
source with a third of all rows spreads over many tasks).  Inside a block each
measurement becomes a daily profile matrix - one row per day and repeat, one
column per hour - which robust principal components (principal component
pursuit) split into a low-rank part, the source's normal behaviour, and a
sparse part.  Readings close to the low-rank part are the ordinary core; all
others are candidates.  A reading whose sparse part is far above the block's usual
departure from the low-rank part is off the source's profile at that hour, even
where its value is common at other hours (reason ``off_profile``).  A block with fewer than ``min_core`` readings has no core
of its own: its readings are candidates of their source, or, if no block of the
source is large enough, they are pooled and the core is that of the pool.
Constant runs and ranges are tested separately:

* runs are found per block and stitched over block borders from per-block
  head and tail lengths only;
* the ordinary range is the core's range, widened by candidates no farther
  from it than its own width until nothing changes.  Candidates enter that
  fixed point as (min, max) per eighth-octave of distance, which is exact: once
  one reading of such a bucket is ordinary, the range is wider than the bucket.

Defined results: null readings are never reported; records with a null
position take no part in runs but in all other tests; a repeated record id
counts once; records with a null source form one source of their own; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.runtime import materialize

HOURS = 24
_OUT = "source string, field int, kind int, record_id bigint, value double, block bigint, head bigint, tail bigint, lo double, hi double"
_NAMES = [part.split()[0] for part in _OUT.split(", ")]
_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
CASE_INVALID, CASE_STUCK, CANDIDATE, PENDING, CORE, CHAIN, LOOSE, OFF = range(8)
#: Departures from the profile, in the block's median departure, from which the sparse part counts.
OFF_PROFILE = 12.0


def robust_components(m: np.ndarray, known: np.ndarray, steps: int = 18) -> tuple[np.ndarray, np.ndarray]:
    """Low-rank and sparse part of ``m``; entries not ``known`` are filled from the low-rank part.

    Inexact augmented Lagrangian; singular values are thresholded through the
    small Gram matrix of the columns.
    """
    m = np.where(known, m, 0.0)
    norm = np.linalg.norm(m, 2)
    if norm == 0:
        return np.zeros_like(m), np.zeros_like(m)
    lam = 1.0 / np.sqrt(max(m.shape))
    dual = m / max(norm, np.abs(m).max() / lam)
    mu, sparse, low = 1.25 / norm, np.zeros_like(m), np.zeros_like(m)
    for _ in range(steps):
        x = m - sparse + dual / mu
        w, v = np.linalg.eigh(x.T @ x)
        s = np.sqrt(np.maximum(w, 0))
        keep = s > 1.0 / mu
        low = (x @ v[:, keep]) * (1 - 1.0 / (mu * s[keep])) @ v[:, keep].T
        m = np.where(known, m, low)
        r = m - low + dual / mu
        sparse = np.where(known, np.sign(r) * np.maximum(np.abs(r) - lam / mu, 0), 0.0)
        dual = dual + mu * (m - low - sparse)
        mu *= 1.5
    return low, sparse


def ordinary_core(v: np.ndarray, day: np.ndarray, hour: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Masks of the readings close to the block's normal behaviour, and of those far off it, and that behaviour."""
    n, day = len(v), day - day.min(initial=0)
    if n < 4:
        core = np.abs(v - np.median(v)) <= np.median(np.abs(v - np.median(v))) if n else np.zeros(0, bool)
        return core, np.zeros(n, bool), v
    mid = np.median(v)
    scale = 1.4826 * np.median(np.abs(v - mid))
    if not scale > 0:
        scale = np.mean(np.sort(np.abs(v - mid))[: max(1, int(0.95 * n))]) or 1.0
    z = np.clip((v - mid) / scale, -30, 30)
    # one matrix row per day and repeat within the hour, one column per hour
    cell = day * HOURS + hour
    order = np.argsort(cell, kind="stable")
    start = np.r_[0, np.flatnonzero(np.diff(cell[order])) + 1]
    repeat = np.empty(n, np.int64)
    repeat[order] = np.arange(n) - np.repeat(start, np.diff(np.r_[start, n]))
    row = np.unique(day * (repeat.max() + 1) + repeat, return_inverse=True)[1]
    m, known = np.zeros((row.max() + 1, HOURS)), np.zeros((row.max() + 1, HOURS), bool)
    m[row, hour], known[row, hour] = z, True
    low, sparse = robust_components(m, known)
    normal = low[row, hour] * scale + mid
    away = np.abs(v - normal)
    usual = np.median(away)
    off = (sparse[row, hour] != 0) & (away > OFF_PROFILE * usual) & (away > 1e-9 * max(abs(mid), scale))
    for q in (0.9 if n >= 200 else 0.75, 0.95):
        core = away <= np.quantile(away, q)
        if v[core].max() > v[core].min():
            break
    return core, off, normal


def _close(a: np.ndarray, b: np.ndarray, tol: float) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return np.abs(a - b) <= tol * np.maximum(np.abs(a), np.abs(b))


def _block_function(signed: tuple[bool, ...], run: int, tol: float, min_core: int):
    def examine(key: tuple, t: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in _NAMES]
        source, block, placed = (x.as_py() for x in key)

        def emit(field: int, kind: int, ids=(), values=(), seg: int | None = None, each: dict | None = None, **one) -> None:
            n = max(len(ids), 1) if one else len(ids)
            cols = {"source": source, "field": field, "kind": kind, "block": block, "head": seg, **one}
            for name, acc in zip(_NAMES, out):
                if name == "record_id" and len(ids):
                    acc.append(pa.array(ids, pa.int64()))
                elif name == "value" and len(values):
                    acc.append(pa.array(values, pa.float64()))
                elif each and name in each:
                    acc.append(pa.array(each[name], _TYPES[_NAMES.index(name)]))
                else:
                    acc.append(pa.array([cols.get(name)] * n, _TYPES[_NAMES.index(name)]))

        pos = t["pos"].to_numpy(zero_copy_only=False).astype(float)
        rid = t["record_id"].to_numpy(zero_copy_only=False)
        order = np.lexsort((rid, pos))
        rid, pos = rid[order], pos[order]
        sec = t["sec"].to_numpy(zero_copy_only=False).astype(float)[order]
        good = np.flatnonzero(np.isfinite(sec))
        sec = np.interp(np.arange(len(sec)), good, sec[good]) if len(good) else np.zeros(len(sec))
        day = np.floor(sec / 86400).astype(np.int64)
        hour = np.floor(sec / 3600).astype(np.int64) - day * 24
        for k, neg in enumerate(signed):
            col = t[f"f{k}"]
            there = ~col.is_null().to_numpy(zero_copy_only=False)[order]
            v = col.fill_null(np.nan).to_numpy(zero_copy_only=False)[order][there]
            ids, d, h, p = rid[there], day[there], hour[there], pos[there]
            n = len(v)
            if not n:
                continue
            place = lambda at, p=p, d=d, h=h: {"lo": p[at], "hi": (d[at] * HOURS + h[at]).astype(float)}
            bad = ~np.isfinite(v) | (v < 0 if not neg else False)
            emit(k, CASE_INVALID, ids[bad], v[bad])
            stuck, pending = np.zeros(n, bool), np.zeros(n, int)
            if placed:
                brk = np.flatnonzero(~_close(v[1:], v[:-1], tol)) + 1
                edges = np.r_[0, brk, n]
                length = np.diff(edges)
                stuck = np.repeat(length >= run, length)
                single = len(length) == 1
                emit(k, CHAIN, lo=float(v[0]), hi=float(v[-1]), head=int(length[0]), tail=None if single else int(length[-1]))
                pending[edges[-2] :] = 2
                pending[: edges[1]] = 1
                pending[stuck | bad] = 0
                # bad readings of a short border run are reported already
            emit(k, CASE_STUCK, ids[stuck & ~bad], v[stuck & ~bad])
            for seg in (1, 2):
                m = pending == seg
                emit(k, PENDING, ids[m], v[m], seg=seg, each=place(m))
            rest = np.flatnonzero(~bad & ~stuck & (pending == 0))
            if len(rest) < min_core:
                emit(k, LOOSE, ids[rest], v[rest], each=place(rest))
            else:
                core, off, normal = ordinary_core(v[rest], d[rest], h[rest])
                emit(k, CANDIDATE, ids[rest][~core], v[rest][~core])
                emit(k, OFF, ids[rest][off], v[rest][off], each={"lo": normal[off]})
                c = v[rest][core]
                emit(k, CORE, lo=float(c.min()), hi=float(c.max()))
        return pa.table({n: pa.concat_arrays(a) if a else pa.array([], ty) for n, a, ty in zip(_NAMES, out, _TYPES)})

    return examine


def _pool(key: tuple, t: pa.Table) -> pa.Table:
    """Core and candidates of one source's readings from blocks too small for a core; ``lo`` is the position, ``hi`` the hour."""
    v, rid, pos, cell = (t[c].to_numpy() for c in ("value", "record_id", "lo", "hi"))
    order = np.lexsort((rid, pos))
    v, rid, cell = v[order], rid[order], cell[order].astype(np.int64)
    core = ordinary_core(v, cell // HOURS, cell % HOURS)[0]
    c, n = v[core], int((~core).sum())
    one = {"source": key[0].as_py(), "field": key[1].as_py(), "block": key[2].as_py()}
    rows = {name: [one.get(name)] * (n + 1) for name in _NAMES}
    rows |= {"kind": [CANDIDATE] * n + [CORE], "record_id": [*rid[~core].tolist(), None], "value": [*v[~core].tolist(), None]}
    rows |= {"lo": [None] * n + [float(c.min())], "hi": [None] * n + [float(c.max())]}
    return pa.table({name: pa.array(rows[name], ty) for name, ty in zip(_NAMES, _TYPES)})


def _widen(key: tuple, t: pa.Table) -> pa.Table:
    """Fixed point of one source's ordinary range over its bucketed candidates."""
    lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
    up = [(a, b) for a, b in zip(t["least"].to_pylist(), t["most"].to_pylist()) if a is not None]
    changed = True
    while changed:
        w, changed, left = hi - lo, False, []
        for a, b in up:
            if b < lo - w or a > hi + w:
                left.append((a, b))
            else:  # a bucket joins as a whole
                lo, hi, changed = min(lo, a), max(hi, b), True
        up = left
    return pa.table({"source": pa.array([key[0].as_py()], pa.string()), "field": pa.array([key[1].as_py()], pa.int32()), "lo": [lo], "hi": [hi]})


def _bucket(value: Column, lo: Column, hi: Column) -> Column:
    """Side and eighth-octave of the distance from [lo, hi], in its own width."""
    w = hi - lo
    far = F.greatest(value - hi, lo - value, F.lit(0.0)) / w + 1
    return F.when(w > 0, F.floor(F.log2(far) * 8) * F.when(value > hi, 1).otherwise(-1))


def implausible_readings(
    df: DataFrame,
    fields: dict[str, bool],
    *,
    record_id: str = "record_id",
    source: str = "source",
    position: str = "index",
    recorded_at: str = "recorded_at",
    min_run: int = 6,
    tolerance: float = 1e-7,
    block_rows: int = 8192,
    min_core: int = 64,
) -> tuple[DataFrame, DataFrame]:
    """(cases, ranges): cases hold ``record_id, field, reason, value, normal``; ranges hold ``source, field, lo, hi``.

    Reasons are invalid, stuck, spike and off_profile; the last has its value and what the profile would be, and may
    come beside another reason.

    ``fields`` maps a column to whether it may be negative.
    """
    names = list(fields)
    pos = F.col(f"`{position}`").cast("bigint")
    rows = df.select(
        F.col(f"`{record_id}`").cast("bigint").alias("record_id"),
        F.col(f"`{source}`").cast("string").alias("source"),
        pos.alias("pos"),
        (F.unix_micros(F.col(f"`{recorded_at}`").cast("timestamp")) / F.lit(1e6)).alias("sec"),
        *(F.col(f"`{f}`").cast("double").alias(f"f{k}") for k, f in enumerate(names)),
    ).dropDuplicates(["record_id"])
    # records without a position are spread over blocks of their own, as many as they fill; a row per source, so it may be broadcast
    free = df.where(pos.isNull()).groupBy(F.col(f"`{source}`").cast("string").alias("s")).agg(F.ceil(F.count("*") / block_rows).alias("blocks"))
    block = F.coalesce(F.floor(F.col("pos") / block_rows), F.pmod(F.xxhash64("record_id"), F.col("blocks")))
    found = materialize(
        rows.withColumn("placed", F.col("pos").isNotNull())
        .join(F.broadcast(free), ~F.col("placed") & F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        .withColumn("block", block).drop("blocks")
        .groupBy("source", "block", "placed")
        .applyInArrow(_block_function(tuple(fields.values()), min_run, tolerance, min_core), _OUT),
        "spikes",
    )
    by = Window.partitionBy("source", "field").orderBy("block", "seg")
    near = lambda a, b: F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))
    chain = found.where(F.col("kind") == CHAIN).withColumn("before", F.lag("hi").over(Window.partitionBy("source", "field").orderBy("block")))
    segs = chain.select(
        "source", "field", "block",
        F.inline(
            F.filter(
                F.array(
                    F.struct(F.lit(1).alias("seg"), F.col("head").alias("len"), (~F.coalesce(near(F.col("before"), F.col("lo")) & ~F.isnan("lo"), F.lit(False))).cast("int").alias("brk")),
                    F.struct(F.lit(2).alias("seg"), F.col("tail").alias("len"), F.lit(1).alias("brk")),
                ),
                lambda s: s["len"].isNotNull(),
            )
        ),
    )
    runs = segs.withColumn("run", F.sum("brk").over(by)).withColumn("total", F.sum("len").over(Window.partitionBy("source", "field", "run")))
    long_runs = runs.where(F.col("total") >= min_run).select(F.col("source").alias("s"), F.col("field").alias("f"), F.col("block").alias("b"), "seg")
    pending = found.where(F.col("kind") == PENDING)
    on = pending["source"].eqNullSafe(long_runs["s"]) & (pending["field"] == long_runs["f"]) & (pending["block"] == long_runs["b"]) & (pending["head"] == long_runs["seg"])
    open_ = pending.join(long_runs, on, "left").select("source", "field", "record_id", "value", F.col("seg").isNotNull().alias("stuck"), "lo", "hi")

    # readings without a block's judgement: of small blocks, and of short runs at a block's border
    loose = found.where(F.col("kind") == LOOSE).select("source", "field", "record_id", "value", F.lit(False).alias("stuck"), "lo", "hi").unionByName(open_.where(~F.col("stuck")))
    whole = found.where(F.col("kind") == CORE).select(F.col("source").alias("s"), F.col("field").alias("f")).distinct()
    alone = loose.groupBy("source", "field").agg(F.ceil(F.count("*") / max(block_rows, 16 * min_core)).alias("parts"))
    alone = alone.join(whole, alone["source"].eqNullSafe(whole["s"]) & (alone["field"] == whole["f"]), "left_anti").withColumnsRenamed({"source": "s", "field": "f"})
    same = loose["source"].eqNullSafe(alone["s"]) & (loose["field"] == alone["f"])
    pools = loose.join(alone, same).withColumn("block", F.pmod(F.xxhash64("record_id"), F.col("parts"))).select("source", "field", "block", "record_id", "value", "lo", "hi")
    pooled = materialize(pools.groupBy("source", "field", "block").applyInArrow(_pool, _OUT), "spike-pools")
    candidate = found.where(F.col("kind") == CANDIDATE).unionByName(pooled.where(F.col("kind") == CANDIDATE)).select("source", "field", "record_id", "value", F.lit(False).alias("stuck"))
    readings = candidate
    for part in (loose.join(alone, same, "left_anti"), open_.where(F.col("stuck"))):
        readings = readings.unionByName(part.drop("lo", "hi"))
    cores = found.where(F.col("kind") == CORE).unionByName(pooled.where(F.col("kind") == CORE))
    cores = cores.groupBy("source", "field").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    def with_core(left: DataFrame, right: DataFrame) -> DataFrame:
        r = right.withColumnsRenamed({"source": "s", "field": "f"})
        return left.join(r, left["source"].eqNullSafe(r["s"]) & (left["field"] == r["f"])).drop("s", "f")

    open_readings = with_core(readings.where(~F.col("stuck")), cores).withColumn("bucket", _bucket(F.col("value"), F.col("lo"), F.col("hi")))
    # with a core of no width every other value keeps a bucket of its own sign
    flat = F.when(F.col("bucket").isNull(), F.signum(F.col("value") - F.col("lo")))
    packed = open_readings.groupBy("source", "field", "bucket", flat.alias("flat")).agg(F.min("value").alias("least"), F.max("value").alias("most"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    packed = packed.select("source", "field", "least", "most", "lo", "hi").unionByName(
        cores.select("source", "field", F.col("lo").alias("least"), F.col("hi").alias("most"), "lo", "hi")
    )
    ranges = materialize(packed.groupBy("source", "field").applyInArrow(_widen, "source string, field int, lo double, hi double"), "spike-ranges")
    judged = with_core(readings.where(~F.col("stuck")), ranges)
    width = F.col("hi") - F.col("lo")
    spikes = judged.where((F.col("value") > F.col("hi") + width) | (F.col("value") < F.col("lo") - width)).select("record_id", "field", F.lit("spike").alias("reason"))
    sure = found.where(F.col("kind").isin(CASE_INVALID, CASE_STUCK)).select("record_id", "field", F.when(F.col("kind") == CASE_INVALID, "invalid").otherwise("stuck").alias("reason"))
    stitched = readings.where(F.col("stuck")).select("record_id", "field", F.lit("stuck").alias("reason"))
    label = F.element_at(F.array(*(F.lit(f) for f in names)), F.col("field") + 1).alias("field")
    none = F.lit(None).cast("double")
    off = found.where(F.col("kind") == OFF).select("record_id", "field", F.lit("off_profile").alias("reason"), "value", F.col("lo").alias("normal"))
    plain = sure.unionByName(stitched).unionByName(spikes).select("record_id", "field", "reason", none.alias("value"), none.alias("normal"))
    cases = plain.unionByName(off).select("record_id", label, "reason", "value", "normal")
    return cases, ranges.select("source", label, "lo", "hi")


AUDIT_FIELDS = {"max_force": False, "energy_per_atom": True, "virial_norm": False}
