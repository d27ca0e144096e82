"""Local chemistry: neighbour counts and fractions per centre element, and contacts of element pairs against chance.

Cutoffs come from a model's header: each pair's is the mean of its elements'.
One pass over the structures finds neighbours up to the largest cutoff and emits
small counts; histograms and sums are ordinary aggregates.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions.elements import NUMBER
from framelake.operators.neighbors import pairs_within, read_frames

SCOPES = ("angular", "radial")


@dataclass(frozen=True)
class CutoffProfile:
    """Elements of a model with their radial and angular cutoffs."""

    elements: tuple[str, ...]
    radial: tuple[float, ...]
    angular: tuple[float, ...]

    def pair(self, a: str, b: str, scope: str) -> float:
        values = {"radial": self.radial, "angular": self.angular}[scope]
        return (values[self.elements.index(a)] + values[self.elements.index(b)]) / 2

    def matrix(self, scope: str) -> np.ndarray:
        v = np.array({"radial": self.radial, "angular": self.angular}[scope])
        return (v[:, None] + v[None, :]) / 2


def parse_cutoffs(text: str) -> CutoffProfile:
    """Profile of a model file: a header ``nep<version> count symbols...`` and a line ``cutoff`` with 4 or 2 n + 2 numbers."""
    lines = [line.split() for line in text.splitlines() if line.strip()]
    if not lines or not lines[0][0].startswith("nep") or len(lines[0]) < 3 or not lines[0][1].isdigit():
        raise ValueError("no model header")
    names = tuple(lines[0][2:])
    if len(names) != int(lines[0][1]) or len(set(names)) != len(names) or not set(names) <= set(NUMBER):
        raise ValueError("the header's elements are unknown, repeated or not as many as stated")
    line = next((t for t in lines[1:] if t[0] == "cutoff"), None)
    if line is None:
        raise ValueError("no cutoff line")
    try:
        values = [float(x) for x in line[1:]]
    except ValueError as e:
        raise ValueError("a cutoff is no number") from e
    n = len(names)
    if len(values) == 4:
        radial, angular = (values[0],) * n, (values[1],) * n
    elif len(values) == 2 * n + 2:
        radial, angular = tuple(values[0 : 2 * n : 2]), tuple(values[1 : 2 * n : 2])
    else:
        raise ValueError("the cutoff line does not fit the number of elements")
    if any(not math.isfinite(v) or v <= 0 for v in radial + angular) or any(a > r for r, a in zip(radial, angular)):
        raise ValueError("cutoffs must be finite and positive, angular ones at most radial")
    return CutoffProfile(names, radial, angular)


def read_cutoffs(spark: SparkSession, path: str) -> CutoffProfile:
    """Profile of the model file at ``path``; only its first lines are fetched."""
    return parse_cutoffs("\n".join(r[0] for r in spark.read.text(path).limit(16).collect()))


def _frames(b: pa.RecordBatch, profile: CutoffProfile) -> Iterator[tuple[int, tuple, np.ndarray]]:
    at = {e: i for i, e in enumerate(profile.elements)}
    for x, (frame, species) in enumerate(zip(read_frames(b), b["species"].to_pylist())):
        if species and len(species) == len(frame[0]) and set(species) <= set(at):
            yield x, frame, np.array([at[s] for s in species])


def environments(df: DataFrame, profile: CutoffProfile, key: str = "structure_id") -> DataFrame:
    """``key, scope, centre, atom, neighbours, counts``: neighbours of every atom within its pair cutoffs, by element."""
    matrices = {s: profile.matrix(s) for s in SCOPES}
    names = [key, "scope", "centre", "atom", "neighbours", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p.slice(x, 512) for p in batches for x in range(0, p.num_rows, 512)):
            read = list(_frames(b, profile))
            s, i, j, d, _ = pairs_within([f for _, f, _ in read], float(matrices["radial"].max()))
            size = np.array([len(t) for *_, t in read], np.int64)
            offset = np.r_[0, np.cumsum(size)]
            kind = np.concatenate([t for *_, t in read]) if read else np.zeros(0, np.int64)
            gi, gj = offset[s] + i, offset[s] + j
            rows = np.array([x for x, *_ in read], np.int64)
            k = len(profile.elements)
            for scope in SCOPES:
                inside = d < matrices[scope][kind[gi], kind[gj]]
                counts = np.bincount(gi[inside] * k + kind[gj[inside]], minlength=len(kind) * k).reshape(-1, k)
                yield pa.record_batch([
                    b[key].take(pa.array(np.repeat(rows, size))), pa.array([scope] * len(kind), pa.string()), pa.array([profile.elements[t] for t in kind], pa.string()),
                    pa.array(np.arange(len(kind)) - np.repeat(offset[:-1], size), pa.int32()), pa.array(counts.sum(1), pa.int32()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(kind) + 1) * k, pa.int32()), pa.array(counts.ravel(), pa.int32())),
                ], names)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "species", "pos", "lattice", "pbc").mapInArrow(run, f"`{key}` {kind}, scope string, centre string, atom int, neighbours int, counts array<int>")


def chemistry_histograms(environment: DataFrame, profile: CutoffProfile, key: str = "structure_id") -> DataFrame:
    """``scope, centre, metric, bin, environments, share, sparse, structures``.

    ``metric`` is ``neighbours`` (bins are the counts) or ``fraction:<element>`` (ten
    bins; atoms without neighbours take no part); a bin with under a tenth is sparse.
    """
    bins = [F.struct(F.lit("neighbours").alias("metric"), F.col("neighbours").cast("int").alias("bin"))]
    for i, e in enumerate(profile.elements):
        f = F.col("counts")[i] / F.col("neighbours")
        bins.append(F.when(F.col("neighbours") > 0, F.struct(F.lit(f"fraction:{e}").alias("metric"), F.least(F.floor(f * 10), F.lit(9)).cast("int").alias("bin"))))
    rows = environment.select(key, "scope", "centre", F.explode(F.array_compact(F.array(*bins))).alias("m")).select(key, "scope", "centre", "m.*")
    # two steps, so that distinct structures are counted from one row each
    per = rows.groupBy("scope", "centre", "metric", "bin", key).agg(F.count("*").alias("n"))
    counts = per.groupBy("scope", "centre", "metric", "bin").agg(F.sum("n").alias("environments"), F.count("*").alias("structures"))
    share = F.col("environments") / F.sum("environments").over(Window.partitionBy("scope", "centre", "metric"))
    return counts.withColumn("share", share).withColumn("sparse", F.col("share") < 0.10)


def pair_contacts(df: DataFrame, profile: CutoffProfile, key: str = "structure_id") -> DataFrame:
    """Contacts of every pair of elements within its cutoff, and how many chance would give.

    ``scope, a, b, co_occurring, contact_structures, contacts, opportunities, expected, ratio, exposed_a, exposed_b,
    distance_q50, near_cutoff, support``.  Expectation: the geometric pairs of a structure times the chance that
    two of its atoms, drawn without replacement, are the pair.  Distances (in cutoffs) are described
    only for pairs of low support.
    """
    pairs = list(combinations_with_replacement(range(len(profile.elements)), 2))
    matrices = {s: profile.matrix(s) for s in SCOPES}
    names = [key, "scope", "a", "b", "contacts", "opportunities", "expected", "centres_a", "centres_b", "met_a", "met_b", "distances"]
    kinds = [None, pa.string(), pa.string(), pa.string(), *[pa.int64()] * 2, pa.float64(), *[pa.int64()] * 4, pa.list_(pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p.slice(x, 512) for p in batches for x in range(0, p.num_rows, 512)):
            read = list(_frames(batch, profile))
            s, i, j, d, _ = pairs_within([f for _, f, _ in read], float(matrices["radial"].max()))
            order = np.argsort(s, kind="stable")
            s, i, j, d = s[order], i[order], j[order], d[order]
            edge = np.searchsorted(s, np.arange(len(read) + 1))
            out: list[list] = [[] for _ in names]
            for x, (row, _, kind) in enumerate(read):
                part = slice(edge[x], edge[x + 1])
                ci, cj, dist = i[part], j[part], d[part]
                count, n, own = Counter(kind.tolist()), len(kind), ci == cj
                for scope in SCOPES:
                    for a, b in pairs:
                        na, nb, same = count[a], count[b], a == b
                        if na < (2 if same else 1) or nb < 1:
                            continue
                        cutoff = float(matrices[scope][a, b])
                        near = dist < cutoff
                        if not same:
                            near = near & ~own
                        apart, self_pairs = int((near & ~own).sum()), int((near & own).sum())
                        chance = na * (na - 1) / (n * (n - 1)) if same else 2 * na * nb / (n * (n - 1))
                        expected = apart * chance + (self_pairs * na / n if same else 0.0)
                        ab, ba = near & (kind[ci] == a) & (kind[cj] == b), near & (kind[ci] == b) & (kind[cj] == a)
                        met = ab if same else ab | ba
                        values = (row, scope, profile.elements[a], profile.elements[b], int(met.sum()), apart + self_pairs, expected, na, 0 if same else nb, len(set(ci[ab].tolist())), 0 if same else len(set(ci[ba].tolist())), (dist[met] / cutoff).tolist())
                        for acc, v in zip(out, values):
                            acc.append(v)
            yield pa.record_batch([batch[key].take(pa.array(out[0], pa.int64())), *(pa.array(c, t) for c, t in zip(out[1:], kinds[1:]))], names)

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, scope string, a string, b string, contacts bigint, opportunities bigint, expected double, centres_a bigint, centres_b bigint, met_a bigint, met_b bigint, distances array<double>"
    rows = df.select(key, "species", "pos", "lattice", "pbc").mapInArrow(run, schema)
    total = lambda c: F.sum(c).alias(c)
    # a pair of low support has under 20 contacts, or under three structures with any; of others no distance is kept
    few = F.when(F.size("distances") > 0, F.struct(F.col(key).alias("k"), F.col("distances").alias("d")))
    sums = rows.groupBy("scope", "a", "b").agg(
        F.count("*").alias("co_occurring"), F.count_if(F.col("contacts") > 0).alias("contact_structures"), *map(total, ("contacts", "opportunities", "expected", "centres_a", "centres_b", "met_a", "met_b")),
        F.min_by("distances", F.when(F.size("distances") > 0, F.col(key))).alias("d1"), F.max_by("distances", F.when(F.size("distances") > 0, F.col(key))).alias("d2"), F.count_distinct(few["k"]).alias("holders"),
    )
    low = (F.col("contacts") > 0) & ((F.col("contacts") < 20) | (F.col("contact_structures") < 3))
    # under three structures the two outermost hold every distance; the others come from a second look at the few pairs
    wide = sums.where(low & (F.col("contact_structures") >= 3)).select("scope", "a", "b")
    more = rows.join(F.broadcast(wide), ["scope", "a", "b"]).groupBy("scope", "a", "b").agg(F.flatten(F.collect_list("distances")).alias("d3"))  # at most as many rows as pairs of elements, each under 20 distances
    both = F.when(F.col("contact_structures") == 1, F.col("d1")).otherwise(F.concat("d1", "d2"))
    values = F.array_sort(F.coalesce("d3", both))
    n = F.size(values)
    median = (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2
    support = F.when(F.col("contacts") == 0, "no local contact").when(low, "low support").otherwise("multi-structure support")
    return sums.join(more, ["scope", "a", "b"], "left").select(
        "scope", "a", "b", "co_occurring", "contact_structures", "contacts", "opportunities", "expected", F.try_divide("contacts", "expected").alias("ratio"),
        F.try_divide("met_a", "centres_a").alias("exposed_a"), F.try_divide("met_b", "centres_b").alias("exposed_b"),
        F.when(low, F.round(median, 4)).alias("distance_q50"), F.when(low, F.round(F.size(F.filter(values, lambda v: v > 0.95)) / n, 4)).alias("near_cutoff"), support.alias("support"),
    )
