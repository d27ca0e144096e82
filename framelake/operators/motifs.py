"""Local motifs and comparisons of distributions: signatures, rarity, coverage, agreement of labelings, held-out evaluation."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions.elements import RADIUS
from framelake.operators.neighbors import nearest, pairs_within, read_frames


def _shell(pos: np.ndarray, cell, pbc: np.ndarray, species: list[str], shell: str, value: float) -> list[np.ndarray] | None:
    """Neighbours of every atom: within a cutoff, within natural cutoffs, the nearest k, or up to the widest gap (4 to 14)."""
    if shell in ("cutoff", "natural"):
        r = np.array([RADIUS.get(s, 1.5) for s in species])
        most = value if shell == "cutoff" else 2 * value * float(r.max())
        _, i, j, d, _ = pairs_within([(pos, cell, pbc)], most)
        keep = np.ones(len(i), bool) if shell == "cutoff" else d <= value * (r[i] + r[j])
        return [j[keep & (i == a)] for a in range(len(pos))]
    k = int(value) if shell == "nearest" else 15
    got = nearest(pos, cell, pbc, k)
    if got is None:
        return None
    if shell == "nearest":
        return list(got[0])
    out = []
    for a in range(len(pos)):
        d = got[1][a]
        n = 4 + int((d[4:15] / d[3:14]).argmax())
        out.append(got[0][a][:n])
    return out


def signatures(df: DataFrame, shell: str = "natural", value: float = 1.2, mode: str = "count", key: str = "structure_id") -> DataFrame:
    """``key, atom, centre, neighbours, signature``: the elements around each atom (``count``), or the pairs of them that are bonded (``pair``)."""
    names = [key, "atom", "centre", "neighbours", "signature"]
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p.slice(x, 256) for p in batches for x in range(0, p.num_rows, 256)):
            rows: list[tuple] = []
            for i, ((pos, cell, pbc), species) in enumerate(zip(read_frames(b), b["species"].to_pylist())):
                if not species or len(species) != len(pos):
                    continue
                around = _shell(pos, cell, pbc, species, shell, value)
                if around is None:
                    continue
                for a, mine in enumerate(around):
                    if mode == "count":
                        c = Counter(species[j] for j in mine)
                        text = ",".join(f"{e}{n}" for e, n in sorted(c.items()))
                    else:
                        c = Counter("-".join(sorted((species[x], species[y]))) for n, x in enumerate(mine) for y in mine[n + 1 :] if y in around[x])
                        text = ",".join(f"{e}:{n}" for e, n in sorted(c.items()))
                    rows.append((i, a, species[a], len(mine), f"{species[a]}|{text}"))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.record_batch([b[key].take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], kinds))], names)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "species", "pos", "lattice", "pbc").mapInArrow(run, f"`{key}` {kind}, atom int, centre string, neighbours int, signature string")


def histogram(rows: DataFrame, by: str = "signature") -> DataFrame:
    """``by, n, share``."""
    counts = rows.groupBy(by).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.crossJoin(F.broadcast(total)).select(by, "n", (F.col("n") / F.col("t")).alias("share"))  # one row of totals


def entropy(rows: DataFrame, by: str = "signature") -> DataFrame:
    """``classes, entropy, evenness``: natural logarithm, and its part of the largest possible."""
    h = histogram(rows, by).agg(F.count("*").alias("classes"), F.sum(-F.col("share") * F.log("share")).alias("entropy"))
    return h.select("classes", "entropy", F.when(F.col("classes") > 1, F.col("entropy") / F.log("classes")).otherwise(0.0).alias("evenness"))


def rare(rows: DataFrame, most: int = 2, by: str = "signature", key: str = "structure_id") -> DataFrame:
    """``key, rare, kinds``: atoms with a signature that occurs at most ``most`` times anywhere, per structure."""
    few = rows.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") <= most).select(by)
    return rows.join(few, by).groupBy(key).agg(F.count("*").alias("rare"), F.count_distinct(by).alias("kinds"))


def universe(spark: SparkSession, elements: list[str], numbers: list[int]) -> DataFrame:
    """Every count signature of ``numbers`` neighbours: ``neighbours, counts, signature``."""
    rows = []
    for n in numbers:
        for combo in combinations_with_replacement(sorted(elements), n):
            c = Counter(combo)
            rows.append((n, dict(c), ",".join(f"{e}{k}" for e, k in sorted(c.items()))))
    return spark.createDataFrame(rows, "neighbours int, counts map<string,int>, around string")


def coverage(rows: DataFrame, shares: dict[str, float], numbers: list[int], ratio: float = 3.0) -> DataFrame:
    """``centre, neighbours, around, observed, expected, state`` against random surroundings of the given shares.

    Expected: the multinomial chance times the atoms with as many neighbours; missing, under, over or as expected.
    """
    spark = rows.sparkSession
    every = universe(spark, list(shares), numbers)
    logs = [F.coalesce(F.element_at("counts", e), F.lit(0)) for e in shares]
    chance = F.exp(sum((n * math.log(s) for n, s in zip(logs, shares.values())), F.lit(0.0))) * F.factorial("neighbours")
    for n in logs:
        chance = chance / F.factorial(n)
    every = every.withColumn("chance", chance)
    mine = rows.where(F.col("neighbours").isin(numbers)).withColumn("around", F.split("signature", "[|]")[1])
    totals = mine.groupBy("centre", "neighbours").agg(F.count("*").alias("total"))
    seen = mine.groupBy("centre", "neighbours", "around").agg(F.count("*").alias("observed"))
    both = totals.join(every, "neighbours").join(seen, ["centre", "neighbours", "around"], "left")
    observed, expected = F.coalesce("observed", F.lit(0)), F.col("chance") * F.col("total")
    state = F.when(observed == 0, "missing").when(observed * ratio < expected, "under").when(observed > ratio * expected, "over").otherwise("expected")
    return both.select("centre", "neighbours", "around", observed.alias("observed"), expected.alias("expected"), state.alias("state"))


def contingency(rows: DataFrame, a: str, b: str, top: int = 5) -> DataFrame:
    """``a, b, n, rank``: the ``top`` most frequent classes of ``b`` for each of ``a``."""
    counts = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(a).orderBy(F.desc("n"), b))).where(F.col("rank") <= top)


def purity(rows: DataFrame, a: str, b: str) -> DataFrame:
    """``a_to_b, b_to_a``: share of rows in the largest class of the other labeling."""
    counts = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    one = lambda x, name: counts.groupBy(x).agg(F.max("n").alias("m"), F.sum("n").alias("t")).agg((F.sum("m") / F.sum("t")).alias(name))
    return one(a, "a_to_b").crossJoin(one(b, "b_to_a"))  # one row each


def divergence(p: DataFrame, q: DataFrame, by: str = "signature", n: str = "n") -> float:
    """Jensen-Shannon divergence (natural logarithm) of two histograms; 0 if both are empty."""
    scaled = lambda df, name: df.groupBy(by).agg(F.sum(n).alias(name))
    both = scaled(p, "p").join(scaled(q, "q"), by, "full_outer").select(F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("q", F.lit(0)).alias("q"))
    total = both.agg(F.sum("p"), F.sum("q")).first()
    if not total[0] or not total[1]:
        return 0.0 if not total[0] and not total[1] else math.log(2)
    a, b = F.col("p") / float(total[0]), F.col("q") / float(total[1])
    term = lambda x: F.when(x > 0, x * F.log(2 * x / (a + b))).otherwise(0.0)
    return both.agg((F.sum(term(a)) + F.sum(term(b))) / 2).first()[0]


def average_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Rank from 1 with ties at their mean; ranks come from counts of distinct values, prefix-summed by range partitions."""
    from framelake.operators.filters import positions  # noqa: PLC0415

    counts = positions(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c")), [value], "ranks")
    block = F.floor(F.col("_at") / 65_536)
    counts = counts.withColumn("_b", block)
    sums = counts.groupBy("_b").agg(F.sum("_c").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per block
    inner = F.sum("_c").over(Window.partitionBy("_b").orderBy("_at")) - F.col("_c")
    placed = counts.withColumn("_i", inner).join(F.broadcast(sums.select("_b", before.alias("_o"))), "_b")
    ranks = placed.select(value, (F.col("_o") + F.col("_i") + (F.col("_c") + 1) / 2).alias(out))
    return df.join(ranks, value, "left")


def correlation(df: DataFrame, x: str, y: str, method: str = "pearson") -> float | None:
    """Pearson, or Spearman with average ranks."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    if method == "spearman":
        rows = average_rank(average_rank(rows, x, "_rx"), y, "_ry").select(F.col("_rx").alias(x), F.col("_ry").alias(y))
    return rows.agg(F.corr(x, y)).first()[0]


def shell_overlap(named: dict[str, DataFrame], top: int = 20) -> DataFrame:
    """``a, b, common, share`` of the ``top`` most frequent signatures under different shells."""
    best = {k: {r[0] for r in histogram(df).orderBy(F.desc("n"), "signature").limit(top).collect()} for k, df in named.items()}
    rows = [(a, b, len(best[a] & best[b]), len(best[a] & best[b]) / max(1, len(best[a] | best[b]))) for a in best for b in best if a < b]
    spark = next(iter(named.values())).sparkSession
    return spark.createDataFrame(rows, "a string, b string, common int, share double")


def stratified_split(df: DataFrame, stratum: str, key: str, share: float, seed: int = 0) -> DataFrame:
    """``df`` with ``held_out``: that share of every stratum (at least one of two or more), drawn by hash."""
    order = Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_n"))
    want = F.when(F.col("_n") > 1, F.greatest(F.lit(1), F.bround(F.col("_n") * share).cast("int"))).otherwise(0)
    return df.join(sizes, stratum).withColumn("held_out", F.row_number().over(order) <= want).drop("_n")


def proportional_quotas(sizes: dict[str, int], n: int, floor: int = 1) -> dict[str, int]:
    """``floor`` per stratum as far as it goes, the rest in proportion, by largest remainder."""
    out = {g: min(floor, s) for g, s in sizes.items()}
    left = n - sum(out.values())
    if left < 0:
        raise ValueError("fewer slots than the floors need")
    room = {g: sizes[g] - out[g] for g in sizes}
    left = min(left, sum(room.values()))
    exact = {g: left * r / max(1, sum(room.values())) for g, r in room.items()}
    add = {g: min(room[g], int(v)) for g, v in exact.items()}
    for g in sorted(exact, key=lambda g: (add[g] - exact[g], g)):
        if sum(add.values()) < left and add[g] < room[g]:
            add[g] += 1
    return {g: out[g] + add[g] for g in sizes}


def inverse_distance(train: DataFrame, test: DataFrame, key: str, vec: str, value: str, k: int = 5, block_rows: int = 512) -> DataFrame:
    """``key, predicted, actual``: mean of the nearest ``k`` training values weighted by inverse distance, block against block."""
    pack = lambda df, what: df.select(F.struct(*what).alias("r"), F.pmod(F.xxhash64(vec), F.lit(max(1, -(-df.count() // block_rows)))).alias("b")).groupBy("b").agg(F.collect_list("r").alias("rows"))
    left = pack(test, [F.col(key).alias("k"), F.col(vec).cast("array<double>").alias("v"), F.col(value).cast("double").alias("y")])
    right = pack(train, [F.col(vec).cast("array<double>").alias("v"), F.col(value).cast("double").alias("y")])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one, two in zip(b["a"].to_pylist(), b["o"].to_pylist()):
                x, y = np.array([r["v"] for r in two], float), np.array([r["y"] for r in two], float)
                for r in one:
                    d = np.sqrt(((x - np.array(r["v"])) ** 2).sum(1))
                    at = np.argsort(d, kind="stable")[:k]
                    yield pa.record_batch({"k": pa.array([r["k"]] * len(at), pa.int64()), "y": pa.array([r["y"]] * len(at), pa.float64()), "d": d[at], "t": y[at]})

    pairs = left.select(F.col("rows").alias("a")).crossJoin(right.select(F.col("rows").alias("o"))).mapInArrow(near, "k bigint, y double, d double, t double")
    best = pairs.groupBy("k").agg(F.first("y").alias("actual"), F.slice(F.array_sort(F.collect_list(F.struct("d", "t"))), 1, k).alias("n"))
    weight = F.transform("n", lambda n: 1 / (n["d"] + 1e-12))
    total = F.aggregate(weight, F.lit(0.0), lambda s, w: s + w)
    mean = F.aggregate(F.zip_with(weight, F.transform("n", lambda n: n["t"]), lambda w, t: w * t), F.lit(0.0), lambda s, v: s + v) / total
    return best.select(F.col("k").alias(key), mean.alias("predicted"), "actual")


def agreement(rows: DataFrame, methods: list[str]) -> DataFrame:
    """``a, b, n, same, share``: how often two methods give the same label."""
    pairs = [(a, b) for i, a in enumerate(methods) for b in methods[i + 1 :]]
    same: list[Column] = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), (F.col(a) == F.col(b)).cast("int")).alias("s")) for a, b in pairs]
    long = rows.select(F.explode(F.array(*same)).alias("x")).select("x.*").where("s IS NOT NULL")
    return long.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("s").alias("same"), F.avg("s").alias("share"))
