"""Crystal phases of structures from neighbour topology, shell geometry and chemistry.

Per atom: common-neighbour analysis of the nearest 12 and 14 neighbours (ordinary
adaptive CNA, Stukowski 2012).  Per structure: fractions of the classes, matching
of the neighbour shells to templates of ordered prototypes, and one label with its
strength.  All inside the structure, in Arrow batches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.generators.cells import PROTOTYPES
from framelake.operators.audit import symbols_point
from framelake.operators.neighbors import by_size, frame_arrays, nearest, nearest_many, pieces

CLASSES = ("fcc", "hcp", "bcc", "other")
STRONG, MIXED = 0.80, 0.50
#: Least share of matching atoms for a prototype: geometry, chemistry, both.
MATCH = (0.82, 0.80, 0.80)


def _signatures(vectors: np.ndarray, n: int, cutoff: float) -> Counter:
    """(common neighbours, bonds among them, longest chain of these bonds) of each of the first ``n`` neighbours."""
    v = vectors[:n]
    bonded = np.linalg.norm(v[:, None] - v[None], axis=2) <= cutoff
    np.fill_diagonal(bonded, False)
    out: Counter = Counter()
    for a in range(n):
        common = np.flatnonzero(bonded[a])
        sub = bonded[np.ix_(common, common)]
        out[len(common), int(sub.sum()) // 2, _longest_chain(sub)] += 1
    return out


def _longest_chain(adjacent: np.ndarray) -> int:
    """Most bonds in one connected run of common neighbours."""
    left, best = set(range(len(adjacent))), 0
    while left:
        queue, part = [left.pop()], []
        while queue:
            a = queue.pop()
            part.append(a)
            near = [b for b in np.flatnonzero(adjacent[a]) if b in left]
            left -= set(near)
            queue += near
        best = max(best, int(adjacent[np.ix_(part, part)].sum()) // 2)
    return best


def classify(distances: np.ndarray, vectors: np.ndarray, gap: float = 1.08) -> str:
    """Class of one atom from its nearest neighbours in order of distance.

    Close-packed classes need a gap of that ratio after the twelfth neighbour, bcc after the fourteenth.
    """
    if len(distances) >= 13 and distances[12] / distances[11] >= gap:
        s = _signatures(vectors, 12, distances[:12].mean() * (1 + np.sqrt(2)) / 2)
        if s[4, 2, 1] == 12:
            return "fcc"
        if s[4, 2, 1] == 6 and s[4, 2, 2] == 6:
            return "hcp"
    if len(distances) >= 15 and distances[14] / distances[13] >= gap:
        unit = (distances[:8].mean() * 2 / np.sqrt(3) + distances[8:14].mean()) / 2
        s = _signatures(vectors, 14, unit * (1 + np.sqrt(2)) / 2)
        if s[4, 4, 3] + s[4, 4, 4] == 6 and s[6, 6, 5] + s[6, 6, 6] == 8:
            return "bcc"
    return "other"


def shell_profile(distances: np.ndarray, same: np.ndarray, shells: int = 3, tolerance: float = 0.08) -> list[tuple[float, int, int]]:
    """Relative distance, size and number of like atoms of the first shells; a shell ends at a jump."""
    out, start, scale = [], 0, distances[0]
    for i in range(1, len(distances) + 1):
        if i == len(distances) or distances[i] > distances[i - 1] * (1 + tolerance):
            out.append((float(distances[start:i].mean() / scale), i - start, int(same[start:i].sum())))
            start = i
            if len(out) == shells:
                break
    return out[:shells]


def template(kind: str, covera: float = 1.633, k: int = 24) -> list[list[tuple[float, int, int]]]:
    """Shell profiles of a prototype's inequivalent atoms."""
    cell, sites = PROTOTYPES[kind]
    lattice = cell(4.0, 1.0 if kind == "l10" else covera)
    pos = np.array([s for s, _ in sites]) % 1.0 @ lattice
    species = np.array([s for _, s in sites])
    j, d, _ = nearest(pos, lattice, np.ones(3, bool), k)
    return [shell_profile(d[i], species[j[i]] == species[i]) for i in range(len(pos))]


TEMPLATES = {k: template(k) for k in ("diamond", "l12", "b2", "l10", "b1", "b3")}


def matches(profile: list, wanted: list, shells: int = 2, tolerance: float = 0.06) -> tuple[bool, bool]:
    """Whether geometry, and also chemistry, of the first shells agree."""
    if len(profile) < shells or len(wanted) < shells:
        return False, False
    geometry = all(abs(a[0] - b[0]) <= tolerance and a[1] == b[1] for a, b in zip(profile[:shells], wanted[:shells]))
    return geometry, geometry and all(a[2] == b[2] for a, b in zip(profile[:shells], wanted[:shells]))


def translational_order(vectors: np.ndarray) -> float:
    """Share of neighbour vectors whose opposite is there too: 1 with inversion symmetry."""
    d = np.linalg.norm(vectors, axis=1)
    scale, whole = d[0], 8 + int((d[8:] / d[7:-1]).argmax()) if len(d) > 8 else len(d)
    vectors = vectors[:whole]  # complete shells only
    away = np.linalg.norm(vectors[:, None] + vectors[None], axis=2).min(1)
    return float((away < 0.15 * scale).mean())


def classify_many(d: np.ndarray, v: np.ndarray, gap: float = 1.08) -> np.ndarray:
    """Places in :data:`CLASSES` of atoms by :func:`classify`, in order of their distance."""
    wide = lambda i: np.flatnonzero(d[:, i] / d[:, i - 1] >= gap) if d.shape[1] > i else np.zeros(0, int)
    out = np.full(len(d), CLASSES.index("other"))

    def bonds(at: np.ndarray, n: int, cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bonds between the first neighbours, common neighbours of two that are bonded, and bonds among the common ones of each."""
        near = v[at, :n]
        b = (np.linalg.norm(near[:, :, None] - near[:, None], axis=3) <= cutoff[:, None, None]).astype(np.float32)
        b[:, np.arange(n), np.arange(n)] = 0
        common = (b @ b) * b
        return b, common, common.sum(2) / 2

    for at in _blocks(wide(12)):
        b, common, among = bonds(at, 12, d[at, :12].mean(1) * (1 + np.sqrt(2)) / 2)
        close = ((b.sum(2) == 4) & (among == 2)).all(1)
        chains = (common.max(2) == 2).sum(1)  # two bonds of the common neighbours meet
        out[at[close & (chains == 0)]], out[at[close & (chains == 6)]] = CLASSES.index("fcc"), CLASSES.index("hcp")
    for at in _blocks(wide(14)):
        at = at[out[at] == CLASSES.index("other")]
        unit = (d[at, :8].mean(1) * 2 / np.sqrt(3) + d[at, 8:14].mean(1)) / 2
        b, _, among = bonds(at, 14, unit * (1 + np.sqrt(2)) / 2)
        degree = b.sum(2)
        six = (degree == 6) & (among == 6)
        likely = np.flatnonzero((((degree == 4) & (among == 4)).sum(1) == 6) & (six.sum(1) == 8))
        if len(likely):
            # six common neighbours with six bonds are one chain of five or six unless they are two triangles
            sub = b[likely][:, :, :, None] * b[likely][:, :, None, :] * b[likely][:, None]
            triangles = np.einsum("paij,paji->pa", sub @ sub, sub) / 6
            rings = (sub.sum(3) == 2).sum(2) == 6
            out[at[likely[~(six[likely] & rings & (triangles == 2)).any(1)]]] = CLASSES.index("bcc")
    return out


def _blocks(at: np.ndarray, rows: int = 2_000) -> Iterator[np.ndarray]:
    return (at[x : x + rows] for x in range(0, len(at), rows))


def shell_profiles(d: np.ndarray, same: np.ndarray, shells: int = 3, tolerance: float = 0.08) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`shell_profile` of many atoms: relative distance, size and like atoms of the shells; size 0 where there is none."""
    shell = np.zeros(d.shape, np.int8)
    shell[:, 1:] = np.cumsum(d[:, 1:] > d[:, :-1] * (1 + tolerance), axis=1)
    size, like, far = (np.zeros((len(d), shells), t) for t in (int, int, float))
    for i in range(shells):
        inside = shell == i
        size[:, i], like[:, i] = inside.sum(1), (inside & same).sum(1)
        far[:, i] = np.einsum("ij,ij->i", d, inside) / np.maximum(size[:, i], 1) / d[:, 0]
    return far, size, like


def template_hits(far: np.ndarray, size: np.ndarray, like: np.ndarray, wanted: list, shells: int = 2, tolerance: float = 0.06) -> tuple[np.ndarray, np.ndarray]:
    """Atoms whose first shells agree with one of the profiles in geometry, and in chemistry too, as :func:`matches`."""
    geometry, chemistry = np.zeros(len(far), bool), np.zeros(len(far), bool)
    for w in dict.fromkeys(tuple(p[:shells]) for p in wanted if len(p) >= shells):
        r, n, s = (np.array(x) for x in zip(*w))
        g = ((size[:, :shells] == n) & (np.abs(far[:, :shells] - r) <= tolerance)).all(1)
        geometry |= g
        chemistry |= g & (like[:, :shells] == s).all(1)
    return geometry, chemistry


def orders(d: np.ndarray, v: np.ndarray) -> np.ndarray:
    """:func:`translational_order` of many atoms."""
    out, k = np.zeros(len(d)), d.shape[1]
    whole = 8 + (d[:, 8:] / d[:, 7:-1]).argmax(1) if k > 8 else np.full(len(d), k)
    for at in _blocks(np.arange(len(d)), 100):
        n, used = whole[at], np.arange(k) < whole[at, None]
        square = (v[at] ** 2).sum(2, keepdims=True)
        one = np.ones_like(square)
        left = np.concatenate([2 * v[at], one, np.where(used[:, :, None], square, np.inf)], 2)
        right = np.concatenate([v[at], square, one], 2)
        away = (left @ right.transpose(0, 2, 1)).min(1)  # by symmetry, over complete shells only
        out[at] = ((away < (0.15 * d[at, :1]) ** 2) & used).sum(1) / n
    return out


def sketches(pos: np.ndarray, cells: np.ndarray, pbc: np.ndarray, kinds: np.ndarray, k: int = 24) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """:func:`structure_sketch` of structures with the same number of atoms: which of them have enough neighbours, and numbers of these."""
    found, j, d, v = nearest_many(pos, cells, pbc, k)
    j, d, v, kinds = j[found], d[found], v[found], kinds[found]
    b, n = kinds.shape
    same = kinds[np.arange(b)[:, None, None], j] == kinds[:, :, None]
    flat, vectors = d.reshape(-1, k), v.reshape(-1, k, 3)
    classes = classify_many(flat, vectors).reshape(b, n)
    profile = shell_profiles(flat, same.reshape(-1, k))
    hits = [template_hits(*profile, wanted) for wanted in TEMPLATES.values()]
    rel = d / d[:, :, :1]
    return found, {
        "fractions": np.stack([(classes == c).sum(1) / n for c in range(len(CLASSES))], 1), "geometry": np.stack([g.reshape(b, n).mean(1) for g, _ in hits], 1),
        "chemistry": np.stack([c.reshape(b, n).mean(1) for _, c in hits], 1), "order": orders(flat, vectors).reshape(b, n).mean(1),
        "fingerprint": np.concatenate([rel.mean(1), rel.std(1), profile[1][:, 0].reshape(b, n).mean(1)[:, None]], 1), "neighbours": j, "distances": d,
    }


def structure_sketch(pos: np.ndarray, cell: np.ndarray | None, pbc: np.ndarray, species: list[str], k: int = 24) -> dict | None:
    """Fractions of the classes, prototype scores, and a fingerprint of shells; None without enough neighbours."""
    if not len(pos):
        return None
    cells = np.full((1, 3, 3), np.nan) if cell is None else cell[None]
    found, s = sketches(pos[None], cells, np.asarray(pbc, bool)[None], np.unique(species, return_inverse=True)[1].reshape(1, -1), k)
    if not found[0]:
        return None
    prototypes = {t: (float(g), float(c)) for t, g, c in zip(TEMPLATES, s["geometry"][0], s["chemistry"][0])}
    return {"fractions": dict(zip(CLASSES, s["fractions"][0].tolist())), "prototypes": prototypes, "order": float(s["order"][0]), "fingerprint": s["fingerprint"][0].tolist()}


def _orderings(pos: np.ndarray, cells: np.ndarray, pbc: np.ndarray, kinds: np.ndarray, s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Confirmed ordering of each sketched structure, or None, and its score."""
    b, n = kinds.shape
    order, score, d = np.full(b, None, object), np.zeros(b), s["distances"]
    ranked = np.sort(kinds, 1)
    number = 1 + (np.diff(ranked, axis=1) != 0).sum(1)
    first = (kinds == ranked[:, :1]).sum(1)
    minor = np.where((2 * first < n)[:, None], ranked[:, :1], ranked[:, -1:]) == kinds  # with two elements, the rarer one
    few, two = minor.sum(1), number == 2
    share = lambda x, of: (x & of).sum(1) / np.maximum(of.sum(1), 1)
    gap = lambda i: d[:, :, i] / d[:, :, i - 1] >= 1.05
    laves = np.flatnonzero(two & (n == 3 * few) & (share(gap(16), minor) >= 0.8) & (share(gap(12), ~minor) >= 0.8))
    for i in laves:
        got = laves_kind(pos[i], cells[i], pbc[i], kinds[i].tolist())
        if got is not None:
            order[i], score[i] = got[0], 1.0
    free = order == None  # noqa: E711 - elementwise
    like = minor[np.arange(b)[:, None, None], s["neighbours"][:, :, :12]].sum(2)
    l12 = np.where(two & (n == 4 * few), np.where(minor, like == 0, like == 4).mean(1), 0.0)
    at = free & (s["fractions"][:, 0] >= 0.5) & (l12 >= MATCH[1])
    order[at], score[at] = "l12", l12[at]
    free &= ~at
    # l12 has its own gate; a prototype counts by geometry and chemistry, the last name of equal ones
    for name in sorted(TEMPLATES):
        i = list(TEMPLATES).index(name)
        if name != "l12":
            g, c = s["geometry"][:, i], s["chemistry"][:, i]
            at = free & (g >= MATCH[0]) & (c >= MATCH[2]) & ((number == 1) == (name == "diamond")) & (c >= score)
            order[at], score[at] = name, c[at]
    return order, score


def central_symmetry(vectors: np.ndarray, n: int = 12) -> float:
    """Departure from inversion symmetry of the first ``n`` neighbours, relative to their square length: 0 in a symmetric place."""
    v = vectors[:n]
    pairs = ((v[:, None] + v[None]) ** 2).sum(2)
    i, k = np.triu_indices(n, 1)
    best = np.sort(pairs[i, k])[: n // 2]
    return float(best.sum() / max((v**2).sum(), 1e-12))


def laves_kind(pos: np.ndarray, cell: np.ndarray | None, pbc: np.ndarray, species: list[str]) -> tuple[str, float] | None:
    """``c15, c14`` or ``c36`` of an AB2 structure whose minority atoms have 16 and the others 12 near neighbours.

    Decided by the minority sublattice: the share of its atoms whose four like neighbours are
    stacked cubically (their next shell keeps inversion between the two tetrahedra).
    """
    count = Counter(species)
    if len(count) != 2:
        return None
    (major, m), (minor, n) = count.most_common()
    if m != 2 * n:
        return None
    got = nearest(pos, cell, pbc, 20)
    if got is None:
        return None
    _, d, _ = got
    kinds = np.array(species)
    wide = lambda row, k: row[k] / row[k - 1] >= 1.05
    z16 = np.mean([wide(d[i], 16) for i in np.flatnonzero(kinds == minor)])
    z12 = np.mean([wide(d[i], 12) for i in np.flatnonzero(kinds == major)])
    if min(z16, z12) < 0.8:
        return None
    sub = nearest(pos[kinds == minor], cell, pbc, 4)
    if sub is None:
        return None
    cubic = 0
    for i in range(n):
        mine = sub[2][i]
        stacked = []
        for a in range(4):
            # around the bond, the other three bonds of both ends are staggered (cubic) or eclipsed (hexagonal)
            axis = mine[a] / np.linalg.norm(mine[a])
            other = sub[2][sub[0][i][a]]
            flat = lambda v: v - (v @ axis)[:, None] * axis  # noqa: E731, B023
            here, there = flat(np.delete(mine, a, 0)), flat(other[np.argsort(np.linalg.norm(other + mine[a], axis=1))[1:]])
            cosine = (here @ there.T) / np.maximum(np.linalg.norm(here, axis=1)[:, None] * np.linalg.norm(there, axis=1)[None], 1e-12)
            stacked.append(cosine.max() < 0.75)
        cubic += np.mean(stacked)
    share = cubic / n
    return ("c15" if share >= 0.88 else "c14" if share <= 0.80 and share >= 0.70 else "c36" if share > 0.80 else "c14"), float(share)


def l12_ordered(pos: np.ndarray, cell: np.ndarray | None, pbc: np.ndarray, species: list[str]) -> float:
    """Share of atoms of an AB3 structure with the neighbours of the ordered one: twelve unlike around A, four A around B."""
    count = Counter(species)
    if len(count) != 2:
        return 0.0
    (major, m), (minor, n) = count.most_common()
    if m != 3 * n:
        return 0.0
    got = nearest(pos, cell, pbc, 13)
    if got is None:
        return 0.0
    kinds = np.array(species)
    like = (kinds[got[0][:, :12]] == minor).sum(1)
    return float(np.mean(np.where(kinds == minor, like == 0, like == 4)))


def label_rule(fractions: Column, ordering: Column) -> tuple[Column, Column]:
    """Label and strength: a confirmed ordering, else the dominant class at 0.8 (strong) or 0.5 (mixed), else unresolved."""
    names = [c for c in CLASSES if c != "other"]
    best = F.array_max(F.array(*(F.struct(F.element_at(fractions, c).alias("f"), F.lit(c).alias("c")) for c in names)))
    label = F.when(ordering.isNotNull(), ordering).when(best["f"] >= MIXED, best["c"]).otherwise("unresolved")
    strength = F.when(ordering.isNotNull() | (best["f"] >= STRONG), "strong").when(best["f"] >= MIXED, "mixed").otherwise("unresolved")
    return label, strength


def phase_evidence(df: DataFrame, key: str = "structure_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, columns to keep and the evidence of every structure with enough neighbours; labels as :func:`label_rule`."""
    names = [key, *keep, "natoms", "fractions", "prototypes", "ordering", "ordering_score", "fingerprint", "order"]

    def scores(labels: tuple[str, ...], values: np.ndarray) -> pa.Array:
        offsets = pa.array(np.arange(len(values) + 1) * len(labels), pa.int32())
        return pa.MapArray.from_arrays(offsets, pa.array(list(labels) * len(values), pa.string()), pa.array(values.ravel(), pa.float64()))

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        n, pos, cells, pbc = frame_arrays(b)
        held = pc.list_value_length(b["species"]).fill_null(0).to_numpy(zero_copy_only=False)
        species = pc.fill_null(b["species"].flatten(), "").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        chosen = (n > 0) & (held == n)
        owner = np.arange(b.num_rows)
        species, pos = species[chosen[np.repeat(owner, held)]], pos[chosen[np.repeat(owner, n)]]
        n = np.where(chosen, n, 0)
        parts: dict[str, list] = {c: [] for c in ("at", "fractions", "chemistry", "ordering", "score", "fingerprint", "order")}
        for rows, atoms in by_size(n, chosen):
            found, s = sketches(pos[atoms], cells[rows], pbc[rows], species[atoms])
            rows, atoms = rows[found], atoms[found]
            s["ordering"], s["score"] = _orderings(pos[atoms], cells[rows], pbc[rows], species[atoms], s)
            for c, x in (s | {"at": rows}).items():
                if c in parts:
                    parts[c].append(x)
        if not parts["at"]:
            return pa.RecordBatch.from_pylist([], pa.schema([*((c, b.schema.field(c).type) for c in (key, *keep)), *zip(names[1 + len(keep) :], kinds)]))
        sort = np.argsort(np.concatenate(parts["at"]))
        at, fractions, chemistry, ordering, score, fingerprint, order = (np.concatenate(x)[sort] for x in parts.values())
        prints = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * fingerprint.shape[1], pa.int32()), pa.array(fingerprint.ravel(), pa.float64()))
        columns = [b[c].take(pa.array(at)) for c in (key, *keep)]
        return pa.record_batch([*columns, pa.array(n[at], pa.int32()), scores(CLASSES, fractions), scores(tuple(TEMPLATES), chemistry), pa.array(ordering, pa.string()), pa.array(score), prints, pa.array(order)], names)

    kinds = [pa.int32(), pa.map_(pa.string(), pa.float64()), pa.map_(pa.string(), pa.float64()), pa.string(), pa.float64(), pa.list_(pa.float64()), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from map(one, pieces(b, rows=5_000, atoms=20_000))

    kept = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in (key, *keep))
    out = df.select(key, *keep, "species", "pos", "lattice", "pbc").mapInArrow(run, f"{kept}natoms int, fractions map<string,double>, prototypes map<string,double>, ordering string, ordering_score double, fingerprint array<double>, order double")
    label, strength = label_rule(F.col("fractions"), F.col("ordering"))
    confidence = F.when(F.col("ordering").isNotNull(), F.col("ordering_score")).otherwise(F.array_max(F.map_values(F.map_filter("fractions", lambda k, _: k != "other"))))
    return out.withColumn("label", label).withColumn("strength", strength).withColumn("confidence", confidence)


def phase_inventory(evidence: DataFrame, points: DataFrame | None = None, key: str = "structure_id") -> DataFrame:
    """Per composition point (``key, point``) and label: structures, atoms, the atoms' share and mean confidence; point ``*`` sums all.

    Without ``points`` the evidence has a column ``symbols`` (:func:`symbols_key`).
    """
    both = F.explode(F.array("point", F.lit("*"))).alias("point")
    if points is None:
        rows = evidence.groupBy("symbols", "label").agg(F.count("*").alias("n"), F.sum("natoms").alias("natoms"), F.sum("confidence").alias("sum"), F.count("confidence").alias("known"))
        rows = rows.withColumn("point", symbols_point(F.col("symbols"))).select("label", "n", "natoms", "sum", "known", both)
    else:
        rows = evidence.join(points.select(key, "point"), key).select("label", F.lit(1).alias("n"), "natoms", F.col("confidence").alias("sum"), F.when(F.col("confidence").isNotNull(), 1).otherwise(0).alias("known"), both)
    sums = rows.groupBy("point", "label").agg(F.sum("n").alias("structures"), F.sum("natoms").alias("atoms"), F.try_divide(F.sum("sum"), F.sum("known")).alias("confidence"))
    total = sums.groupBy("point").agg(F.sum("atoms").alias("all"))
    return sums.join(total, "point").select("point", "label", "structures", "atoms", (F.col("atoms") / F.col("all")).alias("share"), "confidence")


def fit_bank(evidence: DataFrame, k: int, seed: int = 0, sample_rows: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
    """Centres of ``k`` groups of fingerprints (k-means over at most ``sample_rows``, drawn by hash), and each group's 99 % distance."""
    rows = evidence.select("fingerprint").orderBy(F.xxhash64("fingerprint")).limit(sample_rows).collect()
    x = np.array([r[0] for r in rows], float)
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(25):
        at = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([x[at == c].mean(0) if (at == c).any() else centres[c] for c in range(len(centres))])
    d = np.sqrt(((x[:, None] - centres[None]) ** 2).sum(2))
    at = d.argmin(1)
    return centres, np.array([np.quantile(d[at == c, c], 0.99) if (at == c).any() else 0.0 for c in range(len(centres))])


def assign_bank(evidence: DataFrame, bank: tuple[np.ndarray, np.ndarray], slack: float = 1.2) -> DataFrame:
    """``evidence`` with ``group`` of the nearest centre, or -1 beyond its reach (unknown)."""
    centres, reach = bank
    lit = lambda c: F.array(*(F.lit(float(v)) for v in c))
    square = lambda c: F.sqrt(F.aggregate(F.zip_with("fingerprint", lit(c), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    near = F.array_min(F.array(*(F.struct(square(c).alias("d"), F.lit(i).alias("i"), F.lit(float(r) * slack + 1e-9).alias("r")) for i, (c, r) in enumerate(zip(centres, reach)))))
    return evidence.withColumn("near", near).withColumn("group", F.when(F.col("near.d") <= F.col("near.r"), F.col("near.i")).otherwise(-1)).drop("near")

