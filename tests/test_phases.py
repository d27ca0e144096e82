import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions.elements import RADIUS
from framelake.functions.structure import element_counts
from framelake.generators import cells
from framelake.generators.base import Frame
from framelake.operators import magnetic, phases
from framelake.operators.audit import point_key, symbols_key
from framelake.operators.neighbors import bad_bonds, bonds, distance_matrix, frame_arrays, nearest, nearest_many, pairs_within, pieces, read_frames, usable_cell, with_short_pairs


def crystal(kind, a=3.6, n=2, kinds=("Fe", "Ni"), covera=1.633, noise=0.0, seed=0):
    cell, sites = cells.PROTOTYPES[kind]
    lat = cell(a, 1.0 if kind == "l10" else covera)
    f = Frame([kinds[s] for _, s in sites], np.array([x for x, _ in sites]) % 1 @ lat, lat, np.ones(3, bool), structure_id=1)
    f = cells.replicate(f, (n, n, n), "")
    f.pos = f.pos + np.random.default_rng(seed).normal(size=f.pos.shape) * noise
    return f


def brute(pos, cell, pbc, cutoff, reach=4):
    out = []
    for s in np.ndindex(*(2 * reach + 1,) * 3):
        s = np.array(s) - reach
        if (s[~pbc] != 0).any():
            continue
        d = np.linalg.norm(pos[None] + s @ cell - pos[:, None], axis=2)
        for i, j in zip(*np.nonzero(d <= cutoff)):
            if i != j or s.any():
                out.append((i, j, round(float(d[i, j]), 9)))
    return sorted(out)


@pytest.mark.parametrize("pbc", [(1, 1, 1), (1, 0, 1), (0, 0, 0)])
def test_pairs_equal_brute_force(pbc, monkeypatch):
    rng, pbc = np.random.default_rng(20), np.array(pbc, bool)
    frames = []
    for _ in range(4):
        cell = np.eye(3) * rng.uniform(3, 5, 3) + rng.uniform(-1, 1, (3, 3)) * 0.8
        frames.append((rng.uniform(-1, 2, (7, 3)) @ cell, cell, pbc))
    want = [brute(*f, 3.3) for f in frames]
    for direct in (200, 2):  # in one array, and by the grid
        monkeypatch.setattr("framelake.operators.neighbors._DIRECT", direct)
        s, i, j, d, v = pairs_within(frames, 3.3)
        assert [sorted((int(a), int(b), round(float(x), 9)) for q, a, b, x in zip(s, i, j, d) if q == k) for k in range(4)] == want
        assert np.allclose(np.linalg.norm(v, axis=1), d)


def test_nearest_images_and_degenerate_input():
    f = crystal("fcc", n=1)
    j, d, v = nearest(f.pos, f.lattice, f.pbc, 18)
    assert np.allclose(d[:, :12], 3.6 / 2**0.5) and np.allclose(d[:, 12:], 3.6) and np.allclose(np.linalg.norm(v, axis=2), d)
    assert nearest(f.pos, np.zeros((3, 3)), f.pbc, 4) is None and nearest(f.pos[:2], None, np.zeros(3, bool), 4) is None
    for bad in (np.zeros((0, 3)), np.full((2, 3), np.nan)):
        assert len(pairs_within([(bad, f.lattice, f.pbc)], 3.0)[0]) == 0
    assert np.isnan(distance_matrix(f.pos, np.zeros((3, 3)), f.pbc)).all()
    assert [b[:2] for b in bonds(np.array([[0, 0, 0], [0.7, 0, 0], [3.0, 0, 0]]), ["H", "H", "H"])] == [(0, 1)] and len(bad_bonds(np.array([[0, 0, 0], [0.4, 0, 0]]), ["H", "H"])) == 1


def mixed_frames(sizes=(1, 2, 5, 7, 18)):
    """Random and crystalline structures with every periodicity, and some without a usable cell or position."""
    rng, out = np.random.default_rng(8), []
    for n in sizes:
        for p in np.ndindex(2, 2, 2):
            cell = np.eye(3) * rng.uniform(3, 6, 3) + rng.uniform(-1, 1, (3, 3)) * 0.8
            out.append((rng.uniform(-1, 2, (n, 3)) @ cell, cell, np.array(p, bool)))
    whole = np.ones(3, bool)
    for f in (crystal("fcc", n=1), crystal("b2", n=1), crystal("diamond", n=1)):
        out.append((f.pos, f.lattice, whole))
    return [*out, (out[0][0], np.zeros((3, 3)), whole), (out[0][0], None, whole), (out[8][0] * np.nan, out[8][1], whole)]


@pytest.mark.parametrize("k", [4, 24])
@pytest.mark.parametrize("cache", [50_000, 1])
def test_nearest_of_many_equals_one_by_one(k, cache, monkeypatch):
    monkeypatch.setattr("framelake.operators.neighbors._CACHE", cache)
    frames = mixed_frames()
    for n in {len(f[0]) for f in frames}:
        same = [f for f in frames if len(f[0]) == n]
        cells = np.array([np.full((3, 3), np.nan) if c is None else c for _, c, _ in same])
        ok, j, d, v = nearest_many(np.array([f[0] for f in same]), cells, np.array([f[2] for f in same]), k)
        for i, f in enumerate(same):
            want = nearest(*f, k)
            assert ok[i] == (want is not None)
            if want is not None:
                assert (j[i] == want[0]).all() and np.allclose(d[i], want[1]) and np.allclose(v[i], want[2])


def test_frames_as_arrays_and_pieces():
    import pyarrow as pa

    good, cell = [[0.0, 1.0, 2.0], [1.0, 1.0, float("nan")]], [[4.0, 0, 0], [0, 4.0, 0], [0, 0, 4.0]]
    pos = [good, None, [], [[0.0, 1.0]], [[0.0, None, 1.0]], [None, [0.0, 0.0, 0.0]], good[:1], good, good]
    lattice = [cell, cell, cell, cell, cell, cell, None, None, [cell[0], cell[1], [None, 0.0, 4.0]]]
    pbc = [[True, False, True], None, [True] * 3, [True] * 2, [None] * 3, [True] * 3, None, [True, True, None], [False] * 3]
    vec = pa.list_(pa.list_(pa.float64()))
    b = pa.record_batch([pa.array(pos, vec), pa.array(lattice, vec), pa.array(pbc, pa.list_(pa.bool_()))], ["pos", "lattice", "pbc"]).slice(0)
    for part in (b, b.slice(4)):
        n, every, cells, flags = frame_arrays(part)
        first = np.cumsum(n) - n
        for i, (p, c, f) in enumerate(read_frames(part)):
            assert np.array_equal(every[first[i] : first[i] + n[i]], p, equal_nan=True) and (flags[i] == f).all()
            assert np.isnan(cells[i]).any() if c is None or not c.any() else (cells[i] == c).all()
    assert [x.num_rows for x in pieces(b, rows=4, atoms=3)] == [4, 2, 2, 1] and [x.num_rows for x in pieces(b, atoms=1)][0] == 1


@pytest.mark.parametrize("kind", ["fcc", "hcp", "bcc"])
@pytest.mark.parametrize("noise", [0.0, 0.05])
def test_crystals_are_recognised(kind, noise):
    f = crystal(kind, n=3, kinds=("Cu", "Cu"), noise=noise)
    s = phases.structure_sketch(f.pos, f.lattice, f.pbc, f.species)
    assert s["fractions"][kind] >= 0.95
    assert (s["order"] > 0.9) == (kind != "hcp")


def test_prototypes_and_labels(spark):
    frames = [("b1", crystal("b1", 5.6)), ("b2", crystal("b2", 2.9, 3)), ("b3", crystal("b3", 5.4)), ("l12", crystal("l12")), ("l10", crystal("l10", 3.8)), ("diamond", crystal("diamond", 5.4, kinds=("Si", "Si"))), ("fcc", crystal("fcc", 3.6, 3, ("Cu", "Cu")))]
    rng = np.random.default_rng(1)
    frames.append(("unresolved", Frame(["Cu"] * 40, rng.uniform(0, 8, (40, 3)), np.eye(3) * 8, np.ones(3, bool))))
    shuffled = crystal("l12")
    shuffled.species = list(rng.permutation(shuffled.species))
    frames.append(("fcc", shuffled))  # the geometry alone is no ordering
    rows = [(i, f.species, f.pos.tolist(), f.lattice.tolist(), [True] * 3) for i, (_, f) in enumerate(frames)]
    schema = "structure_id bigint, species array<string>, pos array<array<double>>, lattice array<array<double>>, pbc array<boolean>"
    rows.append((99, ["H"], [[0.0, 0.0, 0.0]], None, [False] * 3))
    df = spark.createDataFrame(rows, schema)
    evidence = phases.phase_evidence(df)
    got = {r.structure_id: r.label for r in evidence.collect()}
    assert [got[i] for i in range(len(frames))] == [k for k, _ in frames] and 99 not in got
    points = spark.createDataFrame([(i, "Cu" if i > 5 else "x") for i in range(len(frames))], "structure_id bigint, point string")
    inv = {(r.point, r.label): (r.structures, r.share) for r in phases.phase_inventory(evidence, points).collect()}
    assert inv["Cu", "fcc"][0] == 2 and sum(v[1] for k, v in inv.items() if k[0] == "*") == pytest.approx(1.0)
    bank = phases.fit_bank(evidence, 3)
    assert phases.assign_bank(evidence, bank).where("group >= 0").count() == len(frames)


def test_laves_phases():
    # C15: diamond sublattice of A, four tetrahedra of B
    a = 7.0
    fcc = np.array([(0, 0, 0), (0, 0.5, 0.5), (0.5, 0, 0.5), (0.5, 0.5, 0)])
    big = np.concatenate([fcc + s for s in ((0, 0, 0), (0.25, 0.25, 0.25))])
    small = np.concatenate([fcc + np.array(s) / 8 for s in ((5, 5, 5), (5, 7, 7), (7, 5, 7), (7, 7, 5))])
    pos = np.concatenate([big, small]) % 1 * a
    got = phases.laves_kind(pos, np.eye(3) * a, np.ones(3, bool), ["Mg"] * 8 + ["Cu"] * 16)
    assert got[0] == "c15"
    assert phases.laves_kind(pos, np.eye(3) * a, np.ones(3, bool), ["Mg"] * 24) is None


def moments(f, spin):
    return magnetic.evidence(f.pos, f.lattice, f.pbc, np.asarray(spin, float))


def test_magnetic_orders(spark):
    f = crystal("bcc", 2.87, 4, ("Fe", "Fe"))
    frac = f.fractional() * 4
    rng = np.random.default_rng(5)
    random = rng.normal(size=(len(f), 3))
    up = np.tile([0, 0, 1.0], (len(f), 1))
    layers = np.round(2 * frac[:, 2]).astype(int)
    angle = 2 * np.pi * frac[:, 2] / 4
    cases = {
        "fm": 2.2 * up, "afm_layered": up * np.where(layers % 2 == 0, 1, -1)[:, None], "afm_double_layered": up * np.where(layers % 4 < 2, 1, -1)[:, None],
        "noncollinear": np.stack([np.cos(angle), np.sin(angle), 0 * angle], 1), "pm_like": random / np.linalg.norm(random, axis=1, keepdims=True), "low_moment": 0 * up,
        "ferrimagnetic": up * np.where(layers % 2 == 0, 3.0, -1.5)[:, None],
    }
    rows = [(i, f.species, f.pos.tolist(), f.lattice.tolist(), [True] * 3, s.tolist()) for i, s in enumerate(cases.values())]
    rows.append((50, f.species, f.pos.tolist(), f.lattice.tolist(), [True] * 3, None))
    df = spark.createDataFrame(rows, "structure_id bigint, species array<string>, pos array<array<double>>, lattice array<array<double>>, pbc array<boolean>, spin array<array<double>>")
    e = magnetic.magnetic_evidence(df)
    got = {r.structure_id: r.p for r in e.select("structure_id", magnetic.partition_label().alias("p")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases) and 50 not in got
    points = spark.createDataFrame([(i, "Fe:1") for i in range(9)], "structure_id bigint, point string")
    assert magnetic.magnetic_inventory(e, points).where("point = '*'").count() == len(cases)
    m = magnetic.element_moments(df.where("structure_id = 0")).first()
    assert (m.element, m.atoms, m.mean) == ("Fe", 128, pytest.approx(2.2))
    pair = magnetic.pair_alignment(df.where("structure_id = 1"), 2.6).first()
    assert pair.antiparallel == 1.0 and pair.mean == pytest.approx(-1.0)


def test_magnetic_evidence_of_a_batch_is_computed_together(spark, monkeypatch):
    """Every structure of one size in one pass: the single kernels are not called, and evidence equals that of each alone."""
    frames = [f for f in mixed_frames((1, 2, 5, 7)) if f[1] is not None and np.isfinite(f[0]).all()]
    rng = np.random.default_rng(2)
    spins = [rng.normal(size=p.shape) * (rng.random((len(p), 1)) > 0.2) for p, _, _ in frames]
    rows = [(i, ["Fe", "O", "O", "C", "Fe", "C", "H"][: len(p)] if len(p) < 8 else ["Fe"] * len(p), p.tolist(), c.tolist(), f.tolist(), s.tolist(), f"p{i}") for i, ((p, c, f), s) in enumerate(zip(frames, spins))]
    rows.append((99, ["Fe"], [[0.0, 0.0, 0.0]], None, [False] * 3, [[float("nan"), 0.0, 0.0]], "x"))
    df = spark.createDataFrame(rows, "structure_id bigint, species array<string>, pos array<array<double>>, lattice array<array<double>>, pbc array<boolean>, spin array<array<double>>, point string")
    got = {r.structure_id: r for r in magnetic.magnetic_evidence(df, keep=("point",)).collect()}
    assert len(got) == len(frames)
    for i, (f, s) in enumerate(zip(frames, spins)):
        want = magnetic.evidence(*f, s)
        assert all(abs(got[i][c] - want[c]) < 1e-9 for c in magnetic.FIELDS) and list(got[i].q) == want["q"] and got[i].point == f"p{i}"
        waves = [2 * (np.abs(np.exp(2j * np.pi * (f[0] @ np.linalg.inv(f[1]) @ np.array(q))) @ s) ** 2).sum() / np.linalg.norm(s, axis=1).sum() ** 2 for q in np.ndindex(7, 7, 7) for q in [np.array(q) - 3] if q.any() and not q[~f[2]].any()] if len(s) > 1 and abs(np.linalg.det(f[1])) > 1e-12 and s.any() else []
        assert want["q_peak"] == pytest.approx(min(1.0, max(waves, default=0.0)))
    calls = []
    monkeypatch.setattr(magnetic, "nearest_many", lambda pos, *a: calls.append(len(pos)) or nearest_many(pos, *a))
    magnetic.evidence_many(np.array([frames[8][0]] * 30), np.array([frames[8][1]] * 30), np.array([frames[8][2]] * 30), np.ones((30, 2, 3)))
    assert calls == [30]
    df = df.withColumn("symbols", symbols_key(df.species))
    points = df.select("structure_id", point_key(element_counts(df.species)).alias("point"))
    assert sorted(magnetic.magnetic_inventory(magnetic.magnetic_evidence(df, keep=("symbols",))).collect()) == sorted(magnetic.magnetic_inventory(magnetic.magnetic_evidence(df), points).collect())


def test_sketches_of_many_equal_the_rules_of_one_atom(spark, monkeypatch):
    """Classes, templates and order of a whole batch are computed together and equal the single rules."""
    cases = [crystal(k, n=2, kinds=("Fe", "Ni"), noise=x, seed=i) for k in ("fcc", "hcp", "bcc", "l12", "b2", "b3", "diamond") for i, x in enumerate((0.0, 0.04, 0.12))]
    rng = np.random.default_rng(4)
    frames = [(f.pos, f.lattice, f.pbc, f.species) for f in cases] + [(p, c, f, list(rng.choice(["Fe", "Ni"], len(p)))) for p, c, f in mixed_frames((1, 2, 3, 7)) if c is not None and c.any() and np.isfinite(p).all()]
    calls = []
    monkeypatch.setattr(phases, "sketches", lambda pos, *a, f=phases.sketches: calls.append(len(pos)) or f(pos, *a))
    rows = [(i, s, p.tolist(), c.tolist(), f.tolist()) for i, (p, c, f, s) in enumerate(frames)]
    df = spark.createDataFrame(rows, "structure_id bigint, species array<string>, pos array<array<double>>, lattice array<array<double>>, pbc array<boolean>").coalesce(1).withColumn("symbols", symbols_key(F.col("species")))
    got = {r.structure_id: r for r in phases.phase_evidence(df, keep=("symbols",)).collect()}
    for i, (p, c, f, s) in enumerate(frames):
        near = nearest(p, c, f, 24)
        assert (i in got) == (near is not None)
        if near is None:
            continue
        j, d, v = near
        kinds, n = np.array(s), len(p)
        want = [phases.classify(d[x], v[x]) for x in range(n)]
        assert got[i].fractions == pytest.approx({k: want.count(k) / n for k in phases.CLASSES}) and got[i].symbols == " ".join(sorted(s))
        profiles = [phases.shell_profile(d[x], kinds[j[x]] == kinds[x]) for x in range(n)]
        assert got[i].prototypes == pytest.approx({t: np.mean([any(phases.matches(x, w)[1] for w in wanted) for x in profiles]) for t, wanted in phases.TEMPLATES.items()})
        assert got[i].order == pytest.approx(np.mean([phases.translational_order(x) for x in v])) and got[i].fingerprint[-1] == pytest.approx(np.mean([x[0][1] for x in profiles]))
    points = df.select("structure_id", point_key(element_counts(df.species)).alias("point"))
    one, two = (sorted((r.point, r.label, r.structures, r.atoms, round(r.confidence, 9)) for r in phases.phase_inventory(*x).collect()) for x in ((phases.phase_evidence(df, keep=("symbols",)),), (phases.phase_evidence(df), points)))
    assert one == two and len(one) > 4
    b = [(np.array([frames[-1][0]] * 20), np.array([frames[-1][1]] * 20), np.ones((20, 3), bool), np.zeros((20, len(frames[-1][0])), int))]
    monkeypatch.setattr(phases, "classify", None)
    assert phases.sketches(*b[0])[0].all() and calls == [20]


@pytest.mark.parametrize("limit", [{"cutoff": 0.9}, {"cutoff": 3.4}, {"coefficient": 0.6}])
def test_short_pairs_of_a_batch_equal_all_images(spark, limit):
    frames = [f for f in mixed_frames((1, 2, 5, 7, 18))]
    kinds = [["Fe", "O", "H"][i % 3] for i in range(18)]
    rows = [(i, kinds[: len(p)], p.tolist(), None if c is None else c.tolist(), f.tolist()) for i, (p, c, f) in enumerate(frames)]
    df = spark.createDataFrame(rows, "structure_id bigint, species array<string>, pos array<array<double>>, lattice array<array<double>>, pbc array<boolean>").coalesce(1)
    got = {r.structure_id: r.short for r in with_short_pairs(df, **limit).collect()}
    radius = np.array([RADIUS[k] for k in kinds])
    for i, (p, c, f) in enumerate(frames):
        if usable_cell(c, f) is None or not np.isfinite(p).all():
            assert got[i] is None
            continue
        _, a, b, d, _ = pairs_within([(p, c, f)], 3.4)
        bound = limit["cutoff"] if "cutoff" in limit else 0.6 * (radius[a] + radius[b])
        assert got[i] == bool(((a != b) & (d < bound)).any())
    assert len({x for x in got.values() if x is not None}) == 2
