import json

import numpy as np
import pytest

from framelake import generators as G
from framelake.generators import alloys, cells, magnetism, molecules
from framelake.generators.base import Frame, OperationError, scan, unit_samples
from framelake.generators.conditions import condition, formula
from framelake.operators.neighbors import distance_matrix

FCC = cells.PROTOTYPES["fcc"]


def cubic(n=2, a=3.6, kind="fcc", e="Cu"):
    cell, sites = cells.PROTOTYPES[kind]
    lat = cell(a, 1.633)
    f = Frame([e] * len(sites), np.array([s for s, _ in sites]) % 1 @ lat, lat, np.ones(3, bool), "bulk", structure_id=7)
    return cells.replicate(f, (n, n, n), "")


def test_cells_keep_fractional_coordinates_and_volumes():
    f = cubic(1)
    for r in G.run_one("bain_path", f, ratios=(0.8, 1.2, 0.1)):
        assert r.volume == pytest.approx(f.volume) and np.allclose(r.fractional(), f.fractional())
    assert len(G.run_one("cell_strain", f, axes="biaxial", x=(0, 1, 1), y=(0, 1, 1), z=(0, 1, 1))) == 12
    assert [round(r.lattice[0, 0] / 3.6, 3) for r in G.run_one("cell_strain", f, axes="isotropic", x=(-1, 1, 1))] == [0.99, 1.0, 1.01]
    assert all(r.volume == pytest.approx(f.volume) for r in G.run_one("shear_matrix", f, xy=(-5, 5, 5)))
    got = [cells.cell_parameters(r.lattice)[1][0] for r in G.run_one("shear_angle", f, alpha=(-2, 2, 2))]
    assert got == pytest.approx([88, 90, 92])
    for engine in ("uniform", "sobol"):
        rows = G.run_one("cell_scaling", f, engine=engine, count=8)
        assert len(rows) == 8 and all(np.all(np.abs(cells.cell_parameters(r.lattice)[0] / 3.6 - 1) <= 0.0401) for r in rows)


def test_supercells_and_prototypes(spark):
    f = cubic(1)
    assert [len(r) for r in G.run_one("supercell", f, scale=(2, 1, 3))] == [24]
    assert len(G.run_one("supercell", f, scale=(2, 2, 1), every=True)) == 4
    assert len(G.run_one("supercell", f, mode="max_atoms", max_atoms=40)[0]) <= 40
    r = G.run_one("supercell", f, mode="cell", cell=(8, 8, 8), fixed="z")[0]
    assert len(r) == 16 and np.allclose(np.sort(distance_matrix(r.pos, r.lattice, r.pbc)[0])[1:4], 3.6 / 2**0.5)
    made = G.generate(spark, "crystal_prototype", prototypes=("fcc", "bcc", "hcp"), elements=("Fe", "Ni"), a=(3.5, 3.6, 0.1)).collect()
    assert len(made) == 12 and {len(m.species) for m in made} == {4, 2}
    alloy = G.generate(spark, "ordered_alloy", max_atoms=32, a=(3.5, 3.5, 1)).first()
    assert len(alloy.species) == 32 and alloy.species.count("Al") == 24 and alloy.grp.count("A") == 8


def test_slabs_and_faults():
    f = cubic(1)
    for hkl, spacing in (((0, 0, 1), 3.6), ((1, 1, 1), 3.6 / 3**0.5), ((1, 1, 0), 3.6 / 2**0.5)):
        s = cells.slab(f, hkl, 2, 12.0)
        assert s.volume > 0 and not s.pbc[2] and len(s) % 4 == 0
        d = distance_matrix(s.pos, s.lattice, s.pbc)
        assert d[~np.eye(len(s), dtype=bool)].min() == pytest.approx(3.6 / 2**0.5, abs=1e-6)
        assert s.pos[:, 2].max() <= 2 * spacing + 1e-6
    assert len(G.run_one("random_slab", f, layers=(2, 3, 1))) == 8
    g = G.run_one("gsfe_path", cubic(2), displacements=(0, 1, 0.5))
    assert np.allclose(g[0].pos, cubic(2).wrapped()) and np.allclose((g[2].fractional() - g[0].fractional() + 0.5) % 1, 0.5)
    with pytest.raises(OperationError):
        G.run_one("gsfe_path", f, slip_uvw=(0, 0, 1))
    assert len(G.run_one("stacking_fault", cubic(2))) == 3


def test_results_depend_on_content_only(spark):
    f = cubic(1)
    a, b = (G.run_one("perturb", f, count=4, seed=3) for _ in range(2))
    assert all(np.array_equal(x.pos, y.pos) for x, y in zip(a, b)) and not np.allclose(a[0].pos, a[1].pos)
    lat = f.lattice.tolist()
    rows = [(i, f.species, f.pos.tolist(), lat, [True] * 3, "t") for i in range(20)]
    df = spark.createDataFrame(rows, "structure_id bigint, species array<string>, pos array<array<double>>, lattice array<array<double>>, pbc array<boolean>, config_type string")
    one, two = (sorted((r.structure_id, r.variant, str(r.pos)) for r in G.apply(d, "perturb", count=2).collect()) for d in (df.repartition(1), df.repartition(5)))
    assert one == two and len(one) == 40
    assert all(np.linalg.norm(((x.pos - f.pos) @ np.linalg.inv(f.lattice) + 0.5) % 1 @ f.lattice - np.full(3, 0.5) @ f.lattice, axis=1).max() <= 0.3 for x in a)


def test_compositions():
    assert alloys.parse_composition("Fe:3,Ni:1") == {"Fe": 0.75, "Ni": 0.25} == alloys.parse_composition('{"Fe": 3, "Ni": 1}')
    assert alloys.largest_remainder({"A": 1 / 3, "B": 1 / 3, "C": 1 / 3}, 10) == {"A": 4, "B": 3, "C": 3}
    assert len(alloys.simplex(("A", "B", "C"), 0.25)) == 3
    f = cubic(2)
    sweep = G.run_one("composition_sweep", f, elements=("Fe", "Ni"), orders=(2,), step=0.25)
    assert len(sweep) == 3
    occ = G.run_one("random_occupancy", sweep[0], count=2)
    assert all(r.species.count("Fe") == 8 for r in occ) and occ[0].species != occ[1].species
    dope = G.run_one("random_doping", f, rules=[{"target": "Cu", "dopants": "Zn:1,Al:1", "use": "count", "amount": 6}])[0]
    assert (dope.species.count("Zn"), dope.species.count("Al"), len(dope)) == (3, 3, 32)
    mass = G.run_one("random_doping", f, rules=[{"target": "Cu", "dopants": "Zn", "use": "mass_percent", "amount": 50}])[0]
    assert mass.species.count("Zn") == 16
    part = G.run_one("conditional_replace", f, target="Cu", replacements="Ni:1", where="z <= 0 OR z = 1.8")[0]
    assert part.species.count("Ni") == 16
    grad = G.run_one("composition_gradient", f, start="Cu:1", end="Au:1", bins=4)[0]
    z = f.fractional()[:, 2]
    assert {e for e, x in zip(grad.species, z) if x < 0.2} == {"Cu"} and {e for e, x in zip(grad.species, z) if x > 0.7} == {"Au"}


def test_finite_occupancies_are_exact_and_distinct():
    f = cubic(1)
    rules = [{"target": "Cu", "count_range": {"Fe": [0, 4], "Ni": [0, 4]}}]
    assert alloys.occupancy_estimate(f, rules) == 5
    rows = G.run_one("finite_occupancy", f, rules=rules, arrangements=3)
    assert len({tuple(r.species) for r in rows}) == len(rows) and {r.species.count("Fe") for r in rows} == set(range(5))
    assert alloys.integer_spaces({"fixed_fraction": {"A": 0.3, "B": 0.7}}, 4) == []


def test_defects():
    f = cubic(2)
    v = G.run_one("vacancy_defect", f, count=2, samples=6)
    assert len(v) == 6 and {len(r) for r in v} == {30}
    assert len({str(r.pos.tolist()) for r in G.run_one("random_vacancy", f, rules=[{"target": "Cu", "count": 1}], count=8)}) == 8
    for r in G.run_one("insert_defect", f, species={"H": 1}, count=2, min_distance=1.2, samples=3):
        d = distance_matrix(r.pos, r.lattice, r.pbc)
        assert d[-1][:-1].min() >= 1.2 - 1e-9
    packed = G.run_one("random_packing", f, composition={"Si": 6, "O": 6}, min_distances={"O-Si": 1.4}, default_distance=1.8)[0]
    d = distance_matrix(packed.pos, packed.lattice, packed.pbc)
    assert len(packed) == 12 and d[~np.eye(12, dtype=bool)].min() >= 1.4
    assert G.run_one("group_label", cubic(1, kind="bcc"), mode="parity")[0].grp == ["A", "B"] and set(G.run_one("group_label", f, k=(1, 0, 0))[0].grp) == {"A", "B"}


def test_moments():
    f = cubic(1, kind="bcc", e="Fe")
    fm = G.run_one("magnetic_order", f, order="FM", sizes={"Fe": 2.2})[0]
    assert np.allclose(fm.spin, [[0, 0, 2.2]] * 2)
    afm = G.run_one("magnetic_order", f, order="AFM", k=(0, 0, 1))[0]
    assert np.allclose(afm.spin.sum(0), 0)
    big = cells.replicate(fm, (2, 2, 2), "")
    pm = G.run_one("magnetic_order", big, order="PM", balanced=True, count=2)
    assert np.allclose(pm[0].spin.sum(0), 0) and np.allclose(np.linalg.norm(pm[1].spin, axis=1), 1)
    for r in G.run_one("moment_rotation", big, max_angle=10.0, count=3):
        assert (r.spin @ [0, 0, 1] / np.linalg.norm(r.spin, axis=1)).min() >= np.cos(np.radians(10)) - 1e-9
    spiral = G.run_one("spin_spiral", big, periods=[7.2, 5.0], commensurate=True)
    assert len(spiral) == 1 and np.allclose(np.linalg.norm(spiral[0].spin, axis=1), 1)
    tilt = G.run_one("small_tilt", big, mode="canting", angles=(5, 5, 1))[0]
    assert np.allclose(np.degrees(np.arccos(tilt.spin[:, 2] / 2.2)), 5)
    assert len(G.run_one("small_tilt", big, mode="pair", angles=[3.0])) == len(magnetism.neighbour_shell(big, 1, 6.0)) > 0
    flip = G.run_one("spin_disorder", big, fractions=[0.25])[0]
    assert (flip.spin[:, 2] < 0).sum() == 4
    field = G.run_one("correlated_spins", big, length=100.0, samples=1)[0]
    assert (field.spin @ field.spin.T).min() > 0.5
    helix = G.run_one("folded_helix", big, half_period=2, steps=[30.0])[0]
    assert np.allclose(np.linalg.norm(helix.spin, axis=1), 1)
    set_ = G.run_one("set_moments", f, sizes={"Fe": 3.0}, axis=(1, 0, 0))[0]
    assert np.allclose(set_.spin, [[3, 0, 0]] * 2)
    with pytest.raises(OperationError):
        G.run_one("spin_disorder", f)


BUTANE = Frame(["C"] * 4, np.array([[0, 0, 0], [1.5, 0, 0], [2.0, 1.4, 0], [3.5, 1.4, 0]]) + 5.0, np.eye(3) * 20, np.ones(3, bool))


def test_molecules():
    two = Frame(BUTANE.species + ["O", "H", "H"], np.vstack([BUTANE.pos, np.array(molecules.WATER[1]) + [19.8, 10, 10]]) % 20, BUTANE.lattice, BUTANE.pbc)
    assert [len(c) for c in molecules.clusters(two)] == [4, 3] and np.ptp(molecules.unwrap(two)[4:, 0]) < 2
    assert not molecules.is_organic(two, [4, 5, 6]) and np.all(molecules.recentre(two) > -2)
    assert len(molecules.bridges(molecules.bond_graph(BUTANE))) == 3 and [t[:2] for t in molecules.torsions(BUTANE)] in ([(1, 2)], [(2, 1)])
    for r in G.run_one("conformers", BUTANE, count=3):
        assert np.allclose([np.linalg.norm(r.pos[i + 1] - r.pos[i]) for i in range(3)], [1.5, np.hypot(0.5, 1.4), 1.5])
    s = G.run_one("local_solvation", BUTANE, count=3)[0]
    assert len(s) == 13 and distance_matrix(s.pos, s.lattice, s.pbc)[:4, 4:].min() >= 1.6 - 1e-9
    assert len(G.run_one("solvent_fill", BUTANE, count=5)[0]) == 19
    assert len(G.run_one("perturb", two, rigid=True, count=2)) == 2


def test_conditions_and_formulas():
    x = np.array([[0, 0, 0], [1, 2, 3], [1.00005, 0, 0]])
    assert condition("x = 1 AND y > 0 or x<=0", x).tolist() == [True, True, False] and condition("all", x).all()
    assert condition("NOT x == 1", x).tolist() == [True, False, False] and condition("x**2 + y^2 >= 5", x).tolist() == [False, True, False]
    assert formula("a*sin(x) + max(y, z)", x, {"a": 2}).tolist()[1] == pytest.approx(2 * np.sin(1) + 3)
    for bad in ("x.__class__ > 0", "open('x') > 1", "q > 1", "x >"):
        with pytest.raises(ValueError):
            condition(bad, x)


def test_layers_vibrations_sampling():
    f = cubic(1)
    r = G.run_one("layer_copy", f, dz="0.1*x", layers=3, distance=5.0, vacuum=10.0)[0]
    assert len(r) == 12 and r.lattice[2, 2] == pytest.approx(np.ptp(r.pos[:, 2]) + 10)
    mode = np.ones((4, 3)).tolist()
    assert len(G.run_one("vibration", f, modes=[mode, mode], frequencies=[100.0, 5.0], count=3)) == 3
    assert scan((-1, 1, 0.5)) == [-1, -0.5, 0, 0.5, 1] and scan(3) == [3.0] and scan([1, 2]) == [1, 2]
    u = unit_samples(np.random.default_rng(0), 1024, 4, "sobol")
    assert np.abs(u.mean(0) - 0.5).max() < 0.01
    counts = np.histogram2d(u[:, 1], u[:, 2], bins=8, range=[[0, 1], [0, 1]])[0]
    assert counts.min() > 8


def test_pipelines_groups_and_plugins(spark, tmp_path):
    f = cubic(1)
    rows = [(i, f.species, f.pos.tolist(), f.lattice.tolist(), [True] * 3, "t") for i in range(3)]
    df = spark.createDataFrame(rows, "structure_id bigint, species array<string>, pos array<array<double>>, lattice array<array<double>>, pbc array<boolean>, config_type string")
    steps = [{"name": "supercell", "params": {"scale": [2, 1, 1]}}, {"name": "perturb", "enabled": False}, {"group": [{"name": "vacancy_defect", "params": {"samples": 2}}, {"name": "bain_path", "params": {"ratios": [1.0, 1.1]}}, {"name": "perturb", "enabled": False}], "filter": {"name": "geometry_filter", "params": {"max_volume_per_atom": 12.0}}}]
    out = G.pipeline(df, json.dumps(steps)).collect()
    assert len(out) == 6 and {len(r.species) for r in out} == {8} and all("Supercell" in r.config_type and "Bain" in r.config_type for r in out)
    assert G.branches(df, []).count() == 3
    picked = G.apply(G.apply(df.limit(1), "random_doping", rules=[{"target": "Cu", "dopants": "Zn", "use": "count", "amount": [0, 4]}], count=12), "fps_filter", count=3)
    assert picked.count() == 3
    (tmp_path / "extra.py").write_text("from framelake.generators import operation\n@operation('test_twice')\ndef twice(f, p):\n    yield f\n    yield f\n")
    assert G.load_plugins(str(tmp_path)) == ["test_twice"] and len(G.run_one("test_twice", f)) == 2
    with pytest.raises(OperationError):
        G.pipeline(df, [{"name": "no such step"}])
    with pytest.raises(OperationError):
        G.run_one("perturb", f, colour=1)


def test_batches_give_the_results_of_single_structures(spark, monkeypatch):
    """Supercells, vacancies and displacements of a batch are computed together, with the random numbers of each structure alone."""
    rng, rows = np.random.default_rng(6), []
    for i in range(60):
        n = 1 + i % 6
        cell = np.eye(3) * rng.uniform(3, 6, 3) + rng.uniform(-0.5, 0.5, (3, 3)) if i % 11 else np.zeros((3, 3))
        rows.append((i, list(rng.choice(["Cu", "Zn", "Xx"], n)), rng.uniform(-1, 4, (n, 3)).tolist(), cell.tolist(), [bool(x) for x in rng.random(3) < 0.7], ["", "bulk|x", "a b", None][i % 4]))
    df = spark.createDataFrame(rows, "structure_id bigint, species array<string>, pos array<array<double>>, lattice array<array<double>>, pbc array<boolean>, config_type string").coalesce(1)
    text = lambda i, v, f: (i, v, f.species, np.round(f.pos, 9).tolist(), np.round(f.lattice, 9).tolist(), f.pbc.tolist(), f.config_type)
    frames = [Frame(s, np.array(p), np.array(c), np.array(b), t or "", structure_id=i) for i, s, p, c, b, t in rows]
    cases = [("supercell", {"scale": [2, 1, 3], "fixed": "y"}), ("vacancy_defect", {"samples": 3}), ("vacancy_defect", {"samples": 20, "seed": 5}), ("perturb", {"count": 2, "by_element": {"Zn": 0.1}, "seed": 2**33 + 1})]
    want = [sorted(text(f.structure_id, v, r) for f in frames for v, r in enumerate(G.run_one(name, f, **params))) for name, params in cases]
    for (name, params), expected in zip(cases, want):
        monkeypatch.setattr(G.OPERATIONS[name], "run", lambda f, p: (_ for _ in ()).throw(AssertionError("one by one")))
        got = sorted(text(r.structure_id, r.variant, Frame(list(r.species), np.array(r.pos), np.array(r.lattice), np.array(r.pbc), r.config_type)) for r in G.apply(df, name, **params).collect())
        assert [x[:3] + x[5:] for x in got] == [x[:3] + x[5:] for x in expected] and len(got) > 40
        assert all(np.allclose(a[3], b[3]) and np.allclose(a[4], b[4]) for a, b in zip(got, expected))
        monkeypatch.undo()
    # faults and moments go through the operation itself
    odd = spark.createDataFrame([(1, ["Cu"] * 2, [[0.0] * 3, [1.0] * 3], None, None, None, [[0.0, 0.0, 1.0]] * 2)], "structure_id bigint, species array<string>, pos array<array<double>>, lattice array<array<double>>, pbc array<boolean>, config_type string, spin array<array<double>>")
    assert G.apply(odd, "vacancy_defect", samples=2).where("size(spin) = 1").count() == 2


def test_random_streams_are_those_of_numpy():
    from framelake.functions.structure import content_seed
    from framelake.generators.batches import choose, draw, states

    numbers = np.array([0, 1, 2**32 - 1, 2**32, 2**64 - 1, 123456789012345678], np.uint64)
    for salt in (0, 7, 2**32 - 1):
        for k, (state, inc) in zip(numbers.tolist(), states(salt, numbers)):
            r = np.random.default_rng([salt, k])
            assert r.bit_generator.state["state"] == {"state": state, "inc": inc}
            assert (draw(state, inc)[1] >> 11) * 2.0**-53 == r.random()
            for n in (1, 2, 5, 1000):
                assert choose(state, inc, n) == np.random.default_rng([salt, k]).choice(n, 1, replace=False)[0]
    a = content_seed([29, 8], np.eye(2, 3), np.eye(3), np.ones(3, bool), None, "x", 3)
    import hashlib

    h = hashlib.blake2b(digest_size=8)
    for part in (np.array([29, 8], "<i8"), np.eye(2, 3), np.eye(3), np.ones(3, np.uint8)):
        h.update(part.tobytes())
    h.update(b"x")
    assert (a.normal(size=9) == np.random.default_rng([3, int.from_bytes(h.digest(), "big")]).normal(size=9)).all()
