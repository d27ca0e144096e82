"""Operations on cells and lattices: strain, Bain path, scaling, shear, perturbation, supercells, slabs, faults, layers."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product
from math import gcd

import numpy as np

from framelake.generators.base import Frame, OperationError, operation, scan, unit_samples
from framelake.generators.conditions import condition, formula


def _set_cell(f: Frame, cell: np.ndarray, tag: str) -> Frame:
    """Another cell with the same fractional coordinates."""
    return f.tagged(tag, lattice=cell, pos=f.fractional() @ cell)


@operation("cell_strain", axes="uniaxial", x=(-5, 5, 1), y=(-5, 5, 1), z=(-5, 5, 1))
def cell_strain(f: Frame, p: dict) -> Iterator[Frame]:
    """Scale lattice vectors by percentages: one, two or three at a time, all alike, or those named (such as ``XZ``)."""
    axes = p["axes"].lower()
    if axes == "isotropic":
        sets, values = ["xyz"], {"xyz": [(v, v, v) for v in scan(p["x"])]}
    else:
        n = {"uniaxial": 1, "biaxial": 2, "triaxial": 3}.get(axes)
        sets = ["".join(c) for c in combinations("xyz", n)] if n else ["".join(sorted(set(axes)))]
        if not set("".join(sets)) <= set("xyz"):
            raise OperationError(f"unknown axes {p['axes']}")
        values = {s: list(product(*(scan(p[a]) for a in s))) for s in sets}
    for s in sets:
        for combo in values[s]:
            factor = np.ones(3)
            for a, v in zip(s, combo):
                factor["xyz".index(a)] = 1 + v / 100
            yield _set_cell(f, f.lattice * factor[:, None], "Strain(" + ",".join(f"{a}{v:g}" for a, v in zip(s, combo)) + ")")


@operation("bain_path", axis="z", ratios=(0.9, 1.1, 0.05), mode="constant_volume", volume_scales=(1.0, 1.0, 1.0), scale_atoms=True)
def bain_path(f: Frame, p: dict) -> Iterator[Frame]:
    """Stretch one axis by ``r``: at constant volume (others by its inverse root), with scaled volume, or alone (``free_c``)."""
    at = "xyz".index(p["axis"])
    for r, v in product(scan(p["ratios"]), scan(p["volume_scales"]) if p["mode"] == "scale_volume" else [1.0]):
        if r <= 0 or v <= 0:
            raise OperationError("ratios and scales must be positive")
        factor = np.full(3, 1.0 if p["mode"] == "free_c" else r**-0.5) * v ** (1 / 3)
        factor[at] = r * v ** (1 / 3)
        cell = f.lattice * factor[:, None]
        tag = f"Bain({p['axis']}{r:g}" + (f",v{v:g})" if v != 1 else ")")
        yield _set_cell(f, cell, tag) if p["scale_atoms"] else f.tagged(tag, lattice=cell)


def from_parameters(lengths: np.ndarray, angles: np.ndarray) -> np.ndarray:
    """Cell with the first vector along x and the second in the plane of x and y."""
    a, b, c = np.cos(np.radians(angles))
    s = np.sin(np.radians(angles[2]))
    y = (a - b * c) / s
    z2 = 1 - b * b - y * y
    if z2 <= 0:
        raise OperationError("no cell has these angles")
    return np.array([[lengths[0], 0, 0], [lengths[1] * c, lengths[1] * s, 0], [lengths[2] * b, lengths[2] * y, lengths[2] * np.sqrt(z2)]])


def cell_parameters(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and angles in degrees."""
    n = np.linalg.norm(cell, axis=1)
    cos = [cell[i] @ cell[j] / (n[i] * n[j]) for i, j in ((1, 2), (0, 2), (0, 1))]
    return n, np.degrees(np.arccos(np.clip(cos, -1, 1)))


@operation("cell_scaling", engine="uniform", max_scaling=0.04, count=50, perturb_angle=True, seed=0)
def cell_scaling(f: Frame, p: dict) -> Iterator[Frame]:
    """Random lengths, and angles, within a factor of one plus or minus ``max_scaling``."""
    lengths, angles = cell_parameters(f.lattice)
    u = 1 + (2 * unit_samples(f.rng(p["seed"], "scaling"), p["count"], 6 if p["perturb_angle"] else 3, p["engine"]) - 1) * p["max_scaling"]
    for i, row in enumerate(u):
        try:
            cell = from_parameters(lengths * row[:3], angles * row[3:] if p["perturb_angle"] else angles)
        except OperationError:
            continue
        yield _set_cell(f, cell, f"Scaling({i})")


@operation("shear_matrix", xy=(-5, 5, 5), yz=(0, 0, 1), xz=(0, 0, 1), symmetric=False)
def shear_matrix(f: Frame, p: dict) -> Iterator[Frame]:
    """Cell times identity plus shear, percentages on the full grid."""
    for xy, yz, xz in product(*(scan(p[k]) for k in ("xy", "yz", "xz"))):
        m = np.eye(3)
        m[0, 1], m[1, 2], m[0, 2] = xy / 100, yz / 100, xz / 100
        if p["symmetric"]:
            m = m + m.T - np.eye(3)
        yield _set_cell(f, f.lattice @ m, f"Shear(xy{xy:g},yz{yz:g},xz{xz:g})")


@operation("shear_angle", alpha=(-2, 2, 1), beta=(0, 0, 1), gamma=(0, 0, 1))
def shear_angle(f: Frame, p: dict) -> Iterator[Frame]:
    """Cells of the same lengths with shifted angles."""
    lengths, angles = cell_parameters(f.lattice)
    for d in product(*(scan(p[k]) for k in ("alpha", "beta", "gamma"))):
        yield _set_cell(f, from_parameters(lengths, angles + np.array(d)), "Angle(" + ",".join(f"{v:g}" for v in d) + ")")


@operation("perturb", engine="uniform", max_distance=0.3, count=50, by_element={}, rigid=False, seed=0)
def perturb(f: Frame, p: dict) -> Iterator[Frame]:
    """Displace every atom uniformly within a ball, or every bonded cluster as one; radii may differ by element."""
    from framelake.generators.molecules import clusters  # noqa: PLC0415

    rng = f.rng(p["seed"], "perturb")
    parts = clusters(f) if p["rigid"] else [[i] for i in range(len(f))]
    u = unit_samples(rng, p["count"], 3 * len(parts), p["engine"]).reshape(p["count"], len(parts), 3)
    reach = np.array([p["by_element"].get(f.species[part[0]], p["max_distance"]) for part in parts], float)
    owner = np.empty(len(f), int)
    for i, part in enumerate(parts):
        owner[part] = i
    for i, row in enumerate(u):
        direction = rng.normal(size=(len(parts), 3)) if p["engine"] == "uniform" else np.stack([np.sqrt(1 - (2 * row[:, 1] - 1) ** 2) * np.cos(2 * np.pi * row[:, 2]), np.sqrt(1 - (2 * row[:, 1] - 1) ** 2) * np.sin(2 * np.pi * row[:, 2]), 2 * row[:, 1] - 1], 1)
        direction /= np.maximum(np.linalg.norm(direction, axis=1, keepdims=True), 1e-12)
        step = direction * np.cbrt(row[:, :1])
        pos = f.pos + (step * reach[:, None])[owner]
        moved = f.tagged(f"Perturb({i})", pos=pos)
        yield moved if f.volume < 1e-12 else moved.tagged("", pos=moved.wrapped())


def replicate(f: Frame, n: tuple[int, int, int], tag: str) -> Frame:
    """``n`` copies along the cell's vectors."""
    shifts = np.array(list(product(*(range(k) for k in n))), float) @ f.lattice
    pos = (f.pos[None] + shifts[:, None]).reshape(-1, 3)
    k = len(shifts)
    spin = None if f.spin is None else np.tile(f.spin, (k, 1))
    return f.tagged(tag, species=f.species * k, pos=pos, lattice=f.lattice * np.array(n)[:, None], spin=spin, grp=None if f.grp is None else f.grp * k)


@operation("supercell", mode="scale", scale=(2, 2, 2), cell=(10.0, 10.0, 10.0), max_atoms=100, every=False, fixed="")
def supercell(f: Frame, p: dict) -> Iterator[Frame]:
    """Copies by factors, up to lengths, or up to a number of atoms; with ``every`` all factors up to these; ``fixed`` axes stay single."""
    free = [a not in p["fixed"] for a in "xyz"]
    if p["mode"] == "scale":
        most = [int(s) for s in p["scale"]]
    elif p["mode"] == "cell":
        most = [max(1, int(c // n)) for c, n in zip(p["cell"], cell_parameters(f.lattice)[0])]
    else:
        lengths, best = cell_parameters(f.lattice)[0], (1, 1, 1)
        top = max(1, p["max_atoms"] // max(1, len(f)))
        for n in product(range(1, top + 1), repeat=3):
            if n[0] * n[1] * n[2] <= top and all(k == 1 or ok for k, ok in zip(n, free)):
                key = lambda m: (m[0] * m[1] * m[2], -np.ptp(np.array(m) * lengths))
                best = max(best, n, key=key)
        most = list(best)
    most = [m if ok else 1 for m, ok in zip(most, free)]
    if min(most) < 1:
        raise OperationError("factors start at 1")
    for n in product(*(range(1, m + 1) for m in most)) if p["every"] else [tuple(most)]:
        yield replicate(f, n, "Supercell(" + "x".join(map(str, n)) + ")")


def plane(cell: np.ndarray, hkl: tuple[int, int, int]) -> np.ndarray:
    """Unit normal of a lattice plane."""
    if not any(hkl):
        raise OperationError("a plane needs an index that is not 0")
    n = np.linalg.inv(cell) @ np.array(hkl, float)
    return n / np.linalg.norm(n)


@operation("stacking_fault", hkl=(1, 1, 1), steps=(0, 1, 0.5), layers=1)
def stacking_fault(f: Frame, p: dict) -> Iterator[Frame]:
    """Shift the atoms above the middle plane within it, by steps of the in-plane lattice vector."""
    n = plane(f.lattice, tuple(p["hkl"]))
    height = f.pos @ n
    levels = np.unique(np.round(height, 3))
    cut = levels[max(0, len(levels) // 2 - p["layers"] // 2)] - 1e-3
    along = min((v - (v @ n) * n for v in f.lattice), key=lambda v: -np.linalg.norm(v))
    for s in scan(p["steps"]):
        pos = f.pos.copy()
        pos[height >= cut] += s * along
        yield f.tagged(f"Fault({s:g})", pos=pos)


@operation("gsfe_path", plane_hkl=(0, 0, 1), slip_uvw=(1, 0, 0), displacements=(0, 1, 0.1), unit="fraction", cut="middle", cut_value=0.5, wrap=True)
def gsfe_path(f: Frame, p: dict) -> Iterator[Frame]:
    """Rigid slips of the upper half along a direction that lies in the plane."""
    n = plane(f.lattice, tuple(p["plane_hkl"]))
    slip = np.array(p["slip_uvw"], float) @ f.lattice
    if np.linalg.norm(slip) < 1e-9 or abs(slip @ n) > 1e-6 * np.linalg.norm(slip):
        raise OperationError("the slip direction does not lie in the plane")
    h = f.pos @ n
    if p["cut"] == "middle":
        at = (h.min() + h.max()) / 2
    elif p["cut"] == "fractional":
        at = h.min() + p["cut_value"] * (h.max() - h.min())
    else:
        levels = np.unique(np.round(h, 3))
        i = int(p["cut_value"])
        if not 0 <= i < len(levels) - 1:
            raise OperationError("no such layer")
        at = (levels[i] + levels[i + 1]) / 2
    for d in scan(p["displacements"]):
        pos = f.pos.copy()
        pos[h > at] += slip * d if p["unit"] == "fraction" else slip / np.linalg.norm(slip) * d
        out = f.tagged(f"GSFE({d:g})", pos=pos)
        yield out.tagged("", pos=out.wrapped()) if p["wrap"] else out


def slab(f: Frame, hkl: tuple[int, int, int], layers: int, vacuum: float) -> Frame:
    """A slab of ``layers`` lattice planes with its normal along z and vacuum on top."""
    g = gcd(gcd(abs(hkl[0]), abs(hkl[1])), abs(hkl[2]))
    h = np.array(hkl) // g
    # two lattice vectors in the plane and one that leaves it by one plane spacing
    small = sorted((v for v in product(range(-4, 5), repeat=3) if any(v)), key=lambda v: float(np.linalg.norm(np.array(v) @ f.lattice)))
    inside = [v for v in small if np.dot(v, h) == 0]
    a = np.array(inside[0])
    b = next(np.array(v) for v in inside if np.any(np.cross(a, v)))
    c = np.array(next(v for v in small if np.dot(v, h) == 1))
    m = np.array([a, b, c])
    if np.linalg.det(m) < 0:
        m[1] = -m[1]
    base = m @ f.lattice
    frac = f.pos @ np.linalg.inv(f.lattice) @ np.linalg.inv(m)
    size = abs(round(np.linalg.det(m)))
    every, kinds, seen = [], [], set()
    for s, x in zip(f.species * 1, frac):
        for shift in product(range(-5, 6), repeat=3):
            y = x + np.array(shift) @ np.linalg.inv(m)
            y = y - np.floor(y + 1e-9)
            key = (s, *np.round(y % 1.0, 6))
            if key not in seen:
                seen.add(key)
                every.append(y)
                kinds.append(s)
            if len(every) == size * len(f):
                break
    pos = np.concatenate([(np.array(every) + [0, 0, k]) @ base for k in range(layers)])
    x = base[0] / np.linalg.norm(base[0])
    z = np.cross(base[0], base[1])
    z /= np.linalg.norm(z)
    turn = np.array([x, np.cross(z, x), z]).T
    pos, flat = pos @ turn, base[:2] @ turn
    pos[:, 2] -= pos[:, 2].min()
    cell = np.vstack([flat, [0, 0, pos[:, 2].max() + max(vacuum, 0.0) + (0.0 if vacuum > 0 else (base[2] @ turn)[2] / max(size, 1))]])
    return f.tagged(f"Slab({hkl[0]}{hkl[1]}{hkl[2]},{layers},{vacuum:g})", species=kinds * layers, pos=pos, lattice=cell, pbc=np.array([True, True, vacuum <= 0]), spin=None, grp=None)


@operation("random_slab", h=(0, 1, 1), k=(0, 1, 1), l=(1, 1, 1), layers=(3, 6, 1), vacuum=(10, 10, 1))
def random_slab(f: Frame, p: dict) -> Iterator[Frame]:
    """Slabs of every plane, thickness and vacuum of the ranges."""
    for h, k, ell in product(*(scan(p[x]) for x in "hkl")):
        if h or k or ell:
            for n, v in product(scan(p["layers"]), scan(p["vacuum"])):
                yield slab(f, (int(h), int(k), int(ell)), int(n), v)


@operation("layer_copy", dz="0", parameters={}, mask="all", layers=2, distance=3.0, vacuum=0.0)
def layer_copy(f: Frame, p: dict) -> Iterator[Frame]:
    """Warp the masked atoms by ``dz(x, y, z)`` and stack copies along z; ``mask`` is a condition or ``elements:A,B``."""
    mask = np.isin(f.species, p["mask"][9:].split(",")) if p["mask"].startswith("elements:") else condition(p["mask"], f.pos)
    pos = f.pos.copy()
    pos[mask, 2] += formula(p["dz"], f.pos[mask], p["parameters"])
    copies = [pos + [0, 0, i * p["distance"]] for i in range(p["layers"])]
    every = np.concatenate(copies)
    cell = f.lattice.copy()
    top = np.ptp(every[:, 2]) + (p["vacuum"] or p["distance"])
    cell[2] = cell[2] / max(np.linalg.norm(cell[2]), 1e-12) * top if np.linalg.norm(cell[2]) > 0 else [0, 0, top]
    yield f.tagged(f"Layers({p['layers']})", species=f.species * p["layers"], pos=every, lattice=cell, spin=None if f.spin is None else np.tile(f.spin, (p["layers"], 1)), grp=None if f.grp is None else f.grp * p["layers"])


@operation("vibration", modes=[], frequencies=[], amplitude=0.1, per_sample=2, count=10, distribution="normal", min_frequency=10.0, seed=0)
def vibration(f: Frame, p: dict) -> Iterator[Frame]:
    """Displacements by random sums of vibration modes, each divided by the root of its frequency."""
    usable = [(np.array(m, float).reshape(-1, 3), w) for m, w in zip(p["modes"], p["frequencies"]) if w >= p["min_frequency"]]
    if not usable or any(len(m) != len(f) for m, _ in usable):
        raise OperationError("modes must fit the atoms and lie above the least frequency")
    rng = f.rng(p["seed"], "vibration")
    for i in range(p["count"]):
        chosen = rng.choice(len(usable), min(p["per_sample"], len(usable)), replace=False)
        c = rng.normal(size=len(chosen)) if p["distribution"] == "normal" else rng.uniform(-1, 1, len(chosen))
        move = sum(x * usable[j][0] / np.sqrt(usable[j][1]) for x, j in zip(c, chosen))
        yield f.tagged(f"Vibration({i})", pos=f.pos + p["amplitude"] * move)


#: Conventional cells: fractional sites with their sublattice, and the cell's shape for a length and c/a.
_CUBIC = lambda a, _: np.eye(3) * a
_HEX = lambda a, r: np.array([[a, 0, 0], [-a / 2, a * np.sqrt(3) / 2, 0], [0, 0, a * r]])
_FCC = [(0, 0, 0), (0.5, 0.5, 0), (0.5, 0, 0.5), (0, 0.5, 0.5)]
PROTOTYPES = {
    "fcc": (_CUBIC, [(s, 0) for s in _FCC]), "bcc": (_CUBIC, [((0, 0, 0), 0), ((0.5, 0.5, 0.5), 0)]), "sc": (_CUBIC, [((0, 0, 0), 0)]),
    "hcp": (_HEX, [((1 / 3, 2 / 3, 0.25), 0), ((2 / 3, 1 / 3, 0.75), 0)]), "l12": (_CUBIC, [(s, int(i > 0)) for i, s in enumerate(_FCC)]),
    "b2": (_CUBIC, [((0, 0, 0), 0), ((0.5, 0.5, 0.5), 1)]), "l10": (lambda a, r: np.diag([a, a, a * r]), [(s, int(s[2] > 0)) for s in _FCC]),
    "diamond": (_CUBIC, [(s, 0) for s in _FCC] + [(tuple(x + 0.25 for x in s), 0) for s in _FCC]),
    "b1": (_CUBIC, [(s, 0) for s in _FCC] + [((s[0] + 0.5, s[1], s[2]), 1) for s in _FCC]), "b3": (_CUBIC, [(s, 0) for s in _FCC] + [(tuple(x + 0.25 for x in s), 1) for s in _FCC]),
}
PROTOTYPES |= {"a1": PROTOTYPES["fcc"], "a2": PROTOTYPES["bcc"], "a3": PROTOTYPES["hcp"]}


@operation("crystal_prototype", kind="generator", prototypes=("fcc",), elements=("Cu",), a=(3.5, 3.7, 0.1), covera=1.633, scale=(1, 1, 1), max_atoms=10_000)
def crystal_prototype(p: dict) -> Iterator[Frame]:
    """Crystals of every prototype, element and lattice constant."""
    for kind, e, a in product(p["prototypes"], p["elements"], scan(p["a"])):
        cell, sites = PROTOTYPES[kind.lower()]
        lattice = cell(a, p["covera"])
        f = Frame([e] * len(sites), np.array([s for s, _ in sites]) % 1.0 @ lattice, lattice, np.ones(3, bool))
        if len(sites) * int(np.prod(p["scale"])) <= p["max_atoms"]:
            yield replicate(f, tuple(p["scale"]), f"{kind}({e},{a:g})")


@operation("ordered_alloy", kind="generator", prototype="l12", sublattices=(("Ni",), ("Al",)), a=(3.5, 3.6, 0.1), covera=1.0, max_atoms=128)
def ordered_alloy(p: dict) -> Iterator[Frame]:
    """Ordered alloys: every choice of elements for the sublattices, as large as ``max_atoms`` allows; ``grp`` holds the sublattice."""
    cell, sites = PROTOTYPES[p["prototype"].lower()]
    if len(p["sublattices"]) != max(s for _, s in sites) + 1:
        raise OperationError("one list of elements per sublattice is needed")
    n = max(1, int(round((p["max_atoms"] / len(sites)) ** (1 / 3) - 0.4999)))
    for a, chosen in product(scan(p["a"]), product(*p["sublattices"])):
        lattice = cell(a, p["covera"])
        f = Frame([chosen[s] for _, s in sites], np.array([x for x, _ in sites]) % 1.0 @ lattice, lattice, np.ones(3, bool), grp=["AB"[s] if s < 2 else f"S{s}" for _, s in sites])
        yield replicate(f, (n, n, n), f"{p['prototype']}({'-'.join(chosen)},{a:g})")
