"""Molecules in structures: bonded clusters, torsions, conformers, solvents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from framelake.functions.elements import MASS, RADIUS
from framelake.generators.base import Frame, OperationError, operation
from framelake.generators.alloys import least_distance
from framelake.generators.magnetism import rotate
from framelake.operators.neighbors import pairs_within

ORGANIC = {"H", "O", "N", "S", "P"}


def bond_graph(f: Frame, scale: float = 1.15) -> dict[int, dict[int, np.ndarray]]:
    """For every atom its bonded neighbours with the vector to them, over periodic borders too."""
    graph: dict[int, dict[int, np.ndarray]] = {i: {} for i in range(len(f))}
    if len(f) < 2:
        return graph
    r = np.array([RADIUS.get(s, 1.5) for s in f.species])
    _, i, j, d, v = pairs_within([(f.pos, f.lattice, f.pbc)], 2 * scale * float(r.max()))
    for a, b, x, w in zip(i, j, d, v):
        if a != b and x <= scale * (r[a] + r[b]) and (b not in graph[a] or x < np.linalg.norm(graph[a][b])):
            graph[int(a)][int(b)] = w
    return graph


def clusters(f: Frame, scale: float = 1.15) -> list[list[int]]:
    """Atoms of each bonded cluster, in order of their first atom."""
    graph, seen, out = bond_graph(f, scale), set(), []
    for start in range(len(f)):
        if start in seen:
            continue
        seen.add(start)
        part, queue = [], [start]
        while queue:
            a = queue.pop()
            part.append(a)
            for b in graph[a]:
                if b not in seen:
                    seen.add(b)
                    queue.append(b)
        out.append(sorted(part))
    return out


def is_organic(f: Frame, part: list[int]) -> bool:
    """A cluster with carbon and any of H, O, N, S, P."""
    kinds = {f.species[i] for i in part}
    return "C" in kinds and bool(kinds & ORGANIC)


def unwrap(f: Frame, scale: float = 1.15) -> np.ndarray:
    """Positions with every cluster in one piece, grown from its first atom along bonds."""
    graph, pos, seen = bond_graph(f, scale), f.pos.copy(), set()
    for start in range(len(f)):
        if start in seen:
            continue
        seen.add(start)
        queue = [start]
        while queue:
            a = queue.pop()
            for b, v in graph[a].items():
                if b not in seen:
                    seen.add(b)
                    pos[b] = pos[a] + v
                    queue.append(b)
    return pos


def recentre(f: Frame, scale: float = 1.15) -> np.ndarray:
    """Unwrapped clusters moved as a whole so that their centres of mass lie in the cell."""
    pos = unwrap(f, scale)
    inverse = np.linalg.inv(f.lattice)
    for part in clusters(f, scale):
        m = np.array([MASS.get(f.species[i], 1.0) for i in part])
        frac = (m @ pos[part] / m.sum()) @ inverse
        pos[part] -= np.where(f.pbc, np.floor(frac), 0.0) @ f.lattice
    return pos


def bridges(graph: dict[int, dict[int, np.ndarray]]) -> list[tuple[int, int]]:
    """Bonds whose removal divides their cluster: those that no walk back reaches around."""
    order: dict[int, int] = {}
    low: dict[int, int] = {}
    out = []
    for root in graph:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack = [(root, None, iter(graph[root]))]
        while stack:
            a, parent, rest = stack[-1]
            for b in rest:
                if b == parent:
                    continue
                if b in order:
                    low[a] = min(low[a], order[b])
                else:
                    order[b] = low[b] = len(order)
                    stack.append((b, a, iter(graph[b])))
                    break
            else:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[a])
                    if low[a] > order[parent]:
                        out.append((parent, a))
    return out


def side(graph: dict, a: int, b: int) -> list[int]:
    """Atoms on ``b``'s side of the bond between ``a`` and ``b``."""
    seen, queue = {a, b}, [b]
    while queue:
        for y in graph[queue.pop()]:
            if y not in seen:
                seen.add(y)
                queue.append(y)
    return sorted(seen - {a})


def torsions(f: Frame, max_side: int = 200) -> list[tuple[int, int, list[int]]]:
    """Turnable bonds: bridges between atoms that have other neighbours, with the smaller side."""
    graph, out = bond_graph(f), []
    for a, b in bridges(graph):
        if len(graph[a]) > 1 and len(graph[b]) > 1:
            x, y = side(graph, a, b), side(graph, b, a)
            first, second, part = (a, b, x) if len(x) <= len(y) else (b, a, y)
            if len(part) <= max_side:
                out.append((first, second, part))
    return out


@operation("conformers", angle=(-180.0, 180.0), count=10, attempts=20, bond_tolerance=0.15, clash=0.75, max_side=200, seed=0)
def conformers(f: Frame, p: dict) -> Iterator[Frame]:
    """Random torsions around all turnable bonds; results that stretch a bond or bring unbonded atoms together are drawn again."""
    graph = bond_graph(f)
    turns = torsions(f, p["max_side"])
    if not turns:
        return
    whole = Frame(f.species, unwrap(f), f.lattice, f.pbc, f.config_type, f.spin, f.grp, f.structure_id)
    bonded = {(a, b) for a, g in graph.items() for b in g}
    length = {(a, b): float(np.linalg.norm(v)) for a, g in graph.items() for b, v in g.items()}
    r = np.array([RADIUS.get(s, 1.5) for s in f.species])
    for i in range(p["count"]):
        rng = f.rng(p["seed"], f"torsion{i}")
        for _ in range(p["attempts"]):
            pos = whole.pos.copy()
            for a, b, part in turns:
                axis = pos[b] - pos[a]
                pos[part] = pos[b] + rotate(pos[part] - pos[b], axis, np.full(len(part), np.radians(rng.uniform(*p["angle"]))))
            _, x, y, d, _ = pairs_within([(pos, f.lattice, f.pbc)], 2 * float(r.max()))
            clash = any(d_ < p["clash"] * (r[a] + r[b]) and a != b and (a, b) not in bonded for a, b, d_ in zip(x.tolist(), y.tolist(), d))
            stretched = any(abs(np.linalg.norm(pos[b] - pos[a]) - length[a, b]) > p["bond_tolerance"] for a, b in bonded)
            if not clash and not stretched:
                yield whole.tagged(f"Torsion({i})", pos=pos)
                break


def _turned(rng: np.random.Generator, mol: np.ndarray) -> np.ndarray:
    """A molecule around its centre, turned at random."""
    q, t = np.linalg.qr(rng.normal(size=(3, 3)))
    q = q * np.sign(np.diag(t))
    if np.linalg.det(q) < 0:
        q[:, 0] = -q[:, 0]
    return (mol - mol.mean(0)) @ q


#: Water, for when no solvent is given.
WATER = (["O", "H", "H"], [[0.0, 0.0, 0.0], [0.9572, 0.0, 0.0], [-0.24, 0.9266, 0.0]])


def _fits(out: Frame, points: np.ndarray, least: float) -> bool:
    return all(least_distance(out, x) >= least for x in points)


@operation("local_solvation", solvents=(WATER,), count=6, centres="all", elements=(), shell=(2.5, 4.5), min_distance=1.6, attempts=100, samples=1, strict=False, seed=0)
def local_solvation(f: Frame, p: dict) -> Iterator[Frame]:
    """Place molecules in a shell around chosen centres (all atoms, those of elements, or the middle), turned at random, without collisions."""
    if p["centres"] == "middle":
        centres = f.pos.mean(0, keepdims=True)
    else:
        at = [i for i, s in enumerate(f.species) if not p["elements"] or s in p["elements"]]
        centres = f.pos[at]
    if not len(centres):
        raise OperationError("no centre")
    for i in range(p["samples"]):
        rng, out, placed = f.rng(p["seed"], f"solvation{i}"), f, 0
        for _ in range(p["count"]):
            kinds, mol = p["solvents"][int(rng.integers(len(p["solvents"])))]
            for _ in range(p["attempts"]):
                d = rng.normal(size=3)
                radius = np.cbrt(rng.uniform(p["shell"][0] ** 3, p["shell"][1] ** 3))
                points = _turned(rng, np.array(mol, float)) + centres[int(rng.integers(len(centres)))] + d / np.linalg.norm(d) * radius
                if _fits(out, points, p["min_distance"]):
                    out, placed = out.with_atoms(list(kinds), points, ""), placed + 1
                    break
        if placed == p["count"] or (placed and not p["strict"]):
            yield out.tagged(f"Solvation({placed},{i})")


@operation("solvent_fill", solvent=WATER, count=None, density=1.0, min_distance=1.6, attempts=200, strict=False, samples=1, seed=0)
def solvent_fill(f: Frame, p: dict) -> Iterator[Frame]:
    """Fill the cell with molecules, a given number or up to a mass density (g/cm3) of what the cell has room for."""
    kinds, mol = p["solvent"]
    mass = sum(MASS[e] for e in kinds)
    held = sum(MASS.get(s, 0.0) for s in f.species)
    n = p["count"] if p["count"] is not None else max(0, int((p["density"] * f.volume / 1.66053906660 - held) / mass))
    for i in range(p["samples"]):
        rng, out, placed = f.rng(p["seed"], f"fill{i}"), f, 0
        for _ in range(n):
            for _ in range(p["attempts"]):
                points = _turned(rng, np.array(mol, float)) + rng.random(3) @ f.lattice
                if _fits(out, points, p["min_distance"]):
                    out, placed = out.with_atoms(list(kinds), points, ""), placed + 1
                    break
            else:
                break
        if placed == n or not p["strict"]:
            yield out.tagged(f"Fill({placed},{i})")
