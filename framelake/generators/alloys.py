"""Operations on compositions and defects: doping, occupancies, gradients, vacancies, insertions."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np

from framelake.functions.elements import MASS, NUMBER
from framelake.generators.base import Frame, OperationError, operation, unit_samples
from framelake.generators.conditions import condition


def parse_composition(text: str | dict) -> dict[str, float]:
    """Shares of a text such as ``Fe:0.6,Ni:0.4`` or ``Fe0.6Ni0.4``, or JSON, scaled to sum 1."""
    if isinstance(text, str):
        text = json.loads(text) if text.strip().startswith("{") else {e: float(v or 1) for e, v in re.findall(r"([A-Z][a-z]?)\s*:?\s*(\d*\.?\d*)", text)}
    total = sum(text.values())
    if not text or total <= 0 or min(text.values()) < 0 or not set(text) <= set(NUMBER):
        raise OperationError("no composition")
    return {e: v / total for e, v in text.items()}


def format_composition(shares: dict[str, float]) -> str:
    return "Comp(" + ",".join(f"{e}:{v:g}" for e, v in shares.items()) + ")"


def largest_remainder(shares: dict[str, float], n: int) -> dict[str, int]:
    """Whole numbers that add up to ``n``, as near to the shares as possible; ties by order."""
    exact = {e: v * n for e, v in shares.items()}
    out = {e: int(np.floor(v + 1e-12)) for e, v in exact.items()}
    for e in sorted(exact, key=lambda e: out[e] - exact[e])[: n - sum(out.values())]:
        out[e] += 1
    return out


def _replace(f: Frame, sites: np.ndarray, kinds: list[str], tag: str) -> Frame:
    species = list(f.species)
    for i, e in zip(sites, kinds):
        species[i] = e
    return f.tagged(tag, species=species)


def _sites(f: Frame, target: list[str] | str, group: str | None = None) -> np.ndarray:
    wanted = {target} if isinstance(target, str) else set(target)
    return np.array([i for i, s in enumerate(f.species) if s in wanted and (not group or (f.grp is not None and f.grp[i] == group))], int)


def _fill(rng: np.random.Generator, shares: dict[str, float], n: int, exact: bool) -> list[str]:
    if exact:
        kinds = [e for e, k in largest_remainder(shares, n).items() for _ in range(k)]
        return [kinds[i] for i in rng.permutation(n)]
    return [list(shares)[i] for i in rng.choice(len(shares), n, p=list(shares.values()))]


@operation("random_doping", rules=[], count=1, exact=True, seed=0)
def random_doping(f: Frame, p: dict) -> Iterator[Frame]:
    """Sequential rules ``{target, dopants, use, amount, group}``: replace a share, mass share or number of the target's sites.

    ``use`` is atomic_percent, mass_percent or count; ``amount`` a value or a (low, high) range.
    """
    for i in range(p["count"]):
        rng, out = f.rng(p["seed"], f"doping{i}"), f
        for rule in p["rules"]:
            sites = _sites(out, rule["target"], rule.get("group"))
            shares = parse_composition(rule["dopants"])
            amount = rule["amount"]
            amount = rng.uniform(*amount) if isinstance(amount, (list, tuple)) else amount
            if rule.get("use", "atomic_percent") == "count":
                n = int(round(amount))
            elif rule["use"] == "mass_percent":
                # share of the dopants in the mass of target and dopants together
                host = MASS[out.species[sites[0]]] if len(sites) else 1.0
                guest = sum(v * MASS[e] for e, v in shares.items())
                w = amount / 100
                n = int(round(len(sites) * (w / guest) / (w / guest + (1 - w) / host)))
            else:
                n = int(round(len(sites) * amount / 100))
            chosen = rng.choice(sites, min(max(n, 0), len(sites)), replace=False) if len(sites) else sites
            out = _replace(out, chosen, _fill(rng, shares, len(chosen), p["exact"]), "")
        yield out.tagged(f"Doping({i})")


def simplex(elements: tuple[str, ...], step: float, least: float = 0.0) -> list[dict[str, float]]:
    """All shares on a grid that add up to one."""
    n = int(round(1 / step))
    out = []
    for bars in combinations(range(n + len(elements) - 1), len(elements) - 1):
        edge = [-1, *bars, n + len(elements) - 1]
        part = [(edge[i + 1] - edge[i] - 1) / n for i in range(len(elements))]
        if min(part) > 0 and min(part) >= least - 1e-12:
            out.append({e: round(v, 12) for e, v in zip(elements, part)})
    return out


@operation("composition_sweep", elements=("Fe", "Ni", "Cr"), orders=(2, 3), method="grid", step=0.1, min_fraction=0.0, budget="equal", count=500, seed=0)
def composition_sweep(f: Frame, p: dict) -> Iterator[Frame]:
    """Copies tagged with compositions: grid or Sobol points of every combination of elements; the budget is shared equally or by the number of points."""
    combos = [c for k in p["orders"] for c in combinations(p["elements"], k)]
    rng = f.rng(p["seed"], "sweep")
    points = {}
    for c in combos:
        if p["method"] == "grid":
            points[c] = simplex(c, p["step"], p["min_fraction"])
        else:
            u = np.sort(unit_samples(rng, max(1, p["count"] // len(combos)), len(c) - 1, "sobol"), axis=1)
            shares = np.diff(np.hstack([np.zeros((len(u), 1)), u, np.ones((len(u), 1))]), axis=1)
            points[c] = [dict(zip(c, map(float, s))) for s in shares if s.min() >= p["min_fraction"]]
    total = sum(map(len, points.values()))
    left = {c: len(v) for c, v in points.items() if v}
    quota = dict.fromkeys(left, 0)
    budget = min(p["count"], total)
    if p["budget"] == "weighted" and total:
        quota = {c: min(left[c], int(budget * left[c] / total)) for c in left}
    while sum(quota.values()) < budget:  # what a combination cannot use goes to the others
        for c in left:
            if quota[c] < left[c] and sum(quota.values()) < budget:
                quota[c] += 1
    for c, n in quota.items():
        at = np.linspace(0, len(points[c]) - 1, n).round().astype(int) if n < len(points[c]) else range(n)
        for i in at:
            yield f.tagged(format_composition(points[c][i]))


@operation("random_occupancy", source="tag", composition="", exact=True, count=1, group=None, seed=0)
def random_occupancy(f: Frame, p: dict) -> Iterator[Frame]:
    """Species by a composition, given or from the ``Comp(...)`` tag, on all sites or those of a group."""
    text = p["composition"]
    if p["source"] == "tag":
        found = re.findall(r"Comp\(([^)]*)\)", f.config_type)
        if not found:
            raise OperationError("no composition tag")
        text = found[-1]
    shares = parse_composition(text)
    sites = np.array([i for i in range(len(f)) if not p["group"] or (f.grp is not None and f.grp[i] == p["group"])], int)
    for i in range(p["count"]):
        yield _replace(f, sites, _fill(f.rng(p["seed"], f"occupancy{i}"), shares, len(sites), p["exact"]), f"Occ({i})")


def integer_spaces(rule: dict, n: int) -> list[dict[str, int]]:
    """All whole counts of a site rule: fixed shares, or ranges of shares or counts, that fill ``n`` sites."""
    if "fixed_fraction" in rule:
        exact = {e: v * n for e, v in rule["fixed_fraction"].items()}
        if abs(sum(exact.values()) - n) > 1e-9 or any(abs(v - round(v)) > 1e-9 for v in exact.values()):
            return []
        return [{e: int(round(v)) for e, v in exact.items()}]
    bounds = {e: (int(np.ceil(lo * n - 1e-9)), int(np.floor(hi * n + 1e-9))) for e, (lo, hi) in rule["fraction_range"].items()} if "fraction_range" in rule else {e: (int(lo), int(hi)) for e, (lo, hi) in rule["count_range"].items()}
    names, out = list(bounds), []

    def extend(at: int, left: int, part: dict) -> None:
        lo, hi = bounds[names[at]]
        if at == len(names) - 1:
            if lo <= left <= hi:
                out.append({**part, names[at]: left})
            return
        for k in range(max(0, lo), min(hi, left) + 1):
            extend(at + 1, left - k, {**part, names[at]: k})

    extend(0, n, {})
    return out


def occupancy_estimate(f: Frame, rules: list[dict]) -> int:
    """Number of compositions that the rules allow for a structure."""
    out = 1
    for r in rules:
        out *= len(integer_spaces(r, len(_sites(f, r.get("target", sorted(set(f.species))), r.get("group")))))
    return out


@operation("finite_occupancy", rules=[], arrangements=1, count=200, seed=0)
def finite_occupancy(f: Frame, p: dict) -> Iterator[Frame]:
    """Exact occupancies of a finite cell: every allowed composition of the rules' sites in turn, with distinct arrangements."""
    rules = json.loads(p["rules"]) if isinstance(p["rules"], str) else p["rules"]
    sites = [_sites(f, r.get("target", sorted(set(f.species))), r.get("group")) for r in rules]
    spaces = [integer_spaces(r, len(s)) for r, s in zip(rules, sites)]
    total = int(np.prod([len(s) for s in spaces], dtype=object)) if spaces else 0
    if not total:
        raise OperationError("no composition meets the rules")
    plans = []
    for i in range(total) if total <= p["count"] else np.linspace(0, total - 1, p["count"]).round().astype(int):
        chosen, rest = [], int(i)
        for s in spaces:  # a number is one choice of each space
            chosen.append(s[rest % len(s)])
            rest //= len(s)
        plans.append(chosen)
    made, rounds = 0, 0
    seen: list[set] = [set() for _ in plans]
    while made < p["count"] and rounds < p["arrangements"]:
        for k, plan in enumerate(plans):  # one arrangement of each composition a round
            if made >= p["count"]:
                break
            rng = f.rng(p["seed"], f"finite{k}.{rounds}")
            for _ in range(20):
                out = f
                for s, counts in zip(sites, plan):
                    kinds = [e for e, n in counts.items() for _ in range(n)]
                    out = _replace(out, s, [kinds[j] for j in rng.permutation(len(kinds))], "")
                if tuple(out.species) not in seen[k]:
                    seen[k].add(tuple(out.species))
                    made += 1
                    yield out.tagged("Finite(" + ";".join(",".join(f"{e}{n}" for e, n in c.items()) for c in plan) + f";{rounds})")
                    break
        rounds += 1


@operation("composition_gradient", start="Fe:1", end="Ni:1", axis="c", bins=8, count=1, seed=0)
def composition_gradient(f: Frame, p: dict) -> Iterator[Frame]:
    """Composition changes linearly along an axis: atoms in equal bins of their coordinate, whole counts per bin."""
    a, b = parse_composition(p["start"]), parse_composition(p["end"])
    names = list(dict.fromkeys([*a, *b]))
    order = np.argsort(f.fractional()[:, "abc".index(p["axis"])], kind="stable")
    for i in range(p["count"]):
        rng, out = f.rng(p["seed"], f"gradient{i}"), f
        for k, part in enumerate(np.array_split(order, p["bins"])):
            w = k / max(1, p["bins"] - 1)
            shares = {e: (1 - w) * a.get(e, 0) + w * b.get(e, 0) for e in names}
            out = _replace(out, part, _fill(rng, shares, len(part), True), "")
        yield out.tagged(f"Gradient({p['axis']},{i})")


@operation("conditional_replace", target="Fe", replacements="Ni:1", where="all", exact=True, count=1, seed=0)
def conditional_replace(f: Frame, p: dict) -> Iterator[Frame]:
    """Replace the target's atoms that meet a condition on x, y, z; exact counts or chances."""
    sites = _sites(f, p["target"])
    sites = sites[condition(p["where"], f.pos)[sites]] if len(sites) else sites
    for i in range(p["count"]):
        yield _replace(f, sites, _fill(f.rng(p["seed"], f"where{i}"), parse_composition(p["replacements"]), len(sites), p["exact"]), f"Replace({p['target']},{i})")


@operation("random_vacancy", rules=[], count=10, seed=0)
def random_vacancy(f: Frame, p: dict) -> Iterator[Frame]:
    """Sequential rules ``{target, count, group}``: delete atoms; every pattern of deletions once."""
    seen = set()
    for i in range(p["count"] * 20):
        if len(seen) >= p["count"]:
            return
        rng, gone = f.rng(p["seed"], f"vacancy{i}"), []
        for rule in p["rules"]:
            left = [s for s in _sites(f, rule.get("target", sorted(set(f.species))), rule.get("group")) if s not in gone]
            n = rule["count"]
            n = int(rng.integers(n[0], n[1] + 1)) if isinstance(n, (list, tuple)) else int(n)
            gone += rng.choice(left, min(n, len(left)), replace=False).tolist() if left else []
        key = tuple(sorted(gone))
        if key and key not in seen and len(key) < len(f):
            seen.add(key)
            yield f.pick((k for k in range(len(f)) if k not in set(key)), f"Vacancy({len(key)})")


@operation("vacancy_defect", engine="uniform", count=1, concentration=None, fixed=True, samples=10, seed=0)
def vacancy_defect(f: Frame, p: dict) -> Iterator[Frame]:
    """Delete a number, or share, of all atoms (exactly, or at most); every pattern once."""
    most = int(round(p["concentration"] * len(f))) if p["concentration"] is not None else int(p["count"])
    most = min(most, len(f) - 1)
    if most < 1:
        return
    rng, seen = f.seeds(), set()
    u = unit_samples(rng(p["seed"], "vacancies"), p["samples"] * 4, 2, p["engine"])
    for row in u:
        if len(seen) >= p["samples"]:
            return
        n = most if p["fixed"] else 1 + int(row[0] * most)
        gone = tuple(sorted(rng(int(row[1] * 2**31), "pattern").choice(len(f), n, replace=False).tolist()))
        if gone not in seen:
            seen.add(gone)
            yield f.pick((k for k in range(len(f)) if k not in set(gone)), f"Vacancies({n})")


def least_distance(f: Frame, point: np.ndarray) -> float:
    """Distance from a point to the nearest atom or image."""
    if not len(f):
        return np.inf
    v = f.pos - point
    if f.pbc.any() and f.volume > 1e-12:
        frac = v @ np.linalg.inv(f.lattice)
        frac[:, f.pbc] -= np.round(frac[:, f.pbc])
        shifts = np.array([s for s in np.ndindex(3, 3, 3)]) - 1
        shifts[:, ~f.pbc] = 0
        v = (frac[:, None] + shifts[None]).reshape(-1, 3) @ f.lattice
    return float(np.sqrt((v**2).sum(1).min()))


@operation("insert_defect", mode="interstitial", species={"H": 1.0}, count=1, samples=5, min_distance=1.4, attempts=200, height=2.0, strict=False, seed=0)
def insert_defect(f: Frame, p: dict) -> Iterator[Frame]:
    """Insert atoms anywhere in the cell, or above its top (``adsorbate``), no nearer than a distance to any other."""
    shares = parse_composition(p["species"])
    for i in range(p["samples"]):
        rng, out = f.rng(p["seed"], f"insert{i}"), f
        for e in _fill(rng, shares, p["count"], False):
            for _ in range(p["attempts"]):
                point = rng.random(3) @ f.lattice
                if p["mode"] == "adsorbate":
                    point[2] = out.pos[:, 2].max() + p["height"] if len(out) else 0.0
                if least_distance(out, point) >= p["min_distance"]:
                    out = out.with_atoms([e], point, "")
                    break
            else:
                if p["strict"]:
                    out = None
                    break
        if out is not None and len(out) > len(f):
            yield out.tagged(f"Insert({len(out) - len(f)},{i})")


@operation("random_packing", composition={"Si": 8}, min_distances={}, default_distance=1.5, attempts=500, samples=1, strict=True, seed=0)
def random_packing(f: Frame, p: dict) -> Iterator[Frame]:
    """Fill the cell of a structure anew: atoms one after the other at random points that keep the pairs' distances."""
    apart = {tuple(sorted(k.split("-"))): v for k, v in p["min_distances"].items()}
    for i in range(p["samples"]):
        rng = f.rng(p["seed"], f"packing{i}")
        out = Frame([], np.zeros((0, 3)), f.lattice, f.pbc, f.config_type, structure_id=f.structure_id)
        kinds = [e for e, n in p["composition"].items() for _ in range(n)]
        for e in kinds:
            for _ in range(p["attempts"]):
                point = rng.random(3) @ f.lattice
                near = [Frame([], out.pos[[j for j, s in enumerate(out.species) if s == o]], f.lattice, f.pbc) for o in set(out.species)]
                if all(least_distance(Frame([o] * len(g.pos), g.pos, f.lattice, f.pbc), point) >= apart.get(tuple(sorted((e, o))), p["default_distance"]) for o, g in zip(set(out.species), near)):
                    out = out.with_atoms([e], point, "")
                    break
        if len(out) == len(kinds) or not p["strict"]:
            yield out.tagged(f"Packing({i})")


@operation("group_label", mode="k_vector", k=(0.5, 0.5, 0.5), labels=("A", "B"))
def group_label(f: Frame, p: dict) -> Iterator[Frame]:
    """Labels by the sign of a plane wave at each atom, or by the parity of doubled fractional coordinates."""
    frac = f.fractional()
    if p["mode"] == "k_vector":
        even = np.cos(2 * np.pi * (frac @ np.array(p["k"], float))) >= -1e-9
    else:
        even = np.round(2 * frac).sum(1).astype(int) % 2 == 0
    yield f.tagged("Group", grp=[p["labels"][0] if e else p["labels"][1] for e in even])

