"""Operations on magnetic moments: rotation, assignment, orders, spirals, tilts, disorder, correlated fields."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np

from framelake.generators.base import Frame, OperationError, operation, scan
from framelake.operators.neighbors import pairs_within


def unit(v) -> np.ndarray:
    v = np.asarray(v, float)
    n = np.linalg.norm(v)
    if not n > 1e-12:
        raise OperationError("a direction needs a length")
    return v / n


def basis(axis) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two unit vectors that are normal to an axis and each other, and the axis."""
    w = unit(axis)
    u = unit(np.cross(w, np.eye(3)[np.abs(w).argmin()]))
    return u, np.cross(w, u), w


def rotate(v: np.ndarray, axis, angle: np.ndarray | float) -> np.ndarray:
    """Vectors turned around an axis by angles in radians."""
    k, a = unit(axis), np.asarray(angle, float)
    c, s = np.cos(a)[..., None], np.sin(a)[..., None]
    return v * c + np.cross(k, v) * s + (v @ k)[..., None] * k * (1 - c)


def random_units(rng: np.random.Generator, n: int, mode: str = "sphere", axis=(0, 0, 1), angle: float = 180.0) -> np.ndarray:
    """Unit vectors uniform on the sphere, in a cone around an axis, or in the plane normal to it."""
    u, v, w = basis(axis)
    phi = rng.uniform(0, 2 * np.pi, n)
    if mode == "plane":
        z = np.zeros(n)
    else:
        z = rng.uniform(np.cos(np.radians(angle)) if mode == "cone" else -1.0, 1.0, n)
    r = np.sqrt(1 - z * z)
    return (r * np.cos(phi))[:, None] * u + (r * np.sin(phi))[:, None] * v + z[:, None] * w


def _chosen(f: Frame, elements) -> np.ndarray:
    return np.array([not elements or s in elements for s in f.species], bool)


def _moments(f: Frame) -> np.ndarray:
    if f.spin is None or f.spin.shape != (len(f), 3):
        raise OperationError("the structure has no moments")
    return f.spin.copy()


def _sizes(f: Frame, sizes: dict, default: float) -> np.ndarray:
    return np.array([sizes.get(s, default) for s in f.species], float)


@operation("moment_rotation", elements=(), max_angle=30.0, count=5, magnitude=(1.0, 1.0), seed=0)
def moment_rotation(f: Frame, p: dict) -> Iterator[Frame]:
    """Turn every chosen moment by a random angle around a random axis normal to it, and rescale it."""
    m, at = _moments(f), _chosen(f, p["elements"])
    at &= np.linalg.norm(m, axis=1) > 0
    for i in range(p["count"]):
        rng, out = f.rng(p["seed"], f"turn{i}"), m.copy()
        for k in np.flatnonzero(at):
            u, v, w = basis(m[k])
            a, phi = np.radians(rng.uniform(0, p["max_angle"])), rng.uniform(0, 2 * np.pi)
            out[k] = np.linalg.norm(m[k]) * rng.uniform(*p["magnitude"]) * (np.cos(a) * w + np.sin(a) * (np.cos(phi) * u + np.sin(phi) * v))
        yield f.tagged(f"Turn({i})", spin=out)


@operation("set_moments", source="map", sizes={}, value=0.0, default=0.0, axis=(0, 0, 1), elements=())
def set_moments(f: Frame, p: dict) -> Iterator[Frame]:
    """Moments along an axis by element (``map``), one for all (``constant``), or the sizes they have (``existing``)."""
    at = _chosen(f, p["elements"])
    size = np.linalg.norm(_moments(f), axis=1) if p["source"] == "existing" else np.full(len(f), float(p["value"])) if p["source"] == "constant" else _sizes(f, p["sizes"], p["default"])
    old = f.spin if f.spin is not None else np.zeros((len(f), 3))
    yield f.tagged("Moments", spin=np.where(at[:, None], size[:, None] * unit(p["axis"]), old))


@operation("magnetic_order", order="FM", sizes={}, default=1.0, axis=(0, 0, 1), k=(0.5, 0.5, 0.5), by="k", mode="sphere", angle=30.0, balanced=False, count=1, seed=0)
def magnetic_order(f: Frame, p: dict) -> Iterator[Frame]:
    """FM: all along the axis; AFM: signs of a plane wave or of the two groups; PM: random directions, with opposite partners if ``balanced``."""
    size, w = _sizes(f, p["sizes"], p["default"]), unit(p["axis"])
    if p["order"] == "FM":
        yield f.tagged("FM", spin=size[:, None] * w)
    elif p["order"] == "AFM":
        if p["by"] == "group":
            if f.grp is None:
                raise OperationError("no groups")
            first = sorted(set(f.grp))[0]
            sign = np.array([1.0 if g == first else -1.0 for g in f.grp])
        else:
            sign = np.where(np.cos(2 * np.pi * (f.fractional() @ np.array(p["k"], float))) >= -1e-9, 1.0, -1.0)
        yield f.tagged("AFM", spin=(size * sign)[:, None] * w)
    else:
        for i in range(p["count"]):
            rng = f.rng(p["seed"], f"pm{i}")
            d = random_units(rng, len(f), p["mode"], p["axis"], p["angle"])
            if p["balanced"]:
                order = rng.permutation(len(f))
                half = len(f) // 2
                d[order[half : 2 * half]] = -d[order[:half]]
            yield f.tagged(f"PM({i})", spin=size[:, None] * d)


@operation("spin_spiral", axis=(0, 0, 1), periods=(10.0, 20.0, 5.0), gradient=None, phases=(0, 0, 1), mz=(0, 0, 1), chirality=(1,), layer_locked=False, commensurate=False, sizes={}, default=1.0)
def spin_spiral(f: Frame, p: dict) -> Iterator[Frame]:
    """Helical or conical moments along an axis: period (or degrees per length), phase, part along the axis and sense on a grid."""
    u, v, w = basis(p["axis"])
    s = f.pos @ w
    if p["layer_locked"]:
        s = _layer_mean(s)
    size = _sizes(f, p["sizes"], p["default"])
    span = float(np.abs(f.lattice @ w).max())
    steps = [360.0 / g for g in scan(p["gradient"])] if p["gradient"] is not None else scan(p["periods"])
    for period, phase, mz, sense in product(steps, scan(p["phases"]), scan(p["mz"]), p["chirality"]):
        if abs(mz) > 1:
            raise OperationError("the part along the axis is at most 1")
        if p["commensurate"] and abs(span / period - round(span / period)) > 1e-3:
            continue
        a = sense * 2 * np.pi * s / period + np.radians(phase)
        d = np.sqrt(1 - mz * mz) * (np.cos(a)[:, None] * u + np.sin(a)[:, None] * v) + mz * w
        yield f.tagged(f"Spiral({period:g},{phase:g},{mz:g},{sense:+d})", spin=size[:, None] * d)


def layers(s: np.ndarray, tolerance: float = 0.1) -> np.ndarray:
    """Layer number of every projection: sorted values join the last layer while they are near its running mean."""
    out, mean, n, layer = np.zeros(len(s), int), None, 0, -1
    for i in np.argsort(s, kind="stable"):
        if mean is None or abs(s[i] - mean) > tolerance:
            layer, mean, n = layer + 1, s[i], 1
        else:
            n += 1
            mean += (s[i] - mean) / n
        out[i] = layer
    return out


def _layer_mean(s: np.ndarray) -> np.ndarray:
    at = layers(s)
    return (np.bincount(at, s) / np.bincount(at))[at]


@operation("small_tilt", mode="uniform", angles=(1, 5, 2), axis=(1, 0, 0), pairs=None, shell=1, elements=(), signs=(1,), cutoff=6.0)
def small_tilt(f: Frame, p: dict) -> Iterator[Frame]:
    """Small deterministic tilts: all alike (``uniform``), alternating by sign of the moment (``canting``), one atom at a time (``single``), or one pair apart (``pair``).

    Pairs are given, or those of the ``shell``-th neighbour distance.
    """
    m, at = _moments(f), np.flatnonzero(_chosen(f, p["elements"]))
    u = unit(p["axis"])
    if p["mode"] == "pair":
        pairs = [tuple(x) for x in p["pairs"]] if p["pairs"] else neighbour_shell(f, p["shell"], p["cutoff"])
        sets = [{i: 1.0, j: -1.0} for i, j in pairs if i in at and j in at]
    elif p["mode"] == "single":
        sets = [{i: 1.0} for i in at]
    elif p["mode"] == "canting":
        reference = m[at[np.linalg.norm(m[at], axis=1).argmax()]]
        sets = [{i: 1.0 if m[i] @ reference >= 0 else -1.0 for i in at}]
    else:
        sets = [{i: 1.0 for i in at}]
    for angle, sign, turn in product(scan(p["angles"]), p["signs"], sets):
        out = m.copy()
        for i, s in turn.items():
            out[i] = rotate(m[i], u, np.radians(angle * sign * s))
        yield f.tagged(f"Tilt({p['mode']},{angle * sign:g})", spin=out)


def neighbour_shell(f: Frame, shell: int, cutoff: float) -> list[tuple[int, int]]:
    """Pairs of atoms at the ``shell``-th distinct distance from the first of them."""
    _, i, j, d, _ = pairs_within([(f.pos, f.lattice, f.pbc)], cutoff)
    out = set()
    for a in range(len(f)):
        mine = (i == a) & (j != a)
        levels = np.unique(np.round(d[mine], 2))
        if len(levels) >= shell:
            out |= {(a, int(b)) for b, x in zip(j[mine], d[mine]) if abs(x - levels[shell - 1]) < 0.02 and a < b}
    return sorted(out)


@operation("spin_disorder", mode="flip", fractions=(0.1, 0.5, 0.2), angle=30.0, samples=1, elements=(), seed=0)
def spin_disorder(f: Frame, p: dict) -> Iterator[Frame]:
    """Flip, tilt within a cone, or randomise a share of the moments."""
    m, at = _moments(f), np.flatnonzero(_chosen(f, p["elements"]) & (np.linalg.norm(_moments(f), axis=1) > 0))
    for share, i in product(scan(p["fractions"]), range(p["samples"])):
        rng, out = f.rng(p["seed"], f"disorder{share}.{i}"), m.copy()
        # half to even, as everywhere with shares of atoms
        for k in rng.choice(at, min(len(at), int(np.round(share * len(at)))), replace=False):
            size = np.linalg.norm(m[k])
            out[k] = -m[k] if p["mode"] == "flip" else size * random_units(rng, 1, "cone" if p["mode"] == "cone" else "sphere", m[k], p["angle"])[0]
        yield f.tagged(f"Disorder({p['mode']},{share:g},{i})", spin=out)


@operation("correlated_spins", kernel="exponential", length=5.0, mode="full", axis=(0, 0, 1), angle=30.0, sizes={}, default=1.0, samples=1, max_atoms=200, seed=0)
def correlated_spins(f: Frame, p: dict) -> Iterator[Frame]:
    """Random directions that are correlated over a length: Gaussian fields with a covariance of the distances."""
    from framelake.operators.neighbors import distance_matrix  # noqa: PLC0415

    if len(f) > p["max_atoms"]:
        raise OperationError(f"more than {p['max_atoms']} atoms")
    d = distance_matrix(f.pos, f.lattice, f.pbc) / p["length"]
    c = np.exp(-d) if p["kernel"] == "exponential" else np.exp(-0.5 * d * d)
    w, v = np.linalg.eigh(c)  # periodic distances may leave small negative values
    root = v * np.sqrt(np.maximum(w, 0))
    size = _sizes(f, p["sizes"], p["default"])
    for i in range(p["samples"]):
        g = root @ f.rng(p["seed"], f"field{i}").normal(size=(len(f), 3))
        if p["mode"] == "cone":
            a, b, w_ = basis(p["axis"])
            r = np.tan(np.radians(p["angle"])) * np.tanh(np.linalg.norm(g[:, :2], axis=1, keepdims=True)) / np.maximum(np.linalg.norm(g[:, :2], axis=1, keepdims=True), 1e-12)
            g = w_ + r * (g[:, :1] * a + g[:, 1:2] * b)
        g /= np.maximum(np.linalg.norm(g, axis=1, keepdims=True), 1e-12)
        yield f.tagged(f"Correlated({p['length']:g},{i})", spin=size[:, None] * g)


@operation("folded_helix", axis=(0, 0, 1), half_period=4, steps=(10.0, 30.0, 10.0), phases=(0, 0, 1), sizes={}, default=1.0)
def folded_helix(f: Frame, p: dict) -> Iterator[Frame]:
    """Layers turn forward for half a period and back again."""
    u, v, w = basis(p["axis"])
    at = layers(f.pos @ w)
    h = int(p["half_period"])
    if h < 1:
        raise OperationError("half a period has at least one layer")
    fold = np.abs((at + h) % (2 * h) - h)
    size = _sizes(f, p["sizes"], p["default"])
    for step, phase in product(scan(p["steps"]), scan(p["phases"])):
        a = np.radians(step * fold + phase)
        yield f.tagged(f"Helix({h},{step:g},{phase:g})", spin=size[:, None] * (np.cos(a)[:, None] * u + np.sin(a)[:, None] * v))
