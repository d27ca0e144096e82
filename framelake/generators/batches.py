"""Supercells, vacancies and displacements of whole batches: the same results as the operations on one structure.

Structures with the same number of atoms are arrays; random numbers come from the
same streams (``content_seed``), whose states are computed for all structures at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from framelake.functions.elements import NUMBER
from framelake.functions.structure import DRAW, MIX, PAIRS
from framelake.operators.neighbors import by_size, frame_arrays

_WIDE, _PCG = (1 << 128) - 1, 0x2360ED051FC65DA44385DF649FCCF645


@dataclass
class Stack:
    """Structures with the same number of atoms; ``codes`` are places in ``symbols``."""

    rows: np.ndarray
    variant: np.ndarray
    codes: np.ndarray
    pos: np.ndarray
    cell: np.ndarray
    pbc: np.ndarray
    tags: list[str]
    symbols: list[str]

    def digests(self, salt: str) -> np.ndarray:
        """Hash of every structure as in ``content_hash`` and ``seeded``."""
        digits = lambda x: np.rint(x * 1e8) / 1e8 + 0.0
        numbers = np.array([NUMBER.get(s, 0) for s in self.symbols], "<i8")[self.codes]
        parts = (numbers, digits(self.pos), digits(self.cell), self.pbc.astype(np.uint8))
        data = np.concatenate([np.ascontiguousarray(x).reshape(len(self.rows), -1).view(np.uint8) for x in parts], 1)
        width, data = data.shape[1], data.tobytes()
        return np.array([int.from_bytes(hashlib.blake2b(data[i * width : (i + 1) * width] + (t + salt).encode(), digest_size=8).digest(), "big") for i, t in enumerate(self.tags)], np.uint64)


def states(salt: np.ndarray | int, number: np.ndarray) -> Iterator[tuple[int, int]]:
    """State and increment of ``PCG64(SeedSequence([salt, number]))`` for every number."""
    fold, low = (lambda x: x ^ x >> np.uint64(16)), np.uint64(0xFFFFFFFF)
    words = [np.broadcast_to(np.asarray(salt, np.uint64), number.shape) & low, number & low, number >> np.uint64(32), np.zeros_like(number)]
    pool = [fold((w ^ np.uint64(a)) * np.uint64(b) & low) for w, (a, b) in zip(words, MIX)]
    for (src, dst), (a, b) in zip(PAIRS, MIX[4:]):
        x = fold((pool[src] ^ np.uint64(a)) * np.uint64(b) & low)
        pool[dst] = fold((np.uint64(0xCA01F9DD) * pool[dst] - np.uint64(0x4973F715) * x) & low)
    half = [fold((pool[i % 4] ^ np.uint64(a)) * np.uint64(b) & low) for i, (a, b) in enumerate(DRAW)]
    for a, b, c, d in zip(*((half[i] | half[i + 1] << np.uint64(32)).tolist() for i in (0, 2, 4, 6))):
        inc = ((c << 64 | d) << 1 | 1) & _WIDE
        yield ((inc + (a << 64 | b)) * _PCG + inc) & _WIDE, inc


def draw(state: int, inc: int) -> tuple[int, int]:
    """Next state and 64 bits of a PCG64."""
    state = (state * _PCG + inc) & _WIDE
    x, turn = (state >> 64 ^ state) & 0xFFFFFFFFFFFFFFFF, state >> 122
    return state, (x >> turn | x << (64 - turn)) & 0xFFFFFFFFFFFFFFFF


def choose(state: int, inc: int, n: int) -> int:
    """``Generator.choice(n, 1, replace=False)[0]``."""
    while True:
        state, bits = draw(state, inc)
        for x in (bits & 0xFFFFFFFF, bits >> 32):
            m = x * n
            if m & 0xFFFFFFFF >= (1 << 32) % n or n == 1:
                return m >> 32


def supercell(s: Stack, p: dict, tag: Callable[[str, str], str]) -> Iterator[Stack]:
    n = [int(k) if a not in p["fixed"] else 1 for k, a in zip(p["scale"], "xyz")]
    shifts = np.array(list(product(*(range(k) for k in n))), float) @ s.cell
    pos = (s.pos[:, None] + shifts[:, :, None]).reshape(len(s.rows), -1, 3)
    name = "Supercell(" + "x".join(map(str, n)) + ")"
    yield Stack(s.rows, s.variant * 0, np.tile(s.codes, (1, shifts.shape[1])), pos, s.cell * np.array(n)[:, None], s.pbc, [tag(t, name) for t in s.tags], s.symbols)


def vacancy_defect(s: Stack, p: dict, tag: Callable[[str, str], str]) -> Iterator[Stack]:
    n, wanted = s.pos.shape[1], p["samples"]
    if n < 2:
        return
    running = list(states(p["seed"] & 0xFFFFFFFF, s.digests("vacancies")))
    pattern, tags = s.digests("pattern"), [tag(t, "Vacancies(1)") for t in s.tags]
    found: list[list[int]] = [[] for _ in running]
    left = list(range(len(running)))
    for _ in range(wanted * 4):
        left = [i for i in left if len(found[i]) < wanted]
        if not left:
            break
        salts = []
        for i in left:
            state, inc = running[i]
            state, bits = draw(draw(state, inc)[0], inc)
            running[i] = state, inc
            salts.append(int((bits >> 11) * 2.0**-53 * 2**31))
        for i, (state, inc) in zip(left, states(np.array(salts, np.uint64), pattern[left])):
            gone = choose(state, inc, n)
            if gone not in found[i]:
                found[i].append(gone)
    at = np.array([i for i, g in enumerate(found) for _ in g])
    gone = np.array([x for g in found for x in g])
    keep = np.arange(n - 1)[None] + (np.arange(n - 1)[None] >= gone[:, None])
    variant = np.array([v for g in found for v in range(len(g))])
    yield Stack(s.rows[at], variant, s.codes[at[:, None], keep], s.pos[at[:, None], keep], s.cell[at], s.pbc[at], [tags[i] for i in at], s.symbols)


def perturb(s: Stack, p: dict, tag: Callable[[str, str], str]) -> Iterator[Stack]:
    b, n, count = *s.codes.shape, p["count"]
    bits = np.random.PCG64(0)
    rng, u, normal = np.random.Generator(bits), np.empty((b, count, n, 3)), np.empty((b, count, n, 3))
    for i, (state, inc) in enumerate(states(p["seed"] & 0xFFFFFFFF, s.digests("perturb"))):
        bits.state = {"bit_generator": "PCG64", "state": {"state": state, "inc": inc}, "has_uint32": 0, "uinteger": 0}
        rng.random(out=u[i])
        rng.standard_normal(out=normal[i])
    reach = np.array([p["by_element"].get(e, p["max_distance"]) for e in s.symbols], float)[s.codes]
    regular = ~(np.abs(np.linalg.det(s.cell)) < 1e-12)
    cell = np.where(regular[:, None, None], s.cell, np.eye(3))
    inverse, flags = np.linalg.inv(cell), s.pbc & regular[:, None]
    for i in range(count):
        direction = normal[:, i] / np.maximum(np.linalg.norm(normal[:, i], axis=2, keepdims=True), 1e-12)
        pos = s.pos + direction * np.cbrt(u[:, i, :, :1]) * reach[:, :, None]
        frac = pos @ inverse
        wrapped = (frac - np.where(flags[:, None], np.floor(frac), 0.0)) @ cell
        pos = np.where(regular[:, None, None], wrapped, pos)
        yield Stack(s.rows, np.full(b, i), s.codes, pos, s.cell, s.pbc, [tag(t, f"Perturb({i})") for t in s.tags], s.symbols)


def batch_form(name: str, p: dict) -> Callable | None:
    """The form for batches of an operation with these parameters, if there is one."""
    if name == "supercell" and p["mode"] == "scale" and not p["every"] and len(p["scale"]) == 3 and min(map(int, p["scale"])) >= 1:
        return supercell
    if name == "vacancy_defect" and p["engine"] == "uniform" and p["concentration"] is None and p["fixed"] and p["count"] == 1 and p["samples"] >= 1:
        return vacancy_defect
    return perturb if name == "perturb" and p["engine"] == "uniform" and not p["rigid"] and p["count"] >= 1 else None


def run_batch(b: pa.RecordBatch, form: Callable, p: dict, tag: Callable[[str, str], str], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch | None:
    """Results for all structures of the batch; None if one of them needs the operation itself (moments, groups, faults)."""
    given = b.schema.names
    n, pos, cells, pbc = frame_arrays(b)
    width = lambda c: pc.list_value_length(b[c]).fill_null(-1).to_numpy(zero_copy_only=False)
    if any(c in given and b[c].null_count < b.num_rows for c in ("spin", "grp")) or not {"species", "pos", "lattice", "pbc", "structure_id"} <= set(given):
        return None
    flags, flat = b["pbc"].flatten(), b["species"].flatten()
    if not ((n > 0) & (width("species") == n) & (width("pbc") == 3)).all() or flags.null_count or flat.null_count or not (np.isfinite(cells).all() and np.isfinite(pos).all()):
        return None
    coded = flat.dictionary_encode()
    codes, symbols = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    tags = [t or "" for t in b["config_type"].to_pylist()] if "config_type" in given else [""] * b.num_rows
    out: list[Stack] = []
    for rows, atoms in by_size(n, n > 0):
        stack = Stack(rows, np.zeros(len(rows), np.int64), codes[atoms], pos[atoms], cells[rows], pbc[rows], [tags[r] for r in rows], symbols)
        out += form(stack, p, tag)
    if not out:
        return pa.record_batch([pa.array([], t) for t in kinds], names)
    join = lambda f: np.concatenate([f(s) for s in out])
    ends = lambda x: pa.array(np.concatenate([[0], np.cumsum(x)]), pa.int32())
    size = join(lambda s: np.full(len(s.rows), s.codes.shape[1]))
    vectors = lambda x: pa.ListArray.from_arrays(ends(np.full(len(x), 3)), pa.array(x.ravel()))
    total = len(size)
    made = {
        "structure_id": b["structure_id"].take(pa.array(join(lambda s: s.rows))).cast(pa.int64()), "variant": pa.array(join(lambda s: s.variant), pa.int64()),
        "species": pa.ListArray.from_arrays(ends(size), coded.dictionary.take(pa.array(join(lambda s: s.codes.ravel())))), "pos": pa.ListArray.from_arrays(ends(size), vectors(join(lambda s: s.pos.reshape(-1, 3)))),
        "lattice": pa.ListArray.from_arrays(ends(np.full(total, 3)), vectors(join(lambda s: s.cell.reshape(-1, 3)))), "pbc": pa.ListArray.from_arrays(ends(np.full(total, 3)), pa.array(join(lambda s: s.pbc).ravel())),
        "config_type": pa.array([t for s in out for t in s.tags], pa.string()),
    }
    return pa.record_batch([made[c] if c in made else pa.nulls(total, k) for c, k in zip(names, kinds)], names)
