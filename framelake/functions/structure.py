"""Column functions over one structure: composition, cell, labels, tags.

Missing inputs give a missing result unless stated otherwise.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from framelake.functions.elements import MASS, NUMBER, SYMBOLS
from framelake.operators.cells import determinant

AMU_PER_CUBIC_ANGSTROM = 1.66053906660  # g/cm3
EV_PER_CUBIC_ANGSTROM = 160.21766208  # GPa
#: Positions of xx, yy, zz, xy, yz, zx among nine components in row order.
SIX_OF_NINE = (0, 4, 8, 1, 5, 6)


def lookup(table: dict, key: Column, kind: str) -> Column:
    """Value of ``key`` in a small fixed table, null if absent."""
    return F.try_element_at(F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(v).cast(kind)))), key)


def num_atoms(species: Column) -> Column:
    return F.when(species.isNotNull(), F.size(species))


def elements(species: Column) -> Column:
    """Distinct symbols in order."""
    return F.array_sort(F.array_distinct(F.filter(species, lambda s: s.isNotNull())))


def numbers(species: Column) -> Column:
    """Atomic numbers, null for an unknown symbol."""
    return F.transform(species, lambda s: lookup(NUMBER, s, "int"))


def element_counts(species: Column) -> Column:
    """Map of symbol to number of atoms."""
    names = elements(species)
    return F.map_from_arrays(names, F.transform(names, lambda e: F.size(F.filter(species, lambda x: x == e))))


def _parts(species: Column, count) -> Column:
    order = ["C", "H", *(s for s in SYMBOLS if s not in ("C", "H"))]
    rank = {s: i for i, s in enumerate(order)}
    # unknown symbols come last, by name
    kinds = F.array_sort(F.transform(elements(species), lambda s: F.struct(F.coalesce(lookup(rank, s, "int"), F.lit(len(order))).alias("rank"), s.alias("s"))))

    def part(k: Column) -> Column:
        n = F.size(F.filter(species, lambda x: x == k["s"]))
        return F.concat(k["s"], F.when(n > 1, count(n.cast("string"))).otherwise(""))

    return F.array_join(F.transform(kinds, part), "")


def formula(species: Column) -> Column:
    """Counts with C and H first, then by atomic number; a count of one is left out."""
    return _parts(species, lambda n: n)


def html_formula(species: Column) -> Column:
    """The formula with its counts as subscripts."""
    return _parts(species, lambda n: F.concat(F.lit("<sub>"), n, F.lit("</sub>")))


def element_set_key(species: Column) -> Column:
    return F.array_join(elements(species), "-")


def volume(lattice: Column) -> Column:
    return F.abs(determinant(lattice))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """Euclidean length of an array."""
    return F.sqrt(_dot(v, v))


def lengths(lattice: Column) -> Column:
    """Lengths of the three cell vectors."""
    return F.array(*(norm(lattice[i]) for i in range(3)))


def angles(lattice: Column) -> Column:
    """Angles alpha, beta and gamma in degrees."""
    one = lambda i, j: F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(_dot(lattice[i], lattice[j]), F.sqrt(_dot(lattice[i], lattice[i]) * _dot(lattice[j], lattice[j])))))))
    return F.array(one(1, 2), one(0, 2), one(0, 1))


def per_atom(value: Column, natoms: Column) -> Column:
    return F.try_divide(value.cast("double"), natoms)


def spin_count(force_mag: Column) -> Column:
    """Atoms whose magnetic force is not all zero; 0 without the column."""
    return F.coalesce(F.size(F.filter(force_mag, lambda v: F.exists(v, lambda x: x != 0))), F.lit(0))


def virial(virial_: Column, stress: Column, lattice: Column) -> Column:
    """The virial, else minus stress times volume."""
    return F.coalesce(virial_, F.transform(stress, lambda s: -s * volume(lattice)))


def six_components(v: Column) -> Column:
    """xx, yy, zz, xy, yz, zx of nine components; six stay as they are."""
    return F.when(F.size(v) == 9, F.array(*(F.get(v, F.lit(i)) for i in SIX_OF_NINE))).when(F.size(v) == 6, v)


def virial_per_atom(v: Column, natoms: Column) -> Column:
    return F.transform(six_components(v), lambda x: F.try_divide(x, natoms))


def text_vector_per_atom(text: Column, natoms: Column) -> Column:
    """A dipole or polarizability written as text, per atom."""
    return F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != ""), lambda t: F.try_divide(t.try_cast("double"), natoms))


def stress_from_virial(per_atom_virial: Column, natoms: Column, volume_: Column) -> Column:
    """Stress in GPa of a virial per atom in eV."""
    return F.transform(per_atom_virial, lambda v: F.try_divide(v * natoms, volume_) * EV_PER_CUBIC_ANGSTROM)


def with_reference(pred: Column, ref: Column) -> tuple[Column, Column]:
    """Missing references take the prediction; without a prediction both are the reference, missing ones zero."""
    known = lambda c: F.when(~F.isnan(c), c)
    filled = F.zip_with(ref, pred, lambda r, p: F.coalesce(known(r), p))
    alone = F.transform(ref, lambda r: F.coalesce(known(r), F.lit(0.0)))
    return F.when(pred.isNull(), alone).otherwise(pred), F.when(pred.isNull(), alone).otherwise(filled)


def density(species: Column, volume_: Column) -> Column:
    """Mass density in g/cm3; null if a symbol is unknown or there is no volume."""
    mass = F.aggregate(F.transform(species, lambda s: lookup(MASS, s, "double")), F.lit(0.0), lambda a, m: a + m)
    return F.when(volume_ > 0, mass / volume_ * AMU_PER_CUBIC_ANGSTROM)


def max_norm(vectors: Column) -> Column:
    """Largest length among per-atom vectors."""
    return F.array_max(F.transform(vectors, norm))


def rms_norm(vectors: Column) -> Column:
    return F.sqrt(F.try_divide(F.aggregate(F.transform(vectors, lambda v: _dot(v, v)), F.lit(0.0), lambda a, x: a + x), F.size(vectors)))


def net(vectors: Column) -> Column:
    """Sum of per-atom 3-vectors."""
    zero = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    return F.aggregate(vectors, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))


def component_names(n: int) -> list[str]:
    """Names of a field's components by their number."""
    return {1: ["value"], 3: ["x", "y", "z"], 6: ["xx", "yy", "zz", "xy", "yz", "zx"]}.get(n) or [f"c{i}" for i in range(n)]


def select(value: Column, n: int, part: str) -> Column:
    """A component by name, or ``norm``, of an array of ``n`` values."""
    if part == "norm":
        return norm(value)
    return F.get(value, F.lit(component_names(n).index(part)))


def view(pred: Column, ref: Column, which: str) -> Column:
    """``ref``, ``pred`` or ``err`` (prediction minus reference) of paired arrays."""
    if which == "err":
        return F.zip_with(pred, ref, lambda p, r: p - r)
    return {"ref": ref, "pred": pred}[which]


def fractional(pos: Column, lattice: Column) -> Column:
    """Fractional coordinates of every atom; null for a flat cell."""
    det = determinant(lattice)
    m = [[lattice[i][j] for j in range(3)] for i in range(3)]
    minor = lambda i, j: m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3]
    one = lambda p: F.array(*((p[0] * minor(k, 0) + p[1] * minor(k, 1) + p[2] * minor(k, 2)) / det for k in range(3)))
    return F.when(F.abs(det) > 1e-12, F.transform(pos, one))


def cartesian(frac: Column, lattice: Column) -> Column:
    return F.transform(frac, lambda f: F.array(*(f[0] * lattice[0][j] + f[1] * lattice[1][j] + f[2] * lattice[2][j] for j in range(3))))


def wrap(pos: Column, lattice: Column, pbc: Column) -> Column:
    """Positions moved into the cell along periodic directions; unchanged for a flat cell."""
    inside = F.transform(fractional(pos, lattice), lambda f: F.array(*(F.when(pbc[k], f[k] - F.floor(f[k])).otherwise(f[k]) for k in range(3))))
    return F.coalesce(cartesian(inside, lattice), pos)


def sanitize_tag(tag: str, separator: str = "|") -> str:
    """A tag without quotes and white space, the separator replaced."""
    return re.sub(r"\s+", "", re.sub(r"[\"']", "", tag or "").replace(separator, "_"))


def tags(config_type: Column) -> Column:
    """Tags split at blanks and bars, without quotes; repeats stay."""
    parts = F.transform(F.split(F.coalesce(config_type, F.lit("")), r"[\s|]+"), lambda t: F.regexp_replace(t, "[\"']", ""))
    return F.filter(parts, lambda t: t != "")


def append_tag(config_type: Column, tag: str, limit: int = 200) -> Column:
    """The tags with ``tag`` added unless it is there; beyond ``limit`` characters (if above 0) the first and last tag with ``...+k`` for those between.

    An empty tag changes nothing.
    """
    tag = sanitize_tag(tag)
    if not tag:
        return F.coalesce(config_type, F.lit(""))
    old = tags(config_type)
    parts = F.when(F.array_contains(old, tag), old).otherwise(F.concat(old, F.array(F.lit(tag))))
    whole = F.array_join(parts, "|")
    if limit <= 0:
        return whole
    n, last = F.size(parts), F.element_at(parts, -1)
    head = F.when(n >= 3, F.concat(F.get(parts, F.lit(0)), F.lit("|...+"), (n - 2).cast("string"), F.lit("|"))).when(n == 2, F.concat(F.get(parts, F.lit(0)), F.lit("|"))).otherwise("")
    # only the last tag is cut, unless what stands before it is too long already
    return F.when(F.length(whole) <= limit, whole).otherwise(F.substring(F.concat(head, last), 1, limit))


def config_id(config_type: Column, modulus: int = 1_000_003) -> Column:
    """Stable small number of a config type: the first four bytes of its SHA-1; 0 for none."""
    number = F.conv(F.substring(F.sha1(config_type), 1, 8), 16, 10).cast("bigint")
    return F.when(F.coalesce(config_type, F.lit("")) == "", 0).otherwise(number % modulus if modulus else number)


def _constants(start: int, factor: int, n: int) -> list[tuple[int, int]]:
    out = [start]
    for _ in range(n):
        out.append(out[-1] * factor & 0xFFFFFFFF)
    return list(zip(out, out[1:]))


MIX, DRAW = _constants(0x43B0D7E5, 0x931E8875, 16), _constants(0x8B51F9DD, 0x58F38DED, 8)
PAIRS = [(a, b) for a in range(4) for b in range(4) if a != b]


class _Seed(np.random.bit_generator.ISeedSequence):
    """The state of ``SeedSequence([salt, number])`` in plain integers, which takes a fraction of its time."""

    def __init__(self, salt: int, number: int) -> None:
        self.key, words = (salt, number), [salt, *([0] if not number else [number & 0xFFFFFFFF] if number < 1 << 32 else [number & 0xFFFFFFFF, number >> 32])]
        pool = []
        for i in range(4):
            x = (words[i] if i < len(words) else 0) ^ MIX[i][0]
            x = x * MIX[i][1] & 0xFFFFFFFF
            pool.append(x ^ x >> 16)
        for (a, b), (before, after) in zip(PAIRS, MIX[4:]):
            x = (pool[a] ^ before) * after & 0xFFFFFFFF
            x = (0xCA01F9DD * pool[b] - 0x4973F715 * (x ^ x >> 16)) & 0xFFFFFFFF
            pool[b] = x ^ x >> 16
        self.words = []
        for i, (before, after) in enumerate(DRAW):
            x = (pool[i % 4] ^ before) * after & 0xFFFFFFFF
            self.words.append(x ^ x >> 16)

    def generate_state(self, n_words: int, dtype=np.uint32) -> np.ndarray:
        if n_words * np.dtype(dtype).itemsize > 32:
            return np.random.SeedSequence(list(self.key)).generate_state(n_words, dtype)
        return np.array(self.words, "<u4").view(dtype)[:n_words]


def content_hash(numbers_: list[int], pos: np.ndarray, cell: np.ndarray | None, pbc: np.ndarray) -> hashlib.blake2b:
    """Hash of atoms, cell and periodicity, numbers to eight digits."""
    h = hashlib.blake2b(digest_size=8)
    digits = lambda x: np.rint(np.asarray(x, float) * 1e8) / 1e8 + 0.0
    for part in (np.asarray(numbers_, "<i8"), digits(pos), np.zeros(0) if cell is None else digits(cell), np.asarray(pbc, np.uint8)):
        h.update(part.tobytes())
    return h


def seeded(content: hashlib.blake2b, group: list[str] | None = None, tag: str = "", salt: int = 0) -> np.random.Generator:
    """The generator of :func:`content_seed` from the structure's hash, which stays as it is."""
    h = content.copy()
    h.update("\x1f".join([*(group or []), tag]).encode())
    return np.random.Generator(np.random.PCG64(_Seed(salt & 0xFFFFFFFF, int.from_bytes(h.digest(), "big"))))


def content_seed(numbers_: list[int], pos: np.ndarray, cell: np.ndarray | None, pbc: np.ndarray, group: list[str] | None = None, tag: str = "", salt: int = 0) -> np.random.Generator:
    """A random generator that depends on the structure's content only, so results do not depend on its place in a run."""
    return seeded(content_hash(numbers_, pos, cell, pbc), group, tag, salt)
