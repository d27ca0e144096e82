"""Periodic neighbours of atoms: pairs within a cutoff, nearest neighbours, short distances.

A structure is a row with ``pos`` (array of 3-vectors), ``lattice`` (3 x 3), ``pbc``
(three flags) and ``species``.  Structures of one Arrow batch are grouped by size
and number of images and handled as one array; large ones go through a grid of
cells of the cutoff's size, so that work grows with the number of atoms, not its
square.  Everything stays within the structure: there is no shuffle.

Defined results: a structure without atoms, with a non-finite coordinate or
without a usable cell in its periodic directions has no pairs and no distance
(null); an atom's own images are neighbours, the atom itself is not.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from framelake.functions.elements import RADIUS

_BLOCK = 4_000_000  # distances held at once
_CACHE = 50_000  # distances of small structures held at once, such that they stay near the core
_DIRECT = 200  # atoms up to which all pairs of images are formed


def heights(cell: np.ndarray) -> np.ndarray:
    """Distances between opposite faces of a cell."""
    cross = np.cross(cell[[1, 2, 0]], cell[[2, 0, 1]])
    norm = np.linalg.norm(cross, axis=1)
    return np.abs(np.linalg.det(cell)) / np.where(norm > 0, norm, 1.0)


def usable_cell(cell: np.ndarray | None, pbc: np.ndarray) -> np.ndarray | None:
    """The cell with its non-periodic directions filled up to a basis, or None if the periodic ones are dependent."""
    if cell is None or cell.shape != (3, 3) or not np.isfinite(cell).all():
        return None if pbc.any() or cell is None or cell.shape != (3, 3) else np.eye(3)
    cell = cell.copy()
    if pbc.all():
        return cell if abs(np.linalg.det(cell)) > 1e-12 else None
    if not pbc.any():
        return np.eye(3)
    fixed = cell[pbc]
    if np.linalg.matrix_rank(fixed, tol=1e-12) < len(fixed):
        return None
    # other directions: orthonormal to the periodic ones, so that heights are those of the periodic lattice
    cell[~pbc] = np.linalg.svd(fixed)[2][len(fixed) :]
    return cell


def _wrapped(pos: np.ndarray, cell: np.ndarray, pbc: np.ndarray) -> np.ndarray:
    frac = pos @ np.linalg.inv(cell)
    frac[:, pbc] -= np.floor(frac[:, pbc])
    return frac @ cell


def _images(cell: np.ndarray, pbc: np.ndarray, cutoff: float) -> np.ndarray:
    return np.where(pbc, np.floor(cutoff / heights(cell)).astype(int) + 1, 0)


def _grid_pairs(pos: np.ndarray, cell: np.ndarray, count: np.ndarray, cutoff: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directed pairs of a large structure by a grid of cells."""
    n = len(pos)
    lo, hi = pos.min(0) - cutoff, pos.max(0) + cutoff
    parts, ids = [pos], [np.arange(n)]
    for shift in product(*(range(-c, c + 1) for c in count)):
        if any(shift):
            moved = pos + np.array(shift) @ cell
            near = ((moved >= lo) & (moved <= hi)).all(1)
            parts.append(moved[near])
            ids.append(np.flatnonzero(near))
    every, owner = np.concatenate(parts), np.concatenate(ids)
    size = np.maximum(np.ceil((hi - lo) / cutoff).astype(int), 1)
    place = np.minimum(((every - lo) / cutoff).astype(int), size - 1)
    key = (place[:, 0] * size[1] + place[:, 1]) * size[2] + place[:, 2]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    out: list[tuple] = []
    for step in product((-1, 0, 1), repeat=3):
        other = place[:n] + step
        ok = ((other >= 0) & (other < size)).all(1)
        wanted = (other[:, 0] * size[1] + other[:, 1]) * size[2] + other[:, 2]
        a, b = np.searchsorted(sorted_key, wanted, "left"), np.searchsorted(sorted_key, wanted, "right")
        length = np.where(ok, b - a, 0)
        i = np.repeat(np.arange(n), length)
        at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(a, length)
        j = order[at]
        d = np.sqrt(((every[j] - pos[i]) ** 2).sum(1))
        keep = (d <= cutoff) & (j != i)
        out.append((i[keep], owner[j[keep]], d[keep], every[j[keep]] - pos[i[keep]]))
    return tuple(np.concatenate(x) for x in zip(*out))


def pairs_within(frames: list[tuple[np.ndarray, np.ndarray | None, np.ndarray]], cutoff: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Structure, centre, neighbour, distance and vector of every directed pair of at most ``cutoff``."""
    groups: dict[tuple, list] = defaultdict(list)
    out: list[tuple] = []
    for s, (pos, cell, pbc) in enumerate(frames):
        if not len(pos) or not np.isfinite(pos).all():
            continue
        cell = usable_cell(cell, pbc)
        if cell is None:
            continue
        count = _images(cell, pbc, cutoff)
        pos = _wrapped(pos, cell, pbc)
        if len(pos) > _DIRECT:
            i, j, d, v = _grid_pairs(pos, cell, count, cutoff)
            out.append((np.full(len(i), s), i, j, d, v))
        else:
            groups[len(pos), tuple(count)].append((s, pos, cell))
    for (n, count), members in groups.items():
        shifts = np.array(list(product(*(range(-c, c + 1) for c in count))), float)
        zero = int(np.flatnonzero(~shifts.any(1))[0])
        step = max(1, _BLOCK // (n * n * len(shifts)))
        for part in (members[x : x + step] for x in range(0, len(members), step)):
            pos, cell = np.array([p for _, p, _ in part]), np.array([c for _, _, c in part])
            base = pos[:, None, :, :] - pos[:, :, None, :]  # neighbour minus centre
            moved = shifts @ cell
            v = base[:, :, :, None, :] + moved[:, None, None, :, :]
            d2 = np.einsum("bijmk,bijmk->bijm", v, v)
            d2[:, np.arange(n), np.arange(n), zero] = np.inf
            b, i, j, m = np.nonzero(d2 <= cutoff * cutoff)
            out.append((np.array([s for s, _, _ in part])[b], i, j, np.sqrt(d2[b, i, j, m]), v[b, i, j, m]))
    if not out:
        return (*(np.zeros(0, np.int64),) * 3, np.zeros(0), np.zeros((0, 3)))
    return tuple(np.concatenate(x) for x in zip(*out))


def nearest(pos: np.ndarray, cell: np.ndarray | None, pbc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Indices, distances and vectors of the ``k`` nearest images of every atom; None if there are not so many."""
    usable = usable_cell(cell, pbc)
    if usable is None or not len(pos) or not np.isfinite(pos).all() or (not pbc.any() and len(pos) <= k):
        return None
    volume = abs(np.linalg.det(usable)) if pbc.all() else max(float(np.prod(np.ptp(pos, axis=0) + 1.0)), 1.0)
    radius = 1.3 * (3 * (k + 1) * volume / (4 * np.pi * len(pos))) ** (1 / 3)
    while True:
        _, i, j, d, v = pairs_within([(pos, cell, pbc)], radius)
        if (np.bincount(i, minlength=len(pos)) >= k).all():
            break
        radius *= 1.35
    order = np.lexsort((j, np.round(d, 9), i))
    i, j, d, v = i[order], j[order], d[order], v[order]
    first = np.searchsorted(i, np.arange(len(pos)))
    at = first[:, None] + np.arange(k)[None, :]
    return j[at], d[at], v[at]


def usable_cells(cells: np.ndarray, pbc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`usable_cell` of many structures, and which of them have one."""
    out, finite, ok = np.tile(np.eye(3), (len(cells), 1, 1)), np.isfinite(cells).all((1, 2)), ~pbc.any(1)
    whole = np.flatnonzero(pbc.all(1) & finite)
    whole = whole[np.abs(np.linalg.det(cells[whole])) > 1e-12]
    out[whole], ok[whole] = cells[whole], True
    for flags in list(product((False, True), repeat=3))[1:-1]:
        at, flags = np.flatnonzero((pbc == flags).all(1) & finite), np.array(flags)
        if len(at):
            _, size, basis = np.linalg.svd(cells[at][:, flags])
            good = (size > 1e-12).all(1)
            at, rest = at[good], np.flatnonzero(~flags)
            out[at] = cells[at]
            out[at[:, None], rest] = basis[good, int(flags.sum()) :]
            ok[at] = True
    return out, ok


def _start_radius(pos: np.ndarray, measure: np.ndarray, pbc: np.ndarray, k: int) -> np.ndarray:
    """A guess of the distance to the ``k``-th neighbour; ``measure`` is the volume, area or length of the periodic part."""
    n, free = pos.shape[1], 3 - pbc.sum(1)
    wide = np.prod(np.where(pbc, 1.0, np.ptp(pos, axis=1) + 1.0), axis=1)
    ball = (3 * (k + 1) * measure * wide / (4 * np.pi * n)) ** (1 / 3)
    flat = np.where(free == 1, np.sqrt((k + 1) * measure / (np.pi * n)), np.where(free == 2, (k + 1) * measure / (2 * n), 0.0))
    return 1.12 * np.maximum(ball, flat)


def _k_nearest(pos: np.ndarray, cell: np.ndarray, shifts: np.ndarray, radius: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which structures have ``k`` images within the radius around every atom; their nearest ones in order of distance, atom and image."""
    b, n, m = len(pos), pos.shape[1], len(shifts)
    base, moved = pos[:, None, :, :] - pos[:, :, None, :], shifts @ cell  # neighbour minus centre
    one, far = np.ones((b, n * n, 1)), (moved**2).sum(2, keepdims=True)
    apart = np.concatenate([2 * base.reshape(b, n * n, 3), (base**2).sum(3).reshape(b, n * n, 1), one], 2)
    near = apart @ np.concatenate([moved, np.ones((b, m, 1)), far], 2).transpose(0, 2, 1) <= (radius * radius * (1 - 1e-9))[:, None, None]
    near.reshape(b, n, n, m)[:, np.arange(n), np.arange(n), m // 2] = False  # the atom itself
    pair, shift = np.nonzero(near.reshape(b * n * n, m))
    centre = pair // n
    count = np.bincount(centre, minlength=b * n)
    good = (count.reshape(b, n) >= k).all(1)
    v = base.reshape(-1, 3)[pair] + moved.reshape(-1, 3)[centre // n * m + shift]
    d = np.sqrt(np.einsum("ij,ij->i", v, v))
    first, width = np.cumsum(count) - count, int(count.max(initial=1))
    place = np.arange(len(pair)) - first[centre]
    bits = width.bit_length()
    table = np.full((b * n, width), np.iinfo(np.int64).max)
    table[centre, place] = (np.rint(d * 1e9).astype(np.int64) << bits) | place
    rows = np.repeat(good, n)
    table = table[rows]
    table.sort(1)
    at = first[rows, None] + (table[:, :k] & ((1 << bits) - 1))
    shape = (int(good.sum()), n, k)
    return good, (pair[at] % n).reshape(shape), d[at].reshape(shape), v[at].reshape(*shape, 3)


def nearest_many(pos: np.ndarray, cells: np.ndarray, pbc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """:func:`nearest` of structures with the same number of atoms: which of them have ``k`` neighbours, and these (0 elsewhere)."""
    b, n = pos.shape[:2]
    j, d, v = np.zeros((b, n, k), np.int64), np.zeros((b, n, k)), np.zeros((b, n, k, 3))
    if n > _DIRECT:
        got = [nearest(p, c, f, k) for p, c, f in zip(pos, cells, pbc)]
        for i, g in enumerate(got):
            if g is not None:
                j[i], d[i], v[i] = g
        return np.array([g is not None for g in got], bool), j, d, v
    cell, ok = usable_cells(cells, pbc)
    ok &= np.isfinite(pos).all((1, 2)) & (pbc.any(1) | (n > k)) & (n > 0)
    left = np.flatnonzero(ok)
    inverse = np.linalg.inv(cell[left])
    frac = pos[left] @ inverse
    frac -= np.where(pbc[left][:, None], np.floor(frac), 0.0)
    wrapped = frac @ cell[left]
    high = 1 / np.linalg.norm(inverse, axis=1)
    radius = _start_radius(wrapped, np.abs(np.linalg.det(cell[left])), pbc[left], k)
    todo = np.arange(len(left))
    while len(todo):
        count = np.where(pbc[left[todo]], np.floor(radius[todo, None] / high[todo]).astype(int) + 1, 0)
        kinds, which = np.unique(count, axis=0, return_inverse=True)
        which, missed = which.ravel(), []
        for kind, images in enumerate(kinds):
            members = todo[which == kind]
            shifts = np.array(list(product(*(range(-c, c + 1) for c in images))), float)
            step = max(1, _CACHE // (n * n * len(shifts)))
            for part in (members[x : x + step] for x in range(0, len(members), step)):
                at = left[part]
                good, *found = _k_nearest(wrapped[part], cell[at], shifts, radius[part], k)
                j[at[good]], d[at[good]], v[at[good]] = found
                missed.append(part[~good])
        todo = np.sort(np.concatenate(missed))
        radius[todo] *= 1.2
    return ok, j, d, v


def read_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of 3-vectors of every row, all vectors, and which rows are not null and well formed; others have none."""
    length = lambda a: pc.list_value_length(a).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    n, inner = length(column), column.flatten()
    width, values = length(inner), inner.flatten()
    good = n > 0
    if values.null_count or not (width == 3).all():
        null = np.repeat(np.arange(len(width)), width)[values.is_null().to_numpy(zero_copy_only=False)]
        bad = width != 3
        bad[null] = True
        good &= np.bincount(np.repeat(np.arange(len(n)), n), bad, minlength=len(n)) == 0
        values = values.filter(pa.array(np.repeat(np.repeat(good, n), width)))
    return np.where(good, n, 0), values.to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, 3), good


def frame_arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """:func:`read_frames` as arrays: numbers of atoms, all positions, cells (not a number where missing) and periodicity."""
    n, pos, _ = read_vectors(b["pos"])
    count, rows, good = read_vectors(b["lattice"])
    cells = np.full((b.num_rows, 3, 3), np.nan)
    cells[count == 3] = rows[np.repeat(count == 3, count)].reshape(-1, 3, 3)
    flags = np.ones((b.num_rows, 3), bool)
    width = pc.list_value_length(b["pbc"]).fill_null(0).to_numpy(zero_copy_only=False)
    values = b["pbc"].flatten()
    known = values.is_valid().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(b.num_rows), width)
    whole = (width == 3) & (np.bincount(owner, known, minlength=b.num_rows) == 3)
    flags[whole] = values.fill_null(False).to_numpy(zero_copy_only=False)[whole[owner]].reshape(-1, 3)
    flags[b["lattice"].is_null().to_numpy(zero_copy_only=False) & b["pbc"].is_null().to_numpy(zero_copy_only=False)] = False
    return n, pos, cells, flags


def pieces(b: pa.RecordBatch, rows: int = 10_000, atoms: int = 40_000) -> Iterator[pa.RecordBatch]:
    """The batch in parts of so many rows and atoms at most; a larger structure is a part of its own."""
    total = np.cumsum(pc.list_value_length(b["pos"]).fill_null(0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < b.num_rows:
        before = total[begin - 1] if begin else 0
        end = max(begin + 1, min(begin + rows, int(np.searchsorted(total, before + atoms, "right"))))
        yield b.slice(begin, end - begin)
        begin = end


def by_size(n: np.ndarray, chosen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each number of atoms among the chosen ones, and the places of their atoms."""
    first = np.cumsum(n) - n
    for size in np.unique(n[chosen]):
        at = np.flatnonzero(chosen & (n == size))
        yield at, first[at, None] + np.arange(size)


def read_frames(b: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray | None, np.ndarray]]:
    """Positions, cell and periodicity of every row; malformed positions come back empty."""
    out = []
    for pos, cell, pbc in zip(b["pos"].to_pylist(), b["lattice"].to_pylist(), b["pbc"].to_pylist()):
        good = bool(pos) and all(p is not None and len(p) == 3 and None not in p for p in pos)
        p = np.array(pos, float) if good else np.zeros((0, 3))
        c = None if cell is None or len(cell) != 3 or any(r is None or len(r) != 3 or None in r for r in cell) else np.array(cell, float)
        flags = np.zeros(3, bool) if cell is None and pbc is None else np.ones(3, bool) if pbc is None or len(pbc) != 3 or None in pbc else np.array(pbc, bool)
        out.append((p, c if c is not None or flags.any() else np.zeros((3, 3)), flags))
    return out


_GEOMETRY = ["pos", "lattice", "pbc"]


def _per_batch(df: DataFrame, columns: list[str], function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(x, 512) for x in range(0, b.num_rows, 512)):
                yield function(part)

    return df.select(*dict.fromkeys(columns)).mapInArrow(run, schema)


def neighbor_pairs(df: DataFrame, cutoff: float, key: str = "structure_id") -> DataFrame:
    """``key, centre, neighbour, centre_species, neighbour_species, distance`` of every directed pair."""
    if not np.isfinite(cutoff) or cutoff <= 0:
        raise ValueError("the cutoff must be finite and positive")
    columns = [key, "centre", "neighbour", "centre_species", "neighbour_species", "distance"]

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        s, i, j, d, _ = pairs_within(read_frames(b), cutoff)
        species = b["species"].to_pylist()
        name = lambda at: pa.array([species[x][y] if species[x] and y < len(species[x]) else None for x, y in zip(s, at)], pa.string())
        return pa.record_batch([b[key].take(pa.array(s, pa.int64())), pa.array(i, pa.int32()), pa.array(j, pa.int32()), name(i), name(j), pa.array(d, pa.float64())], columns)

    kind = df.schema[key].dataType.simpleString()
    return _per_batch(df, [key, "species", *_GEOMETRY], one, f"`{key}` {kind}, centre int, neighbour int, centre_species string, neighbour_species string, distance double")


def nearest_neighbors(df: DataFrame, k: int = 24, key: str = "structure_id") -> DataFrame:
    """``key, centre, rank, neighbour, distance, vector`` of the ``k`` nearest images of every atom."""
    columns = [key, "centre", "rank", "neighbour", "distance", "vector"]

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for x, frame in enumerate(read_frames(b)):
            got = nearest(*frame, k)
            if got is not None:
                rows += [(x, c, r, int(got[0][c, r]), float(got[1][c, r]), got[2][c, r].tolist()) for c in range(len(got[0])) for r in range(k)]
        s, *rest = list(zip(*rows)) if rows else [[]] * 6
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64())]
        return pa.record_batch([b[key].take(pa.array(s, pa.int64())), *(pa.array(c, t) for c, t in zip(rest, kinds))], columns)

    kind = df.schema[key].dataType.simpleString()
    return _per_batch(df, [key, *_GEOMETRY], one, f"`{key}` {kind}, centre int, rank int, neighbour int, distance double, vector array<double>")


def distance_matrix(pos: np.ndarray, cell: np.ndarray | None, pbc: np.ndarray) -> np.ndarray:
    """Shortest distances between distinct atoms over the 27 nearest images; zero on the diagonal, NaN without a usable cell."""
    n, usable = len(pos), usable_cell(cell, pbc)
    if usable is None:
        return np.full((n, n), np.nan)
    pos = _wrapped(pos, usable, pbc)
    best = np.full((n, n), np.inf)
    for shift in product(*((-1, 0, 1) if p else (0,) for p in pbc)):
        v = pos[None, :, :] - pos[:, None, :] + np.array(shift, float) @ usable
        best = np.minimum(best, np.einsum("ijk,ijk->ij", v, v))
    best = np.sqrt(best)
    best[np.arange(n), np.arange(n)] = 0.0
    return best


def minimum_distances(df: DataFrame, key: str = "structure_id") -> DataFrame:
    """``key, a, b, distance``: shortest distance of two distinct atoms for every pair of elements of a structure."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for x, ((pos, cell, pbc), species) in enumerate(zip(read_frames(b), b["species"].to_pylist())):
            if len(pos) < 2 or not species or len(species) != len(pos) or not np.isfinite(pos).all():
                continue
            d = distance_matrix(pos, cell, pbc)
            best: dict[tuple[str, str], float] = {}
            i, j = np.triu_indices(len(pos), 1)
            for p, q, v in zip(i, j, d[i, j]):
                pair = tuple(sorted((species[p], species[q])))
                if v < best.get(pair, np.inf):
                    best[pair] = float(v)
            rows += [(x, *pair, v) for pair, v in best.items()]
        s, a, c, v = list(zip(*rows)) if rows else [[]] * 4
        return pa.record_batch([b[key].take(pa.array(s, pa.int64())), pa.array(a, pa.string()), pa.array(c, pa.string()), pa.array(v, pa.float64())], [key, "a", "b", "distance"])

    kind = df.schema[key].dataType.simpleString()
    return _per_batch(df, [key, "species", *_GEOMETRY], one, f"`{key}` {kind}, a string, b string, distance double")


def _radii(species: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of symbols of every row and the covalent radii of all."""
    codes = species.flatten().dictionary_encode()
    table = np.array([*(RADIUS.get(e, np.nan) for e in codes.dictionary.to_pylist()), np.nan])
    return pc.list_value_length(species).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), table[codes.indices.fill_null(len(table) - 1).to_numpy(zero_copy_only=False)]


def _aligned(n: np.ndarray, held: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values of every atom; not a number beyond those of its row."""
    out = np.full(int(n.sum()), np.nan)
    at = np.arange(len(out)) - np.repeat(np.cumsum(n) - n, n)
    known = at < np.repeat(held, n)
    out[known] = values[(at + np.repeat(np.cumsum(held) - held, n))[known]]
    return out


def _short(n: np.ndarray, pos: np.ndarray, cells: np.ndarray, pbc: np.ndarray, most: float, limits: np.ndarray | None, strict: bool) -> tuple[np.ndarray, np.ndarray]:
    """Structures with usable geometry, and those with a pair of distinct atoms below ``most``, or below the sum of their limits."""
    good, flag = np.zeros(len(n), bool), np.zeros(len(n), bool)
    below = np.less if strict else np.less_equal
    first = np.cumsum(n) - n
    for rows, atoms in by_size(n, n > 0):
        p = pos[atoms]
        cell, ok = usable_cells(cells[rows], pbc[rows])
        ok &= np.isfinite(p).all((1, 2))
        good[rows] = ok
        if most <= 0 or not ok.any():
            continue
        inverse = np.linalg.inv(cell)
        # within half of every height only the nearest image can be as near as that
        near = ok & (most * np.where(pbc[rows], np.linalg.norm(inverse, axis=1), 0.0) < 0.49).all(1) & (len(atoms[0]) <= _DIRECT)
        i, j = np.triu_indices(atoms.shape[1], 1)
        some = np.flatnonzero(near)
        step = max(1, _CACHE // max(1, len(i)))
        for x in (some[x : x + step] for x in range(0, len(some), step)) if len(i) else ():
            v = p[x][:, j] - p[x][:, i]
            v -= np.where(pbc[rows[x]][:, None], np.rint(v @ inverse[x]), 0.0) @ cell[x]
            d = np.sqrt(np.einsum("bik,bik->bi", v, v))
            bound = most if limits is None else limits[atoms[x]][:, i] + limits[atoms[x]][:, j]
            flag[rows[x]] = below(d, bound).any(1)
        rest = rows[ok & ~near]
        if len(rest):
            s, i, j, d, _ = pairs_within([(pos[first[r] : first[r] + n[r]], cells[r], pbc[r]) for r in rest], most)
            r = rest[s]
            bound = np.full(len(d), most) if limits is None else limits[first[r] + i] + limits[first[r] + j]
            flag[r[(i != j) & below(d, bound)]] = True
    return good, flag


def with_short_pairs(df: DataFrame, *, cutoff: float | None = None, coefficient: float | None = None, strict: bool = True, out: str = "short", key: str = "structure_id") -> DataFrame:
    """``df`` with a flag: a pair of distinct atoms closer than ``cutoff``, or than ``coefficient`` times the sum of covalent radii.

    Null where the structure has no usable geometry.  Images of one atom are no pair.
    """
    if (cutoff is None) == (coefficient is None):
        raise ValueError("give a cutoff or a coefficient")
    bound = cutoff if cutoff is not None else coefficient
    if not np.isfinite(bound) or bound < 0:
        raise ValueError("the bound must be finite and not negative")
    names = [c.name for c in df.schema]
    if out in names:
        raise ValueError(f"{out} is a column already")
    schema = StructType([*df.schema.fields, StructField(out, BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(x, 512) for x in range(0, b.num_rows, 512)):
                n, pos, cells, pbc = frame_arrays(part)
                held, radii = _radii(part["species"])
                most = cutoff if cutoff is not None else coefficient * 2 * float(np.nanmax(radii, initial=0.0))
                limits = None if cutoff is not None else _aligned(n, held, radii) * coefficient
                good, flag = _short(n, pos, cells, pbc, most, limits, strict)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in part.schema.names), pa.array(flag, pa.bool_(), mask=~good)], [*part.schema.names, out])

    return df.mapInArrow(run, schema)


def bonds(pos: np.ndarray, species: list[str], scale: float = 1.15) -> list[tuple[int, int, float]]:
    """Pairs of atoms at most ``scale`` times the sum of their covalent radii apart, without images."""
    r = np.array([RADIUS[e] for e in species])
    d = np.sqrt(((pos[:, None] - pos[None]) ** 2).sum(2))
    i, j = np.nonzero(np.triu(d <= scale * (r[:, None] + r[None]), 1))
    return [(int(a), int(b), float(d[a, b])) for a, b in zip(i, j)]


def bad_bonds(pos: np.ndarray, species: list[str], coefficient: float = 0.8) -> list[tuple[int, int, float]]:
    """Bonds that are shorter than ``coefficient`` times the sum of the covalent radii."""
    return [b for b in bonds(pos, species) if b[2] < coefficient * (RADIUS[species[b[0]]] + RADIUS[species[b[1]]])]


def cell_status(lattice: Column, pbc: Column) -> Column:
    """Bits: 1 periodic vectors finite, not null and independent; 2 the full cell is regular, or nothing is periodic; 0 for no cell."""
    finite = F.size(F.filter(F.flatten(lattice), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))) == 9
    rows = [lattice[i] for i in range(3)]
    dot = lambda a, b: sum((a[k] * b[k] for k in range(1, 3)), a[0] * b[0])
    cross = lambda a, b: F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    long = [F.sqrt(dot(r, r)) > 1e-12 for r in rows]
    apart = lambda i, j: F.sqrt(dot(cross(rows[i], rows[j]), cross(rows[i], rows[j]))) > 1e-12 * F.sqrt(F.greatest(dot(rows[i], rows[i]), dot(rows[j], rows[j])))
    volume = F.abs(dot(rows[0], cross(rows[1], rows[2])))
    n = sum((pbc[i].cast("int") for i in range(1, 3)), pbc[0].cast("int"))
    alone = (~pbc[0] | long[0]) & (~pbc[1] | long[1]) & (~pbc[2] | long[2])
    two = (~(pbc[0] & pbc[1]) | apart(0, 1)) & (~(pbc[1] & pbc[2]) | apart(1, 2)) & (~(pbc[0] & pbc[2]) | apart(0, 2))
    valid = finite & alone & two & ((n < 3) | (volume > 1e-12))
    return F.when(F.coalesce(valid, F.lit(False)), F.lit(1) + F.when((n == 0) | (volume > 1e-12), 2).otherwise(0)).otherwise(0)
