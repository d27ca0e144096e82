"""Parsers of structure formats: each turns lines into frames, and fails on malformed ones; nothing is filled with zeros."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np

HARTREE, BOHR, GPA = 27.211386245988, 0.52917721067, 160.21766208  # eV, angstrom, GPa per eV/angstrom^3
_PAIR = re.compile(r'([A-Za-z_][\w.\-]*)\s*=\s*("(?:[^"\\]|\\.)*"|\'[^\']*\'|\{[^}]*\}|\S+)')
_TRUE, _FALSE = {"T", "TRUE", "1"}, {"F", "FALSE", "0"}
_KNOWN = {"lattice", "properties", "pbc", "energy", "virial", "stress", "config_type"}
#: Names of per-atom columns that have a place of their own.
COLUMNS = {"forces": "forces", "force": "forces", "spin": "spin", "magmom_vec": "spin", "force_mag": "force_mag", "mforce": "force_mag"}
EMPTY = {"forces": None, "spin": None, "force_mag": None, "props": [], "labels": [], "lattice": None, "pbc": [True] * 3, "energy": None, "virial": None, "stress": None, "config_type": None, "extra": []}


class FormatError(ValueError):
    """A file that breaks the rules of its format."""


def numbers(text: str, count: int | None = None) -> list[float]:
    try:
        values = [float(x.replace("D", "E").replace("d", "e")) for x in text.split()]
    except ValueError as e:
        raise FormatError(f"no numbers: {text!r}") from e
    if (count is not None and len(values) != count) or not all(map(math.isfinite, values)):
        raise FormatError(f"expected {count} finite numbers: {text!r}")
    return values


def flags(text: str) -> list[bool]:
    tokens = text.upper().replace(",", " ").split()
    if len(tokens) not in (1, 3) or not set(tokens) <= _TRUE | _FALSE:
        raise FormatError(f"no periodicity: {text!r}")
    return [t in _TRUE for t in tokens] * (3 // len(tokens))


def extxyz(lines: Iterator[str]) -> Iterator[dict]:
    """Frames of an extended XYZ text; every per-atom column is kept."""
    for first in lines:
        if not first.strip():
            continue
        try:
            n = int(first)
        except ValueError as e:
            raise FormatError(f"expected an atom count: {first!r}") from e
        if n < 0:
            raise FormatError("a negative atom count")
        plain = lambda v: re.sub(r'\\(.)', r"\1", v[1:-1]) if v[0] in "\"'{" else v
        fields = {k: plain(v) for k, v in _PAIR.findall(next(lines, ""))}
        low = {k.lower(): v for k, v in fields.items()}
        spec = low.get("properties", "species:S:1:pos:R:3").split(":")
        if len(spec) % 3:
            raise FormatError("Properties are triples of name, type and count")
        columns = list(zip(spec[::3], spec[1::3], spec[2::3]))
        if any(k not in "SRIL" or not c.isdigit() or int(c) < 1 for _, k, c in columns):
            raise FormatError("a column needs a type of S, R, I, L and a count")
        names = [c[0] for c in columns]
        if not {"species", "pos"} <= set(names) or len(set(names)) != len(names):
            raise FormatError("Properties need species and pos, each name once")
        width, atoms = sum(int(c[2]) for c in columns), {name: [] for name in names}
        for _ in range(n):
            tokens = next(lines, "").split()
            if len(tokens) != width:
                raise FormatError(f"expected {width} columns, got {len(tokens)}")
            at = 0
            for name, kind, count in columns:
                part = tokens[at : at + int(count)]
                at += int(count)
                if kind == "S":
                    atoms[name].append(" ".join(part))
                elif kind == "L":
                    atoms[name].append([float(x) for x in (flags(t)[0] for t in part)])
                else:
                    atoms[name].append(numbers(" ".join(part), int(count)))
        cell = numbers(low["lattice"], 9) if "lattice" in low else None
        tensors = {}
        for name in ("virial", "stress"):
            tensors[name] = numbers(low[name]) if name in low else None
            if tensors[name] is not None and len(tensors[name]) not in (6, 9):
                raise FormatError(f"a {name} has 6 or 9 components")
        kinds = {c[0]: c[1] for c in columns}
        own = {"species": "species", "pos": "pos", **{name: COLUMNS[name.lower()] for name in names if name.lower() in COLUMNS}}
        yield {
            **EMPTY, "natoms": n, **{to: atoms[name] for name, to in own.items()},
            "props": [(name, atoms[name]) for name in names if name not in own and kinds[name] != "S"], "labels": [(name, atoms[name]) for name in names if name not in own and kinds[name] == "S"],
            "lattice": [cell[i : i + 3] for i in (0, 3, 6)] if cell else None, "pbc": flags(low.get("pbc", "T T T")), "energy": numbers(low["energy"], 1)[0] if "energy" in low else None,
            **tensors, "config_type": low.get("config_type"), "extra": [(k, v) for k, v in fields.items() if k.lower() not in _KNOWN],
        }


def lammps(lines: Iterator[str], elements: dict[int, str] | None = None) -> Iterator[dict]:
    """Frames of a LAMMPS text dump, orthogonal or triclinic; ``elements`` maps atom types; ``c_spin[1..4]`` gives moments."""
    step, n, pbc, bounds = None, 0, "pp pp pp", []
    for line in lines:
        if line.startswith("ITEM: TIMESTEP"):
            step = next(lines).strip()
        elif line.startswith("ITEM: NUMBER OF ATOMS"):
            n = int(next(lines))
        elif line.startswith("ITEM: BOX BOUNDS"):
            pbc = " ".join(w for w in line.split()[3:] if len(w) == 2 and set(w) <= set("pfsm"))
            bounds = [numbers(next(lines)) for _ in range(3)]
        elif line.startswith("ITEM: ATOMS"):
            names = line.split()[2:]
            xy, xz, yz = (b[2] if len(b) > 2 else 0.0 for b in bounds)
            lo = [bounds[0][0] - min(0, xy, xz, xy + xz), bounds[1][0] - min(0, yz), bounds[2][0]]
            hi = [bounds[0][1] - max(0, xy, xz, xy + xz), bounds[1][1] - max(0, yz), bounds[2][1]]
            a, b, c = [hi[0] - lo[0], 0.0, 0.0], [xy, hi[1] - lo[1], 0.0], [xz, yz, hi[2] - lo[2]]
            rows = [dict(zip(names, next(lines, "").split())) for _ in range(n)]
            triple = next((t for t in (("x", "y", "z"), ("xu", "yu", "zu"), ("xs", "ys", "zs")) if set(t) <= set(names)), None)
            if triple is None or any(len(r) != len(names) for r in rows):
                raise FormatError("dump without coordinates or with short rows")
            rows.sort(key=lambda r: int(r.get("id", 0)))
            pos = [numbers(" ".join(r[k] for k in triple), 3) for r in rows]
            pos = [[sum(p[k] * v[j] for k, v in enumerate((a, b, c))) for j in range(3)] for p in pos] if triple[0] == "xs" else [[p[j] - lo[j] for j in range(3)] for p in pos]
            name = lambda r: r["element"] if "element" in r else (elements or {}).get(int(r["type"]), f"X{r['type']}")
            vectors = lambda keys: [numbers(" ".join(r[k] for k in keys), 3) for r in rows] if set(keys) <= set(names) else None
            spin = vectors(["c_spin[1]", "c_spin[2]", "c_spin[3]"])
            if spin is not None and "c_spin[4]" in names:  # the first three are a direction, the fourth its size
                spin = [[x * float(r["c_spin[4]"]) for x in s] for s, r in zip(spin, rows)]
            flags_ = [w == "pp" for w in pbc.split()] or [True] * 3
            yield {**EMPTY, "natoms": n, "species": [name(r) for r in rows], "pos": pos, "forces": vectors(["fx", "fy", "fz"]), "spin": spin, "lattice": [a, b, c], "pbc": flags_, "extra": [("timestep", step)]}


def _numeric(tokens: list[str]) -> bool:
    return bool(tokens) and all(re.fullmatch(r"[+-]?\d+(\.\d*)?", t) for t in tokens)


def xdatcar(lines: Iterator[str], species: list[str] | None = None) -> Iterator[dict]:
    """Frames of a VASP trajectory; headers may repeat, old files without symbols take ``species`` or ``X1...``."""
    held = list(lines)
    at, header, frame = 0, None, 0
    while at < len(held):
        if not held[at].strip():
            at += 1
            continue
        mode = held[at].strip().lower()
        if header is None or not ("direct" in mode or "cart" in mode):
            if at + 6 >= len(held):
                return
            scale = numbers(held[at + 1].split()[0], 1)[0]
            cell = np.array([numbers(" ".join(held[at + 2 + i].split()[:3]), 3) for i in range(3)]) * scale
            tokens = held[at + 5].split()
            if _numeric(tokens):
                counts, names, at = [int(float(t)) for t in tokens], species or [f"X{i + 1}" for i in range(len(tokens))], at + 6
            else:
                counts, names, at = [int(float(t)) for t in held[at + 6].split()], tokens, at + 7
            if len(names) != len(counts):
                raise FormatError("species do not fit the counts")
            header = (cell, [e for e, n in zip(names, counts) for _ in range(n)])
            continue
        cell, kinds = header
        rows = held[at + 1 : at + 1 + len(kinds)]
        if len(rows) < len(kinds):
            return  # an unfinished last frame
        pos = np.array([numbers(" ".join(r.split()[:3]), 3) for r in rows]).reshape(-1, 3)
        frame, at = frame + 1, at + 1 + len(kinds)
        yield {**EMPTY, "natoms": len(kinds), "species": kinds, "pos": (pos @ cell if "direct" in mode else pos).tolist(), "lattice": cell.tolist(), "config_type": f"XDATCAR_{frame}"}


def outcar(lines: Iterator[str]) -> Iterator[dict]:
    """Frames of a VASP output: positions with forces, stress in kB, energies; blocks of a machine-learned force field are left out."""
    names: list[str] = []
    kinds: list[str] = []
    cell = stress = None
    last: dict | None = None
    learned, frame = False, 0
    for line in lines:
        text = line.strip()
        if text.startswith("VRHFIN"):
            names.append(re.split(r"[=:]", text)[1].strip())
        elif text.startswith("ions per type"):
            counts = [int(x) for x in text.split("=")[1].split()]
            if len(counts) > len(names):
                raise FormatError("more counts than species")
            kinds = [e for e, n in zip(names, counts) for _ in range(n)]
        elif text.startswith("direct lattice vectors"):
            cell = [numbers(" ".join(next(lines).split()[:3]), 3) for _ in range(3)]
        elif text.startswith("in kB") and not learned:
            xx, yy, zz, xy, yz, zx = numbers(" ".join(text.split()[-6:]), 6)
            stress = [-v * 0.1 / GPA for v in (xx, xy, zx, xy, yy, yz, zx, yz, zz)]
        elif "ML FORCE" in text.upper() or "ML ENERGY" in text.upper():
            learned = True
        elif "FREE ENERGIE OF THE ION-ELECTRON" in text:
            learned = False
        elif text.startswith("POSITION") and "TOTAL-FORCE" in text:
            ml, rows = "(ML)" in text, []
            for row in lines:
                if set(row.strip()) <= {"-"}:
                    if rows:
                        break
                    continue
                rows.append(numbers(" ".join(row.split()[:6]), 6))
            if len(rows) != len(kinds) or cell is None:
                raise FormatError(f"{len(rows)} positions for {len(kinds)} atoms")
            if last is not None:
                yield last
                last = None
            if not ml:
                frame += 1
                volume = abs(float(np.linalg.det(np.array(cell))))
                last = {**EMPTY, "natoms": len(kinds), "species": kinds, "pos": [r[:3] for r in rows], "forces": [r[3:] for r in rows], "lattice": cell, "stress": stress, "virial": None if stress is None else [-s * volume for s in stress], "config_type": f"OUTCAR_{frame}"}
                stress = None
        elif "free  energy   TOTEN" in text and last is not None:
            last["energy"] = numbers(text.split("=")[-1].split()[0], 1)[0]
            yield last
            last = None
    if last is not None:
        yield last


def cp2k(lines: Iterator[str]) -> Iterator[dict]:
    """The frame of a single-point CP2K output; a second block of coordinates or forces is an error."""
    cell: dict[str, list[float]] = {}
    species, pos, forces, energy, stress = [], [], None, None, None
    for line in lines:
        text = line.strip()
        m = re.match(r"CELL\| Vector ([abc])\s*\[angstrom\]:?\s*(.*)", text)
        if m:
            cell[m[1]] = numbers(" ".join(m[2].split()[:3]), 3)
        elif "MODULE QUICKSTEP: ATOMIC COORDINATES IN ANGSTROM" in text.upper():
            if pos:
                raise FormatError("more than one block of coordinates")
            for row in lines:
                t = row.split()
                if len(t) >= 7 and t[0].isdigit() and t[1].isdigit():
                    species.append(t[2])
                    pos.append(numbers(" ".join(t[4:7]), 3))
                elif pos:
                    break
        elif text.startswith("ATOMIC FORCES in [a.u.]"):
            if forces is not None:
                raise FormatError("more than one block of forces")
            forces = []
            for row in lines:
                t = row.split()
                if len(t) >= 6 and t[0].isdigit():
                    forces.append([v * HARTREE / BOHR for v in numbers(" ".join(t[-3:]), 3)])
                elif forces:
                    break
        elif "ENERGY| Total FORCE_EVAL" in text:
            energy = numbers(text.split(":")[-1].split()[0], 1)[0] * HARTREE
        elif text.startswith("Total energy:") and energy is None:
            energy = numbers(text.split(":")[-1].split()[0], 1)[0] * HARTREE
        elif text.startswith("STRESS| Analytical stress tensor"):
            next(lines)
            stress = [v / GPA for _ in range(3) for v in numbers(" ".join(next(lines).split()[-3:]), 3)]
    if set(cell) != set("abc"):
        raise FormatError("the cell is incomplete")
    lattice = [cell[k] for k in "abc"]
    if abs(np.linalg.det(np.array(lattice))) < 1e-12 or not pos or (forces is not None and len(forces) != len(pos)):
        raise FormatError("a flat cell, no atoms, or forces that do not fit them")
    yield {**EMPTY, "natoms": len(pos), "species": species, "pos": pos, "forces": forces, "lattice": lattice, "energy": energy, "stress": stress, "config_type": "CP2K_1"}


def n2p2(lines: Iterator[str]) -> Iterator[dict]:
    """Blocks of ``begin ... end`` in Bohr and Hartree, with no or three lattice rows."""
    length, unit = 1 / 1.8897261328, 1 / 0.0367493254
    block = 0
    rows: dict | None = None
    for line in lines:
        t = line.split()
        if not t:
            continue
        if t[0] == "begin":
            rows, block = {"lattice": [], "atoms": [], "extra": [], "energy": None}, block + 1
        elif rows is None:
            raise FormatError(f"outside of a block: {line!r}")
        elif t[0] == "lattice":
            rows["lattice"].append([v * length for v in numbers(" ".join(t[1:4]), 3)])
        elif t[0] == "atom":
            if len(t) < 10:
                raise FormatError("an atom has ten columns")
            rows["atoms"].append((t[4], [v * length for v in numbers(" ".join(t[1:4]), 3)], numbers(t[5], 1), [numbers(t[6], 1)[0] * unit], [v * unit / length for v in numbers(" ".join(t[7:10]), 3)]))
        elif t[0] == "energy":
            rows["energy"] = numbers(t[1], 1)[0] * unit
        elif t[0] in ("charge", "comment"):
            rows["extra"].append((t[0], " ".join(t[1:])))
        elif t[0] == "end":
            if not rows["atoms"] or len(rows["lattice"]) not in (0, 3):
                raise FormatError(f"block {block} has no atoms or an incomplete lattice")
            a = rows["atoms"]
            yield {
                **EMPTY, "natoms": len(a), "species": [x[0] for x in a], "pos": [x[1] for x in a], "forces": [x[4] for x in a], "props": [("charge", [x[2] for x in a]), ("atom_energy", [x[3] for x in a])],
                "lattice": rows["lattice"] or None, "pbc": [bool(rows["lattice"])] * 3, "energy": rows["energy"], "config_type": f"N2P2_{block}", "extra": rows["extra"],
            }
            rows = None
    if rows is not None:
        raise FormatError("the last block has no end")
