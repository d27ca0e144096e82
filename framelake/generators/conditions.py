"""Conditions and formulas over coordinates: a small safe language evaluated on arrays."""

from __future__ import annotations

import ast
import re

import numpy as np

TOLERANCE = 1e-4
FUNCTIONS = {
    "sin": np.sin, "cos": np.cos, "tan": np.tan, "arcsin": np.arcsin, "arccos": np.arccos, "arctan": np.arctan, "sinh": np.sinh, "cosh": np.cosh, "tanh": np.tanh,
    "exp": np.exp, "log": np.log, "log10": np.log10, "sqrt": np.sqrt, "abs": np.abs, "floor": np.floor, "ceil": np.ceil, "min": np.minimum, "max": np.maximum,
}
_NEAR = {
    ast.Eq: lambda a, b: np.abs(a - b) <= TOLERANCE, ast.NotEq: lambda a, b: np.abs(a - b) > TOLERANCE, ast.LtE: lambda a, b: a <= b + TOLERANCE,
    ast.GtE: lambda a, b: a >= b - TOLERANCE, ast.Lt: lambda a, b: a < b, ast.Gt: lambda a, b: a > b,
}
_MATH = {ast.Add: np.add, ast.Sub: np.subtract, ast.Mult: np.multiply, ast.Div: np.divide, ast.Pow: np.power}


def _value(node: ast.AST, names: dict) -> np.ndarray:
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
        return np.float64(node.value)
    if isinstance(node, ast.Name):
        if node.id == "pi":
            return np.float64(np.pi)
        if node.id not in names:
            raise ValueError(f"unknown name {node.id}")
        return names[node.id]
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        v = _value(node.operand, names)
        return -v if isinstance(node.op, ast.USub) else v
    if isinstance(node, ast.BinOp) and type(node.op) in _MATH:
        with np.errstate(all="ignore"):
            return _MATH[type(node.op)](_value(node.left, names), _value(node.right, names))
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in FUNCTIONS and not node.keywords:
        with np.errstate(all="ignore"):
            return FUNCTIONS[node.func.id](*(_value(a, names) for a in node.args))
    raise ValueError(f"not allowed: {ast.unparse(node)}")


def _truth(node: ast.AST, names: dict) -> np.ndarray:
    if isinstance(node, ast.BoolOp):
        parts = [_truth(v, names) for v in node.values]
        return np.logical_and.reduce(parts) if isinstance(node.op, ast.And) else np.logical_or.reduce(parts)
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
        return ~_truth(node.operand, names)
    if isinstance(node, ast.Compare):
        sides = [_value(x, names) for x in (node.left, *node.comparators)]
        if any(type(op) not in _NEAR for op in node.ops):
            raise ValueError("this comparison is not supported")
        return np.logical_and.reduce([_NEAR[type(op)](a, b) for op, a, b in zip(node.ops, sides, sides[1:])])
    raise ValueError(f"no condition: {ast.unparse(node)}")


def _parse(text: str) -> ast.AST:
    try:
        return ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"cannot read {text!r}") from e


def condition(text: str, coordinates: np.ndarray) -> np.ndarray:
    """Mask of the points (rows x, y, z) that meet ``text``; ``all`` takes every one.

    ``==, !=, <=, >=`` (and a single ``=``) allow 1e-4, ``<`` and ``>`` are strict.
    """
    if text.strip().lower() in ("", "all"):
        return np.ones(len(coordinates), bool)
    plain = re.sub(r"(?i)\b(and|or|not)\b", lambda m: m.group().lower(), text)
    plain = re.sub(r"(?<![<>=!])=(?!=)", "==", plain).replace("^", "**")
    names = dict(zip("xyz", np.asarray(coordinates, float).T))
    return np.broadcast_to(_truth(_parse(plain), names), len(coordinates)).copy()


def formula(text: str, coordinates: np.ndarray, parameters: dict[str, float] | None = None) -> np.ndarray:
    """Value of a formula of x, y, z and parameters at every point."""
    names = {**dict(zip("xyz", np.asarray(coordinates, float).T)), **{k: np.float64(v) for k, v in (parameters or {}).items()}}
    out = np.broadcast_to(_value(_parse(text.replace("^", "**")), names), len(coordinates)).astype(float)
    if not np.isfinite(out).all():
        raise ValueError("the formula has no finite value everywhere")
    return out
