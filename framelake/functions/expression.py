"""Boolean expressions over two-level data, compiled to Spark columns.

``and or not`` (any case, also ``&& || !``), chained comparisons, ``+ - * /``
and dotted names are allowed; the result must be a predicate.  Missing values
compare as false, except ``!=``, which is true; ``not`` flips plainly; division
by zero gives an infinity or, for 0/0, a missing value.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


class ExpressionError(ValueError):
    """The text is no predicate of the supported grammar."""


_COMPARE: dict[type, Callable[[Column, Column], Column]] = {
    ast.Eq: lambda a, b: a == b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b,
}


def _present(c: Column) -> Column:
    """Numbers that are not a number count as missing."""
    return F.when(~F.isnan(c.cast("double")), c.cast("double"))


def _divide(a: Column, b: Column) -> Column:
    inf = F.lit(float("inf"))
    return F.when(b == 0, F.when(a > 0, inf).when(a < 0, -inf)).otherwise(F.try_divide(a, b))


def compile_predicate(text: str, fields: Mapping[str, Column] | Callable[[str], Column | None]) -> Column:
    """The predicate of ``text``; ``fields`` gives the column of each dotted name."""
    find = fields if callable(fields) else fields.get
    plain = re.sub(r"(?i)\b(and|or|not)\b", lambda m: m.group().lower(), text.replace("&&", " and ").replace("||", " or "))
    plain = re.sub(r"!(?!=)", " not ", plain).strip()
    if re.search(r"[A-Za-z_]\w*\.\d", plain):
        raise ExpressionError("components are named, not numbered")
    try:
        tree = ast.parse(plain, mode="eval").body
    except SyntaxError as e:
        raise ExpressionError(f"cannot read {text!r}") from e
    used: list[str] = []

    def name(node: ast.AST) -> str:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute):
            return f"{name(node.value)}.{node.attr}"
        raise ExpressionError("only names may have parts")

    def field(node: ast.AST) -> Column:
        n = name(node)
        c = find(n)
        if c is None:
            raise ExpressionError(f"unknown field {n}")
        used.append(n)
        return c

    def number(node: ast.AST) -> Column:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return F.lit(float(node.value))
        if isinstance(node, (ast.Name, ast.Attribute)):
            return _present(field(node))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
            return number(node.operand) if isinstance(node.op, ast.UAdd) else -number(node.operand)
        if isinstance(node, ast.BinOp):
            a, b = number(node.left), number(node.right)
            for kind, result in ((ast.Add, a + b), (ast.Sub, a - b), (ast.Mult, a * b), (ast.Div, _divide(a, b))):
                if isinstance(node.op, kind):
                    return _present(result)  # inf - inf and the like are missing too
        raise ExpressionError(f"not a number: {ast.unparse(node)}")

    def test(node: ast.AST) -> Column:
        if isinstance(node, ast.BoolOp):
            out = test(node.values[0])
            for v in node.values[1:]:
                out = out & test(v) if isinstance(node.op, ast.And) else out | test(v)
            return out
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return ~test(node.operand)
        if isinstance(node, ast.Compare):
            sides, out = [node.left, *node.comparators], None
            for op, a, b in zip(node.ops, sides, sides[1:]):
                l, r = number(a), number(b)
                if isinstance(op, ast.NotEq):
                    one = F.coalesce(l != r, F.lit(True))
                elif type(op) in _COMPARE:
                    one = F.coalesce(_COMPARE[type(op)](l, r), F.lit(False))
                else:
                    raise ExpressionError("this comparison is not supported")
                out = one if out is None else out & one
            return out
        if isinstance(node, (ast.Name, ast.Attribute)) and re.match(r"has[_.]", name(node)):
            return F.coalesce(field(node).cast("boolean"), F.lit(False))
        raise ExpressionError(f"not a predicate: {ast.unparse(node)}")

    out = test(tree)
    if not used:
        raise ExpressionError("the expression uses no field")
    return out
