"""Typed filters: text, element, tag, range and index conditions, and their combination.

Every condition is a Column, so that a whole specification is one ``filter``
that Catalyst can push down.  Malformed specifications raise
:class:`FilterError` with a code; they never select everything by accident.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.elements import NUMBER
from framelake.functions.expression import compile_predicate
from framelake.runtime import materialize


class FilterError(ValueError):
    """A condition that cannot be evaluated; ``code`` says why."""

    def __init__(self, code: str, detail: str = "", condition_id: str | None = None) -> None:
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code, self.condition_id = code, condition_id


def text_condition(c: Column, values: list[str], mode: str = "contains", case: bool = False) -> Column:
    """Any of ``values`` by ``contains, exact, prefix, suffix`` or ``regex``; null counts as an empty text."""
    values = [str(v).strip() for v in values if str(v).strip()]
    if not values:
        raise FilterError("empty_condition")
    c = F.coalesce(c, F.lit(""))
    if mode == "regex":
        for v in values:
            try:
                re.compile(v)
            except re.error as e:
                raise FilterError("invalid_regex", str(e)) from e
        tests = [c.rlike(v if case else f"(?iu){v}") for v in values]
    else:
        c = c if case else F.lower(c)
        how = {"contains": c.contains, "exact": c.__eq__, "prefix": c.startswith, "suffix": c.endswith}.get(mode)
        if how is None:
            raise FilterError("unsupported_operator", mode)
        tests = [how(v if case else v.lower()) for v in values]
    return reduce(lambda a, b: a | b, tests)


def symbol(text: str) -> str | None:
    """A chemical symbol in its usual spelling, or None."""
    s = text.strip()
    s = s[:1].upper() + s[1:].lower()
    return s if s in NUMBER else None


def _symbols(values: list[str]) -> list[str]:
    out = []
    for v in values:
        s = symbol(str(v))
        if s is None:
            raise FilterError("unknown_element", str(v))
        out.append(s)
    return out


def element_condition(elements: Column, required: list[str] = (), excluded: list[str] = (), allowed: list[str] = ()) -> Column:
    """All required present, none excluded, nothing outside the allowed; an unknown symbol is an error."""
    lit = lambda xs: F.array(*(F.lit(x) for x in xs))
    required, excluded, allowed = _symbols(required), _symbols(excluded), _symbols(allowed)
    tests = [F.array_contains(elements, e) for e in required]
    if excluded:
        tests.append(~F.arrays_overlap(elements, lit(excluded)))
    if allowed:
        tests.append(F.size(F.array_except(elements, lit(allowed))) == 0)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def parse_elements(query: str, unknown: list[str] | None = None) -> dict[str, list[str]]:
    """``Fe,O`` allowed, ``+Fe`` required, ``-H`` or ``!H`` excluded; unknown symbols are left out and put into ``unknown``."""
    out: dict[str, list[str]] = {"required": [], "excluded": [], "allowed": []}
    for token in re.split(r"[,\s]+", query.strip()):
        kind = {"+": "required", "-": "excluded", "!": "excluded"}.get(token[:1], "allowed")
        name = token[1:] if kind != "allowed" else token
        if not name:
            continue
        s = symbol(name)
        if s is not None:
            out[kind].append(s)
        elif unknown is not None:
            unknown.append(name)
    return out


def search(df: DataFrame, query: str, kind: str = "tag", *, tag: str = "config_type", formula: str = "formula", elements: str = "elements") -> DataFrame:
    """One-line search: a case-sensitive regular expression over ``tag`` or ``formula``, or an element query; a bad expression finds nothing."""
    if kind == "elements":
        return df.where(element_condition(F.col(elements), **parse_elements(query)))
    try:
        re.compile(query)
    except re.error:
        return df.limit(0)
    return df.where(F.coalesce(F.col(tag if kind == "tag" else formula), F.lit("")).rlike(query))


def combine(conditions: list[Column], how: str = "all") -> Column:
    """``all`` or ``any`` of the enabled conditions; there must be one."""
    if not conditions:
        raise FilterError("empty_condition")
    return reduce((lambda a, b: a & b) if how == "all" else (lambda a, b: a | b), conditions)


def tag_groups(c: Column, groups: list[tuple[str, list[tuple[str, bool]]]]) -> Column:
    """Groups of ``(any|all, [(substring, negate)])``, all of which must hold; case-sensitive; without any text nothing matches."""
    c = F.coalesce(c, F.lit(""))
    one = lambda s, neg: ~c.contains(s) if neg else c.contains(s)
    full = [(how, [t for t in tests if t[0]]) for how, tests in groups]
    full = [combine([one(*t) for t in tests], how) for how, tests in full if tests]
    return combine(full) if full else F.lit(False)


@dataclass(frozen=True)
class Condition:
    """One condition of a filter: ``field`` is config_type, formula, element_required, element_excluded, element_allowed or expression."""

    field: str
    values: tuple[str, ...] = ()
    mode: str | None = None
    case: bool | None = None
    enabled: bool = True
    condition_id: str | None = None


@dataclass(frozen=True)
class FilterSpec:
    """Conditions combined by ``all`` or ``any``; a specification without an enabled condition is an error."""

    conditions: tuple[Condition, ...] = ()
    how: str = "all"

    def to_dict(self) -> dict:
        return {"how": self.how, "conditions": [{k: list(v) if isinstance(v, tuple) else v for k, v in vars(c).items()} for c in self.conditions]}

    @staticmethod
    def from_dict(d: dict) -> FilterSpec:
        return FilterSpec(tuple(Condition(**{**c, "values": tuple(c.get("values", ()))}) for c in d.get("conditions", ())), d.get("how", "all"))

    def compile(self, columns: dict[str, Column], fields=None) -> Column:
        """The predicate; ``columns`` gives config_type, formula and elements, ``fields`` the names of expressions."""
        tests = []
        for c in self.conditions:
            if not c.enabled:
                continue
            try:
                if c.field in ("config_type", "formula"):
                    mode = c.mode or ("contains" if c.field == "config_type" else "exact")
                    tests.append(text_condition(columns[c.field], list(c.values), mode, bool(c.case)))
                elif c.field.startswith("element_"):
                    values = [v for v in c.values if v.strip()]
                    if not values:
                        raise FilterError("empty_condition")
                    tests.append(element_condition(columns["elements"], **{c.field[8:]: values}))
                elif c.field == "expression":
                    tests.append(compile_predicate(" ".join(c.values), fields or {}))
                else:
                    raise FilterError("unsupported_operator", c.field)
            except FilterError as e:
                raise FilterError(e.code, str(e), c.condition_id) from e
        return combine(tests, self.how)


def evaluate(df: DataFrame, spec: FilterSpec, key: str, columns: dict[str, Column], fields=None) -> DataFrame:
    """Sorted ids of the rows that a specification selects."""
    return df.where(spec.compile(columns, fields)).select(key).orderBy(key)


@dataclass
class Presets:
    """Named filter specifications, kept as one small JSON document: save, load, rename, delete and list."""

    items: dict[str, dict] = field(default_factory=dict)

    def save(self, name: str, spec: FilterSpec) -> None:
        if not name.strip():
            raise FilterError("empty_name")
        self.items[name.strip()] = spec.to_dict()

    def load(self, name: str) -> FilterSpec:
        if name not in self.items:
            raise FilterError("unknown_preset", name)
        return FilterSpec.from_dict(self.items[name])

    def rename(self, old: str, new: str) -> None:
        if new in self.items:
            raise FilterError("name_taken", new)
        self.items[new] = self.items.pop(old)

    def delete(self, name: str) -> bool:
        return self.items.pop(name, None) is not None

    def names(self) -> list[str]:
        return sorted(self.items)


def in_box(df: DataFrame, key: str, x: Column, y: Column, x_range: tuple[float, float], y_range: tuple[float, float], both: bool = True) -> DataFrame:
    """Distinct keys of rows inside both ranges, or inside either; ends belong to the range."""
    a, b = x.between(*x_range), y.between(*y_range)
    return df.where(a & b if both else a | b).select(key).distinct()


def paired_components(df: DataFrame, key: str, pred: str, ref: str) -> DataFrame:
    """``key, component, x, y``: reference and prediction of every component of paired vectors."""
    return df.select(key, F.posexplode(F.arrays_zip(F.col(ref).alias("r"), F.col(pred).alias("p"))).alias("component", "v")).select(key, "component", F.col("v.r").alias("x"), F.col("v.p").alias("y"))


def lattice_range(lengths: Column, angles: Column, low: list[float], high: list[float], tolerance: float = 1e-4) -> Column:
    """Inclusive ranges of a, b, c, alpha, beta and gamma, widened by ``tolerance``."""
    values = [lengths[i] for i in range(3)] + [angles[i] for i in range(3)]
    return combine([v.between(lo - tolerance, hi + tolerance) for v, lo, hi in zip(values, low, high)])


def _slice_test(i: Column, n: Column, parts: list[str]) -> Column:
    """Positions that a Python slice of ``n`` rows would take, negative steps included."""
    start, stop, step = ([int(p) if p else None for p in parts] + [None] * 3)[:3]
    step = 1 if step is None else step
    if step == 0:
        raise FilterError("zero_step")
    lo_bound, hi_bound = (F.lit(0), n) if step > 0 else (F.lit(-1), n - 1)

    def edge(v: int | None, default: Column) -> Column:
        return default if v is None else F.greatest(lo_bound, F.least(hi_bound, n + v if v < 0 else F.lit(v)))

    a, b = (edge(start, lo_bound), edge(stop, hi_bound)) if step > 0 else (edge(start, hi_bound), edge(stop, lo_bound))
    inside = (i >= a) & (i < b) if step > 0 else (i <= a) & (i > b)
    return inside & (F.pmod(i - a, F.lit(abs(step))) == 0)


def positions(df: DataFrame, order: list[str], label: str = "positions") -> DataFrame:
    """``df`` with ``_at``, the position in the global order, and ``_all``, the number of rows.

    The sorted rows are written once with the number of their sort partition, so
    that counts and ranks see the same partitions; no task holds more than its range.
    """
    ranged = materialize(df.orderBy(*order).withColumn("_part", F.spark_partition_id()), label)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    sizes = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    local = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    return local.join(F.broadcast(sizes), "_part").withColumn("_at", F.col("_i") + F.col("_off")).drop("_part", "_i", "_n", "_off")  # one row per partition


def index_positions(df: DataFrame, order: list[str], expression: str) -> DataFrame:
    """Rows at the positions of an index expression such as ``1:10, ::3, -5:``; tokens that are no index are skipped."""
    i, n, tests = F.col("_at"), F.col("_all"), []
    for token in re.split(r"[,\s]+", expression.strip()):
        if re.fullmatch(r"[+-]?\d+", token):
            tests.append(i == (n + int(token) if int(token) < 0 else F.lit(int(token))))
        elif re.fullmatch(r"([+-]?\d+)?(:([+-]?\d+)?){1,2}", token):
            tests.append(_slice_test(i, n, token.split(":")))
    if not tests:
        return df.limit(0)
    return positions(df, order).where(combine(tests, "any")).select(*df.columns)
