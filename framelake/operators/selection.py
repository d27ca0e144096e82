"""Selection and removal state of a dataset as set algebra over id tables.

A state is two small logs, ``selection(structure_id)`` per step and
``removed(structure_id, op)``; every operation returns a new state, undo drops
the last step.  Ids that are not active are dropped, repeated ones count once.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "structure_id"


def merge(old: DataFrame, new: DataFrame, how: str) -> DataFrame:
    """``replace, add, intersect, remove`` or ``clear`` of two id sets."""
    old, new = old.select(KEY).distinct(), new.select(KEY).distinct()
    if how == "replace":
        return new
    if how == "add":
        return old.union(new).distinct()
    if how == "intersect":
        return old.join(new, KEY, "left_semi")
    if how == "remove":
        return old.join(new, KEY, "left_anti")
    if how == "clear":
        return old.limit(0)
    raise ValueError(f"unknown selection mode {how}")


@dataclass(frozen=True)
class State:
    """Dataset ``base`` with its removals and selections; ``version`` grows with every change of the active rows."""

    base: DataFrame
    removals: tuple[DataFrame, ...] = ()
    selections: tuple[DataFrame, ...] = ()
    version: int = 0

    def removed(self) -> DataFrame:
        """``structure_id, op``: what was removed by which step."""
        out = self.base.select(KEY, F.lit(0).alias("op")).limit(0)
        for op, ids in enumerate(self.removals, 1):
            out = out.unionByName(ids.select(KEY, F.lit(op).alias("op")))
        return out

    def active(self) -> DataFrame:
        """Rows that are not removed."""
        return self.base.join(self.removed().select(KEY), KEY, "left_anti") if self.removals else self.base

    def inactive(self) -> DataFrame:
        return self.base.join(self.removed().select(KEY), KEY, "left_semi")

    def selected(self) -> DataFrame:
        """Ids of the current selection that are active."""
        chosen = self.selections[-1] if self.selections else self.base.select(KEY).limit(0)
        return chosen.select(KEY).join(self.active().select(KEY), KEY, "left_semi").distinct()

    def apply(self, ids: DataFrame, how: str = "replace") -> State:
        """One selection step; undone as one."""
        valid = ids.select(KEY).join(self.active().select(KEY), KEY, "left_semi")
        return replace(self, selections=(*self.selections, merge(self.selected(), valid, how)))

    def select(self, ids: DataFrame) -> State:
        return self.apply(ids, "add")

    def uncheck(self, ids: DataFrame) -> State:
        return self.apply(ids, "remove")

    def inverse(self) -> State:
        """The active rows that were not selected."""
        rest = self.active().select(KEY).join(self.selected(), KEY, "left_anti")
        return replace(self, selections=(*self.selections, rest))

    def undo_selection(self) -> State:
        return replace(self, selections=self.selections[:-1])

    def remove(self, ids: DataFrame) -> State:
        """Remove active rows; nothing changes if none of the ids is active."""
        mine = ids.select(KEY).join(self.active().select(KEY), KEY, "left_semi").distinct()
        if not mine.limit(1).count():
            return self
        return replace(self, removals=(*self.removals, mine), version=self.version + 1)

    def delete_selected(self) -> State:
        out = self.remove(self.selected())
        return replace(out, selections=(*out.selections, self.base.select(KEY).limit(0))) if out is not self else self

    def revoke(self) -> State:
        """Bring the last removed rows back."""
        return replace(self, removals=self.removals[:-1], version=self.version + 1) if self.removals else self

    def scope(self, kind: str, ids: DataFrame | None = None) -> DataFrame:
        """Ids of ``all``, ``active``, ``selected`` or ``custom`` (those of ``ids`` that are active)."""
        if kind == "all":
            return self.base.select(KEY)
        if kind == "active":
            return self.active().select(KEY)
        if kind == "selected":
            return self.selected()
        return ids.select(KEY).distinct().join(self.active().select(KEY), KEY, "left_semi")


def member(df: DataFrame, ids: DataFrame, out: str = "selected") -> DataFrame:
    """``df`` with a flag whether its id is in the set."""
    return df.join(ids.select(KEY).distinct().withColumn(out, F.lit(True)), KEY, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def rows_of(metrics: DataFrame, ids: DataFrame) -> DataFrame:
    """Dataset rows that belong to the structures of a set."""
    return metrics.join(ids.select(KEY).distinct(), KEY, "left_semi")


def attach_rows(structures: DataFrame, rows: DataFrame, counts: Column) -> DataFrame:
    """Give file rows their structure by position: ``row`` runs over all structures in order of id, ``counts`` rows each.

    Raises unless the counts add up to the rows.
    """
    from framelake.operators.filters import positions  # noqa: PLC0415

    sized = positions(structures.select(KEY, counts.cast("bigint").alias("n")), [KEY], "attach")
    # running totals: inside blocks of positions, then over the few blocks
    from pyspark.sql import Window  # noqa: PLC0415

    block = F.floor(F.col("_at") / 65_536)
    sized = sized.withColumn("block", block)
    inner = F.sum("n").over(Window.partitionBy("block").orderBy("_at")) - F.col("n")
    sums = sized.groupBy("block").agg(F.sum("n").alias("b"))
    before = F.coalesce(F.sum("b").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sized.withColumn("inner", inner).join(F.broadcast(sums.select("block", before.alias("before"))), "block").select(KEY, "n", (F.col("inner") + F.col("before")).alias("first"))
    expected, found = sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], rows.count()
    if expected != found:
        raise ValueError(f"{found} rows for {expected} expected")
    owner = offsets.where("n > 0").select(KEY, F.explode(F.expr("sequence(first, first + n - 1)")).alias("row"), "first")
    return rows.join(owner, "row").withColumn("row_no", (F.col("row") - F.col("first")).cast("int")).drop("row", "first")


def sync(metrics: DataFrame, updates: DataFrame, dataset: str) -> DataFrame:
    """Write changed references back: ``updates`` has ``structure_id, row_no, ref``."""
    new = updates.select(KEY, "row_no", F.col("ref").alias("_new"), F.lit(dataset).alias("dataset"))
    return metrics.join(new, [KEY, "row_no", "dataset"], "left").withColumn("ref", F.coalesce("_new", "ref")).drop("_new")


def concat(branches: list[DataFrame]) -> DataFrame:
    """Branches one after the other, columns by name, absent ones null."""
    out = branches[0]
    for b in branches[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out


def unique_patterns(df: DataFrame, pattern: str) -> DataFrame:
    """One row per set of indices, whatever their order."""
    return df.withColumn("_p", F.array_sort(F.array_distinct(pattern))).dropDuplicates(["_p"]).drop("_p")


def parse_value(text: str) -> str:
    """Canonical form of an edited value: a JSON array, else a number, else the text."""
    try:
        value = json.loads(text)
        if isinstance(value, list):
            return json.dumps(value)
    except ValueError:
        pass
    try:
        return json.dumps(float(text))
    except ValueError:
        return text


def edit_metadata(df: DataFrame, chosen: DataFrame, *, add: dict[str, str] | None = None, rename: dict[str, str] | None = None, remove: list[str] = (), column: str = "extra") -> DataFrame:
    """Add, rename and remove keys of the selected rows' metadata map; new values replace old ones."""
    flagged = member(df, chosen, "_chosen")
    m = F.coalesce(column, F.create_map().cast("map<string,string>"))
    gone = [*remove, *(add or {})]
    m = F.map_filter(m, lambda k, _: ~k.isin(*gone)) if gone else m
    if rename:
        taken = F.map_filter(m, lambda k, _: ~k.isin(*rename.values()) | k.isin(*rename))
        m = F.transform_keys(taken, lambda k, _: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in rename.items() for x in p)), k), k))
    if add:
        m = F.map_concat(m, F.create_map(*(F.lit(x) for k, v in add.items() for x in (k, parse_value(v)))))
    return flagged.withColumn(column, F.when(F.col("_chosen"), m).otherwise(F.col(column))).drop("_chosen")
