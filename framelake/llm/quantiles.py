"""Percentiles per group by deterministic buffer collapsing.

A sketch of one group is a set of sorted buffers of ``size`` values; a buffer of
level ``l`` stands for ``size * 2**l`` values.  Two buffers of a level collapse
into one of the next by merging and keeping every second position, odd and even
in turn.  A collapse at level ``l`` moves the rank of any value by at most
``2**l``; these are added up, so each result states its own error bound.  A last
short buffer stays exact.  Sketches are rows (one per buffer) and merge with
those of other partitions, files or days: within a task per partition, then in
rounds of ``fan_in`` partial sketches, so no task sees more than that many.

Defined results: null, NaN and infinite values are left out and counted in
neither ``n`` nor ranks; a null group is a group; an empty table gives no rows.
The error is at most ``levels / (2 * size)`` of ``n``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.runtime import materialize

_SCHEMA = "grp string, field int, part bigint, level int, error bigint, buffer array<double>"
_FIELDS = pa.schema([("grp", pa.string()), ("field", pa.int32()), ("part", pa.int64()), ("level", pa.int32()), ("error", pa.int64()), ("buffer", pa.list_(pa.float64()))])
CHUNK = 131_072


class Buffers:
    """The buffers of one group."""

    __slots__ = ("size", "loose", "count", "full", "turn", "error")

    def __init__(self, size: int) -> None:
        self.size, self.loose, self.count = size, [], 0
        self.full: dict[int, np.ndarray] = {}
        self.turn: dict[int, int] = {}
        self.error = 0

    def add(self, values: np.ndarray) -> None:
        """Take values of weight one."""
        self.loose.append(values)
        self.count += len(values)
        if self.count >= self.size:
            x = np.sort(np.concatenate(self.loose))
            whole = len(x) // self.size
            # interleaved, so each buffer covers the whole range
            for i in range(whole):
                self.push(0, x[: whole * self.size][i::whole])
            self.loose = [x[whole * self.size :]]
            self.count = len(self.loose[0])

    def push(self, level: int, buffer: np.ndarray) -> None:
        """Take a full buffer, collapsing as long as its level holds one already."""
        while (other := self.full.pop(level, None)) is not None:
            odd = self.turn[level] = 1 - self.turn.get(level, 1)
            merged = np.concatenate([other, buffer])
            merged.sort(kind="stable")
            buffer, self.error, level = merged[odd::2], self.error + (1 << level), level + 1
        self.full[level] = buffer

    def rows(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(level, error, buffer); level -1 is the short exact one."""
        error = self.error
        for level, buffer in sorted(self.full.items()):
            yield level, error, buffer
            error = 0
        if self.count or error:
            yield -1, error, np.sort(np.concatenate(self.loose)) if self.loose else np.empty(0)


def _table(states: dict[tuple[str | None, int], Buffers], part: int) -> pa.Table:
    flat = [(g, f, part, level, error, buffer) for (g, f), s in states.items() for level, error, buffer in s.rows()]
    cols = list(zip(*flat)) or [[]] * 6
    return pa.table([pa.array(c, t.type) for c, t in zip(cols, _FIELDS)], schema=_FIELDS)


def _sketch(size: int, fields: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple[str | None, int], Buffers] = {}

        def take(held: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(held)
            coded = t["grp"].combine_chunks().dictionary_encode()
            names, codes = [*coded.dictionary.to_pylist(), None], coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
            for f in range(fields):
                v = t[f"f{f}"].to_numpy()
                ok = np.isfinite(v)
                c, v = codes[ok], v[ok]
                order = np.argsort(c, kind="stable")
                c, v = c[order], v[order]
                at = np.r_[0, np.flatnonzero(np.diff(c)) + 1, len(c)] if len(c) else [0]
                for i, j in zip(at[:-1], at[1:]):
                    states.setdefault((names[c[i]], f), Buffers(size)).add(v[i:j])

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= CHUNK:
                take(held)
                held, n = [], 0
        if held:
            take(held)
        yield from _table(states, TaskContext.get().partitionId()).to_batches()

    return run


def _merge(size: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        grp, field, part = (k.as_py() for k in key)
        out = Buffers(size)
        levels, errors, buffers = t["level"].to_pylist(), t["error"].to_pylist(), t["buffer"]
        out.error = sum(errors)
        for i in sorted(range(len(levels)), key=lambda i: levels[i]):
            b = buffers[i].values.to_numpy()
            if levels[i] < 0:
                out.add(b)
            else:
                out.push(levels[i], b)
        return _table({(grp, field): out}, part)

    return run


def sketch(df: DataFrame, grp: str, fields: list[str], size: int = 2048) -> DataFrame:
    """One sketch per partition and group of ``df``; merge with :func:`merge`."""
    rows = df.select(F.col(grp).cast("string").alias("grp"), *(F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(float("nan"))).alias(f"f{k}") for k, f in enumerate(fields)))
    return rows.mapInArrow(_sketch(size, len(fields)), _SCHEMA)


def merge(sketches: DataFrame, size: int = 2048, fan_in: int = 32) -> DataFrame:
    """One sketch per group, from any sketches of the same size; ``part`` tells them apart."""
    held = materialize(sketches, "sketches")
    parts = (held.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = -(-parts // fan_in)
        held = held.withColumn("part", F.floor(F.col("part") / fan_in)).groupBy("grp", "field", "part").applyInArrow(_merge(size), _SCHEMA)
        if parts == 1:
            return held


def percentiles(sketches: DataFrame, fields: list[str], at: list[float]) -> DataFrame:
    """``grp, field, n, rank_error`` and a column per percentile from merged sketches."""
    names = [f"p{round(p * 100):02d}" for p in at]

    def read(key: tuple, t: pa.Table) -> pa.Table:
        values = np.concatenate([np.empty(0), *(b.values.to_numpy() for b in t["buffer"])])
        weights = np.concatenate([np.empty(0, np.int64), *(np.full(len(b.values), 1 << max(level, 0)) for b, level in zip(t["buffer"], t["level"].to_pylist()))])
        order = np.argsort(values, kind="stable")
        cum = np.cumsum(weights[order])
        n = int(cum[-1]) if len(cum) else 0
        row = {"grp": key[0].as_py(), "field": fields[key[1].as_py()], "n": n, "rank_error": sum(t["error"].to_pylist()) / n if n else 0.0}
        for name, p in zip(names, at):
            row[name] = float(values[order][np.searchsorted(cum, max(1, np.ceil(p * n)))]) if n else None
        return pa.Table.from_pylist([row], schema=pa.schema([("grp", pa.string()), ("field", pa.string()), ("n", pa.int64()), ("rank_error", pa.float64()), *((m, pa.float64()) for m in names)]))

    return sketches.groupBy("grp", "field").applyInArrow(read, "grp string, field string, n bigint, rank_error double, " + ", ".join(f"{m} double" for m in names))
