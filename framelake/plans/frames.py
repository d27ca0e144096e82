"""Structures built from the relational test tables, in Spark and in SQL.

Orders are structures and order lines their atoms.  Cells, coordinates, species
and labels are arithmetic on the keys, written the same way on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPECIES = ["H", "C", "O", "Fe", "Ni"]
RADII = [0.31, 0.76, 0.66, 1.32, 1.24]
TAGS = ["bulk", "surface", "bulk|strain", " ", "liquid melt"]

#: Common table expressions: ``cells`` and ``atoms``.
SQL = """
cells AS (SELECT o_orderkey AS sid, 4.0::DOUBLE + (o_custkey % 7) * 0.5::DOUBLE AS a, 4.3::DOUBLE + (o_custkey % 5) * 0.6::DOUBLE AS b, 4.1::DOUBLE + (o_custkey % 3) * 0.7::DOUBLE AS c, (o_orderkey % 3) * 0.4::DOUBLE AS t,
    o_orderkey % 4 <> 0 AS px, TRUE AS py, o_orderkey % 5 <> 0 AS pz, o_totalprice / -1000.0 AS energy, ['bulk', 'surface', 'bulk|strain', ' ', 'liquid melt'][1 + CAST(o_custkey % 5 AS INT)] AS tag FROM orders),
lines AS (SELECT l_orderkey AS sid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS k,
    (l_partkey % 97) / 97.0 AS f1, (l_suppkey % 89) / 89.0 AS f2, ((l_partkey * 7 + l_linenumber * 13) % 83) / 83.0 AS f3, CAST(l_partkey % 5 AS INT) AS e,
    l_discount * 10 - 0.5 AS fx, l_tax * 10 - 0.4 AS fy, l_quantity / 25 - 1 AS fz FROM lineitem),
atoms AS (SELECT l.sid, k, ['H', 'C', 'O', 'Fe', 'Ni'][e + 1] AS el, [0.31, 0.76, 0.66, 1.32, 1.24][e + 1] AS r,
    f1 * a + f2 * t AS x, f2 * b + f3 * t AS y, f3 * c AS z, fx, fy, fz, a, b, c, t, px, py, pz FROM lines l JOIN cells USING (sid))"""

#: All pairs of atoms and images up to 3.0137, distances in ``d``.
PAIRS = (
    SQL
    + """,
shift AS (SELECT i, j, k FROM (VALUES (-1), (0), (1)) p(i), (VALUES (-1), (0), (1)) q(j), (VALUES (-1), (0), (1)) s(k)),
pairs AS (SELECT * FROM (SELECT p.sid, p.k AS i, q.k AS j, p.el AS ei, q.el AS ej, p.r AS ri, q.r AS rj,
      sqrt(power(q.x - p.x + s.i * p.a + s.j * p.t, 2) + power(q.y - p.y + s.j * p.b + s.k * p.t, 2) + power(q.z - p.z + s.k * p.c, 2)) AS d
    FROM atoms p JOIN atoms q USING (sid) CROSS JOIN shift s
    WHERE (s.i = 0 OR p.px) AND (s.j = 0 OR p.py) AND (s.k = 0 OR p.pz) AND NOT (p.k = q.k AND s.i = 0 AND s.j = 0 AND s.k = 0)) t WHERE d <= 3.0137)"""
)

#: The same structures with faults, as ``dirty``: empty lists, wrong shapes, non-finite values and repeated geometries.
DIRTY = (
    SQL
    + """,
frames AS (SELECT c.sid, coalesce(list(el ORDER BY k) FILTER (WHERE el IS NOT NULL), []) AS species, coalesce(list([x, y, z] ORDER BY k) FILTER (WHERE el IS NOT NULL), []) AS pos,
    coalesce(list([fx, fy, fz] ORDER BY k) FILTER (WHERE el IS NOT NULL), []) AS forces, any_value(c.a) AS a, any_value(c.b) AS b, any_value(c.c) AS c, any_value(c.t) AS t,
    any_value(c.px) AS px, any_value(c.py) AS py, any_value(c.pz) AS pz, any_value(energy) AS energy FROM cells c LEFT JOIN atoms a ON a.sid = c.sid GROUP BY c.sid)"""
)


def frames(t) -> DataFrame:
    """Nested structures: one row per order, atoms in order of their lines; orders without lines are empty."""
    o, li = t("orders"), t("lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = li.select(
        F.col("l_orderkey").alias("structure_id"), F.row_number().over(order).alias("k"), ((F.col("l_partkey") % 97).cast("double") / 97.0).alias("f1"),
        ((F.col("l_suppkey") % 89).cast("double") / 89.0).alias("f2"), (((F.col("l_partkey") * 7 + F.col("l_linenumber") * 13) % 83).cast("double") / 83.0).alias("f3"),
        F.element_at(F.array(*map(F.lit, SPECIES)), (F.col("l_partkey") % 5).cast("int") + 1).alias("el"),
        F.array(F.col("l_discount") * 10 - 0.5, F.col("l_tax") * 10 - 0.4, F.col("l_quantity") / 25 - 1).alias("force"),
    )
    held = lines.groupBy("structure_id").agg(F.array_sort(F.collect_list(F.struct("k", "el", "f1", "f2", "f3", "force"))).alias("atoms"))
    cells = o.select(
        F.col("o_orderkey").alias("structure_id"), (4.0 + (F.col("o_custkey") % 7) * 0.5).alias("a"), (4.3 + (F.col("o_custkey") % 5) * 0.6).alias("b"), (4.1 + (F.col("o_custkey") % 3) * 0.7).alias("c"),
        ((F.col("o_orderkey") % 3) * 0.4).alias("t"), F.array(F.col("o_orderkey") % 4 != 0, F.lit(True), F.col("o_orderkey") % 5 != 0).alias("pbc"), (F.col("o_totalprice") / -1000.0).alias("energy"),
        F.element_at(F.array(*map(F.lit, TAGS)), (F.col("o_custkey") % 5).cast("int") + 1).alias("config_type"),
    )
    both = cells.join(held, "structure_id", "left").withColumn("atoms", F.coalesce("atoms", F.array().cast(dict(held.dtypes)["atoms"])))
    zero = F.lit(0.0)
    return both.select(
        "structure_id", F.transform("atoms", lambda x: x["el"]).alias("species"),
        F.transform("atoms", lambda x: F.array(x["f1"] * F.col("a") + x["f2"] * F.col("t"), x["f2"] * F.col("b") + x["f3"] * F.col("t"), x["f3"] * F.col("c"))).alias("pos"),
        F.array(F.array("a", zero, zero), F.array("t", F.col("b"), zero), F.array(zero, F.col("t"), F.col("c"))).alias("lattice"), "pbc", "energy",
        F.transform("atoms", lambda x: x["force"]).alias("forces"),
        F.array(*(F.col("energy") * w for w in (0.1, 0.2, 0.3, 0.01, 0.02, 0.03))).alias("virial"), "config_type",
    )


def dirty(t) -> DataFrame:
    """The structures with faults, and every fiftieth once more under another id, some with other labels."""
    f, s = frames(t), F.col("structure_id")
    every = lambda n: s % n == 0
    nan = float("nan")
    f = f.withColumn("energy", F.when(every(101), nan).when(every(103), None).otherwise(F.col("energy")))
    f = f.withColumn("forces", F.when(every(107), F.slice("forces", F.lit(1), F.greatest(F.size("forces") - 1, F.lit(0)))).otherwise(F.col("forces")))
    f = f.withColumn("virial", F.when(every(109), F.slice("virial", 1, 5)).otherwise(F.col("virial")))
    f = f.withColumn("pbc", F.when(every(113), None).when(every(127), F.array(F.lit(True), F.lit(False))).otherwise(F.col("pbc")))
    f = f.withColumn("lattice", F.when(every(131), F.array(F.array(*[F.lit(0.0)] * 3), F.col("lattice")[1], F.col("lattice")[2])).otherwise(F.col("lattice")))
    f = f.withColumn("pos", F.when(every(137), F.transform("pos", lambda p, i: F.when(i == 0, F.array(F.lit(nan), p[1], p[2])).otherwise(p))).otherwise(F.col("pos")))
    f = f.withColumn("species", F.when(every(139), F.transform("species", lambda e, i: F.when(i == 0, "Xx").otherwise(e))).otherwise(F.col("species")))
    again = f.where(every(50)).withColumn("energy", F.col("energy") + (s % 3) * 4e-5).withColumn("structure_id", s + 10_000_000)
    return f.unionByName(again)
