"""Queries of the core problems: spikes in measurements and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators.hierarchy import all_descendants, descendants, hierarchy
from framelake.operators.spikes import AUDIT_FIELDS, implausible_readings
from framelake.runtime import read_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading that cannot be right for its source."""
    cases, _ = implausible_readings(read_table(spark, sf_dir, "audit_records"), AUDIT_FIELDS)
    return cases.where("reason <> 'off_profile'").select("record_id", "field")


def p1_profile_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings far off their source's daily profile: the sparse part of the robust components."""
    cases, _ = implausible_readings(read_table(spark, sf_dir, "audit_records"), AUDIT_FIELDS)
    return cases.where("reason = 'off_profile'").select("record_id", "field", "value", "normal")


def p1_ordinary_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range of ordinary readings of each source and field."""
    return implausible_readings(read_table(spark, sf_dir, "audit_records"), AUDIT_FIELDS)[1]


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda table, tree: read_table(spark, sf_dir, table).select("id", "parent_id", F.lit(tree).alias("tree"))
    return one("projects", "project").unionByName(one("model_versions", "model_version"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that are their own ancestor."""
    nodes = hierarchy(_trees(spark, sf_dir), tree=F.col("tree"), paths=False)
    return nodes.where(F.col("status") == "on_loop").select("tree", "node_id")


def p5_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, depth, root, number of descendants and status of every node."""
    nodes = hierarchy(_trees(spark, sf_dir), tree=F.col("tree"))
    return nodes.withColumn("path", F.when(F.col("path").isNotNull(), F.array_join("path", "/")))


def p5_contracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p5_hierarchy, by contraction to the end: no rest is finished in one task, whatever the size."""
    nodes = hierarchy(_trees(spark, sf_dir), tree=F.col("tree"), finish_rows=0)
    return nodes.withColumn("path", F.when(F.col("path").isNotNull(), F.array_join("path", "/")))


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of ancestor and descendant with its distance."""
    return descendants(hierarchy(_trees(spark, sf_dir), tree=F.col("tree")))


def p5_all_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of ancestor and descendant with its shortest distance, on and below loops too."""
    return all_descendants(_trees(spark, sf_dir), tree=F.col("tree"))


QUERIES = {"p1_found": p1_found, "p1_ordinary_ranges": p1_ordinary_ranges, "p1_profile_spikes": p1_profile_spikes, "p5_contracted": p5_contracted, "p5_found": p5_found, "p5_hierarchy": p5_hierarchy, "p5_descendants": p5_descendants, "p5_all_descendants": p5_all_descendants}

_EDGES = """
n AS (SELECT tree, id, min(nullif(parent_id, 0)) AS p FROM (
        SELECT 'project' AS tree, id, parent_id FROM projects UNION ALL SELECT 'model_version', id, parent_id FROM model_versions) t
      WHERE id IS NOT NULL GROUP BY tree, id),
e AS (SELECT a.tree, a.id, b.id AS p FROM n a LEFT JOIN n b ON a.tree = b.tree AND a.p = b.id),
"""
_DOWN = "d AS (SELECT tree, id, id AS root, 0::BIGINT AS depth, id::VARCHAR AS path FROM e WHERE p IS NULL UNION ALL SELECT e.tree, e.id, d.root, d.depth + 1, d.path || '/' || e.id::VARCHAR FROM d JOIN e ON e.tree = d.tree AND e.p = d.id)"
_REACH = "r AS (SELECT tree, id AS s, p AS c FROM e WHERE p IS NOT NULL UNION SELECT r.tree, r.s, e.p FROM r JOIN e ON e.tree = r.tree AND e.id = r.c WHERE e.p IS NOT NULL)"
ORACLE = {
    "p5_found": f"WITH RECURSIVE {_EDGES} {_REACH} SELECT tree, s AS node_id FROM r WHERE s = c",
    "p5_hierarchy": f"""WITH RECURSIVE {_EDGES} {_DOWN}, {_REACH},
        l AS (SELECT tree, s AS id FROM r WHERE s = c),
        k AS (SELECT tree, c AS id, count(*) AS n FROM r WHERE s <> c GROUP BY tree, c)
        SELECT e.tree, e.id AS node_id, d.root AS root_id, d.depth, CASE WHEN l.id IS NULL THEN coalesce(k.n, 0) END AS n_descendants,
               CASE WHEN l.id IS NOT NULL THEN 'on_loop' WHEN d.id IS NULL THEN 'below_loop' ELSE 'tree' END AS status, d.path
        FROM e LEFT JOIN d ON e.tree = d.tree AND e.id = d.id LEFT JOIN l ON e.tree = l.tree AND e.id = l.id
        LEFT JOIN k ON e.tree = k.tree AND e.id = k.id""",
    "p5_descendants": f"""WITH RECURSIVE {_EDGES} {_DOWN},
        u AS (SELECT tree, id, p AS a, 1::BIGINT AS distance FROM e WHERE p IS NOT NULL AND (tree, id) IN (SELECT (tree, id) FROM d)
              UNION ALL SELECT u.tree, u.id, e.p, u.distance + 1 FROM u JOIN e ON e.tree = u.tree AND e.id = u.a WHERE e.p IS NOT NULL)
        SELECT tree, a AS ancestor_id, id AS descendant_id, distance FROM u""",
    "p5_all_descendants": f"""WITH RECURSIVE {_EDGES}
        w AS (SELECT tree, id, p AS a, 1::BIGINT AS distance, [p] AS seen FROM e WHERE p IS NOT NULL
              UNION ALL SELECT w.tree, w.id, e.p, w.distance + 1, list_append(w.seen, e.p) FROM w JOIN e ON e.tree = w.tree AND e.id = w.a WHERE e.p IS NOT NULL AND NOT list_contains(w.seen, e.p))
        SELECT tree, a AS ancestor_id, id AS descendant_id, distance FROM w""",
}
ORACLE["p5_contracted"] = ORACLE["p5_hierarchy"]
