"""Catalog of projects, model versions and tags as tables: search, trees, lineage, changes, import of packaged catalogs.

Tables are immutable; a change returns new tables and the caller writes them.
Names are compared after trimming and lower-casing.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from framelake.operators.hierarchy import hierarchy
from framelake.runtime import materialize


class CatalogError(ValueError):
    """A change or a packaged catalog that breaks the catalog's rules."""


def subtree(tree: DataFrame, root: int) -> DataFrame:
    """``id`` of the node and all its descendants, loops included, level by level: as many joins as levels."""
    edges = tree.select("id", F.expr("nullif(parent_id, 0)").alias("parent_id")).distinct()
    found = level = edges.where(F.col("id") == root).select("id").distinct()
    while level.limit(1).count():
        below = edges.join(level.select(F.col("id").alias("parent_id")), "parent_id").select("id").distinct()
        level = materialize(below.join(found, "id", "left_anti"), "catalog")
        found = materialize(found.union(level), "catalog")
    return found


def tagged(links: DataFrame, ids: Iterable[int], how: str) -> DataFrame:
    """``id`` of model versions that have any, or all, of the tags."""
    wanted = sorted(set(ids))
    rows = links.where(F.col("tag_id").isin(wanted)).select(F.col("model_version_id").alias("id"), "tag_id")
    if how == "any":
        return rows.select("id").distinct()
    return rows.groupBy("id").agg(F.count_distinct("tag_id").alias("n")).where(F.col("n") == len(wanted)).select("id")


def search_models(
    models: DataFrame, *, projects: DataFrame | None = None, project_id: int | None = None, with_subprojects: bool = False, links: DataFrame | None = None, parent: int | str | None = None,
    model_type: str | None = None, text: str | None = None, any_tags: Iterable[int] = (), all_tags: Iterable[int] = (), no_tags: Iterable[int] = (), newest_first: bool = True, offset: int = 0, limit: int | None = None,
) -> DataFrame:
    """Model versions that meet every given condition, by creation time, ties by id.

    ``parent``: an id, or ``none`` for versions without a parent; ``text`` stands anywhere in name or notes, whatever its case.
    """
    out = models.where("id IS NOT NULL").distinct()
    if project_id is not None:
        if with_subprojects:
            out = out.join(subtree(projects, project_id).select(F.col("id").alias("project_id")), "project_id", "left_semi")
        else:
            out = out.where(F.col("project_id") == project_id)
    if parent is not None:
        out = out.where(F.coalesce("parent_id", F.lit(0)) == 0) if parent == "none" else out.where(F.col("parent_id") == parent)
    if model_type:
        out = out.where(F.upper(F.trim("model_type")) == model_type.strip().upper())
    if text:
        found = [F.lower(F.coalesce(c, F.lit(""))).contains(text.lower()) for c in ("name", "notes")]
        out = out.where(found[0] | found[1])
    if list(any_tags):
        out = out.join(tagged(links, any_tags, "any"), "id", "left_semi")
    if list(all_tags):
        out = out.join(tagged(links, all_tags, "all"), "id", "left_semi")
    if list(no_tags):
        out = out.join(tagged(links, no_tags, "any"), "id", "left_anti")
    order = (F.desc_nulls_last if newest_first else F.asc_nulls_last)("created_at")
    out = out.orderBy(order, F.desc("id") if newest_first else F.asc("id")).offset(offset)
    return out if limit is None else out.limit(limit)


def trees(nodes: DataFrame) -> DataFrame:
    """Path, depth, root and status of every node of a parent table."""
    return hierarchy(nodes.select("id", "parent_id"))


def lineage(nodes: DataFrame, node: int) -> DataFrame:
    """``step, id`` from the node up to its root; nodes on or below a loop have no root and give nothing."""
    row = hierarchy(nodes.select("id", "parent_id")).where(F.col("node_id") == node)
    return row.select(F.posexplode(F.reverse("path")).alias("step", "id"))


def project_counts(projects: DataFrame, models: DataFrame) -> DataFrame:
    """``project_id, models, total``: versions of each project, and of its whole subtree."""
    own = models.select(F.col("id").alias("m"), "project_id").distinct().groupBy("project_id").agg(F.count("m").alias("models"))
    base = projects.select(F.col("id").alias("project_id")).where("project_id IS NOT NULL").distinct().join(own, "project_id", "left").select("project_id", F.coalesce("models", F.lit(0)).alias("models"))
    paths = hierarchy(projects.select("id", "parent_id")).where("path IS NOT NULL").select(F.col("node_id").alias("project_id"), F.explode("path").alias("above"))
    up = base.join(paths, "project_id").groupBy(F.col("above").alias("project_id")).agg(F.sum("models").alias("total"))
    return base.join(up, "project_id", "left").select("project_id", "models", F.coalesce("total", "models").alias("total"))


def _normal(name: str) -> str:
    return " ".join(name.split())


def _like(table: DataFrame, rows: list[tuple]) -> DataFrame:
    """Rows with a table's columns, any of which may be missing."""
    return table.sparkSession.createDataFrame(rows, StructType([StructField(f.name, f.dataType) for f in table.schema.fields]))


def add_row(table: DataFrame, row: dict, unique: str | None = "name") -> tuple[DataFrame, int]:
    """The table with a new row and its id; a name that is there already is an error."""
    if "name" in row:
        row = {**row, "name": _normal(row["name"] or "")}
        if not row["name"]:
            raise CatalogError("a name is needed")
        if unique and table.where(F.lower(F.trim(unique)) == row[unique].lower()).limit(1).count():
            raise CatalogError(f"{row[unique]!r} exists")
    new = row.get("id") or (table.agg(F.max("id")).first()[0] or 0) + 1
    one = _like(table, [tuple({**row, "id": new}.get(c) for c in table.columns)])
    return table.unionByName(one), new


def modify_row(table: DataFrame, row_id: int, changes: dict) -> DataFrame:
    """The table with new values in one row; the id stays."""
    here = F.col("id") == row_id
    kinds = dict(table.dtypes)
    return table.select(*(F.when(here, F.lit(changes[c]).cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in changes and c != "id" else F.col(c) for c in table.columns))


def remove_project(projects: DataFrame, models: DataFrame, links: DataFrame, project_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three tables without the project, its subprojects, their versions and the versions' tags."""
    gone = subtree(projects, project_id)
    versions = models.join(gone.select(F.col("id").alias("project_id")), "project_id", "left_semi").select("id")
    return (
        projects.join(gone, "id", "left_anti"), models.join(versions, "id", "left_anti"),
        links.join(versions.select(F.col("id").alias("model_version_id")), "model_version_id", "left_anti"),
    )


def remove_model(models: DataFrame, links: DataFrame, model_id: int) -> tuple[DataFrame, DataFrame]:
    """Tables without a version; its children lose their parent."""
    kept = models.where(F.coalesce("id", F.lit(-1)) != model_id)
    parent = F.when(F.col("parent_id") == model_id, None).otherwise(F.col("parent_id"))
    return kept.withColumn("parent_id", parent.cast(dict(models.dtypes)["parent_id"])), links.where(F.col("model_version_id") != model_id)


def tag_models(tags: DataFrame, links: DataFrame, model_id: int, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Give a version exactly these tags; unknown names become new tags."""
    wanted = list({_normal(n).lower(): _normal(n) for n in reversed(names) if n.strip()}.values())
    known = {r["name"].lower(): r["id"] for r in tags.where(F.lower("name").isin([w.lower() for w in wanted])).select("name", "id").collect()}
    for w in wanted:
        if w.lower() not in known:
            tags, known[w.lower()] = add_row(tags, {"name": w})
    kept = links.where(F.col("model_version_id") != model_id)
    rows = [tuple({"model_version_id": model_id, "tag_id": known[w.lower()]}.get(c) for c in links.columns) for w in wanted]
    return tags, kept.unionByName(_like(links, rows)) if rows else kept


def remove_tag(tags: DataFrame, links: DataFrame, tag_id: int) -> tuple[DataFrame, DataFrame]:
    return tags.where(F.col("id") != tag_id), links.where(F.col("tag_id") != tag_id)


def parse_catalog(text: str, version: int = 1) -> dict:
    """A packaged catalog: unique ids, parents that exist, required texts; anything else is an error."""
    try:
        data = json.loads(text)
    except ValueError as e:
        raise CatalogError(f"no JSON: {e}") from e
    if not isinstance(data, dict) or data.get("schema_version") != version:
        raise CatalogError("unsupported schema version")
    for name, kind in (("project", dict), ("source", dict), ("models", list)):
        if not isinstance(data.get(name), kind):
            raise CatalogError(f"{name} is missing or of the wrong kind")
    required = [(data, k, "catalog") for k in ("catalog_id", "catalog_version")] + [(data["project"], "name", "project")]
    ids: set[int] = set()
    for i, m in enumerate(data["models"]):
        if not isinstance(m, dict) or not isinstance(m.get("id"), int) or m["id"] < 0 or m["id"] in ids or not isinstance(m.get("tags", []), list):
            raise CatalogError(f"models[{i}] has no unique id or malformed tags")
        ids.add(m["id"])
        required += [(m, k, f"models[{i}]") for k in ("name", "model_type", "model_path")]
    for holder, key, where in required:
        if not isinstance(holder.get(key), str) or not holder[key].strip():
            raise CatalogError(f"{where} needs {key}")
    for m in data["models"]:
        parent = m.get("parent_id")
        if parent is not None and (parent not in ids or parent == m["id"]):
            raise CatalogError(f"model {m['id']} has no valid parent")
    return data


def load_catalog(spark: SparkSession, path: str) -> dict:
    return parse_catalog(spark.read.text(path, wholetext=True).first()[0])


def import_catalog(catalog: dict, projects: DataFrame, models: DataFrame) -> tuple[DataFrame, DataFrame, dict[int, int]]:
    """Tables with the catalog's project and models, and the new id of each; parents come before children, a loop is an error."""
    projects, project = add_row(projects, {"name": catalog["project"]["name"], "notes": f"{catalog['catalog_id']} {catalog['catalog_version']}. {catalog['project'].get('notes') or ''}".strip()})
    left, order, done = list(catalog["models"]), [], set()
    while left:
        ready = [m for m in left if m.get("parent_id") is None or m["parent_id"] in done]
        if not ready:
            raise CatalogError(f"parents form a loop: {sorted(m['id'] for m in left)}")
        order += ready
        done |= {m["id"] for m in ready}
        left = [m for m in left if m["id"] not in done]
    first = (models.agg(F.max("id")).first()[0] or 0) + 1
    new = {m["id"]: first + i for i, m in enumerate(order)}
    rows = []
    for m in order:
        row = {**m, "id": new[m["id"]], "project_id": project, "parent_id": new.get(m.get("parent_id"))}
        rows.append(tuple(float(row.get(c) or 0) if c in ("energy", "force", "virial") else row.get(c) for c in models.columns))
    return projects, models.unionByName(_like(models, rows)) if rows else models, new


def version_metrics(spark: SparkSession, folder: str) -> dict:
    """Frames and root mean square errors (times 1,000) of a training folder's files."""
    from framelake.operators.audit import rmse  # noqa: PLC0415
    from framelake.sources.tables import count_frames, read_out  # noqa: PLC0415

    out: dict = {"data_size": count_frames(spark, f"{folder}/train.xyz")}
    for name, n in (("energy", 1), ("force", 3), ("virial", 6)):
        rows = read_out(spark, f"{folder}/{name}_train.out")
        out[name] = rmse(rows, F.slice("values", 1, n), F.slice("values", n + 1, n), scale=1000.0).first()[0]
    return out

