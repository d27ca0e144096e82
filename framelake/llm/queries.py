"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.clusters import audit_points, similar_groups, similarity_clusters
from framelake.llm.leakage import leaks
from framelake.llm.packing import pack
from framelake.llm.quantiles import merge, percentiles, sketch
from framelake.llm.subjects import subject_shares
from framelake.llm.subset import config_key, varied_subsets
from framelake.runtime import read_table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each group of similar records with the group's smallest id."""
    return similar_groups(audit_points(read_table(spark, sf_dir, "audit_records")))


def p2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of bisecting k-means: size, centre and most typical members."""
    leaves, _ = similarity_clusters(audit_points(read_table(spark, sf_dir, "audit_records")))
    return leaves.select("leaf", "grp", "isolated", "elements", "n", "first_id", "centre", F.array_join("typical", ",").alias("typical"))


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of force and energy per config type and over all records, with their error bound."""
    fields = ["max_force", "energy_per_atom"]
    rows = read_table(spark, sf_dir, "audit_records").select("record_id", config_key(F.col("config_type")).alias("config_type"), *fields).dropDuplicates(["record_id"])
    parts = sketch(rows, "config_type", fields)
    per_type = merge(parts)
    # the sketch over all records is merged from those of the config types
    per_type = per_type.withColumn("scope", F.lit("config_type"))
    whole = merge(per_type.withColumn("part", F.pmod(F.xxhash64("grp"), F.lit(1024))).withColumn("grp", F.lit("*all*")).drop("scope"))
    at = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    one = percentiles(per_type.drop("scope"), fields, at).select(F.lit("config_type").alias("scope"), F.col("grp").alias("config_type"), "*").drop("grp")
    every = percentiles(whole, fields, at).select(F.lit("all").alias("scope"), F.lit(None).cast("string").alias("config_type"), "*").drop("grp")
    return one.unionByName(every)


def p4_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The varied subset of each request."""
    requests = [r.asDict() for r in read_table(spark, sf_dir, "fps_filter_params").select("params_id", "n_samples", "strategy", "source").collect()]
    return varied_subsets(read_table(spark, sf_dir, "audit_records"), requests)


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container, bin, document and piece, for each kind of container."""
    kinds = [(r["container"], r["capacity_tokens"]) for r in read_table(spark, sf_dir, "container_specs").collect()]
    return pack(read_table(spark, sf_dir, "documents"), kinds)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents larger than the container."""
    return p6_packing(spark, sf_dir).where((F.col("pieces") > 1) & (F.col("piece") == 0)).select("container", "doc_id")


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used and unused room by kind."""
    kinds = {r["container"]: r["capacity_tokens"] for r in read_table(spark, sf_dir, "container_specs").collect()}
    used = p6_packing(spark, sf_dir).groupBy("container").agg(F.count_distinct("bin").alias("bins"), F.sum("tokens").alias("tokens"))
    capacity = F.element_at(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv)), F.col("container"))
    return used.withColumn("filled", F.col("tokens") / (F.col("bins") * capacity))


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leaked passage, with its item and its place in the original text."""
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of an item."""
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each subject in each document."""
    areas = [(r["subject"], r["description"] or "") for r in read_table(spark, sf_dir, "subject_areas").orderBy("subject_id").collect()]
    return subject_shares(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "subject_labels"), areas)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects that take at least a quarter of a document's treating sentences."""
    return p8_shares(spark, sf_dir).where(F.col("share") >= 0.25).select("doc_id", "subject")


QUERIES = {
    "p2_found": p2_found, "p2_clusters": p2_clusters, "p3_percentiles": p3_percentiles, "p4_subsets": p4_subsets,
    "p6_found": p6_found, "p6_packing": p6_packing, "p6_fill": p6_fill,
    "p7_found": p7_found, "p7_leaks": p7_leaks, "p8_found": p8_found, "p8_shares": p8_shares,
}
ORACLE = {
    "p6_found": r"SELECT c.container, d.doc_id FROM documents d CROSS JOIN container_specs c WHERE len(regexp_extract_all(coalesce(d.text, ''), '[A-Za-z0-9]+|[^A-Za-z0-9 \t\r\n]')) > c.capacity_tokens",
}
