"""Numeric tables and settings that stand beside structure files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``source, block, seq, value``: lines of all files under ``path``; ``seq`` orders those of one block of a file.

    Files are split into blocks as Spark pleases; nothing depends on where.
    """
    lines = spark.read.text(path)
    return lines.select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value")


def row_numbers(lines: DataFrame) -> DataFrame:
    """``source, row, value``: lines numbered within their file, counting block by block."""
    sizes = lines.groupBy("source", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("source", "block", before.alias("before"))  # one row per block of a file
    local = F.row_number().over(Window.partitionBy("source", "block").orderBy("seq")) - 1
    return lines.withColumn("i", local).join(offsets, ["source", "block"]).select("source", (F.col("i") + F.col("before")).alias("row"), "value")


def read_out(spark: SparkSession, path: str) -> DataFrame:
    """``row, values`` of a numeric table such as ``energy.out``, in file order; blank lines and comments do not count."""
    lines = numbered_lines(spark, path)
    lines = lines.where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    return row_numbers(lines).select("row", F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double")).alias("values"))


def count_frames(spark: SparkSession, path: str) -> int:
    """Frames of an extended XYZ file: lines that hold nothing but a number."""
    return spark.read.text(path).where(F.col("value").rlike(r"^\s*\d+\s*$")).count()


def parse_settings(text: str) -> dict[str, str]:
    """``key value...`` lines of a settings file; what follows a ``#`` is no part of it, the last of repeated keys counts."""
    out = {}
    for line in text.splitlines():
        m = re.match(r"\s*([A-Za-z_]\w*)\s*=?\s*([^#]*)", line)
        if m and m[2].strip():
            out[m[1]] = m[2].strip()
    return out


def read_settings(spark: SparkSession, path: str) -> dict[str, str]:
    return parse_settings("\n".join(r[0] for r in spark.read.text(path).collect()))  # a settings file has some dozen lines


def full_batch(settings: dict[str, str], frames: int) -> bool:
    """Whether a training took all frames at once."""
    return int(settings.get("batch", "1000").split()[0]) >= frames
