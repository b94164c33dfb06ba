"""Sizes and timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def corpus_rows(edges: DataFrame, steps: DataFrame) -> DataFrame:
    """(part, n): rows of each part of a corpus."""
    counted = [("edges", edges.agg(F.count("*").alias("n"))), ("steps", steps.agg(F.count("*").alias("n"))), ("vertices", steps.agg(F.countDistinct("vertex").alias("n"))), ("walks", steps.agg(F.countDistinct("walk_id").alias("n")))]
    out = None
    for part, rows in counted:
        rows = rows.select(F.lit(part).alias("part"), "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def stored_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(part, files, bytes) of stored tables, a part for each folder below path; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    part = F.element_at(F.split("path", "/"), -2)
    return files.select(part.alias("part"), "length").groupBy("part").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
