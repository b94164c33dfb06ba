"""Graphs derived from the star-schema tables, and their edge batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    return items.join(orders, items.l_orderkey == orders.o_orderkey)


def mirrored(pairs: DataFrame) -> DataFrame:
    """Both directions of (a, b), without repeats and self-loops; extra columns are dropped.

    Repeats are dropped from the pairs in one order: half the rows are shuffled.
    """
    once = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ends = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return once.select(ends.alias("e")).select("e.src", "e.dst")


def bipartite_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers at even ids, the parts they ordered at odd ids."""
    return mirrored(_lines(spark, sf_dir).select((F.col("o_custkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b")))


def tripartite_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, at, flag): customer-part, part-supplier and customer-supplier pairs of each order line."""
    lines = _lines(spark, sf_dir)
    c, p, s = F.col("o_custkey") * 3, F.col("l_partkey") * 3 + 1, F.col("l_suppkey") * 3 + 2
    ends = F.explode(F.array(*(F.struct(x.alias("a"), y.alias("b")) for x, y in ((c, p), (p, s), (c, s)))))
    return lines.select(ends.alias("e"), F.col("o_orderdate").alias("at"), F.col("l_returnflag").alias("flag")).select("e.a", "e.b", "at", "flag")


def tripartite_edges(spark: SparkSession, sf_dir: str, before: str | None = None) -> DataFrame:
    pairs = tripartite_pairs(spark, sf_dir)
    return mirrored(pairs.where(F.col("at") < F.lit(before).cast("timestamp")) if before else pairs)


def month_batch(spark: SparkSession, sf_dir: str, month: int, returned_only: bool = False) -> DataFrame:
    """Edges of a month of 2001: the batch to insert, or with returned_only the batch to delete."""
    start = F.lit(f"2001-{month:02d}-01").cast("timestamp")
    pairs = tripartite_pairs(spark, sf_dir).where((F.col("at") >= start) & (F.col("at") < F.add_months(start.cast("date"), 1).cast("timestamp")))
    return mirrored(pairs.where("flag = 'R'") if returned_only else pairs)
