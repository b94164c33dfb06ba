"""Recursive-matrix random edges, as one Column expression a bit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwalk.functions.rng import portable_draw


def log2_up(n: int) -> int:
    return max(0, (n - 1).bit_length())


def rmat_edges(spark: SparkSession, edges: int, vertices: int, seed: int = 0, self_loops: bool = False, directed: bool = True, per_mille: tuple[int, int, int] = (500, 200, 100)) -> DataFrame:
    """Distinct (src, dst) over 2 ** (log2_up(vertices) - 1) ids.

    Each bit of the ends is drawn by the portable generator keyed by edge and
    bit; per_mille are the quadrants' weights, the fourth has the rest.
    """
    bits = max(0, log2_up(vertices) - 1)
    a, b, c = per_mille
    src = dst = F.lit(0).cast("long")
    for bit in range(bits):
        r = portable_draw(F.col("id") * 64 + bit, F.lit(bit + 1), seed) % 1000
        src = src + F.when(r >= a + b, F.lit(1 << bit)).otherwise(F.lit(0)).cast("long")
        dst = dst + F.when(((r >= a) & (r < a + b)) | (r >= a + b + c), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long")
    out = spark.range(edges).select(src.alias("src"), dst.alias("dst"))
    if not directed:
        out = out.unionByName(out.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return (out if self_loops else out.where("src <> dst")).distinct()
