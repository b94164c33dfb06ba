"""What the operators share: reading columns, worker caches, folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwalk.plans.materialise import folder, stored


def two_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone: other columns can't clash with an operator's own."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def staging(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return folder(spark, f"llm-{name}")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: computed once, safe from lost executors."""
    return stored(df, f"llm-{name}")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def runs(batch, column: str, most: int, each: int = 1):
    """Slices of an Arrow batch whose texts have about `most` bytes each, a row counting `each` besides.

    A longer text is one alone: lists of Python values stay bounded.
    """
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + each
    block = (np.cumsum(sizes) - sizes) // most
    cuts = np.flatnonzero(np.diff(block, prepend=-1)).tolist()
    for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)
