import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwalk.llm import topk_search


def vectors(spark, scale=1.0, n=400):
    rng = np.random.default_rng(3)
    return spark.createDataFrame([(i, (scale * rng.normal(size=6)).tolist()) for i in range(n)], "vec_id long, embedding array<double>")


def test_waves_of_queries_give_the_same_rows(spark, monkeypatch):
    df = vectors(spark)
    want = sorted(map(tuple, topk_search.top_k(df, F.col("vec_id") % 2 == 0, k=7).collect()))
    assert len(want) == 1400
    for name, size in (("WAVE_BYTES", 1000), ("CANDIDATES", 50), ("QUERIES", 16)):
        monkeypatch.setattr(topk_search, name, size)
    assert sorted(map(tuple, topk_search.top_k(df, F.col("vec_id") % 2 == 0, k=7).collect())) == want


def test_scores_beyond_63_bits_raise(spark):
    with pytest.raises(Exception, match="63 bits"):
        topk_search.top_k(vectors(spark, 1e9, 40), F.col("vec_id") % 2 == 0).collect()


def test_plan_has_no_join(spark):
    plan = topk_search.top_k(vectors(spark), F.col("vec_id") % 20 == 0)._jdf.queryExecution().toString()
    assert "Join" not in plan and "Cartesian" not in plan
