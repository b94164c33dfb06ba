"""Triangles on edges against brute force, whatever the number of groups; shuffle files go with what made them."""

import random

import numpy as np
import pytest

from driftwalk.operators import triangles


def graph_of(n: int, m: int, base: int, seed: int = 3) -> set[tuple[int, int]]:
    rng = random.Random(seed)
    pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)} | {(0, k) for k in range(1, n)}  # a hub
    return {(base + a, base + b) for x, y in pairs if x != y for a, b in ((x, y), (y, x))}


@pytest.mark.parametrize("groups, base", [(1, 0), (2, 0), (4, 0), (5, 1 << 40)])
def test_common_neighbors_of_each_edge(spark, monkeypatch, groups, base):
    edges = graph_of(40, 120, base)
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    df = spark.createDataFrame(sorted(edges), "src long, dst long")
    got = {(r.src, r.dst): (r.common, r.degree) for r in triangles.edge_triangles(df, with_degree=True, groups=groups).collect()}
    assert got == {(a, b): (len(near[a] & near[b]), len(near[b])) for a, b in edges}
    plain = triangles.edge_triangles(df, groups=groups).collect()
    assert len(plain) == len(edges) and {(r.src, r.dst): r.common for r in plain} == {k: v[0] for k, v in got.items()}


def test_wedges_are_cut_into_blocks(monkeypatch):
    edges = np.array(sorted((a, b) for a, b in graph_of(60, 400, 0) if a < b)).T
    whole = triangles.on_edges(*edges)
    monkeypatch.setattr(triangles, "WEDGES", 7)
    assert whole.sum() > 0 and (triangles.on_edges(*edges) == whole).all()


def test_no_edges(spark):
    assert triangles.edge_triangles(spark.createDataFrame([], "src long, dst long"), with_degree=True).count() == 0


def test_rows_don_t_grow_with_wedges(spark):
    """A star of n leaves has n * n wedges; the plan has no join that makes them."""
    star = spark.createDataFrame([p for k in range(1, 2000) for p in ((0, k), (k, 0))], "src long, dst long")
    found = triangles.edge_triangles(star)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.where("common <> 0").isEmpty() and found.count() == 2 * 1999


def test_stored_leaves_no_shuffle_files(spark, tmp_path):
    from driftwalk.plans.materialise import DROP_SHUFFLES, cut, stored

    where = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: where.getAllFiles().mkString("\n").count("/shuffle_")
    made, before = spark.range(1000).repartition(3, "id"), held()
    one, two = stored(made, "dropped"), cut(made)
    assert held() <= before and spark.conf.get(DROP_SHUFFLES, None) is None
    assert one.count() == two.count() == 1000


def test_weights_of_states_need_no_row_for_each_candidate(spark):
    from driftwalk.queries import QUERIES

    plan = QUERIES["node2vec_weights"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
