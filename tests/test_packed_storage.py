"""What is kept in the shared folder between steps."""

import os

from driftwalk.operators import walks
from driftwalk.plans.materialise import cut, shared_dir, stored


def held(spark):
    top = shared_dir(spark).removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names)


def test_cut_packs_its_rows(spark):
    """A step takes a few bytes, not its five columns as they are."""
    steps = spark.range(50_000).selectExpr("id div 5 AS walk_id", "cast(id % 5 AS int) AS pos", "id * 7919 % 50000 AS vertex", "id * 104729 % 50000 AS next", "0 AS batch")
    before = held(spark)
    kept = cut(steps)
    assert held(spark) - before < 50_000 * 12
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, steps.collect()))
    assert cut(steps.limit(0)).columns == steps.columns and cut(steps.limit(0)).isEmpty()


def test_graph_keeps_edges_packed(spark):
    """Edges and neighbor lists of a graph take less than its edges in plain files."""
    pairs = spark.range(60_000).selectExpr("id * 7919 % 3001 AS src", "(id * 104729 + 17) % 2999 AS dst").distinct()
    before = held(spark)
    stored(pairs, "plain")
    plain, before = held(spark) - before, held(spark)
    graph = walks.WalkGraph(pairs)
    assert held(spark) - before < plain
    assert sorted(map(tuple, graph.edges.collect())) == sorted(map(tuple, pairs.collect()))
