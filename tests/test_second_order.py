"""Exact second-order choices from packed lists against brute force: hubs, large ids, previous vertices that are no neighbors."""

import numpy as np
import pytest

from driftwalk.operators import second_order
from driftwalk.operators.walks import WalkGraph
from tests.test_neighbors import hub_edges

BACK, NEAR, FAR = 4, 2, 1


def chosen(neighbors, cur, prev, draw):
    options = sorted(neighbors[cur])
    weights = [BACK if v == prev else NEAR if v in neighbors.get(prev, ()) else FAR for v in options]
    target = draw % sum(weights)
    return options[int(np.searchsorted(np.cumsum(weights), target, side="right"))]


@pytest.mark.parametrize("base, spread, packed", [(0, 50_000, 1_000_000), (0, 20, 50), (1 << 33, 20, 1000)])
def test_choices_are_those_of_brute_force(spark, monkeypatch, base, spread, packed):
    monkeypatch.setattr(second_order, "SPREAD", spread)
    monkeypatch.setattr(second_order, "PACKED", packed)
    edges = hub_edges(spark, base)
    neighbors = {}
    for r in edges.collect():
        neighbors.setdefault(r.src, set()).add(r.dst)
    ids, rng = sorted(neighbors), np.random.default_rng(5)
    asked = []
    for walk in range(3000):
        cur = int(ids[rng.integers(len(ids))])
        near = sorted(neighbors[cur])
        prev = [int(near[rng.integers(len(near))])] * 5 + [int(ids[rng.integers(len(ids))]), max(ids) + 7, None]
        prev = prev[walk % 8]
        asked.append((walk, cur, prev, len(near), len(neighbors.get(prev, ())), int(rng.integers(2147483647))))
    rows = spark.createDataFrame(asked, "walk_id long, cur long, prev long, deg long, prev_deg long, draw long")
    graph = WalkGraph(edges)
    got = second_order.choices(graph.hops, rows, (BACK, NEAR, FAR), *graph.sizes).collect()
    assert len(got) == len(asked)
    assert dict(map(tuple, got)) == {walk: chosen(neighbors, cur, prev, draw) for walk, cur, prev, _, _, draw in asked}


def test_lists_are_packed_without_loss():
    columns, size, flat = [np.array([5, -1, 1 << 40]), np.zeros(3, np.int64)], np.array([2, 0, 3]), np.array([7, 1 << 33, -4, 0, 9])
    back, sizes, ids = second_order.unpack_lists(second_order.pack_lists(columns, size, flat), 2)
    assert [c.tolist() for c in back] == [c.tolist() for c in columns] and sizes.tolist() == size.tolist() and ids.tolist() == flat.tolist()


def test_no_row_for_each_neighbor(spark):
    from driftwalk.queries import QUERIES

    plan = QUERIES["node2vec_steps"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and "Window" not in plan
