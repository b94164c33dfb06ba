"""Neighbor lists in pieces give the numbering of graph.adjacency, also where vertices have several blocks and pieces."""

import random

import pytest

from driftwalk.config import WalkConfig
from driftwalk.operators import graph, neighbors, walks


def hub_edges(spark, base: int = 0):
    rng = random.Random(5)
    pairs = {(0, k) for k in range(1, 300)} | {(rng.randrange(300), rng.randrange(300)) for _ in range(200)}
    return spark.createDataFrame(sorted({(base + a, base + b) for x, y in pairs if x != y for a, b in ((x, y), (y, x))}), "src long, dst long")


@pytest.mark.parametrize("bits, piece, base", [(20, 128, 0), (4, 3, 0), (6, 1, 1 << 33)])
def test_pieces_follow_the_numbering(spark, bits, piece, base):
    edges = hub_edges(spark, base)
    lists = neighbors.pieces(edges, bits, piece, tasks=5)
    begin = {(r.u, r.block): r.begin for r in neighbors.blocks(lists).collect()}
    got = {(r.u, begin[r.u, r.block] + r.piece * piece + k, v) for r in lists.collect() for k, v in enumerate(r.vs)}
    assert got == {(r.u, r.idx, r.v) for r in graph.adjacency(edges).collect()}
    assert max(len(r.vs) for r in lists.collect()) <= piece
    deg = {r.vertex: r.degree for r in neighbors.degrees_of(neighbors.blocks(lists)).collect()}
    assert deg == {r.vertex: r.degree for r in graph.degrees(edges).collect()}


@pytest.mark.parametrize("config", [WalkConfig(length=5), WalkConfig(length=4, model="node2vec", p=0.5, q=2.0), WalkConfig(length=4, model="node2vec", p=0.5, q=2.0, sampler="mh")])
def test_walks_don_t_depend_on_blocks_and_pieces(spark, monkeypatch, config):
    edges = hub_edges(spark)
    want = sorted(map(tuple, walks.generate(edges, config).collect()))
    monkeypatch.setattr(walks, "PIECE", 3)
    monkeypatch.setattr(walks, "pieces", lambda e: neighbors.pieces(e, 4, 3))
    assert len(want) > 300 and sorted(map(tuple, walks.generate(edges, config).collect())) == want


def test_a_hop_joins_lists(spark):
    """A row for each neighbor is what a hop must not shuffle."""
    table = walks.WalkGraph(hub_edges(spark))
    assert table.hops.count() <= 300 + 300 and table.hops.agg({"u": "max"}).first()[0] == 299
