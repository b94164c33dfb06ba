"""Starts of chains in packed passes against joins, with hubs, passes and large ids; no row for each proposal is shuffled."""

import pytest

from driftwalk.operators import chains
from tests.test_neighbors import hub_edges


@pytest.mark.parametrize("base, hub, states", [(0, 1000, 1 << 20), (0, 100, 1 << 20), (0, 1000, 300), (1 << 33, 100, 300)])
@pytest.mark.parametrize("some", [False, True])
def test_starts_are_those_of_joins(spark, monkeypatch, base, hub, states, some):
    edges = hub_edges(spark, base)
    pairs = edges.selectExpr("src AS prev", "dst AS cur")
    asked = pairs.where("(prev + cur) % 3 = 0") if some else pairs
    want = {tuple(r) for r in chains._by_joins(edges, asked, (4, 2, 1), 8).collect()}
    monkeypatch.setattr(chains, "HUB", hub)
    monkeypatch.setattr(chains, "STATES", states)
    got = chains.chain_starts(edges, (4, 2, 1), 8, asked if some else None).collect()
    assert len(got) == len(want) == asked.count() and {tuple(r) for r in got} == want


def test_no_edges(spark):
    assert chains.chain_starts(spark.createDataFrame([], "src long, dst long"), (4, 2, 1), 8).count() == 0


@pytest.mark.parametrize("name, most", [("mh_weight_init", 0), ("previously_sampled_vertex", 1)])
def test_no_row_for_each_proposal(spark, name, most):
    from driftwalk.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == most and "Generate" not in plan
