import random

import pytest

from driftwalk.operators import graph
from driftwalk.plans import materialise


def test_chain_with_random_ids(spark, monkeypatch):
    """1500 vertices in a row: labels that move a hop a round would need hundreds of rounds."""
    ids = list(range(1500))
    random.Random(4).shuffle(ids)
    ids, apart = [i + 10 for i in ids], [(1, 2), (5, 4)]
    pairs = [*zip(ids, ids[1:], strict=False), *apart]
    edges = spark.createDataFrame([e for a, b in pairs for e in ((a, b), (b, a))], "src long, dst long")
    rounds = []

    def counted(df, cut=materialise.cut):
        rounds.append(1)
        if len(rounds) > 16:
            pytest.fail("more than 16 rounds")
        return cut(df)

    monkeypatch.setattr(materialise, "cut", counted)
    got = {r.vertex: r.component for r in graph.components(edges, spark.createDataFrame([(i,) for i in [*ids, 1, 2, 4, 5, 7]], "vertex long")).collect()}
    assert got == {**dict.fromkeys(ids, 10), 1: 1, 2: 1, 4: 4, 5: 4, 7: 7}
