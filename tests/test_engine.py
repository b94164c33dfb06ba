import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from driftwalk import WalkConfig
from driftwalk.functions.pairing import pair, unpair
from driftwalk.operators import graph, ordered, updates, walks
from driftwalk.plans import strategy
from driftwalk.sources import graph_files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["adjacency_index", "edge_union", "edge_difference", "triangle_count", "rmat_edges", "szudzik_unpair", "deepwalk_steps", "deepwalk_broadcast", "deepwalk_segmented", "deepwalk_parity_rng", "find_next_in_range", "insert_batch_live", "delete_batch_live", "node2vec_steps", "mh_accept", "prefix_scan", "range_min", "kth_smallest", "is_sorted", "adjacency_text_roundtrip"]


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, name):
    df = entry_points.queries()[name](spark, SF)
    columns = sorted(df.columns)
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = con.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert sorted(str(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(str(tuple(r[i] for i in at)) for r in got.fetchall())


def edges_of(spark, pairs):
    return spark.createDataFrame([e for a, b in pairs for e in ((a, b), (b, a))], "src long, dst long")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_path_graph_walks_are_complete(spark):
    edges = edges_of(spark, [(0, 1), (1, 2), (2, 3)])
    steps = walks.generate(edges, WalkConfig(length=5)).collect()
    known = {tuple(r) for r in edges.collect()}
    assert len({(s.walk_id, s.pos) for s in steps}) == len(steps) == 20
    assert all((s.vertex, s.next) in known for s in steps if s.pos < 4)
    assert all(s.vertex == s.next for s in steps if s.pos == 4)
    assert all(s.vertex == s.walk_id for s in steps if s.pos == 0)


def test_strategies_agree(spark):
    edges = edges_of(spark, [(0, k) for k in range(1, 300)])
    config = WalkConfig(length=6, walks_per_vertex=2)
    assert rows(walks.generate(edges, config), "walk_id", "pos", "vertex", "next") == rows(strategy.generate_broadcast(edges, config), "walk_id", "pos", "vertex", "next")


def test_isolated_vertex_gets_edges(spark):
    corpus = updates.new_corpus(edges_of(spark, [(0, 1)]), WalkConfig(length=4), spark.createDataFrame([(v, 3) for v in range(3)], "vertex long, n long"))
    assert [(r.pos, r.vertex) for r in corpus.live.where("walk_id = 2").collect()] == [(0, 2)]
    after, mav = corpus.apply(edges_of(spark, [(2, 0)]))
    assert {r.walk_id: r.p_min for r in mav.collect()}[2] == 0
    assert after.live.where("walk_id = 2").count() == 4
    assert after.live.groupBy("walk_id", "pos").count().where("count > 1").isEmpty()


def test_last_edge_resets(spark):
    corpus = updates.new_corpus(edges_of(spark, [(0, 1), (1, 2)]), WalkConfig(length=4))
    after, mav = corpus.apply(edges_of(spark, [(1, 2)]), delete=True)
    assert any(r.reset for r in mav.collect())
    assert [(r.pos, r.vertex, r.next) for r in after.live.where("walk_id = 2").collect()] == [(0, 2, 2)]
    known = {tuple(r) for r in after.edges.collect()}
    assert all((r.vertex, r.next) in known or r.vertex == r.next for r in after.live.collect())


def test_insert_then_delete_restores_edges(spark):
    edges = edges_of(spark, [(0, 1), (1, 2)])
    corpus = updates.new_corpus(edges, WalkConfig(length=3))
    batch = edges_of(spark, [(0, 2), (0, 2)])
    assert rows(corpus.apply(batch)[0].apply(batch, delete=True)[0].edges, "src", "dst") == rows(edges, "src", "dst")
    assert rows(graph.edge_difference(edges, edges_of(spark, [(8, 9)])), "src", "dst") == rows(edges, "src", "dst")


def test_new_vertices_get_walks(spark):
    corpus = updates.new_corpus(edges_of(spark, [(0, 1)]), WalkConfig(length=3))
    after, _ = corpus.apply(edges_of(spark, [(1, 7)]))
    assert rows(after.starts, "walk_id", "vertex") == [(0, 0), (1, 1), (2, 7)]


def test_pairing_vectors(spark):
    known = {(0, 0): 0, (0, 1): 2, (1, 0): 1, (1, 1): 3, (3, 5): 33, (5, 3): 28, (0, 3037000498): None}
    df = spark.createDataFrame(list(known), "x long, y long").withColumn("z", pair("x", "y"))
    a, b = unpair("z")
    for r in df.withColumn("a", a).withColumn("b", b).collect():
        assert (r.a, r.b) == (r.x, r.y) and known[r.x, r.y] in (None, r.z)


def test_node2vec_weights():
    assert walks.integer_weights(0.5, 2.0) == (4, 2, 1)


def test_uniform_neighbors(spark):
    edges = edges_of(spark, [(0, k) for k in range(1, 11)])
    first = walks.generate(edges, WalkConfig(length=2, walks_per_vertex=2000)).where("pos = 0 AND vertex = 0").groupBy("next").count().collect()
    assert len(first) == 10 and sum((r["count"] - 200) ** 2 / 200 for r in first) < 30


def test_byte_graph_roundtrip(spark, tmp_path):
    adjacency = {0: [1, 5, 300], 1: [0], 5: [0, 70_000], 300: [0], 70_000: [5]}
    (tmp_path / "g").write_bytes(graph_files.write_byte_graph(adjacency, 70_001))
    assert rows(graph_files.read_byte_graph(spark, str(tmp_path / "g")), "src", "dst") == sorted((a, b) for a, x in adjacency.items() for b in x)


def test_embedding_files(spark, tmp_path):
    model = spark.createDataFrame([("3", 9, [1.0, 2.0, 3.0], [3.0, 2.0, 1.0]), ("4", 1, [0.0] * 3, [0.0] * 3)], "word string, count long, input array<double>, output array<double>")
    graph_files.write_embeddings(model, str(tmp_path / "e"), min_count=5)
    assert [(r.vertex, r.vector) for r in graph_files.read_embeddings(spark, str(tmp_path / "e")).collect()] == [(3, [2.0, 2.0, 2.0])]


def test_quantifiers_with_one_match(spark):
    seq = spark.createDataFrame([(0, 1), (1, 7), (2, None)], "idx long, value long")
    assert tuple(ordered.quantified(seq, F.col("value") > 5).first()) == (False, True, False, 1, 1)
