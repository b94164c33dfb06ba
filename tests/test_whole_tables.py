"""Queries over whole tables on a small fixture, against their SQL."""

import datetime
import random

import duckdb
import pytest

from driftwalk.queries import QUERIES, SQL

N_ORDERS = 130


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    at, rng = tmp_path_factory.mktemp("small"), random.Random(2)
    day = datetime.datetime(1995, 1, 1)
    orders = [(k, rng.randrange(40), day + datetime.timedelta(days=rng.randrange(2500))) for k in range(N_ORDERS)]
    lines = [(rng.randrange(N_ORDERS), rng.randrange(60), rng.randrange(6), rng.choice("RNA")) for _ in range(260)]
    parts = [(k, rng.choice(["", None, "banana", "aaaa", "é日é", "x"]) if k % 2 else "".join(rng.choice("ab") for _ in range(k))) for k in range(20)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp").coalesce(1).write.parquet(str(at / "orders.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string").coalesce(1).write.parquet(str(at / "lineitem.parquet"))
    spark.createDataFrame([(k, rng.randrange(9)) for k in range(50)], "c_custkey long, c_nationkey int").coalesce(1).write.parquet(str(at / "customer.parquet"))
    spark.createDataFrame(parts, "p_partkey long, p_name string").coalesce(1).write.parquet(str(at / "part.parquet"))
    return str(at)


def same(spark, small, name, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("orders", "lineitem", "customer", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet/*.parquet'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    df = QUERIES[name](spark, small)
    assert sorted(df.columns) == sorted(names)
    want = sorted(str(r) for r in got.fetchall())
    assert want and sorted(str(tuple(r[c] for c in names)) for r in df.collect()) == want


GRAPH = ["connected_components", "k_hop_frontier", "neighbor_intersection_count", "node2vec_steps", "mh_accept", "node2vec_weights", "mh_weight_init", "byte_graph_roundtrip", "find_next", "find_next_in_range", "previously_sampled_vertex", "check_edges", "count_neighbors"]
BATCHES = ["merge_partial", "merge_last_ranges", "merge_by_position", "streaming_mixed_batches", "streamed_corpus_check"]
ORDERED = ["rotate_reverse_append", "reverse_scan", "sort_values", "merge_sorted", "split_three", "map_filter", "search_sequence", "adjacent_find", "compare_sequences", "is_partitioned", "extreme_positions", "augmented_filter", "random_shuffle", "suffix_array"]


@pytest.mark.parametrize("name", GRAPH)
def test_graph_queries(spark, small, name):
    same(spark, small, name, SQL[name])


@pytest.mark.parametrize("name", BATCHES)
def test_batch_queries(spark, small, name):
    same(spark, small, name, SQL[name])


@pytest.mark.parametrize("name", ORDERED)
def test_ordered_queries(spark, small, name):
    same(spark, small, name, SQL[name])


def test_no_query_cuts_its_tables():
    """Conditions on ids or early dates would hide rows from the comparison."""
    assert not [n for n, sql in SQL.items() if "1995" in sql or "% 5 = 0 AND" in sql]


def test_vectors_are_returned(spark, small):
    assert all(len(r.vector) == 8 and any(r.vector) for r in QUERIES["word2vec_embeddings"](spark, small).collect())


def test_stream_ends_with_all_edges(spark, small):
    same(spark, small, "streaming_foreach_batch", SQL["edges_symmetric"])


def test_learning_covers_all_vertices(spark, small):
    linked = {r.src for r in QUERIES["edges_symmetric"](spark, small).collect()}
    assert {r.vertex for r in QUERIES["word2vec_embeddings"](spark, small).collect()} == linked
    assert 0 < QUERIES["vertex_classification"](spark, small).first().n < len(linked)
