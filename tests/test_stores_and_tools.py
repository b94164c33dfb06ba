"""Stores, checks, files, draws and the command line."""

import os
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from driftwalk import WalkConfig
from driftwalk.__main__ import main
from driftwalk.functions import rng
from driftwalk.operators import embeddings, graph, metrics, ordered, updates, walks
from driftwalk.plans import materialise, strategy
from driftwalk.sources import graph_files
from driftwalk.streaming.runner import CorpusStore, apply_batch, windowed_edges


def edges_of(spark, pairs):
    return spark.createDataFrame([e for a, b in pairs for e in ((a, b), (b, a))], "src long, dst long")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


def bytes_below(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_store_reads_snapshots_and_changes_alike(spark, tmp_path):
    """Versions from changes equal those from snapshots; changes are small beside the graph."""
    pairs = [(k, (k * 7 + 1) % 400) for k in range(400) if k != (k * 7 + 1) % 400]
    batches = [([(0, 5), (0, 401)], []), ([(1, 9)], [(0, 5), (2, 15)])]
    found = []
    for every in (1, 100):
        store = CorpusStore(spark, str(tmp_path / str(every)), WalkConfig(length=4, snapshot_every=every))
        store.write(updates.new_corpus(edges_of(spark, pairs), store.config), 0)
        for number, (inserts, deletes) in enumerate(batches, 1):
            parts = [edges_of(spark, x).withColumn("op", F.lit(op)) for x, op in ((inserts, "insert"), (deletes, "delete")) if x]
            apply_batch(store, parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), number)
        versions = [store.read(n) for n in range(3)]
        found.append([(rows(c.edges, "src", "dst"), rows(c.live, *walks.STEP_COLUMNS), rows(c.starts)) for c in versions])
        assert all(r.violations == 0 for c in versions for r in updates.check_corpus(c).collect())
        assert store.last() == 2 and store.snapshots() == ([0, 1, 2] if every == 1 else [0])
    assert found[0] == found[1]
    at = tmp_path / "100"
    assert bytes_below(at / "change=0000000001" / "edges") < bytes_below(at / "snapshot=0000000000" / "edges") / 2
    store.destroy(walks_only=True)
    assert sorted(os.listdir(at / "snapshot=0000000000")) == ["edges"]
    store.destroy()
    assert not at.exists()


def test_checks_see_violations(spark):
    edges = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (0, 2), (0, 2), (None, 3), (-1, 0)], "src long, dst long")
    assert {r.check: r.violations for r in graph.check_edges(edges).collect()} == {"missing end": 1, "negative id": 1, "self-loop": 1, "repeated edge": 1, "missing mirror": 3}
    corpus = updates.new_corpus(edges_of(spark, [(0, 1), (1, 2), (2, 3)]), WalkConfig(length=3))
    broken = corpus.steps.where("NOT (walk_id = 1 AND pos = 1)").withColumn("next", F.when(F.expr("walk_id = 0 AND pos = 0"), F.lit(3)).otherwise(F.col("next")))
    import dataclasses

    found = {r.check: r.violations for r in updates.check_corpus(dataclasses.replace(corpus, steps=broken)).collect()}
    assert found["gap in a walk"] == 1 and found["step without an edge"] == 1 and found["next is not the next vertex"] == 1


def test_hub_neighbors_are_numbered_by_blocks(spark):
    edges = edges_of(spark, [(0, k) for k in range(1, 200)] + [(5, 900)])
    want = rows(graph.adjacency(edges))
    assert rows(graph.adjacency(edges, block_bits=3)) == want
    assert [r[1] for r in want if r[0] == 0] == list(range(199)) and {r[3] for r in want if r[0] == 0} == {199}


def test_broadcast_refuses_large_graphs(spark):
    edges, config = edges_of(spark, [(0, 1), (1, 2)]), WalkConfig(length=3, broadcast_edges=3)
    with pytest.raises(ValueError, match="edges"):
        strategy.generate_broadcast(edges, config)
    assert rows(strategy.generate_auto(edges, config)) == rows(walks.generate(edges, config))


def test_public_vectors_of_generators():
    """xoroshiro128+ (24, 16, 37) from state (1, 2), and splitmix64 from 0, as published with them."""
    stream = rng.Xoroshiro128Plus(1, 2, 24, 16, 37)
    assert [stream.draw() for _ in range(4)] == [3, 412333834243, 2360170716294286339, 9295852285959843169]
    step = rng.ParityStream.INCREMENT
    assert [rng.splitmix64(k * step) for k in (1, 2)] == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4]
    assert rng.splitmix64(5) == rng.splitmix64(5, signed=True) or rng.splitmix64(step) != rng.splitmix64(step, signed=True)


def test_hashed_draws_equal_the_library(spark):
    def chained(*values):
        seed = 42
        for size, v in values:
            seed = xxhash.xxh64(struct.pack(size, v), seed=seed).intdigest()
        return seed >> 33

    got = spark.range(20).select("id", rng.hashed_draw("id", 1, 42).alias("d")).collect()
    assert [r.d for r in got] == [chained(("<i", 42), ("<q", r.id), ("<i", 1), ("<i", 0)) for r in got]


def test_stored_bytes_by_part(spark, tmp_path):
    store = CorpusStore(spark, str(tmp_path / "s"), WalkConfig(length=3))
    store.write(updates.new_corpus(edges_of(spark, [(0, 1), (1, 2)]), store.config), 0)
    got = {r.part: r.bytes for r in metrics.stored_bytes(spark, str(tmp_path / "s")).collect()}
    assert got == {part: bytes_below(tmp_path / "s" / "snapshot=0000000000" / part) for part in CorpusStore.PARTS}


def test_stored_folders_are_released(spark):
    df = materialise.stored(spark.range(5), "released")
    at = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert df.count() == 5 and os.path.isdir(at)
    materialise.remove(spark, at)
    assert not os.path.exists(at) and materialise.children(spark, at) == []


def test_files_of_labels_and_graphs(spark, tmp_path):
    (tmp_path / "labels").write_text("1 a\n2 b\n")
    assert rows(graph_files.read_labels(spark, str(tmp_path / "labels"))) == [(1, "a"), (2, "b")]
    (tmp_path / "list").write_text("# comment\n0 1\n1\t0\n\n")
    assert rows(graph_files.load_graph(spark, str(tmp_path / "list"), "edge_list")) == [(0, 1), (1, 0)]
    edges = edges_of(spark, [(0, 1), (0, 300), (70_000, 5)])
    graph_files.write_byte_files(edges, str(tmp_path / "bytes"))
    for parts in (1, 5):
        assert rows(graph_files.read_byte_graph(spark, str(tmp_path / "bytes"), parts)) == rows(edges)
    adjacency = {0: [1, 300], 1: [0], 300: [0], 5: [70_000], 70_000: [5]}
    assert (tmp_path / "bytes" / "graph.bytes").read_bytes() == graph_files.write_byte_graph(adjacency, 70_001)


def test_approximate_kth_is_near(spark):
    values = spark.range(10_000).select(((F.col("id") * 7919) % 10_007).alias("value"))
    exact = ordered.kth_smallest(values, 321).first()[0]
    assert abs(ordered.approximate_kth(values, 321).first()[0] - exact) <= 3


def test_late_rows_of_a_stream_are_dropped(spark, tmp_path):
    schema = "ts timestamp, src long, dst long"
    for k, hour in enumerate((0, 30, 31, 1, 60)):  # the fourth file is later than the watermark of the batch before allows
        at = tmp_path / f"part{k}"
        spark.sql(f"SELECT timestamp'2001-01-01' + make_interval(0, 0, 0, 0, {hour}) ts, {k}L src, 1L dst").coalesce(1).write.parquet(str(at))
        (tmp_path / "in").mkdir(exist_ok=True)
        moved = next(at.glob("*.parquet")).rename(tmp_path / "in" / f"{k}.parquet")
        os.utime(moved, (1.7e9 + k, 1.7e9 + k))
    stream = spark.readStream.option("maxFilesPerTrigger", 1).schema(schema).parquet(str(tmp_path / "in"))
    query = windowed_edges(stream, "1 hour", "2 hours").writeStream.format("memory").queryName("late").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    assert {r.src for r in spark.table("late").collect()} == {0, 1, 2}


def test_incremental_vectors_stay_near_the_old_ones(spark):
    paths = spark.createDataFrame([(k, [k % 7, (k + 1) % 7, (k * 3) % 7, 7 + k % 3]) for k in range(60)], "walk_id long, path array<long>")
    old = embeddings.word2vec(paths, dim=4, iterations=2)
    changed = spark.createDataFrame([(100 + k, [0, 1, 10, 2]) for k in range(20)], "walk_id long, path array<long>")
    new = {r.vertex: r.vector for r in embeddings.update_vectors(old, changed, dim=4).collect()}
    before = {r.vertex: r.vector for r in old.collect()}
    assert set(new) == {*before, 10} and all(list(new[v]) == list(before[v]) for v in before if v not in (0, 1, 2, 10))
    assert all(len(v) == 4 for v in new.values())


def test_command_line(spark, tmp_path):
    edges_of(spark, [(0, 1), (1, 2), (2, 0)]).write.parquet(str(tmp_path / "g"))
    edges_of(spark, [(2, 3)]).write.parquet(str(tmp_path / "b"))
    store = str(tmp_path / "store")
    main(["--length", "4", "--walks", "2", "generate", str(tmp_path / "g"), store], spark)
    main(["--length", "4", "--walks", "2", "update", store, str(tmp_path / "b")], spark)
    main(["--length", "4", "walks", store, str(tmp_path / "out")], spark)
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == 7 and all(len(x.split()) == 4 for x in lines)
    main(["--length", "4", "check", store], spark)
    main(["drop", store], spark)
    assert not os.path.exists(store)
    with pytest.raises(SystemExit):
        main(["nothing"], spark)
