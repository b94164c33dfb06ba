"""Graph operators over edges(src, dst): both directions stored, set semantics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_batch(edges: DataFrame) -> DataFrame:
    """Distinct edges without self-loops and without a missing end."""
    return edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src <> dst").distinct()


def vertex_count(edges: DataFrame) -> DataFrame:
    """(n): largest id + 1, so that ids without edges count."""
    return edges.agg((F.max(F.greatest("src", "dst")) + 1).alias("n"))


def edge_count(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("m"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("vertex")).agg(F.count("*").alias("degree"))


def degree_histogram(edges: DataFrame) -> DataFrame:
    return degrees(edges).groupBy("degree").agg(F.count("*").alias("vertices"))


#: Bits of a neighbor id within a block of the neighbor numbering.
BLOCK_BITS = 17


def adjacency(edges: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """(u, idx, v, deg): the neighbors of u by id, numbered from 0.

    Neighbors are numbered within blocks of 2 ** block_bits ids, and blocks of
    a vertex by their counts: a hub's neighbors spread over many tasks.
    """
    rows = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.shiftright("dst", block_bits).alias("_b"))
    own = Window.partitionBy("u")
    counts = rows.groupBy("u", "_b").agg(F.count("*").alias("_c"))
    before = counts.select("u", "_b", F.coalesce(F.sum("_c").over(own.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_c").over(own).alias("deg"))
    numbered = rows.withColumn("_k", F.row_number().over(Window.partitionBy("u", "_b").orderBy("v")) - 1)
    return numbered.join(before, ["u", "_b"]).select("u", (F.col("_before") + F.col("_k")).cast("long").alias("idx"), "v", "deg")


def has_edge(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs(src, dst) with a column has_edge."""
    known = edges.select("src", "dst", F.lit(True).alias("has_edge"))
    return pairs.join(known, ["src", "dst"], "left").withColumn("has_edge", F.coalesce("has_edge", F.lit(False)))


def vertex_subset(vertices: DataFrame, predicate: Column) -> DataFrame:
    return vertices.where(predicate).select("vertex").distinct()


def edge_map(frontier: DataFrame, edges: DataFrame, condition: Column | None = None) -> DataFrame:
    """Vertices reached from frontier(vertex) over edges that fulfil condition on src and dst.

    The choice between pushing from a small frontier and scanning all edges is
    the optimizer's choice between a broadcast and a shuffled semi-join.
    """
    out = edges.join(frontier.select(F.col("vertex").alias("src")).distinct(), "src", "left_semi")
    return (out if condition is None else out.where(condition)).select(F.col("dst").alias("vertex")).distinct()


def k_hop(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(vertex, hop): the first hop at which each vertex is reached."""
    seen = start.select("vertex", F.lit(0).alias("hop")).distinct()
    for hop in range(1, hops + 1):
        reached = edge_map(seen.where(F.col("hop") == hop - 1), edges)
        seen = seen.unionByName(reached.join(seen, "vertex", "left_anti").withColumn("hop", F.lit(hop)))
    return seen


def edge_union(edges: DataFrame, batch: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(clean_batch(batch)).distinct()


def edge_difference(edges: DataFrame, batch: DataFrame) -> DataFrame:
    """Edges that are not in batch; edges of unknown vertices are no-ops."""
    return edges.join(clean_batch(batch), ["src", "dst"], "left_anti")


def _oriented(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, from the end of lower degree: no vertex then has more than sqrt(2m) out-edges."""
    deg = degrees(edges)
    ranked = edges.join(deg.select(F.col("vertex").alias("src"), F.col("degree").alias("ds")), "src").join(deg.select(F.col("vertex").alias("dst"), F.col("degree").alias("dd")), "dst")
    return ranked.where((F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))).select("src", "dst")


def triangle_count(edges: DataFrame) -> DataFrame:
    """(triangles): common out-neighbors of both ends of each degree-ordered edge.

    Out-neighbors of a vertex stand in one list, whose length the ordering
    bounds by sqrt(2m); lists meet edges by two joins, wedges aren't rows.
    """
    from driftwalk.plans.materialise import stored

    low = stored(_oriented(stored(edges.select("src", "dst"), "triangle-edges")), "triangle-oriented")
    lists = low.groupBy("src").agg(F.collect_list("dst").alias("out"))
    ends = low.join(lists.select(F.col("src").alias("dst"), F.col("out").alias("far")), "dst").join(lists.select("src", F.col("out").alias("near")), "src")
    return ends.agg(F.coalesce(F.sum(F.size(F.array_intersect("near", "far"))), F.lit(0)).cast("long").alias("triangles"))


def common_neighbors(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs(src, dst) with common: the size of the intersection of both neighbor sets."""
    mids = edges.select("src", F.col("dst").alias("mid"))
    ends = edges.select(F.col("src").alias("mid"), "dst")
    found = pairs.select("src", "dst").join(mids, "src").join(ends, ["mid", "dst"]).groupBy("src", "dst").agg(F.count("*").alias("common"))
    return pairs.select("src", "dst").join(found, ["src", "dst"], "left").withColumn("common", F.coalesce("common", F.lit(0)))


def batch_runs(batch: DataFrame) -> DataFrame:
    """(src, run_length, first_dst, last_dst): the run of each source in a sorted batch."""
    return clean_batch(batch).groupBy("src").agg(F.count("*").alias("run_length"), F.min("dst").alias("first_dst"), F.max("dst").alias("last_dst"))


def spmv(edges: DataFrame, vector: DataFrame) -> DataFrame:
    """(vertex, value): adjacency matrix times vector(vertex, value)."""
    joined = edges.join(vector.select(F.col("vertex").alias("dst"), "value"), "dst")
    return joined.groupBy(F.col("src").alias("vertex")).agg(F.sum("value").alias("value"))


def count_neighbors(edges: DataFrame, predicate: Column) -> DataFrame:
    """(vertex, n): how many neighbors (dst) of each vertex fulfil a predicate on src and dst."""
    return edges.groupBy(F.col("src").alias("vertex")).agg(F.count_if(F.coalesce(predicate, F.lit(False))).alias("n"))


def check_edges(edges: DataFrame) -> DataFrame:
    """(check, violations): what an undirected graph without repeats must not hold, counted."""
    def row(name: str, found: DataFrame) -> DataFrame:
        return found.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")

    known = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    mirrored = known.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    parts = [
        row("missing end", edges.where("src IS NULL OR dst IS NULL")), row("negative id", known.where("least(src, dst) < 0")), row("self-loop", known.where("src = dst")),
        row("repeated edge", known.groupBy("src", "dst").agg(F.count("*").alias("n")).where("n > 1")), row("missing mirror", known.join(mirrored, ["src", "dst"], "left_anti")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(vertex, component): the smallest reachable id, for undirected edges.

    Labels are parents in trees. In each round a vertex takes the smallest
    label near it, the root of a tree takes the smallest that any vertex of
    its tree has found, and pointers jump: whole trees merge, and so rounds
    grow with the logarithm of the vertices on chains too. They go on until no
    label changes. Each is materialised by checkpoint() in the shared folder.
    """
    from driftwalk.plans.materialise import cut

    labels = vertices.select("vertex", F.col("vertex").alias("component")).distinct()
    while True:
        pulled = edges.join(labels.select(F.col("vertex").alias("dst"), F.col("component").alias("near")), "dst")
        pulled = pulled.groupBy(F.col("src").alias("vertex")).agg(F.min("near").alias("near"))
        better = labels.join(pulled, "vertex", "left").select("vertex", "component", F.least("component", F.coalesce("near", "component")).alias("low"))
        hooks = better.where("low < component").groupBy(F.col("component").alias("vertex")).agg(F.min("low").alias("hook"))
        hooked = better.join(hooks.hint("merge"), "vertex", "left").select("vertex", "component", F.least("low", F.coalesce("hook", "low")).alias("low"))
        # Only labels that moved are joined: few once labels are hot, so the join needn't bring their vertices together.
        moved = hooked.where("low <> vertex").join(hooked.select(F.col("low").alias("vertex")).distinct(), "vertex", "left_semi")
        jump = moved.select(F.col("vertex").alias("low"), F.col("low").alias("jumped"))
        after = cut(hooked.join(jump, "low", "left").select("vertex", F.coalesce("jumped", "low").alias("next"), "component"))
        if after.where("next <> component").isEmpty():
            return after.select("vertex", "component")
        labels = after.select("vertex", F.col("next").alias("component"))
