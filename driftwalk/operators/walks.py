"""Walk generation: walkers hop by equi-joins; a walk is one row per step."""

from __future__ import annotations

from functools import cached_property
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwalk.config import WalkConfig
from driftwalk.functions.rng import portable_draw
from driftwalk.operators import second_order
from driftwalk.operators.neighbors import PIECE, blocks, degrees_of, pieces
from driftwalk.plans.materialise import cut, stored, stored_edges

STEP_COLUMNS = ["walk_id", "pos", "vertex", "next", "batch"]
# Purposes of draws: added to the seed so that one hop's draws are independent.
PROPOSE, ACCEPT, CHOOSE, START = 0, 1_000_003, 2_000_003, 3_000_017


class WalkModel(Protocol):
    """How a walker's next vertex is drawn; add a model by adding an entry to MODELS."""

    def hop(self, walkers: DataFrame, graph: "WalkGraph", config: WalkConfig) -> DataFrame:
        """walkers with columns nxt and nxt_deg, null where the walker stays."""


class WalkGraph:
    """The tables that a hop joins: neighbor lists in pieces, edges and degrees of one graph version.

    Edges are stored once: however they are derived, each hop would else do so anew.
    """

    def __init__(self, edges: DataFrame):
        self.edges = stored_edges(edges, "graph-edges")
        self.hops = stored(pieces(self.edges), "graph-hops", packed=True)
        self.blocks = stored(blocks(self.hops), "graph-blocks", packed=True)
        self.degrees = stored(degrees_of(self.blocks), "graph-degrees", packed=True)
        self.split = self.blocks.count() > self.degrees.count()  # a vertex has several blocks

    @cached_property
    def sizes(self) -> tuple[int, list[tuple[int, int]]]:
        """(edges, vertices of more than second_order.SPREAD neighbors with their degrees): at most edges / SPREAD of these."""
        heavy = self.degrees.where(F.col("degree") > second_order.SPREAD).orderBy("vertex").collect()
        return self.degrees.agg(F.sum("degree")).first()[0] or 0, [(r.vertex, r.degree) for r in heavy]


def _drawn(purpose: int, config: WalkConfig, trial: int | Column = 0) -> Column:
    return portable_draw("walk_id", F.col("at"), F.lit(config.seed + purpose) + trial, "batch")


def _neighbor(walkers: DataFrame, graph: WalkGraph, draw: Column, vertex: str, degree: str, out: str) -> DataFrame:
    """walkers with out: the neighbor of `vertex` that draw selects, by the block and the piece it stands in."""
    pick = F.when(F.col("live") & (F.col(degree) > 0), draw % F.greatest(F.col(degree), F.lit(1))).otherwise(F.lit(-1))
    keyed = walkers.withColumn("_pick", pick)
    lists = graph.hops.select(F.col("u").alias("_u"), F.col("block").alias("_of"), F.col("piece").alias("_at"), "vs")
    if graph.split:
        parts = graph.blocks.select(F.col("u").alias("_w"), F.col("block").alias("_block"), F.col("begin").alias("_begin"), F.col("size").alias("_size"))
        inside = (F.col("_pick") >= F.col("_begin")) & (F.col("_pick") < F.col("_begin") + F.col("_size"))
        keyed = keyed.join(parts, (keyed[vertex] == parts["_w"]) & inside, "left").withColumn("_pick", F.col("_pick") - F.col("_begin")).drop("_w", "_begin", "_size")
    placed = keyed.withColumn("_piece", F.when(F.col("_pick") >= 0, F.expr(f"_pick div {PIECE}")))
    there = (placed[vertex] == lists["_u"]) & (placed["_piece"] == lists["_at"])
    met = placed.join(lists, there & (placed["_block"] == lists["_of"]) if graph.split else there, "left")
    return met.withColumn(out, F.get("vs", (F.col("_pick") % PIECE).cast("int"))).drop("_pick", "_block", "_piece", "_u", "_of", "_at", "vs")


def _with_degree(walkers: DataFrame, graph: WalkGraph, vertex: str, out: str) -> DataFrame:
    """walkers with out: the degree of a vertex, 0 without edges; null where the vertex is."""
    known = graph.degrees.select(F.col("vertex").alias("_v"), F.col("degree").alias("_d"))
    joined = walkers.join(known, walkers[vertex] == known["_v"], "left")
    return joined.withColumn(out, F.when(F.col(vertex).isNotNull(), F.coalesce("_d", F.lit(0)))).drop("_v", "_d")


class DeepWalk:
    """First order: every neighbor alike."""

    def hop(self, walkers: DataFrame, graph: WalkGraph, config: WalkConfig) -> DataFrame:
        return _with_degree(_neighbor(walkers, graph, _drawn(PROPOSE, config), "cur", "deg", "nxt"), graph, "nxt", "nxt_deg")


def integer_weights(p: float, q: float) -> tuple[int, int, int]:
    """(back to the previous vertex, to its neighbors, onward): 1/p : 1 : 1/q in whole numbers."""
    from fractions import Fraction
    from math import gcd, lcm

    parts = [1 / Fraction(p).limit_denominator(1000), Fraction(1), 1 / Fraction(q).limit_denominator(1000)]
    scale = lcm(*(x.denominator for x in parts))
    whole = [int(x * scale) for x in parts]
    common = gcd(*whole)
    return tuple(x // common for x in whole)


def second_order_weight(previous: Column, candidate: Column, linked: Column, config: WalkConfig) -> Column:
    back, near, far = integer_weights(config.p, config.q)
    return F.when(candidate == previous, F.lit(back)).when(linked, F.lit(near)).otherwise(F.lit(far)).cast("long")


class Node2Vec:
    """Second order. The state's previous vertex starts as a random neighbor of the start.

    sampler "exact" weighs all neighbors and draws by cumulative weight; of cur
    and prev the shorter list goes to the other one, packed. "mh" proposes a neighbor and accepts it
    against the chain's last sample: one row per walker and hop, for graphs
    with hubs. The chain is the walker's own, so results don't depend on order.
    """

    def hop(self, walkers: DataFrame, graph: WalkGraph, config: WalkConfig) -> DataFrame:
        return (self._exact if config.sampler == "exact" else self._mh)(walkers, graph, config)

    def _weighed(self, walkers: DataFrame, graph: WalkGraph, candidate: str, out: str, config: WalkConfig) -> DataFrame:
        known = graph.edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d"))
        joined = walkers.join(known, (walkers["prev"] == known["_s"]) & (walkers[candidate] == known["_d"]), "left")
        return joined.withColumn(out, second_order_weight(F.col("prev"), F.col(candidate), F.col("_s").isNotNull(), config)).drop("_s", "_d")

    def _exact(self, walkers: DataFrame, graph: WalkGraph, config: WalkConfig) -> DataFrame:
        walkers = cut(_with_degree(walkers, graph, "prev", "prev_deg").withColumn("draw", _drawn(CHOOSE, config)))
        live = walkers.where("live")
        found = second_order.choices(graph.hops, live, integer_weights(config.p, config.q), *graph.sizes)
        met = walkers.drop("prev_deg", "draw").join(stored(found, "choices", packed=True), "walk_id", "left")
        return _with_degree(met, graph, "nxt", "nxt_deg")

    def _mh(self, walkers: DataFrame, graph: WalkGraph, config: WalkConfig) -> DataFrame:
        first = _neighbor(walkers, graph, _drawn(PROPOSE, config), "cur", "deg", "old")
        both = _neighbor(first, graph, _drawn(PROPOSE, config, F.lit(7)), "cur", "deg", "new")
        both = self._weighed(self._weighed(both, graph, "old", "old_wt", config), graph, "new", "new_wt", config)
        accepted = (F.col("new_wt") > F.col("old_wt")) | (_drawn(ACCEPT, config) * F.col("old_wt") <= F.col("new_wt") * 2147483647)
        taken = both.withColumn("nxt", F.when(accepted, F.col("new")).otherwise(F.col("old"))).drop("old", "new", "old_wt", "new_wt")
        return _with_degree(taken, graph, "nxt", "nxt_deg")


MODELS: dict[str, WalkModel] = {"deepwalk": DeepWalk(), "node2vec": Node2Vec()}


def initial_walkers(graph: WalkGraph, starts: DataFrame, config: WalkConfig, batch: int = 0) -> DataFrame:
    """(walk_id, p0, cur, deg, prev, batch, path) for starts(walk_id, vertex[, p0, prev]).

    Where prev is missing, a second-order walker gets a random neighbor of its vertex.
    """
    p0 = F.col("p0") if "p0" in starts.columns else F.lit(0)
    prev = F.col("prev") if "prev" in starts.columns else F.lit(None)
    deg = graph.degrees.select(F.col("vertex").alias("cur"), F.col("degree").alias("_deg"))
    out = starts.select("walk_id", p0.cast("int").alias("p0"), F.col("vertex").alias("cur"), prev.cast("long").alias("prev")).join(deg, "cur", "left")
    out = out.select("walk_id", "p0", "cur", F.coalesce("_deg", F.lit(0)).alias("deg"), "prev", F.lit(batch).alias("batch"), F.array("cur").alias("path"))
    if config.model == "node2vec":
        drawn = portable_draw("walk_id", F.lit(0), F.lit(config.seed + START), "batch")
        out = _neighbor(out.withColumn("live", F.col("prev").isNull()), graph, drawn, "cur", "deg", "first")
        out = out.withColumn("prev", F.coalesce("prev", "first")).drop("first", "live")
    return out


def run_walkers(graph: WalkGraph, walkers: DataFrame, config: WalkConfig) -> DataFrame:
    """(walk_id, p0, path, batch): the vertices from position p0 on, in segments.

    A walker carries only the path since its last segment. After each segment
    the walkers are materialised; the segments' rows are the result.
    """
    model, parts, hops = MODELS[config.model], [], config.length - 1
    while True:
        for _ in range(min(hops, config.segment_hops)):
            at = F.col("p0") + F.size("path")
            ready = walkers.withColumn("at", at).withColumn("live", (at < config.length) & (F.col("deg") > 0))
            moved = model.hop(ready, graph, config)
            went = F.col("nxt").isNotNull()
            walkers = moved.select(
                "walk_id", "p0", F.coalesce("nxt", "cur").alias("cur"), F.when(went, F.col("nxt_deg")).otherwise(F.col("deg")).alias("deg"),
                F.when(went, F.col("cur")).otherwise(F.col("prev")).alias("prev"), "batch", F.when(went, F.concat("path", F.array("nxt"))).otherwise(F.col("path")).alias("path"),
            )
        hops -= config.segment_hops
        if hops <= 0:
            parts.append(walkers.select("walk_id", "p0", "path", "batch"))
            break
        walkers = cut(walkers)
        parts.append(walkers.where((F.col("deg") == 0) | (F.col("p0") + F.size("path") >= config.length)).select("walk_id", "p0", "path", "batch"))
        open_ = walkers.where((F.col("deg") > 0) & (F.col("p0") + F.size("path") < config.length))
        # The last vertex opens the next segment, so it is left out of this one.
        parts.append(open_.where(F.size("path") > 1).select("walk_id", "p0", F.expr("slice(path, 1, size(path) - 1)").alias("path"), "batch"))
        walkers = open_.select("walk_id", (F.col("p0") + F.size("path") - 1).alias("p0"), "cur", "deg", "prev", "batch", F.array("cur").alias("path"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out if len(parts) == 1 else out


def as_steps(paths: DataFrame, config: WalkConfig) -> DataFrame:
    """(walk_id, pos, vertex, next, batch); next of the last position is the vertex itself."""
    rows = paths.select("walk_id", "p0", "batch", "path", F.posexplode("path").alias("k", "vertex"))
    if config.length - 1 <= config.segment_hops:
        follow = F.get("path", F.col("k") + 1)
    else:  # the follower may stand in the next segment
        follow = F.lead("vertex").over(Window.partitionBy("walk_id").orderBy(F.col("p0") + F.col("k")))
    return rows.select("walk_id", (F.col("p0") + F.col("k")).cast("int").alias("pos"), "vertex", F.coalesce(follow, "vertex").alias("next"), "batch")


def starts_of(vertices: DataFrame, walks_per_vertex: int) -> DataFrame:
    """(walk_id, vertex) for vertices(vertex, n): walk ids rep * n + vertex."""
    return vertices.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(walks_per_vertex - 1)))).select((F.col("rep") * F.col("n") + F.col("vertex")).alias("walk_id"), "vertex")


def id_domain(edges: DataFrame, partitions: int | None = None) -> DataFrame:
    """(vertex, n) for all ids 0 .. n-1, those without edges too."""
    spark = edges.sparkSession
    n = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
    n = 0 if n is None else n + 1
    return spark.range(0, n, 1, partitions).select(F.col("id").alias("vertex"), F.lit(n).cast("long").alias("n"))


def generate(edges: DataFrame | None, config: WalkConfig, vertices: DataFrame | None = None, batch: int = 0, graph: WalkGraph | None = None) -> DataFrame:
    """The whole corpus as steps: walks_per_vertex walks from each id. graph: the tables of edges, where they are there."""
    graph = graph or WalkGraph(edges)
    starts = starts_of(id_domain(graph.edges) if vertices is None else vertices, config.walks_per_vertex)
    return as_steps(run_walkers(graph, initial_walkers(graph, starts, config, batch), config), config)


def previously_sampled(walkers: DataFrame, samplers: DataFrame) -> DataFrame:
    """walkers(cur, prev, ...) with last: the last sample of the chain of their state, from samplers(prev, cur, last)."""
    return walkers.join(samplers.select("prev", "cur", "last"), ["prev", "cur"], "left").select(*walkers.columns, "last")


def generate_parity(edges: DataFrame, config: WalkConfig) -> DataFrame:
    """First-order corpus drawn from one seeded stream per repetition: draw k serves hop k of all its walks."""
    from driftwalk.functions.rng import parity_draws

    graph = WalkGraph(edges)
    domain = id_domain(graph.edges)
    draws = F.broadcast(parity_draws(edges.sparkSession, config.walks_per_vertex, config.length))
    n = domain.select("n").first()
    starts = starts_of(domain, config.walks_per_vertex).withColumn("rep", F.floor((F.col("walk_id") - F.col("vertex")) / F.lit(max(1, n[0] if n else 1))).cast("long"))
    walkers = initial_walkers(graph, starts, config).join(starts.select("walk_id", "rep"), "walk_id")
    for hop in range(config.length - 1):
        live = walkers.join(draws.where(F.col("k") == hop).select("rep", "draw"), "rep", "left").withColumn("live", F.col("deg") > 0)
        pick = F.when(F.col("live"), (F.col("draw") % F.greatest("deg", F.lit(1)).cast("decimal(20,0)")).cast("long")).otherwise(F.lit(-1))
        moved = _with_degree(_neighbor(live.withColumn("_p", pick), graph, F.col("_p"), "cur", "deg", "nxt"), graph, "nxt", "nxt_deg")
        walkers = moved.select("rep", "walk_id", "p0", F.coalesce("nxt", "cur").alias("cur"), F.coalesce("nxt_deg", F.lit(0)).alias("deg"), "batch", F.when(F.col("nxt").isNotNull(), F.concat("path", F.array("nxt"))).otherwise(F.col("path")).alias("path"))
    return as_steps(walkers, WalkConfig(length=config.length, segment_hops=config.length))
