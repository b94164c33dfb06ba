"""Batches of edges: find the walks they invalidate, re-sample only their suffixes, compact."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwalk.config import WalkConfig
from driftwalk.operators.graph import clean_batch
from driftwalk.operators.walks import STEP_COLUMNS, WalkGraph, as_steps, generate, id_domain, initial_walkers, run_walkers, starts_of
from driftwalk.plans.materialise import cut


def affected_walks(live: DataFrame, batch: DataFrame, number: int) -> DataFrame:
    """(batch, walk_id, p_min, vertex): the earliest step of each walk at a vertex whose edges change.

    The last step too: it has no successor to re-sample, but the reference
    semantics count the walk as affected.
    """
    touched = clean_batch(batch).select(F.col("src").alias("vertex")).distinct()
    hit = live.join(touched, "vertex", "left_semi")
    return hit.groupBy("walk_id").agg(F.min("pos").alias("p_min"), F.min_by("vertex", "pos").alias("vertex")).select(F.lit(number).alias("batch"), "walk_id", "p_min", "vertex")


def with_reset(mav: DataFrame, edges_after: DataFrame, starts: DataFrame) -> DataFrame:
    """mav with reset: where the vertex has lost all edges, the walk restarts at position 0 from its start.

    starts: (walk_id, vertex) of position 0.
    """
    deg = edges_after.select(F.col("src").alias("vertex")).distinct().withColumn("degree", F.lit(1))
    first = starts.select("walk_id", F.col("vertex").alias("start"))
    joined = mav.join(deg, "vertex", "left").join(first, "walk_id", "left")
    reset = F.col("degree").isNull()
    return joined.select("batch", "walk_id", F.when(reset, 0).otherwise(F.col("p_min")).cast("int").alias("p_min"), F.when(reset, F.col("start")).otherwise(F.col("vertex")).alias("vertex"), reset.alias("reset"))


def resample(mav: DataFrame, live: DataFrame, graph: WalkGraph, config: WalkConfig, number: int) -> DataFrame:
    """Fresh steps from p_min on, drawn with the batch number in the key so that old suffixes aren't replayed."""
    starts = mav.select("walk_id", "vertex", F.col("p_min").alias("p0"))
    if config.model == "node2vec":
        before = live.select("walk_id", (F.col("pos") + 1).alias("p0"), F.col("vertex").alias("prev"))
        starts = starts.join(before, ["walk_id", "p0"], "left")
    return as_steps(run_walkers(graph, initial_walkers(graph, starts, config, number), config), config)


def stale_steps(steps: DataFrame, mav: DataFrame) -> DataFrame:
    """Steps at or after the earliest invalid position of a batch later than their own."""
    later = mav.select("walk_id", F.col("p_min").alias("_p"), F.col("batch").alias("_b"))
    joined = steps.join(later, "walk_id")
    return joined.where((F.col("_b") > F.col("batch")) & (F.col("pos") >= F.col("_p"))).select(*STEP_COLUMNS).distinct()


def live_steps(steps: DataFrame, mav: DataFrame) -> DataFrame:
    """Steps that no later batch has invalidated: the corpus read lazily from base and deltas."""
    later = mav.select("walk_id", F.col("p_min").alias("_p"), F.col("batch").alias("_b"))
    stale = (steps["walk_id"] == later["walk_id"]) & (later["_b"] > steps["batch"]) & (steps["pos"] >= later["_p"])
    return steps.join(later, stale, "left_anti")


def as_of(steps: DataFrame, mav: DataFrame, batch: int) -> DataFrame:
    """The corpus as it was after a batch."""
    return live_steps(steps.where(F.col("batch") <= batch), mav.where(F.col("batch") <= batch))


def compact(steps: DataFrame, mav: DataFrame, completed: int) -> tuple[DataFrame, DataFrame]:
    """(steps, mav) after dropping what batches up to the last completed one made stale; queries don't change."""
    return live_steps(steps, mav.where(F.col("batch") <= completed)), mav.where(F.col("batch") > completed)


def compact_vertices(steps: DataFrame, mav: DataFrame, vertices: DataFrame, completed: int) -> DataFrame:
    """steps without those at some vertices(vertex) that batches up to `completed` made stale; all else stays, mav too.

    A partial compaction: readers that keep mav see the same corpus.
    """
    inside = steps.join(vertices.select("vertex").distinct(), "vertex", "left_semi").select(*STEP_COLUMNS)
    outside = steps.join(vertices.select("vertex").distinct(), "vertex", "left_anti").select(*STEP_COLUMNS)
    return outside.unionByName(live_steps(inside, mav.where(F.col("batch") <= completed)))


def compact_with_ranges(steps: DataFrame, mav: DataFrame, completed: int) -> tuple[DataFrame, DataFrame]:
    """(steps after a last compaction, (vertex, next_min, next_max) of its live steps)."""
    from driftwalk.operators.lookup import next_ranges

    left = compact(steps, mav, completed)[0]
    return left, next_ranges(left)


def compact_by_position(steps: DataFrame, mav: DataFrame, length: int, completed: int) -> DataFrame:
    """As compact, by the positions of the invalidated suffixes one by one: equi-joins on (walk_id, pos) alone.

    For each position the latest batch that invalidates it decides, so a walk
    that many batches hit has no more than `length` rows.
    """
    last = mav.where(F.col("batch") <= completed).select("walk_id", F.col("batch").alias("_b"), F.explode(F.sequence("p_min", F.greatest(F.lit(length - 1), F.col("p_min")))).alias("pos"))
    last = last.groupBy("walk_id", "pos").agg(F.max("_b").alias("_b"))
    joined = steps.join(last, ["walk_id", "pos"], "left")
    return joined.where(F.col("_b").isNull() | (F.col("_b") <= F.col("batch"))).select(*STEP_COLUMNS)


def check_corpus(corpus: "Corpus") -> DataFrame:
    """(check, violations): what a consistent corpus must not hold, counted."""
    live, edges = corpus.live, corpus.edges
    follow = live.select("walk_id", (F.col("pos") - 1).alias("pos"), F.col("vertex").alias("_then"))
    pairs = live.join(follow, ["walk_id", "pos"], "left")
    known = edges.select(F.col("src").alias("vertex"), F.col("dst").alias("next"))
    first = live.where("pos = 0").select("walk_id", F.col("vertex").alias("_v"))
    parts = {
        "repeated position": live.groupBy("walk_id", "pos").agg(F.count("*").alias("n")).where("n > 1"),
        "gap in a walk": live.groupBy("walk_id").agg(F.count("*").alias("n"), F.max("pos").alias("m")).where("n <> m + 1"),
        "step without an edge": live.where("vertex <> next").join(known, ["vertex", "next"], "left_anti"),
        "next is not the next vertex": pairs.where("_then IS NOT NULL AND next <> _then"),
        "walk ends at a vertex with edges": pairs.where((F.col("_then").isNull()) & (F.col("pos") < corpus.config.length - 1)).join(edges.select(F.col("src").alias("vertex")), "vertex", "left_semi"),
        "walk doesn't begin at its start": corpus.starts.join(first, "walk_id", "left").where("_v IS NULL OR _v <> vertex"),
    }
    out = None
    for name, found in parts.items():
        row = found.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = row if out is None else out.unionByName(row)
    return out


def affected_fraction(mav: DataFrame, starts: DataFrame) -> DataFrame:
    """(batch, affected, walks, per_mille)."""
    walks = starts.agg(F.count("*").alias("walks"))
    counted = mav.groupBy("batch").agg(F.count("*").alias("affected")).join(F.broadcast(walks))
    return counted.withColumn("per_mille", F.expr("affected * 1000 div greatest(walks, 1L)"))


def extend(starts: DataFrame, edges_after: DataFrame) -> DataFrame:
    """(walk_id, vertex) of one new walk for each vertex that no walk starts from; ids follow the largest.

    Existing walks keep id and start, whatever the number of vertices becomes.
    """
    new = edges_after.select(F.col("src").alias("vertex")).distinct().join(starts.select("vertex").distinct(), "vertex", "left_anti")
    top = starts.agg(F.coalesce(F.max("walk_id"), F.lit(-1)).alias("_top"))
    # Numbered by counts of id ranges, so that no single task sorts all new vertices.
    ranged = new.withColumn("_block", F.expr("vertex div 4096"))
    blocks = ranged.groupBy("_block").agg(F.count("*").alias("_c"))
    sizes = blocks.withColumn("_before", F.sum("_c").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)))
    placed = ranged.join(sizes.select("_block", F.coalesce("_before", F.lit(0)).alias("_before")), "_block")
    numbered = placed.withColumn("_k", F.row_number().over(Window.partitionBy("_block").orderBy("vertex")))
    return numbered.join(F.broadcast(top)).select((F.col("_top") + F.col("_before") + F.col("_k")).alias("walk_id"), "vertex")


@dataclass(frozen=True)
class Change:
    """What a batch changes: edges(src, dst, present), and the rows it adds to mav, steps and starts."""

    number: int
    edges: DataFrame
    mav: DataFrame | None
    steps: DataFrame | None
    starts: DataFrame | None


@dataclass(frozen=True)
class Corpus:
    """A graph version with its walks: edges, steps (base and deltas), mav, starts, last batch.

    Each batch's own rows (changed edges, mav, fresh steps) are materialised
    once, so the plan of a later batch doesn't repeat the earlier ones.
    changes has them by batch, for stores that keep deltas.
    """

    edges: DataFrame
    steps: DataFrame
    mav: DataFrame
    starts: DataFrame
    batch: int
    config: WalkConfig
    changes: tuple[Change, ...] = field(default=())

    @property
    def live(self) -> DataFrame:
        return live_steps(self.steps, self.mav)

    def apply(self, batch: DataFrame, delete: bool = False, update_walks: bool = True) -> tuple["Corpus", DataFrame]:
        """(corpus after the batch, its affected walks). With update_walks false only the graph changes.

        The batch is set against the edges once; the edges themselves aren't written.
        """
        number = self.batch + 1
        known, batch = ["src", "dst"], cut(clean_batch(batch))
        changed = cut(batch.join(self.edges, known, "left_semi" if delete else "left_anti"))
        after = self.edges.join(changed, known, "left_anti") if delete else self.edges.select(*known).unionByName(changed)
        edge_change = changed.withColumn("present", F.lit(not delete))
        if not update_walks:
            change = Change(number, edge_change, None, None, None)
            return Corpus(after, self.steps, self.mav, self.starts, self.batch, self.config, (*self.changes, change)), self.mav.limit(0)
        live, graph = self.live, WalkGraph(after)
        mav = cut(with_reset(affected_walks(live, batch, number), graph.edges, self.starts))
        fresh, starts, new = resample(mav, live, graph, self.config, number), self.starts, None
        if not delete:
            new = cut(extend(starts, graph.edges))
            fresh = fresh.unionByName(as_steps(run_walkers(graph, initial_walkers(graph, new, self.config, number), self.config), self.config))
            starts = starts.unionByName(new)
        fresh = cut(fresh)
        steps, mavs = self.steps.unionByName(fresh), self.mav.unionByName(mav)
        if number % self.config.merge_frequency == 0:
            steps, mavs = compact(steps, mavs, number)
        change = Change(number, edge_change, mav, fresh, new)
        return Corpus(graph.edges, steps, mavs, starts, number, self.config, (*self.changes, change)), mav


MAV_SCHEMA = "batch int, walk_id long, p_min int, vertex long, reset boolean"


def new_corpus(edges: DataFrame, config: WalkConfig, vertices: DataFrame | None = None) -> Corpus:
    graph = WalkGraph(edges)
    vertices = id_domain(graph.edges) if vertices is None else vertices
    return Corpus(graph.edges, cut(generate(None, config, vertices, graph=graph)), edges.sparkSession.createDataFrame([], MAV_SCHEMA), starts_of(vertices, config.walks_per_vertex), 0, config)
