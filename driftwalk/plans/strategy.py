"""Choosing how walkers hop: shuffled joins, or a kernel over a broadcast graph.

Both draw by the same pure function, so they give the same rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwalk.config import WalkConfig
from driftwalk.functions.rng import BATCH_STEP, HOP_STEP, MODULUS, MULTIPLIER, SCRAMBLE
from driftwalk.plans.materialise import stored
from driftwalk.operators.walks import WalkGraph, as_steps, generate, id_domain, initial_walkers, run_walkers, starts_of


def fits_broadcast(edges: DataFrame, config: WalkConfig) -> bool:
    """Whether the graph has at most config.broadcast_edges edges; reads no more than that many."""
    return edges.limit(config.broadcast_edges + 1).count() <= config.broadcast_edges


def compressed_rows(edges: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, targets), sorted; only for graphs that fits_broadcast() has admitted."""
    table = edges.select("src", "dst").toArrow()
    src, dst = (table.column(c).to_numpy().astype(np.int64) for c in ("src", "dst"))
    order = np.lexsort((dst, src))
    ids, first = np.unique(src[order], return_index=True)
    return ids, np.append(first, len(src)), dst[order]


def _walk_batch(walk_id, vertex, ids, offsets, targets, length, seed, batch):
    """An array walkers x length; -1 after a dead end."""
    path = np.full((len(walk_id), length), -1, np.int64)
    if length:
        path[:, 0] = vertex
    cur, live = vertex.copy(), np.ones(len(vertex), bool)
    for hop in range(1, length):
        at = np.searchsorted(ids, cur) if len(ids) else np.zeros(len(cur), np.int64)
        safe = np.minimum(at, max(len(ids) - 1, 0))
        live &= (ids[safe] == cur) if len(ids) else False
        if not live.any():
            break
        degree = np.where(live, offsets[safe + 1] - offsets[safe], 1)
        draw = ((walk_id % MODULUS) * MULTIPLIER + hop * HOP_STEP + seed + batch * BATCH_STEP) % MODULUS * SCRAMBLE % MODULUS
        cur = np.where(live, targets[np.where(live, offsets[safe] + draw % degree, 0)], cur)
        path[live, hop] = cur[live]
    return path


def generate_broadcast(edges: DataFrame, config: WalkConfig, batch: int = 0) -> DataFrame:
    """First-order corpus: all hops of a walker in one task, without a shuffle.

    Raises ValueError for a graph of more than config.broadcast_edges edges.
    """
    if config.model != "deepwalk":
        raise ValueError("the broadcast kernel walks first-order models")
    spark, edges = edges.sparkSession, stored(edges.select("src", "dst"), "broadcast-edges")
    if not fits_broadcast(edges, config):
        raise ValueError(f"more than {config.broadcast_edges} edges")
    held = spark.sparkContext.broadcast(compressed_rows(edges))
    length, seed = config.length, config.seed

    def kernel(frames):
        ids, offsets, targets = held.value
        for frame in frames:
            walk, vertex = frame["walk_id"].to_numpy(np.int64), frame["vertex"].to_numpy(np.int64)
            path = _walk_batch(walk, vertex, ids, offsets, targets, length, seed, batch)
            yield pd.DataFrame({"walk_id": walk, "path": [row[row >= 0] for row in path]})

    paths = starts_of(id_domain(edges), config.walks_per_vertex).mapInPandas(kernel, "walk_id long, path array<long>")
    whole = WalkConfig(length=length, segment_hops=max(1, length))
    return as_steps(paths.select("walk_id", F.lit(0).alias("p0"), "path", F.lit(batch).alias("batch")), whole)


def generate_auto(edges: DataFrame, config: WalkConfig) -> DataFrame:
    """By the kernel where the model and the size of the graph allow, else by joins."""
    edges = stored(edges.select("src", "dst"), "counted-edges")
    if config.model == "deepwalk" and fits_broadcast(edges, config):
        return generate_broadcast(edges, config)
    return generate(edges, config)


__all__ = ["WalkGraph", "compressed_rows", "fits_broadcast", "generate_auto", "generate_broadcast", "initial_walkers", "run_walkers"]
