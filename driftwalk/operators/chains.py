"""Starts of Metropolis-Hastings chains: of some proposals for each second-order state, the first of the largest weight.

A state's proposals are neighbors of its current vertex, their weights ask for
edges of its previous one. Whole neighbor lists are stored once; states then
go, packed, from the list of cur to the task of prev, which holds prev's edges.
That is done in passes over groups of prev, each of about STATES states, and a
pass drops its shuffle files: disk holds the states of one pass alone. States
with a vertex of more than HUB neighbors take joins, which spread a hub's rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwalk.functions.rng import HOP_STEP, MODULUS, MULTIPLIER, SCRAMBLE, portable_draw
from driftwalk.operators import graph
from driftwalk.operators.triangles import _MIX, BLOCKS_SQL, PACKED, _dealt, _group, _unpack
from driftwalk.plans.materialise import stored

#: Neighbors from which on a vertex is a hub; states of a pass; edges and states of a task; rows given back at once.
HUB, STATES, PER_TASK, ROWS = 1_000_000, 32_000_000, 1_000_000, 100_000
LISTS = pa.schema([("u", pa.int64()), ("vs", pa.list_(pa.int64())), ("prevs", pa.list_(pa.int64()))])


def chain_starts(edges: DataFrame, weights: tuple[int, int, int], trials: int, asked: DataFrame | None = None) -> DataFrame:
    """(prev, cur, last) of the states asked(prev, cur), distinct and edges all of them; of all edges without asked.

    edges: stored, both directions, distinct, ids from 0 on. weights: back to prev, to its neighbors, onward.
    """
    hubs = sorted(r.vertex for r in graph.degrees(edges).where(F.col("degree") > HUB).select("vertex").collect())  # at most edges / HUB
    states = (edges if asked is None else asked).count()
    passes = max(1, -(-states // STATES))
    lists = stored(_lists(edges, asked, hubs), "chain-lists", packed=True)
    parts = [stored(_pass(lists, k, passes, states, weights, trials, hubs), "chain-starts", packed=True) for k in range(passes)]
    if hubs:
        pairs = edges.select(F.col("src").alias("prev"), F.col("dst").alias("cur")) if asked is None else asked.select("prev", "cur")
        parts.append(_by_joins(edges, pairs.where(F.col("prev").isin(hubs) | F.col("cur").isin(hubs)), weights, trials))
    return reduce(DataFrame.unionByName, parts)


def _by_joins(edges: DataFrame, asked: DataFrame, weights: tuple[int, int, int], trials: int) -> DataFrame:
    """The same with a row for each proposal."""
    deg = graph.degrees(edges).select(F.col("vertex").alias("cur"), "degree")
    tried = asked.join(deg, "cur").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    tried = tried.withColumn("idx", portable_draw(F.col("prev") * 1000003 + F.col("cur"), F.col("k")) % F.col("degree"))
    options = tried.join(graph.adjacency(edges).select(F.col("u").alias("cur"), "idx", F.col("v").alias("cand")), ["cur", "idx"])
    known = edges.select(F.col("src").alias("prev"), F.col("dst").alias("cand"), F.lit(True).alias("linked"))
    back, near, far = weights
    weight = F.when(F.col("cand") == F.col("prev"), F.lit(back)).when(F.col("linked"), F.lit(near)).otherwise(F.lit(far)).cast("long")
    weighed = options.join(known, ["prev", "cand"], "left")
    return weighed.groupBy("prev", "cur").agg(F.max_by("cand", weight * 100 - F.col("k")).alias("last"))


def _gathered(batches):
    """{half of a task's number: (blocks of the even task, blocks of the odd one)} of a partition."""
    held: dict[int, tuple[list, list]] = {}
    for batch in batches:
        for task, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(task >> 1, ([], []))[task & 1].append(block)
    return held


def _joined(blocks: list[bytes], width: int) -> np.ndarray:
    return np.concatenate([_unpack(b, width) for b in blocks], axis=1) if blocks else np.zeros((width, 0), np.int64)


def _in_order(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(u) and max(u.max(), v.max()) < 1 << 31:
        key = np.sort((u << 32) | v)
        return key >> 32, key & 0xFFFFFFFF
    order = np.lexsort((v, u))
    return u[order], v[order]


def _lists(edges: DataFrame, asked: DataFrame | None, hubs: list[int]) -> DataFrame:
    """(u, vs, prevs): the neighbors of each u that is no hub, by id, and the asked states' prev; null: all neighbors."""
    n = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), edges.count() // PER_TASK + 1)
    rows, whole = edges.select("src", "dst", F.lit(0).alias("kind")), asked is None
    if not whole:
        rows = rows.unionByName(asked.select(F.col("cur").alias("src"), F.col("prev").alias("dst"), F.lit(1).alias("kind")))

    def deal(batches):
        held: list[np.ndarray] = []

        def packed():
            u, v, kind = np.concatenate(held, axis=1)
            held.clear()
            if hubs:
                some = ~np.isin(u, hubs)
                u, v, kind = u[some], v[some], kind[some]
            if len(u):
                yield _dealt(2 * _group(u, n) + kind, u, v)

        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)]))
            if sum(h.shape[1] for h in held) >= PACKED:
                yield from packed()
        if held:
            yield from packed()

    def listed(batches):
        held = _gathered(batches)
        for task in sorted(held):
            even, odd = held.pop(task)
            u, v = _in_order(*_joined(even, 2))
            first = np.flatnonzero(np.diff(u, prepend=-1))
            ends = np.append(first, len(u))
            cur, prev = _in_order(*_joined(odd, 2))
            at = 0
            while at < len(first):
                to = max(at + 1, min(at + ROWS, int(np.searchsorted(ends, ends[at] + PACKED, side="right")) - 1))
                ids = u[first[at:to]]
                offsets = ends[at : to + 1]
                vs = pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(v[offsets[0] : offsets[-1]]))
                if whole:
                    prevs = pa.nulls(to - at, pa.list_(pa.int64()))
                else:
                    a, b = np.searchsorted(cur, ids), np.searchsorted(cur, ids, side="right")
                    prevs = pa.ListArray.from_arrays(pa.array(np.append(a, b[-1]) - a[0], pa.int32()), pa.array(prev[a[0] : b[-1]]))
                yield pa.RecordBatch.from_arrays([pa.array(ids), vs, prevs], schema=LISTS)
                at = to

    return rows.mapInArrow(deal, BLOCKS_SQL).repartition(n, F.expr("task div 2")).mapInArrow(listed, "u long, vs array<long>, prevs array<long>")


def _draws(prev: np.ndarray, cur: np.ndarray, trial: int) -> np.ndarray:
    """portable_draw(prev * 1000003 + cur, trial)."""
    mixed = (prev * 1000003 + cur) % MODULUS * MULTIPLIER + trial * HOP_STEP
    return mixed % MODULUS * SCRAMBLE % MODULUS


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of an Arrow column of lists."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _pass(lists: DataFrame, number: int, passes: int, states: int, weights: tuple[int, int, int], trials: int, hubs: list[int]) -> DataFrame:
    """(prev, cur, last) of the states whose prev is of a pass and no hub."""
    spark = lists.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), states // passes // PER_TASK + 1)

    def mine(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the ids are of this pass, the tasks of these)."""
        group = _group(ids, n * passes)
        some = np.flatnonzero(group % passes == number)
        return some, group[some] // passes

    def propose(batches):
        for batch in batches:
            u, (vs, ends), given = batch.column(0).to_numpy(), _flat(batch.column(1)), batch.column(2).null_count == 0
            prevs, upto = _flat(batch.column(2)) if given else (vs, ends)
            at = 0
            while at < len(u):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + PACKED, side="right")) - 1)
                size = np.diff(ends[at : to + 1])
                own, task = mine(u[at:to])
                rows = np.repeat(np.arange(to - at), size)
                slot = np.full(to - at, -1)
                slot[own] = task
                some = slot[rows] >= 0
                if some.any():
                    yield _dealt(2 * slot[rows][some], u[at:to][rows][some], vs[ends[at] : ends[to]][some])
                for low in range(upto[at], upto[to], PACKED):
                    high = min(low + PACKED, int(upto[to]))
                    prev = prevs[low:high]
                    row = np.searchsorted(upto, np.arange(low, high), side="right") - 1
                    some, task = mine(prev)
                    if hubs and len(some):
                        light = ~np.isin(prev[some], hubs)
                        some, task = some[light], task[light]
                    if len(some):
                        prev, row = prev[some], row[some]
                        cur, begin, deg = u[row], ends[row], ends[row + 1] - ends[row]
                        yield _dealt(2 * task + 1, prev, cur, *(vs[begin + _draws(prev, cur, k) % deg] for k in range(trials)))
                at = to

    def resolve(batches):
        held = _gathered(batches)
        for task in sorted(held):
            even, odd = held.pop(task)
            if not odd:
                continue
            edge, state = _joined(even, 2), _joined(odd, 2 + trials)
            ids = None
            if max(edge.max(initial=0), state.max(initial=0)) >= 1 << 31:  # numbers of ids in their place: two must fit 63 bits
                ids = np.unique(np.concatenate([edge.ravel(), state.ravel()]))
                edge, state = np.searchsorted(ids, edge), np.searchsorted(ids, state)
            state = state[:, np.lexsort((state[1], state[0]))]
            keys = np.sort((edge[0] << 32) | edge[1])
            # Most proposals aren't linked: a table of hashes rules them out.
            shift = np.uint64(64 - min(25, max(10, len(keys).bit_length() + 3)))
            hashed = lambda k: (k.astype(np.uint64) * _MIX) >> shift
            seen = np.zeros(1 << (64 - int(shift)), bool)
            with np.errstate(over="ignore"):
                seen[hashed(keys)] = True
                for low in range(0, state.shape[1], ROWS):
                    prev, cur, *cands = state[:, low : low + ROWS]
                    best, last = np.full(len(prev), -1 << 40), cands[0].copy()
                    for k, cand in enumerate(cands):
                        key = (prev << 32) | cand
                        linked = seen[hashed(key)]
                        maybe = np.flatnonzero(linked)
                        place = np.minimum(np.searchsorted(keys, key[maybe]), len(keys) - 1)
                        linked[maybe] = keys[place] == key[maybe]
                        score = np.where(cand == prev, weights[0], np.where(linked, weights[1], weights[2])) * 100 - k
                        better = score > best
                        best[better], last[better] = score[better], cand[better]
                    out = (prev, cur, last) if ids is None else (ids[prev], ids[cur], ids[last])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["prev", "cur", "last"])

    dealt = lists.mapInArrow(propose, BLOCKS_SQL).repartition(n, F.expr("task div 2"))
    return dealt.mapInArrow(resolve, "prev long, cur long, last long")
