"""Operator 6: exact top-k inner products by aggregation without random access.

Vectors become whole numbers, floor(scale * x). A block of candidates has one
list a dimension, sorted by value. For a query, lists are read in order, from
the end that favours the query's sign, some entries at a time. Each candidate
has a lower and an upper bound of its score: what was read of it, and the last
read value of each list for the rest. Reading stops when no candidate outside
the best k, seen or unseen, can still qualify; the scores of those that can
are then resolved. The best scores of earlier blocks are kept and let later
blocks stop sooner.

Candidates are packed into blocks once. Queries come in waves of bounded size:
a wave is broadcast, each task reads blocks of candidates and keeps the k best
of each query, and a wave's rows are written before the next one is read. So
what is shuffled are the vectors, and k rows a query and task. A first pass of
the wave over one block gives each query a floor: the k-th best score of some
candidates, which the k-th best of all can't be below.

Vectors that are null or hold null or non-finite components take no part. A
shorter vector counts as filled up by zeros. Scores that don't fit 63 bits
raise a ValueError. Repeated ids are candidates each, but a row never meets
another row of its own id. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block of candidates and of queries, at most; partitions hold half of that, so that few blocks are remainders.
CANDIDATES, QUERIES = 8192, 512
#: Bytes of query vectors that are broadcast at once.
WAVE_BYTES = 16 << 20
#: The floor of a query that has none.
LOWEST = -(1 << 63)
#: Entries read of each list between two looks at the bounds.
DEPTH = 256


class SortedLists:
    """One sorted list a dimension over a block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        order = np.argsort(vectors, axis=0, kind="stable")
        self.order = np.ascontiguousarray(order.T)
        self.values = np.ascontiguousarray(np.take_along_axis(vectors, order, axis=0).T)
        self.dense = np.ascontiguousarray(vectors, np.float64)
        self.doubles, self.largest = self.values.astype(np.float64), int(np.abs(vectors).max(initial=0))

    def top(self, query_id: int, query: np.ndarray, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, scores, entries read) of candidates that may be among the best k; floor: the k-th best score so far."""
        n = len(self.ids)
        plus, minus = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        active, own = np.concatenate([plus, minus]), self.ids == query_id
        if not len(active):
            return np.arange(n)[~own], np.zeros(int((~own).sum()), np.int64), 0
        small = self.largest * int(np.abs(query).max()) * 2 * len(active) < 1 << 52  # doubles hold all sums exactly
        values = self.doubles if small else self.values
        weight = query[active].astype(values.dtype)
        worst = np.concatenate([values[plus, 0], values[minus, -1]]) * weight
        # The last read values at each look, and their sum: what a row that wasn't seen has at most.
        looks = np.arange(DEPTH, n, DEPTH)
        last = np.concatenate([values[plus[:, None], n - looks], values[minus[:, None], looks - 1]]) * weight[:, None]
        unseen = last.sum(axis=0)

        def entries(read: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
            rows = np.concatenate([self.order[plus, n - depth : n - read], self.order[minus, read:depth]])
            return rows, np.concatenate([values[plus, n - depth : n - read], values[minus, read:depth]]) * weight[:, None]

        def resolved(look: int, bar, parts) -> tuple[np.ndarray, np.ndarray, int]:
            # Upper bound of a row: its read entries, and the last read values of all other lists.
            upper = unseen[look] + sum(self._add(r, g - last[:, look, None], n) for r, g in parts)
            keep = np.flatnonzero((upper >= bar) & ~own)
            if not small:
                scores = self.vectors[keep] @ query
            elif 4 * len(keep) < n:
                scores = self.dense[keep] @ query.astype(np.float64)
            else:  # cheaper than picking rows
                scores = (self.dense @ query.astype(np.float64))[keep]
            return keep, scores.astype(np.int64), int(looks[look]) * len(active)

        if floor is not None:
            # The k-th best score so far bounds what qualifies: read on until no unseen row can reach it.
            ends = np.flatnonzero(unseen < floor)
            if len(ends):
                return resolved(int(ends[0]), floor, [entries(0, int(looks[ends[0]]))])
        lower = np.full(n, worst.sum())  # what a candidate has at least
        parts, read = [], 0
        for look, depth in enumerate([*looks.tolist(), n]):
            rows, gained = entries(read, depth)
            lower += self._add(rows, gained - worst[:, None], n)
            read = depth
            if read == n:
                break
            parts.append((rows, gained))
            others = lower[~own]
            kth = np.partition(others, -k)[-k] if len(others) >= k else None
            bar = kth if floor is None else floor if kth is None else max(kth, floor)
            if bar is not None and unseen[look] < bar:
                return resolved(look, bar, parts)
        lower = lower.astype(np.int64)
        keep = np.flatnonzero(~own & (lower >= (floor if floor is not None else lower.min())))
        return keep, lower[keep], read * len(active)

    @staticmethod
    def _add(rows: np.ndarray, amounts: np.ndarray, n: int) -> np.ndarray:
        """Sums of amounts by row, in the amounts' type."""
        if amounts.dtype == np.float64:
            return np.bincount(rows.ravel(), amounts.ravel(), n)
        out = np.zeros(n, amounts.dtype)
        np.add.at(out, rows.ravel(), amounts.ravel())
        return out


def whole_numbers(embedding: Column, scale: int) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def _vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    x = F.col(vector_col)
    usable = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return df.where(usable & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), whole_numbers(x, scale).alias("v"))


def _packed(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows of (name, ids, dims, data): blocks of at most `size` vectors, as bytes."""
    schema = pa.schema([("ids", pa.binary()), ("dims", pa.int32()), ("data", pa.binary())])

    def pack(batches):
        ids, vectors = [], []

        def block():
            dims = max(map(len, vectors))
            grid = np.zeros((len(vectors), dims), "<i8")
            for k, v in enumerate(vectors):
                grid[k, : len(v)] = v
            narrow = "<i2" if np.abs(grid).max(initial=0) < 32000 else "<i8"
            return pa.RecordBatch.from_pydict({"ids": [np.array(ids, "<i8").tobytes()], "dims": [dims if narrow == "<i8" else -dims], "data": [grid.astype(narrow).tobytes()]}, schema)

        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                ids.append(i)
                vectors.append(v)
                if len(ids) == size:
                    yield block()
                    ids, vectors = [], []
        if ids:
            yield block()

    return rows.mapInArrow(pack, "ids binary, dims int, data binary").select(*(F.col(c).alias(f"{name}_{c}") for c in ("ids", "dims", "data")))


def _unpack(ids: bytes, dims: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8").astype(np.int64)
    return i, np.frombuffer(data, "<i2" if dims < 0 else "<i8").astype(np.int64).reshape(len(i), abs(dims))


def _waves(queries: DataFrame):
    """Runs of query blocks of at most about WAVE_BYTES, read partition by partition."""
    run, held = [], 0
    for row in queries.toLocalIterator():
        run.append((bytes(row.q_ids), row.q_dims, bytes(row.q_data)))
        held += len(row.q_ids) + len(row.q_data)
        if held >= WAVE_BYTES:
            yield run
            run, held = [], 0
    if run:
        yield run


def top_k(df: DataFrame, query_filter: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", lanes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best, ties to the smaller vec_id.

    A wave of queries meets all candidate blocks, in `lanes` tasks at most;
    each task keeps k rows a query, so that lanes * k rows a query meet at the end.
    """
    from driftwalk.llm.common import shuffle_partitions, staged

    spark = df.sparkSession
    rows = _vectors(df, id_col, vector_col, scale)
    lanes = lanes or shuffle_partitions(spark)
    spread = max(1, -(-2 * rows.count() // CANDIDATES))
    candidates = staged(_packed(rows.repartition(spread, F.xxhash64("vec_id")), CANDIDATES, "c"), "topk-candidates")
    queries = staged(_packed(rows.where(query_filter), QUERIES, "q"), "topk-queries")
    schema, found = "query_id long, vec_id long, score long", None
    waves = _waves(queries)
    wave = next(waves, [])
    while wave is not None:
        later = next(waves, None)
        floors = _floors(spark, wave, candidates, k, lanes)
        best = candidates.repartition(min(lanes, spread)).mapInArrow(_search(spark.sparkContext.broadcast((wave, floors)), k), schema)
        best = best if later is None else staged(best, "topk-wave")
        found, wave = best if found is None else found.unionByName(best), later
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _floors(spark, wave: list, candidates: DataFrame, k: int, lanes: int) -> list[np.ndarray]:
    """For each query of a wave, the k-th best score in one block of candidates; a query block is a task."""
    some = [(bytes(r.c_ids), r.c_dims, bytes(r.c_data)) for r in candidates.limit(1).collect()]
    if not wave or not some:
        return [np.full(len(ids) // 8, LOWEST) for ids, _, _ in wave]
    held = spark.sparkContext.broadcast((wave, some[0]))

    def first(batches):
        queries, block = held.value
        for batch in batches:
            for j in batch.column("id").to_pylist():
                best, own = {}, _unpack(*queries[j])
                _compare(best, [own], None, *_unpack(*block), k)
                floor = np.array([best[0, i][1][-1] if len(best[0, i][1]) >= k else LOWEST for i in range(len(own[0]))], "<i8")
                yield pa.RecordBatch.from_pydict({"id": [j], "floor": [floor.tobytes()]}, pa.schema([("id", pa.int64()), ("floor", pa.binary())]))

    found = {r.id: np.frombuffer(bytes(r.floor), "<i8") for r in spark.range(0, len(wave), 1, min(lanes, len(wave))).mapInArrow(first, "id long, floor binary").collect()}
    return [found[j] for j in range(len(wave))]


def _search(held, k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(batches):
        wave, floors = held.value
        queries = [_unpack(*block) for block in wave]
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for ids, dims, data in zip(*(batch.column(c) for c in ("c_ids", "c_dims", "c_data")), strict=True):
                _compare(best, queries, floors, *_unpack(ids.as_py(), dims.as_py(), data.as_py()), k)
        for b, (ids, _) in enumerate(queries):
            own = [(np.full(len(best[b, i][0]), ids[i]), *best[b, i]) for i in range(len(ids)) if (b, i) in best]
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*own, strict=True)], schema=schema)

    return search


def _compare(best: dict, queries: list[tuple[np.ndarray, np.ndarray]], floors: list[np.ndarray] | None, other: np.ndarray, values: np.ndarray, k: int) -> None:
    """Takes a block of candidates into the k best (ids, scores) of each query, those of at least its floor."""
    widest = max([values.shape[1], *(v.shape[1] for _, v in queries)])
    lists = SortedLists(other, np.pad(values, ((0, 0), (0, widest - values.shape[1]))))
    for b, (ids, vectors) in enumerate(queries):
        if lists.largest * int(np.abs(vectors).max(initial=0)) * widest >= 1 << 62:
            raise ValueError("scores don't fit 63 bits")
        vectors = np.pad(vectors, ((0, 0), (0, widest - vectors.shape[1])))
        for i in range(len(ids)):
            old = best.get((b, i))
            floor = int(floors[b][i]) if floors is not None and floors[b][i] > LOWEST else None
            if old is not None and len(old[1]) >= k:
                floor = int(old[1][-1]) if floor is None else max(floor, int(old[1][-1]))
            rows, scores, _ = lists.top(int(ids[i]), vectors[i], k, floor)
            if floor is not None:
                rows, scores = rows[scores >= floor], scores[scores >= floor]
            v, s = other[rows], scores
            if old is not None:
                v, s = np.concatenate([old[0], v]), np.concatenate([old[1], s])
            by = np.lexsort((v, -s))[:k]
            best[b, i] = (v[by], s[by])
