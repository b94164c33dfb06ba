"""Ordered maps and sequences as DataFrames.

A map is rows (key, value) with distinct keys; a sequence is rows (idx, value)
with idx from 0. Running values over a whole sequence go through block sums:
blocks run in parallel and only one row per block is ordered globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwalk.functions.rng import portable_draw
from driftwalk.plans.materialise import cut

BLOCK = 1 << 16


def prefix_sums(seq: DataFrame, inclusive: bool = False, block: int = BLOCK, backward: bool = False) -> DataFrame:
    """(idx, value, prefix): the sum of what comes before; with backward, of what comes after."""
    way = F.desc if backward else F.asc
    blocked = seq.withColumn("_b", F.expr(f"idx div {block}"))
    sums = blocked.groupBy("_b").agg(F.sum("value").alias("_s"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy(way("_b")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_b", "_before")
    inner = F.sum("value").over(Window.partitionBy("_b").orderBy(way("idx")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = blocked.withColumn("_in", inner).join(before, "_b")
    return out.select("idx", "value", (F.col("_before") + F.col("_in") - (F.lit(0) if inclusive else F.col("value"))).alias("prefix"))


def ranks(keys: DataFrame, partitions: int | None = None) -> DataFrame:
    """(key, rank): rank from 0 among distinct keys, by range partitions and their sizes.

    Partitions are written once: sizes and keys must come from the same ranges, whatever is retried.
    """
    n = partitions or int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = cut(keys.select("key").distinct().repartitionByRange(n, "key").withColumn("_p", F.spark_partition_id()))
    sizes = sorted_.groupBy("_p").agg(F.count("*").alias("_c"), F.min("key").alias("_lo"), F.max("key").alias("_hi"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_lo").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = sorted_.withColumn("_in", F.row_number().over(Window.partitionBy("_p").orderBy("key")) - 1)
    bounds = before.select(F.col("_p"), "_before")
    return placed.join(F.broadcast(bounds), "_p").select("key", (F.col("_before") + F.col("_in")).cast("long").alias("rank"))


def select_rank(keys: DataFrame, i: int) -> DataFrame:
    return ranks(keys).where(F.col("rank") == i)


def successor(keys: DataFrame, key) -> DataFrame:
    return keys.where(F.col("key") > key).agg(F.min("key").alias("key"))


def predecessor(keys: DataFrame, key, or_equal: bool = False) -> DataFrame:
    return keys.where(F.col("key") <= key if or_equal else F.col("key") < key).agg(F.max("key").alias("key"))


def key_range(pairs: DataFrame, low, high) -> DataFrame:
    return pairs.where(F.col("key").between(low, high))


def range_aggregate(pairs: DataFrame, low, high, how: Column) -> DataFrame:
    return key_range(pairs, low, high).agg(how)


def augmented_select(pairs: DataFrame, limit) -> DataFrame:
    """(key): the first key at which the running sum of value exceeds limit."""
    seq = ranks(pairs).join(pairs, "key").select(F.col("rank").alias("idx"), "value", "key")
    running = prefix_sums(seq, inclusive=True).join(seq.select("idx", "key"), "idx")
    return running.where(F.col("prefix") > limit).agg(F.min("key").alias("key"))


def kth_smallest(values: DataFrame, k: int) -> DataFrame:
    """(value): the k-th smallest from 0, with repeats.

    Counts by value give its place; ties need no extra rows.
    """
    counts = values.groupBy("value").agg(F.count("*").alias("c"))
    seq = ranks(counts.select(F.col("value").alias("key"))).join(counts, F.col("key") == F.col("value")).select(F.col("rank").alias("idx"), F.col("c").alias("value"), "key")
    run = prefix_sums(seq).join(seq.select("idx", "key"), "idx")
    return run.where((F.col("prefix") <= k) & (F.col("prefix") + F.col("value") > k)).select(F.col("key").alias("value"))


def range_minimum(seq: DataFrame, queries: DataFrame, block: int = 1024) -> DataFrame:
    """queries(q, low, high) with minimum: block minima serve whole blocks, rows only the ends."""
    blocked = seq.withColumn("_b", F.expr(f"idx div {block}"))
    minima = blocked.groupBy("_b").agg(F.min("value").alias("m"))
    lo, hi = F.expr(f"low div {block}"), F.expr(f"high div {block}")
    inner = queries.where(hi - lo > 1).select("q", F.explode(F.sequence(lo + 1, hi - 1)).alias("_b")).join(minima, "_b").select("q", "m")
    edge = queries.select("q", "low", "high", F.explode(F.array_distinct(F.array(lo, hi))).alias("_b")).join(blocked, "_b").where("idx BETWEEN low AND high").select("q", F.col("value").alias("m"))
    return queries.join(inner.unionByName(edge).groupBy("q").agg(F.min("m").alias("minimum")), "q", "left")


def map_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, value): the value of b wins."""
    right = b.select("key", F.col("value").alias("_v"), F.lit(True).alias("_there"))
    return a.join(right, "key", "full_outer").select("key", F.when(F.col("_there"), F.col("_v")).otherwise(F.col("value")).alias("value"))


def map_intersect(a: DataFrame, b: DataFrame, combine: Column | None = None) -> DataFrame:
    """(key, value) of keys in both; combine is an expression over left and right."""
    both = a.select("key", F.col("value").alias("left")).join(b.select("key", F.col("value").alias("right")), "key")
    return both.select("key", (F.col("right") if combine is None else combine).alias("value"))


def map_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("key"), "key", "left_anti")


def multi_insert(base: DataFrame, batch: DataFrame, reduce: Column) -> DataFrame:
    """Bulk upsert: batch rows of a key are reduced, then replace the base value."""
    return map_union(base, batch.groupBy("key").agg(reduce.alias("value")))


def histogram(values: DataFrame, bucket: Column) -> DataFrame:
    return values.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def collect_reduce(pairs: DataFrame, reduce: Column) -> DataFrame:
    return pairs.groupBy("key").agg(reduce.alias("value"))


def sort_dedup(values: DataFrame) -> DataFrame:
    """(idx, value): distinct values in order."""
    return ranks(values.select(F.col("value").alias("key"))).select(F.col("rank").alias("idx"), F.col("key").alias("value"))


def pack_index(flags: DataFrame) -> DataFrame:
    """(slot, idx): indices of set flags(idx, flag), numbered from 0."""
    kept = flags.where("flag").select(F.col("idx").alias("key"))
    return ranks(kept).select(F.col("rank").alias("slot"), F.col("key").alias("idx"))


def split_two(rows: DataFrame, flag: Column) -> tuple[DataFrame, DataFrame]:
    """(unset, set); a null flag counts as unset."""
    held = F.coalesce(flag, F.lit(False))
    return rows.where(~held), rows.where(held)


def quantified(rows: DataFrame, predicate: Column) -> DataFrame:
    """(all_of, any_of, none_of, count_if, first_index); first_index is null where nothing fits."""
    fits = F.coalesce(predicate, F.lit(False))
    counted = F.count_if(fits)
    return rows.agg((counted == F.count("*")).alias("all_of"), (counted > 0).alias("any_of"), (counted == 0).alias("none_of"), counted.alias("count_if"), F.min(F.when(fits, F.col("idx"))).alias("first_index"))


def is_sorted(seq: DataFrame) -> DataFrame:
    """(sorted, sorted_until): the first idx whose value is smaller than its predecessor's, else the count.

    Neighbors meet by a join on idx, not by one ordered partition.
    """
    after = seq.select((F.col("idx") - 1).alias("idx"), F.col("value").alias("_next"))
    breaks = seq.join(after, "idx").where(F.col("_next") < F.col("value")).agg(F.min(F.col("idx") + 1).alias("_at"))
    return seq.agg(F.count("*").alias("n")).join(F.broadcast(breaks)).select(F.col("_at").isNull().alias("sorted"), F.coalesce("_at", "n").alias("sorted_until"))


def unique_runs(seq: DataFrame) -> DataFrame:
    """(idx, value): the first element of each run of equal values."""
    before = seq.select((F.col("idx") + 1).alias("idx"), F.col("value").alias("_prev"), F.lit(True).alias("_has"))
    joined = seq.join(before, "idx", "left")
    return joined.where(F.col("_has").isNull() | ~F.col("value").eqNullSafe(F.col("_prev"))).select("idx", "value")


def rotate(seq: DataFrame, by: int, n: int) -> DataFrame:
    return seq.select(F.pmod(F.col("idx") - by, F.lit(n)).alias("idx"), "value")


def reverse(seq: DataFrame, n: int) -> DataFrame:
    return seq.select((F.lit(n - 1) - F.col("idx")).alias("idx"), "value")


def append(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    return a.select("idx", "value").unionByName(b.select((F.col("idx") + n).alias("idx"), "value"))


def shuffled(seq: DataFrame, seed: int) -> DataFrame:
    """A seeded permutation: the same for the same seed and rows."""
    keyed = seq.select(F.struct(portable_draw("idx", 0, seed).alias("draw"), "idx").alias("key"), "value")
    return ranks(keyed).join(keyed, "key").select(F.col("rank").alias("idx"), "value")


def sort_values(seq: DataFrame) -> DataFrame:
    """(idx, value): all values in order, repeats in the order they had."""
    return ranks(seq.select(F.struct("value", "idx").alias("key"))).select(F.col("rank").alias("idx"), F.col("key.value").alias("value"))


def merge_sorted(a: DataFrame, b: DataFrame) -> DataFrame:
    """(idx, value) of two sorted sequences; of equal values those of a come first.

    A value's place is its own index and the number of the other's values
    before it, which comes from their counts by value: no sort of all rows.
    """
    def before(side: DataFrame, inclusive: bool) -> DataFrame:
        # Values of the side are sorted, so the first or last index of a value counts what stands before it.
        edge = F.max("idx") + 1 if inclusive else F.min("idx")
        return side.groupBy("value").agg(edge.cast("long").alias("n"))

    def placed(own: DataFrame, other: DataFrame, inclusive: bool) -> DataFrame:
        marks = before(other, inclusive).select("value", "n", F.lit(True).alias("_mark"))
        # For values that the other side lacks: the count up to its largest smaller value, filled in by block maxima.
        least = before(other, True).select("value", F.col("n").alias("upto"))
        values = own.select("value").distinct().join(marks, "value", "left")
        return own.join(filled(values, least), "value").select((F.col("idx") + F.col("n")).alias("idx"), "value")

    def filled(values: DataFrame, least: DataFrame) -> DataFrame:
        known = values.where("_mark").select("value", "n")
        asked = values.where("_mark IS NULL").select("value", F.lit(0).cast("long").alias("upto"), F.lit(1).alias("ask"))
        both = least.select("value", "upto", F.lit(0).alias("ask")).unionByName(asked)
        order = ranks(both.select(F.struct("value", "ask").alias("key"))).select(F.col("rank").alias("idx"), F.col("key.value").alias("value"), F.col("key.ask").alias("ask"))
        run = prefix_max(order.join(least, "value", "left").select("idx", F.when(F.col("ask") == 0, F.col("upto")).otherwise(F.lit(0)).alias("value")))
        return known.unionByName(order.where("ask = 1").join(run, "idx").select(order["value"], F.col("prefix").alias("n")))

    return placed(a, b, False).unionByName(placed(b, a, True))


def prefix_max(seq: DataFrame, block: int = BLOCK) -> DataFrame:
    """(idx, prefix): the largest value up to and with each, nulls left out, by block maxima."""
    blocked = seq.withColumn("_b", F.expr(f"idx div {block}"))
    tops = blocked.groupBy("_b").agg(F.max("value").alias("_m"))
    before = tops.select("_b", F.max("_m").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inner = F.max("value").over(Window.partitionBy("_b").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return blocked.withColumn("_in", inner).join(before, "_b").select("idx", F.greatest("_before", "_in").alias("prefix"))


def split_three(rows: DataFrame, part: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows whose part is 0, 1 and 2; others, nulls too, are an error of the caller and in none."""
    return tuple(rows.where(part == k) for k in range(3))


def map_filter(rows: DataFrame, value: Column) -> DataFrame:
    """(idx, value): what an expression gives, where it gives something."""
    return rows.select("idx", value.alias("value")).where("value IS NOT NULL")


def occurrences(seq: DataFrame, pattern: list) -> DataFrame:
    """(idx): where a pattern (a list on the driver) begins as consecutive values.

    A value votes for each beginning that its places in the pattern allow.
    """
    places: dict = {}
    for k, x in enumerate(pattern):
        places.setdefault(x, []).append(k)
    if not places:
        return seq.select("idx")
    where = F.create_map(*(F.lit(y) for x, ks in places.items() for y in (x, ks)))
    votes = seq.where(F.col("value").isin(list(places))).select("idx", F.explode(where[F.col("value")]).alias("_k")).select((F.col("idx") - F.col("_k")).alias("idx"))
    return votes.groupBy("idx").agg(F.count("*").alias("n")).where(F.col("n") == len(pattern)).select("idx")


def search(seq: DataFrame, pattern: list) -> DataFrame:
    """(first_index, last_index) at which a pattern begins, nulls where it doesn't occur."""
    return occurrences(seq, pattern).agg(F.min("idx").alias("first_index"), F.max("idx").alias("last_index"))


def adjacent_find(seq: DataFrame) -> DataFrame:
    """(first_index): of the first value that is equal to its follower."""
    after = seq.select((F.col("idx") - 1).alias("idx"), F.col("value").alias("_next"))
    return seq.join(after, "idx").where(F.col("value") == F.col("_next")).agg(F.min("idx").alias("first_index"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(mismatch, equal, less): the first index at which two sequences differ or one has ended, and how a stands to b."""
    left, right = (s.select("idx", F.col("value").alias(f"_{n}"), F.lit(True).alias(f"_has_{n}")) for s, n in ((a, "a"), (b, "b")))
    differ = left.join(right, "idx", "full_outer").where(F.col("_has_a").isNull() | F.col("_has_b").isNull() | ~F.col("_a").eqNullSafe(F.col("_b")))
    first = differ.agg(F.min(F.struct("idx", (F.col("_has_a").isNull() | F.coalesce(F.col("_a") < F.col("_b"), F.lit(False))).alias("less"))).alias("m"))
    return first.select(F.col("m.idx").alias("mismatch"), F.col("m").isNull().alias("equal"), F.coalesce("m.less", F.lit(False)).alias("less"))


def is_partitioned(seq: DataFrame, predicate: Column) -> DataFrame:
    """(partitioned): whether no value that fulfils a predicate stands after one that doesn't."""
    fits = F.coalesce(predicate, F.lit(False))
    ends = seq.agg(F.max(F.when(fits, F.col("idx"))).alias("last"), F.min(F.when(~fits, F.col("idx"))).alias("first"))
    return ends.select(F.coalesce(F.col("last") < F.col("first"), F.lit(True)).alias("partitioned"))


def extreme_positions(seq: DataFrame) -> DataFrame:
    """(min_index, min_value, max_index, max_value), ties to the first index."""
    low, high = F.min(F.struct("value", "idx")), F.max(F.struct("value", (-F.col("idx")).alias("back")))
    return seq.where("value IS NOT NULL").agg(low.alias("l"), high.alias("h")).select(F.col("l.idx").alias("min_index"), F.col("l.value").alias("min_value"), (-F.col("h.back")).alias("max_index"), F.col("h.value").alias("max_value"))


def approximate_kth(values: DataFrame, k: int, accuracy: int = 10_000) -> DataFrame:
    """(value): the k-th smallest from 0, its rank off by at most the n-th part of the rows, n = accuracy; one pass, one sketch."""
    n = values.count()
    return values.agg(F.percentile_approx("value", F.lit(min(1.0, (k + 1) / max(1, n))), accuracy).alias("value"))


def augmented_filter(pairs: DataFrame, limit) -> DataFrame:
    """Entries whose own contribution to the maximum is above a limit: what pruning by subtree maxima leaves."""
    return pairs.where(F.col("value") > limit)
