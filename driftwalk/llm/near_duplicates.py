"""Operator 4: near duplicates by MinHash bands and odd sketches, links confirmed on full shingle sets.

A document's set has the hashes of its distinct 5-word shingles (words between
ASCII blanks, A-Z lowered; fewer words: the whole sequence as one shingle).

1. Documents of equal sets form a class. All else is done once a class.
2. Each class has 128 MinHash samples. 32 bands of 4 samples put it in buckets:
   a pair of similarity 0.75 misses all of them once in 190,000 times.
3. An odd sketch folds the samples into 512 parity bits. Inside a bucket, two
   classes are candidates if the population count of their sketches' XOR fits
   a similarity of 0.75, five standard deviations included. A bucket gives a
   spanning forest of its candidates, never all pairs.
4. Components of these forests are clusters; every link is inside one. Each
   class's set goes to its cluster once. There, sketches again choose the
   pairs whose sets are compared; a spanning forest of the links results.
5. Components of the links, with the smallest doc_id.

Groups beyond a bound are cut into chunks, and each pair of chunks is a task:
memory is bounded, nothing is capped. Steps 3 and 4 compare sketches of all
pairs in a group at worst, but visited classes leave the work, so a group of
mutual near copies costs as many comparisons as it has members.

A very long text takes time and memory in proportion to its words.
Null or empty text, or text of blanks: the empty set, linked with nothing.
Rows of null doc_id link nothing, and have a null component and kept = false.
Repeated ids with different texts are judged text by text. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwalk.llm.common import runs, shuffle_partitions, staged, two_columns
from driftwalk.operators.graph import components

WORDS, SAMPLES, BANDS, SKETCH_BITS = 5, 128, 32, 512
#: Similarity of links, in hundredths.
PERCENT = 75
#: Classes of a bucket, and shingles of a cluster, that a task holds of each of two chunks.
BUCKET_CHUNK, CLUSTER_CHUNK = 4096, 2_000_000

#: Bytes of text whose shingles a worker turns into rows at once, but for a longer text.
RUN_BYTES = 2_000_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)  # mixing factors
_random = np.random.default_rng(4)
_FACTORS = _random.integers(0, 1 << 31, SAMPLES, np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _random.integers(0, 1 << 32, SAMPLES, np.uint32)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _most_differing(percent: int) -> int:
    """Largest population count of an XOR that still speaks for a link."""
    apart = 1 - percent / 100
    mean = SKETCH_BITS / 2 * (1 - np.exp(-4 * SAMPLES * apart / SKETCH_BITS))
    slope = 2 * np.exp(-4 * SAMPLES * apart / SKETCH_BITS)
    spread = np.sqrt((slope * np.sqrt(SAMPLES * apart * (1 - apart))) ** 2 + mean / 2)
    return int(mean + 5 * spread)


MOST_DIFFERING = _most_differing(PERCENT)


def estimated_similarity(differing: np.ndarray) -> np.ndarray:
    """From the population count of the XOR of two odd sketches."""
    inside = np.clip(1 - 2 * np.asarray(differing) / SKETCH_BITS, 1e-9, 1)
    return np.clip(1 + SKETCH_BITS / (4 * SAMPLES) * np.log(inside), 0, 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _ODD[3]
    x = x ^ (x >> np.uint64(29))
    x = x * _ODD[4]
    return x ^ (x >> np.uint64(32))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_word_hashes = _WordHashes()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, n)
    with np.errstate(over="ignore"):
        if n < WORDS:
            whole = np.uint64(n)
            for h in hashes:
                whole = _mix(np.array([whole * _ODD[0] + h], np.uint64))[0]
            return np.array([whole], np.uint64)
        total = hashes[: n - WORDS + 1] * _ODD[0]
        for k in range(1, WORDS):
            total = _mix(total) + hashes[k : n - WORDS + 1 + k] * _ODD[k % 3]
        return np.unique(_mix(total))


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        out = np.minimum(out, (_FACTORS[:, None] * low[None, at : at + 2048] + _SHIFTS[:, None]).min(axis=1))
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples.reshape(BANDS, -1).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(rows.shape[1]):
        key = _mix(key * _ODD[1] + rows[:, k])
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray) -> bytes:
    """Bit parities: each sample, with its number, flips one bit."""
    bit = _mix(samples.astype(np.uint64) * np.uint64(SAMPLES) + np.arange(SAMPLES, dtype=np.uint64)) % np.uint64(SKETCH_BITS)
    parity = np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8)).tobytes()


FEATURES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])


def _features(batches):
    with np.errstate(over="ignore"):
        for batch in batches:
            for run in runs(batch, "text", RUN_BYTES, each=2000):
                rows = []
                for i, text in zip(run.column("doc_id").to_pylist(), run.column("text").to_pylist(), strict=True):
                    s = shingle_set(text)
                    if not len(s):
                        rows.append((i, 0, None, None, None))
                        continue
                    samples = min_hashes(s)
                    rows.append((i, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), band_keys(samples), odd_sketch(samples)))
                yield pa.RecordBatch.from_pydict({f.name: [r[k] for r in rows] for k, f in enumerate(FEATURES)}, FEATURES)


def _sets(batches):
    schema = pa.schema([("cluster", pa.binary()), ("fp", pa.binary()), ("chunks", pa.int32()), ("sketch", pa.binary()), ("shingles", pa.binary())])
    for batch in batches:
        for part in runs(batch, "text", RUN_BYTES, each=2000):
            rows = []
            for cluster, fp, chunks, sketch, text in zip(*(part.column(c).to_pylist() for c in ("cluster", "fp", "chunks", "sketch", "text")), strict=True):
                s = shingle_set(text)
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == fp:
                    rows.append((cluster, fp, chunks, sketch, s.tobytes()))
            yield pa.RecordBatch.from_pydict({f.name: [r[k] for r in rows] for k, f in enumerate(schema)}, schema)


def _chunk_pairs(df: DataFrame, group: str) -> DataFrame:
    """df, each row of a group of `chunks` chunks copied to all pairs of chunks that have its own."""
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    out = df.withColumn("own", own).withColumn("other", other)
    return out.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("own", "other", "chunks").repartition(shuffle_partitions(df.sparkSession), group, "i", "j").sortWithinPartitions(group, "i", "j", "fp")


def _groups(batches, keys: list[str], columns: list[str]):
    """Rows of a sorted stream, group by group."""
    key, rows = None, []
    for batch in batches:
        lists = [batch.column(c).to_pylist() for c in [*keys, *columns]]
        for row in zip(*lists, strict=True):
            if row[: len(keys)] != key:
                if len(rows) > 1:
                    yield rows
                key, rows = row[: len(keys)], []
            rows.append(row[len(keys) :])
    if len(rows) > 1:
        yield rows


def _near(sketches: np.ndarray, sizes: np.ndarray, one: int, others: np.ndarray) -> np.ndarray:
    """Which of `others` may be linked with `one`, by sizes and sketches."""
    a, b = sizes[one], sizes[others]
    fits = (100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b))
    others = others[fits]
    differing = np.bitwise_count(sketches[others] ^ sketches[one]).sum(axis=1, dtype=np.int64)
    return others[differing <= MOST_DIFFERING]


def _forest(n: int, neighbors) -> list[tuple[int, int]]:
    """Edges that span the components of a graph; neighbors(one, unvisited) gives one's neighbors among these."""
    left, edges = np.arange(n), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            one = queue.pop()
            found = neighbors(one, left)
            if len(found):
                edges += [(one, int(k)) for k in found]
                queue += found.tolist()
                left = np.setdiff1d(left, found, assume_unique=True)
    return edges


EDGES = pa.schema([("src", pa.binary()), ("dst", pa.binary())])


def _edge_batch(pairs: list[tuple[bytes, bytes]]):
    return pa.RecordBatch.from_pydict({"src": [a for a, _ in pairs], "dst": [b for _, b in pairs]}, EDGES)


def _candidates(batches):
    held = []
    for rows in _groups(batches, ["key", "i", "j"], ["fp", "n_shingles", "sketch"]):
        sketches = np.frombuffer(b"".join(r[2] for r in rows), np.uint64).reshape(len(rows), -1)
        sizes = np.array([r[1] for r in rows], np.int64)
        held += [(rows[a][0], rows[b][0]) for a, b in _forest(len(rows), lambda one, rest: _near(sketches, sizes, one, rest))]
        if len(held) > 10_000:
            yield _edge_batch(held)
            held = []
    yield _edge_batch(held)


def _links(batches):
    held = []
    for rows in _groups(batches, ["cluster", "i", "j"], ["fp", "sketch", "shingles"]):
        sketches = np.frombuffer(b"".join(r[1] for r in rows), np.uint64).reshape(len(rows), -1)
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        sizes = np.array([len(s) for s in sets], np.int64)

        def linked(one: int, rest: np.ndarray) -> np.ndarray:
            near = _near(sketches, sizes, one, rest)
            if not len(near):
                return near
            flat = np.concatenate([sets[k] for k in near])
            place = np.minimum(np.searchsorted(sets[one], flat), len(sets[one]) - 1)
            same = np.add.reduceat((sets[one][place] == flat).astype(np.int64), np.cumsum(sizes[near]) - sizes[near])
            return near[100 * same >= PERCENT * (sizes[near] + sizes[one] - same)]

        held += [(rows[a][0], rows[b][0]) for a, b in _forest(len(rows), linked)]
        if len(held) > 10_000:
            yield _edge_batch(held)
            held = []
    yield _edge_batch(held)


def _both_ways(edges: DataFrame) -> DataFrame:
    ends = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return edges.select(ends.alias("e")).select("e.src", "e.dst").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    source = two_columns(docs, id_col, text_col)
    features = staged(source.mapInArrow(_features, "doc_id long, n_shingles long, fp binary, bands array<long>, sketch binary"), "neardup-features")
    usable = features.where("doc_id IS NOT NULL AND fp IS NOT NULL")
    classes = staged(usable.groupBy("fp").agg(F.min("doc_id").alias("label"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "neardup-classes")

    banded = classes.select("fp", F.explode("bands").alias("key"))
    full = banded.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key", F.ceil(F.col("members") / BUCKET_CHUNK).cast("int").alias("chunks"))
    meeting = banded.join(full, "key").join(classes.select("fp", "n_shingles", "sketch"), "fp")
    candidate = _chunk_pairs(meeting, "key").select("key", "i", "j", "fp", "n_shingles", "sketch").mapInArrow(_candidates, "src binary, dst binary")
    candidate = staged(_both_ways(candidate), "neardup-candidates")
    clusters = components(candidate, candidate.select(F.col("src").alias("vertex"))).select(F.col("vertex").alias("fp"), F.col("component").alias("cluster"))

    member = clusters.join(classes.select("fp", "label", "n_shingles", "sketch"), "fp")
    load = member.groupBy("cluster").agg(F.ceil(F.sum("n_shingles") / CLUSTER_CHUNK).cast("int").alias("chunks"))
    asked = member.join(load, "cluster").select("cluster", "fp", "chunks", "sketch", F.col("label").alias("doc_id"))
    sets = asked.join(source, "doc_id").select("cluster", "fp", "chunks", "sketch", "text").mapInArrow(_sets, "cluster binary, fp binary, chunks int, sketch binary, shingles binary")
    links = _chunk_pairs(sets, "cluster").select("cluster", "i", "j", "fp", "sketch", "shingles").mapInArrow(_links, "src binary, dst binary")
    links = staged(_both_ways(links), "neardup-links")
    linked = components(links, links.select(F.col("src").alias("vertex"))).select(F.col("vertex").alias("fp"), "component")

    named = linked.join(classes.select("fp", "label"), "fp")
    least = named.groupBy("component").agg(F.min("label").alias("least"))
    smallest = named.select("fp", "component").join(least, "component").select("fp", "least")
    label = classes.select("fp", "label").join(smallest, "fp", "left").select("fp", F.coalesce("least", "label").alias("component_id"))
    found = features.select("doc_id", "n_shingles", "fp").join(label, "fp", "left")
    component = F.when(F.col("fp").isNull(), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))

