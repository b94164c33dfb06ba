"""Operator 5: token counts by a two-tier lookup on the map side.

Tier one is a broadcast table of the most frequent pre-tokens' lengths, at
most `table_size` entries. Tier two is each worker's cache, bounded by bytes:
misses are encoded by the tokenizer once and kept. Nothing is shuffled by
pre-token: the frequency pass packs a partition's summary, `summary_size`
counts at most, into one row; rows are dealt round-robin to MERGERS tasks
that add them up, and the driver gets one merged summary from each.

Null and empty text: 0 bytes, 0 tokens. Repeated rows are counted each. An
empty table gives no rows. The table of frequent parts changes speed alone.
"""

from __future__ import annotations

import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwalk.llm.common import runs, two_columns

#: Bytes of text that a worker cuts at once.
RUN_BYTES = 2_000_000
#: Tasks that merge the partitions' summaries.
MERGERS = 64
SUMMARY = pa.schema([("parts", pa.string()), ("counts", pa.binary())])
COUNTED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def _packed(counts: Counter, size: int):
    """A summary's row: the largest counts, ties by part."""
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]
    return pa.RecordBatch.from_pydict({"parts": ["\0".join(p for p, _ in top)], "counts": [np.array([c for _, c in top], "<i8").tobytes()]}, SUMMARY)


def _unpacked(parts: str, counts: bytes) -> dict[str, int]:
    return dict(zip(parts.split("\0"), np.frombuffer(counts, "<i8").tolist(), strict=True)) if counts else {}


def frequent_parts(docs: DataFrame, table_size: int, summary_size: int, held: int = 100_000) -> list[str]:
    """The most frequent parts of all texts, about: each partition counts at most `held` parts and sends its largest."""
    def bounded(counts: Counter) -> Counter:
        return Counter(dict(counts.most_common(held // 2))) if len(counts) > held else counts

    def summarise(batches):
        counts: Counter = Counter()
        for batch in batches:
            for run in runs(batch, "text", RUN_BYTES):
                for text in run.column("text").to_pylist():
                    if text:
                        counts.update(text.replace("\n", " ").split(" "))
                        counts = bounded(counts)
        yield _packed(Counter({p: c for p, c in counts.items() if len(p) <= 64 and "\0" not in p}), summary_size)

    def merge(batches):
        counts: Counter = Counter()
        for batch in batches:
            for parts, some in zip(batch.column("parts"), batch.column("counts"), strict=True):
                counts.update(_unpacked(parts.as_py(), some.as_py()))
                counts = bounded(counts)
        yield _packed(counts, table_size)

    kind = "parts string, counts binary"
    merged: Counter = Counter()
    for row in docs.select("text").mapInArrow(summarise, kind).repartition(MERGERS).mapInArrow(merge, kind).toLocalIterator():
        merged.update(_unpacked(row.parts, bytes(row.counts)))
    return [p for p, _ in sorted(merged.items(), key=lambda x: (-x[1], x[0]))[:table_size]]


def pack_lengths(lengths: dict[str, int]) -> bytes:
    """A compact table: all parts as one NUL-separated UTF-8 run, and u16 lengths."""
    kept = {p: n for p, n in lengths.items() if "\0" not in p and n < 65536}
    names = "\0".join(kept).encode()
    return struct.pack("<II", len(kept), len(names)) + names + struct.pack(f"<{len(kept)}H", *kept.values())


def unpack_lengths(data: bytes) -> dict[str, int]:
    n, size = struct.unpack_from("<II", data)
    names = data[8 : 8 + size].decode().split("\0") if n else []
    return dict(zip(names, struct.unpack_from(f"<{n}H", data, 8 + size), strict=True))


_counters: dict = {}


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, table_size: int = 20_000, summary_size: int = 4_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit)."""
    from driftwalk.llm.pieces import PieceCounter

    rows = two_columns(docs, id_col, text_col)
    tool = PieceCounter(tokenizer_path, {})
    frequent = frequent_parts(rows, table_size, summary_size)
    table = pack_lengths(dict(zip(frequent, tool.cache.lookup(frequent, tool.compute), strict=True)))
    held = docs.sparkSession.sparkContext.broadcast(table)
    key = (tokenizer_path, hash(table))

    def count(batches):
        counter = _counters.get(key)
        if counter is None:
            _counters.clear()
            counter = _counters[key] = PieceCounter(tokenizer_path, unpack_lengths(held.value))
        for batch in batches:
            for run in runs(batch, "text", RUN_BYTES):
                n_bytes = pc.binary_length(run.column("text")).fill_null(0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([run.column("doc_id"), n_bytes, pa.array(counter.count(run.column("text").to_pylist()), pa.int64())], schema=COUNTED)

    found = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
