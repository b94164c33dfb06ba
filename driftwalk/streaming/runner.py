"""Edge batches from a stream: one foreachBatch per edge batch, state in versioned folders."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftwalk.config import WalkConfig
from driftwalk.operators.updates import Corpus
from driftwalk.plans.materialise import children, cut, remove


class CorpusStore:
    """Corpus versions as parquet below root: snapshots, and what each batch after one changes.

    What a batch writes is in proportion to the batch and the walks it hits,
    but for a snapshot every config.snapshot_every batches. A batch counts
    once its folder is complete: a replayed batch overwrites its own, and
    readers take a version by number. One writer a root: the stream's batches
    come one after the other.
    """

    PARTS = ("edges", "steps", "mav", "starts")

    def __init__(self, spark: SparkSession, root: str, config: WalkConfig):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config

    def _at(self, kind: str, number: int, part: str) -> str:
        return f"{self.root}/{kind}={number:010d}/{part}"

    def write(self, corpus: Corpus, number: int = 0) -> None:
        """A whole snapshot; stale steps are left behind."""
        parts = {"edges": corpus.edges, "steps": corpus.live, "mav": corpus.mav.limit(0), "starts": corpus.starts}
        for part in self.PARTS:
            parts[part].write.mode("overwrite").parquet(self._at("snapshot", number, part))

    def append(self, corpus: Corpus, number: int) -> None:
        """Version `number` as what the corpus' changes add to the version before."""
        parts: dict[str, list[DataFrame]] = {part: [] for part in self.PARTS}
        for change in corpus.changes:
            parts["edges"].append(change.edges.withColumn("batch", F.lit(change.number)))
            for part in self.PARTS[1:]:
                if getattr(change, part) is not None:
                    parts[part].append(getattr(change, part))
        for part, rows in parts.items():
            all_rows = reduce(DataFrame.unionByName, rows) if rows else getattr(corpus, part).limit(0)
            all_rows.write.mode("overwrite").parquet(self._at("change", number, part))

    def snapshots(self) -> list[int]:
        return sorted(int(name.split("=")[1]) for name in children(self.spark, self.root) if name.startswith("snapshot="))

    def last(self) -> int:
        """The latest version."""
        found = [int(name.split("=")[1]) for name in children(self.spark, self.root) if name.startswith(("snapshot=", "change="))]
        if not found:
            raise ValueError(f"{self.root} has no version")
        return max(found)

    def read(self, batch: int) -> Corpus:
        """Version `batch`: the last snapshot up to it and the changes since."""
        found = [n for n in self.snapshots() if n <= batch]
        if not found:
            raise ValueError(f"{self.root} has no version {batch}")
        later = range(found[-1] + 1, batch + 1)
        parts = {part: self.spark.read.parquet(self._at("snapshot", found[-1], part)) for part in self.PARTS}
        if later:
            for part in self.PARTS[1:]:
                parts[part] = parts[part].unionByName(self.spark.read.schema(parts[part].schema).parquet(*(self._at("change", n, part) for n in later)))
            changed = self.spark.read.parquet(*(self._at("change", n, "edges") for n in later))
            last = changed.groupBy("src", "dst").agg(F.max_by("present", "batch").alias("present"))
            parts["edges"] = parts["edges"].join(last, ["src", "dst"], "left_anti").unionByName(last.where("present").select("src", "dst"))
        return Corpus(parts["edges"], parts["steps"], parts["mav"], parts["starts"], 2 * batch, self.config)

    def destroy(self, walks_only: bool = False) -> None:
        """Deletes the store; with walks_only the graph versions stay."""
        if not walks_only:
            return remove(self.spark, self.root)
        for name in children(self.spark, self.root):
            for part in self.PARTS[1:]:
                remove(self.spark, f"{self.root}/{name}/{part}")


def apply_batch(store: CorpusStore, rows: DataFrame, number: int, metrics: Callable[[dict], None] | None = None) -> None:
    """Batch `number` (from 1): rows(src, dst, op), op 'insert' or 'delete'; inserts come first.

    The corpus counts both as batches of their own, 2 * number - 1 and 2 * number.
    """
    import time

    corpus = store.read(number - 1)
    began = time.time()
    rows = cut(rows)  # read for inserts and deletes, several times
    after, affected = corpus.apply(rows.where("op = 'insert'"))
    deletes = rows.where("op = 'delete'")
    if not deletes.isEmpty():
        after, more = after.apply(deletes, delete=True)
        affected = affected.unionByName(more)
    if number % store.config.snapshot_every == 0:
        store.write(after, number)
    else:
        store.append(after, number)
    if metrics:
        metrics({"batch": number, "phase": "update", "seconds": time.time() - began, "affected": affected.select("walk_id").distinct().count()})


def run_stream(stream: DataFrame, store: CorpusStore, checkpoint: str, metrics: Callable[[dict], None] | None = None, **trigger) -> StreamingQuery:
    """stream(src, dst, op): each micro-batch is an edge batch, exactly once by its batch id."""
    def handle(rows: DataFrame, batch_id: int) -> None:
        apply_batch(store, rows, batch_id + 1, metrics)

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_edges(events: DataFrame, width: str, lateness: str, slide: str | None = None) -> DataFrame:
    """(window_start, src, dst, n): edges of event-time windows, tumbling or sliding, for streams and tables alike.

    On a stream, rows that come later than `lateness` behind the latest are dropped.
    """
    timed = events.withWatermark("ts", lateness) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width, slide).alias("w"), "src", "dst").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "src", "dst", "n")


def session_edges(events: DataFrame, gap: str, lateness: str) -> DataFrame:
    """(session_start, session_end, src, dst, n): edges of sessions, which end when an edge has a gap."""
    timed = events.withWatermark("ts", lateness) if events.isStreaming else events
    grouped = timed.groupBy(F.session_window("ts", gap).alias("w"), "src", "dst").agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "src", "dst", "n")
