"""Command line: generate a stored corpus, apply a batch to it, read walks of it.

python -m driftwalk generate GRAPH STORE [--format F] [--walks N] [--length L] [--model M] [--seed S]
python -m driftwalk update STORE BATCH [--delete]
python -m driftwalk walks STORE OUT [--version V]
python -m driftwalk check STORE [--version V]
python -m driftwalk drop STORE [--walks-only]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from driftwalk.config import WalkConfig
from driftwalk.operators import lookup, updates
from driftwalk.sources.graph_files import load_graph, write_walks
from driftwalk.streaming.runner import CorpusStore, apply_batch

FORMATS = ("parquet", "edge_list", "adjacency_text", "bytes")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="driftwalk", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    out.add_argument("--walks", type=int, default=1, help="walks from each vertex")
    out.add_argument("--length", type=int, default=6)
    out.add_argument("--model", choices=("deepwalk", "node2vec"), default="deepwalk")
    out.add_argument("--p", type=float, default=4.0)
    out.add_argument("--q", type=float, default=1.0)
    out.add_argument("--seed", type=int, default=42)
    out.add_argument("--version", type=int, help="version of the store; the last by default")
    commands = out.add_subparsers(dest="command", required=True)
    one = commands.add_parser("generate")
    one.add_argument("graph")
    one.add_argument("store")
    one.add_argument("--format", choices=FORMATS, default="parquet")
    two = commands.add_parser("update")
    two.add_argument("store")
    two.add_argument("batch")
    two.add_argument("--format", choices=FORMATS, default="parquet")
    two.add_argument("--delete", action="store_true")
    three = commands.add_parser("walks")
    three.add_argument("store")
    three.add_argument("out")
    commands.add_parser("check").add_argument("store")
    five = commands.add_parser("drop")
    five.add_argument("store")
    five.add_argument("--walks-only", action="store_true")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    asked = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    store = CorpusStore(spark, asked.store, WalkConfig(walks_per_vertex=asked.walks, length=asked.length, model=asked.model, p=asked.p, q=asked.q, seed=asked.seed))
    if asked.command == "generate":
        store.write(updates.new_corpus(load_graph(spark, asked.graph, asked.format), store.config), 0)
        return
    version = store.last() if asked.version is None else asked.version
    if asked.command == "update":
        batch = load_graph(spark, asked.batch, asked.format)
        apply_batch(store, batch.withColumn("op", F.lit("delete" if asked.delete else "insert")), version + 1)
    elif asked.command == "walks":
        write_walks(lookup.walk_strings(store.read(version).live), asked.out)
    elif asked.command == "check":
        updates.check_corpus(store.read(version)).show(truncate=False)
    else:
        store.destroy(asked.walks_only)


if __name__ == "__main__":
    main()
