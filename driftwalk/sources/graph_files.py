"""Readers and writers of the graph, walk, label and embedding file formats."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TEXT_HEADER = "AdjacencyGraph"


def read_adjacency_text(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices(vertex, n), edges(src, dst)) of an adjacency text file.

    Tokens: the header word (may be missing), n, m, n offsets, m targets. Lines
    are numbered by blocks of files, in the order of the files' names and the
    blocks' places, so a file of one token a line is read in parallel.
    Raises ValueError if the number of tokens doesn't fit.
    """
    block = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), block.alias("block"), "value")
    tokens = lines.select("line", "block", F.posexplode(F.split("value", r"[\s\x00]+")).alias("k", "token")).where("token <> ''")
    tokens = tokens.where(F.col("token") != TEXT_HEADER)
    sizes = tokens.groupBy("block").agg(F.count("*").alias("c"))
    before = sizes.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("block", "before")
    numbered = tokens.withColumn("k", F.row_number().over(Window.partitionBy("block").orderBy("line", "k")) - 1).join(before, "block")
    numbered = numbered.select((F.col("before") + F.col("k")).alias("i"), F.col("token").cast("long").alias("x"))
    head = {r.i: r.x for r in numbered.where("i < 2").collect()}
    n, m = head.get(0, 0), head.get(1, 0)
    if numbered.count() != n + m + 2:
        raise ValueError(f"{path}: {n} offsets and {m} targets are announced, other numbers of tokens found")
    offsets = numbered.where((F.col("i") >= 2) & (F.col("i") < n + 2)).select((F.col("i") - 2).alias("vertex"), F.col("x").alias("off"))
    following = offsets.select((F.col("vertex") - 1).alias("vertex"), F.col("off").alias("end"))
    spans = offsets.join(following, "vertex", "left").select("vertex", "off", F.coalesce("end", F.lit(m)).alias("end"))
    targets = numbered.where(F.col("i") >= n + 2).select((F.col("i") - n - 2).alias("e"), F.col("x").alias("dst"))
    owner = spans.where("end > off").select("vertex", F.explode(F.sequence("off", F.col("end") - 1)).alias("e"))
    edges = owner.join(targets, "e").select(F.col("vertex").alias("src"), "dst")
    return spans.select("vertex", F.lit(n).cast("long").alias("n")), edges


def write_adjacency_text(edges: DataFrame, n: int, path: str) -> None:
    """One token a line, in order: header, n, m, offsets, targets; the order goes on from part file to part file by name."""
    from driftwalk.operators.ordered import prefix_sums

    spark = edges.sparkSession
    deg = spark.range(n).select(F.col("id").alias("vertex")).join(edges.groupBy(F.col("src").alias("vertex")).agg(F.count("*").alias("d")), "vertex", "left")
    offsets = prefix_sums(deg.select(F.col("vertex").alias("idx"), F.coalesce("d", F.lit(0)).alias("value"))).select(F.lit(1).alias("part"), F.col("idx").alias("a"), F.lit(0).cast("long").alias("b"), F.col("prefix").cast("string").alias("token"))
    targets = edges.select(F.lit(2).alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("dst").cast("string").alias("token"))
    head = spark.createDataFrame([(0, 0, 0, TEXT_HEADER), (0, 1, 0, str(n)), (0, 2, 0, str(edges.count()))], "part int, a long, b long, token string")
    head.unionByName(offsets).unionByName(targets).orderBy("part", "a", "b").select("token").write.text(path)


def encode_neighbors(source: int, neighbors: list[int]) -> bytes:
    """Byte codes of a sorted list: 7 bits a byte, the first as a signed difference to the source."""
    out = bytearray()
    for k, v in enumerate(neighbors):
        diff = v - source if k == 0 else v - neighbors[k - 1]
        if k == 0:
            size = abs(diff)
            byte = (size & 0x3F) | (0x40 if diff < 0 else 0)
            size >>= 6
        else:
            size, byte = diff >> 7, diff & 0x7F
        while size:
            out.append(byte | 0x80)
            byte, size = size & 0x7F, size >> 7
        out.append(byte)
    return bytes(out)


def decode_neighbors(source: int, degree: int, data: bytes, at: int = 0) -> list[int]:
    out: list[int] = []
    for k in range(degree):
        byte, shift = data[at], 6 if k == 0 else 7
        at += 1
        value = byte & (0x3F if k == 0 else 0x7F)
        negative, more = k == 0 and bool(byte & 0x40), byte & 0x80
        while more:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift, more = shift + 7, byte & 0x80
        out.append((source - value if negative else source + value) if k == 0 else out[-1] + value)
    return out


def write_byte_graph(adjacency: dict[int, list[int]], n: int) -> bytes:
    """A binary graph file: n, m, total; n + 1 offsets; n degrees; the byte codes."""
    codes = [encode_neighbors(v, adjacency.get(v, [])) for v in range(n)]
    offsets = [0]
    for code in codes:
        offsets.append(offsets[-1] + len(code))
    degrees = [len(adjacency.get(v, [])) for v in range(n)]
    return struct.pack(f"<3q{n + 1}q{n}q", n, sum(degrees), offsets[-1], *offsets, *degrees) + b"".join(codes)


def read_byte_graph(spark: SparkSession, path: str, parts: int = 8) -> DataFrame:
    """edges(src, dst) of byte graph files, a file's vertices in `parts` ranges.

    One task a file cuts it into ranges of about equal bytes, each with its
    own offsets, degrees and codes alone; ranges are decoded by tasks of their
    own. A file must fit one row of the binary source (2 GB). Raises
    ValueError if the degrees don't add up to the number of edges.
    """
    def cut_up(frames):
        for frame in frames:
            for data in frame["content"]:
                n, m, total = struct.unpack_from("<3q", data)
                offsets = np.frombuffer(data, "<i8", n + 1, 24)
                degs = np.frombuffer(data, "<i8", n, 24 + 8 * (n + 1))
                if degs.sum() != m:
                    raise ValueError("degrees don't add up to the number of edges")
                base = 24 + 8 * (2 * n + 1)
                cuts = np.unique(np.append(np.searchsorted(offsets[:n], np.arange(parts) * total // parts), n))
                cuts[0] = 0
                for low, high in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                    yield pd.DataFrame({"first": [low], "offsets": [(offsets[low:high] - offsets[low]).tobytes()], "degrees": [degs[low:high].tobytes()], "codes": [data[base + int(offsets[low]) : base + int(offsets[high])]]})

    def decode(frames):
        for frame in frames:
            for first, offsets, degs, codes in zip(*(frame[c] for c in ("first", "offsets", "degrees", "codes")), strict=True):
                at, deg = np.frombuffer(offsets, "<i8").tolist(), np.frombuffer(degs, "<i8").tolist()
                for low in range(0, len(at), 10_000):
                    rows = [(first + v, w) for v in range(low, min(len(at), low + 10_000)) for w in decode_neighbors(first + v, deg[v], codes, at[v])]
                    yield pd.DataFrame(rows, columns=["src", "dst"], dtype="int64")

    files = spark.read.format("binaryFile").load(path).select("content")
    ranges = files.mapInPandas(cut_up, "first long, offsets binary, degrees binary, codes binary")
    return ranges.repartition(parts).mapInPandas(decode, "src long, dst long")


def write_byte_files(edges: DataFrame, path: str) -> None:
    """edges as one byte graph file in the folder `path`, neighbors encoded by the executors.

    The format has one header for all, so one writer appends the codes in the
    order of the vertices; it reads them partition by partition.
    """
    from driftwalk.plans.materialise import stored

    spark = edges.sparkSession

    def encode(frames):
        for frame in frames:
            codes = [encode_neighbors(v, sorted(int(x) for x in neighbors)) for v, neighbors in zip(frame["src"], frame["out"], strict=True)]
            yield pd.DataFrame({"src": frame["src"], "degree": frame["out"].map(len), "code": codes})

    lists = edges.groupBy("src").agg(F.collect_list("dst").alias("out")).mapInPandas(encode, "src long, degree long, code binary")
    coded = stored(lists.repartitionByRange("src").sortWithinPartitions("src"), "byte-codes")
    n = (edges.agg(F.max(F.greatest("src", "dst"))).first()[0] or -1) + 1
    degrees, sizes = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for row in coded.select("src", "degree", F.length("code").alias("size")).toLocalIterator():
        degrees[row.src], sizes[row.src] = row.degree, row.size
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/graph.bytes")
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(struct.pack("<3q", n, int(degrees.sum()), int(sizes.sum())) + np.append(0, np.cumsum(sizes)).astype("<i8").tobytes() + degrees.astype("<i8").tobytes()))
    held = bytearray()
    for row in coded.orderBy("src").select("code").toLocalIterator():
        held += row.code
        if len(held) > 1 << 20:
            out.write(held)
            held = bytearray()
    out.write(held)
    out.close()


def load_graph(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """edges(src, dst) from parquet, an edge list, adjacency text or a byte graph."""
    if format == "parquet":
        return spark.read.parquet(path).select("src", "dst")
    if format == "edge_list":
        parts = F.split(F.trim("value"), r"\s+")
        lines = spark.read.text(path).where("value <> '' AND NOT startswith(value, '#')")
        return lines.select(parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst"))
    if format == "adjacency_text":
        return read_adjacency_text(spark, path)[1]
    if format == "bytes":
        return read_byte_graph(spark, path)
    raise ValueError(f"no graph format {format}")


def write_walks(walks: DataFrame, path: str) -> None:
    """walks(walk_id, walk): one walk a line."""
    walks.select("walk").write.text(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema="vertex long, label string")


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(vertex, vector) from text with a header line `count dim`, which has two fields only."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts.alias("f")).where(F.size("f") > 2)
    return rows.select(F.col("f")[0].cast("long").alias("vertex"), F.slice("f", 2, 1_000_000).cast("array<double>").alias("vector"))


def write_embeddings(model: DataFrame, path: str, min_count: int = 0) -> None:
    """model(word, count, input, output): the mean of both vectors as text, after a header line `count dim`.

    The header stands first in the first part file by name.
    """
    kept = model.where(F.col("count") >= min_count).select("word", F.zip_with("input", "output", lambda a, b: (a + b) / 2).alias("vector")).cache()
    first = kept.select(F.size("vector")).first()
    head = kept.sparkSession.createDataFrame([(0, f"{kept.count()} {first[0] if first else 0}")], "part int, value string")
    rows = kept.select(F.lit(1).alias("part"), F.concat_ws(" ", "word", F.array_join(F.col("vector").cast("array<string>"), " ")).alias("value"))
    head.unionByName(rows).orderBy("part", "value").select("value").write.text(path)
    kept.unpersist()


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """(word, n) of tokens between white space and NUL characters."""
    words = texts.select(F.explode(F.split(F.col(column), r"[\s\x00]+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n"))
