"""Operator 9: benchmark decontamination by an FM-index of each training shard.

Words are lower-cased (A-Z alone) runs of ASCII digits, letters and non-ASCII
characters. A shard is a run of documents that a worker holds, of at most
SHARD_BYTES unless a single text is longer. Its words are
written over the alphabet of the test phrases; a word outside that alphabet
can't be part of a phrase, so a run of such words is one separator, and runs
of alphabet words shorter than the shortest phrase are left out. Over this
text stands an FM-index: suffix order, Burrows-Wheeler transform in a wavelet
matrix, sampled positions. All phrases are searched backward together; hits
are located by stepping to sampled positions, and their spans are merged.

Results: null or empty text has no words and no hits; an item without words
has no phrase. Items of null id mark words but aren't listed. Repeated items
count once, repeated documents each. Empty tables give no rows, or no hits.
The test set is searched in blocks of at most BLOCK_CHARS characters, read one
after the other: the driver and the workers hold one block at a time, and what
a block has found is written before the next one comes.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwalk.llm.common import runs, staged

#: Bytes of text in a shard, and characters of test items in a broadcast.
SHARD_BYTES, BLOCK_CHARS = 8_000_000, 20_000_000
#: Text positions between two sampled ones.
SAMPLE = 8

# Bytes that are parts of words, A-Z lowered; all others become spaces.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


_WORDS = re.compile(rb"[^ ]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


class Phrases:
    """Distinct windows of test items, over an alphabet of their words (symbols from 1)."""

    def __init__(self, items: list[tuple[int | None, str | None]], size: int):
        self.alphabet: dict[bytes, int] = {}
        windows: dict[tuple, set] = {}
        for item, text in items:
            ids = [self.alphabet.setdefault(w, len(self.alphabet) + 1) for w in words_of(text)]
            for at in range(max(1, len(ids) - size + 1) if ids else 0):
                windows.setdefault(tuple(ids[at : at + size]), set()).add(item)
        self.items = [frozenset(x for x in found if x is not None) for found in windows.values()]
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.symbols = np.zeros((len(windows), size), np.int64)
        for k, w in enumerate(windows):
            self.symbols[k, : len(w)] = w
        self.shortest = int(self.lengths.min()) if len(windows) else 0


class Bits:
    """A bit vector in 64-bit words, with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        size = len(bits) // 64 + 1
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(size, "<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(size, np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), dtype=np.int32, out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        word = i >> 6
        inside = self.words[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(inside).astype(np.int64)

    def at(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class WaveletMatrix:
    """rank(symbol, i): how often a symbol stands before i; and access(i). Each level takes 1.5 bits a position."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            one = ((symbols >> level) & 1).astype(bool)
            self.levels.append(Bits(one))
            self.zeros.append(int(len(one) - one.sum()))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        start = np.zeros_like(i)
        for level, ones, zeros in zip(range(self.bits - 1, -1, -1), self.levels, self.zeros, strict=True):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = ones.rank(start), ones.rank(i)
            start = np.where(one, zeros + a, start - a)
            i = np.where(one, zeros + b, i - b)
        return i - start

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at i, rank of that symbol at i)."""
        symbol, start = np.zeros_like(i), np.zeros_like(i)
        for ones, zeros in zip(self.levels, self.zeros, strict=True):
            bit = ones.at(i)
            symbol = symbol * 2 + bit
            a, b = ones.rank(start), ones.rank(i)
            start = np.where(bit == 1, zeros + a, start - a)
            i = np.where(bit == 1, zeros + b, i - b)
        return symbol, i - start


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, by doubling; ordered groups leave the work."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    step = 1
    open_ = np.arange(n)  # places in `order` whose group isn't single
    while True:
        sorted_rank = rank[order]
        first = np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]]) if n else np.zeros(0, bool)
        group = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        rank[order] = group
        single = first & np.concatenate([first[1:], [True]])
        open_ = np.flatnonzero(~single)
        if not len(open_):
            return order
        who = order[open_]
        ahead = np.where(who + step < n, rank[np.minimum(who + step, n - 1)] + 1, 0)
        by = np.lexsort((ahead, group[open_]))
        order[open_] = who[by]
        mixed_group, mixed_ahead = group[open_], ahead[by]
        new = np.concatenate([[True], (mixed_group[1:] != mixed_group[:-1]) | (mixed_ahead[1:] != mixed_ahead[:-1])])
        rank[order[open_]] = np.maximum.accumulate(np.where(new, open_, 0))
        step *= 2


class FMIndex:
    """Backward search and location over symbols from 1 (separators included); 0 is the end."""

    def __init__(self, text: np.ndarray, largest: int):
        text = np.append(text, 0)  # not kept: the index stands for it
        order = suffix_order(text)
        self.n, self.wavelet = len(text), WaveletMatrix(text[order - 1], max(1, int(largest).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=largest + 1))])
        sampled = order % SAMPLE == 0
        self.sampled, self.positions = Bits(sampled), order[sampled].astype(np.int32)

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """(low, high) of each phrase among the ordered suffixes."""
        low, high = np.zeros(len(phrases.lengths), np.int64), np.full(len(phrases.lengths), self.n, np.int64)
        for back in range(phrases.symbols.shape[1]):
            at = phrases.lengths - 1 - back
            k = np.flatnonzero((at >= 0) & (low < high))
            if not len(k):
                break
            symbol = phrases.symbols[k, at[k]]
            low[k] = self.before[symbol] + self.wavelet.rank(symbol, low[k])
            high[k] = self.before[symbol] + self.wavelet.rank(symbol, high[k])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of ordered suffixes: steps to the left until a sampled one."""
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        left, at = np.arange(len(rows)), rows.copy()
        while len(left):
            done = self.sampled.at(at) == 1
            out[left[done]] = self.positions[self.sampled.rank(at[done])] + steps[left[done]]
            left, at = left[~done], at[~done]
            if len(left):
                symbol, rank = self.wavelet.access_rank(at)
                at = self.before[symbol] + rank
                steps[left] += 1
        return out


def shard_hits(texts: list[str | None], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], frozenset]]:
    """For each text: number of words, merged spans of hit words (end exclusive), ids of items that occur."""
    get, coded, sizes = phrases.alphabet.get, [], []
    for text in texts:
        words = words_of(text)
        sizes.append(len(words))
        coded.append(np.fromiter((get(w, 0) for w in words), np.int64, len(words)))
    plain = [(n, [], frozenset()) for n in sizes]
    if not phrases.shortest or not sum(sizes):
        return plain
    # A separator stands between documents, so no phrase reaches from one to the next.
    flat = np.concatenate([part for c in coded for part in (c, np.zeros(1, np.int64))])
    inside = np.concatenate([[False], flat > 0, [False]])
    start, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    keep = end - start >= phrases.shortest
    start, end = start[keep], end[keep]
    if not len(start):
        return plain
    size = end - start + 1
    run_at = np.cumsum(size) - size
    separator = len(phrases.alphabet) + 1
    text = np.full(int(size.sum()), separator, np.int64)
    inner = np.repeat(start - run_at, size - 1) + np.arange(len(text))[np.repeat(run_at, size - 1) + (np.arange(int((size - 1).sum())) - np.repeat(np.cumsum(size - 1) - (size - 1), size - 1))]
    target = inner - np.repeat(start - run_at, size - 1)
    text[target] = flat[inner]
    index = FMIndex(text, separator)
    low, high = index.search(phrases)
    count = high - low
    phrase = np.repeat(np.arange(len(count)), count)
    rows = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    found = index.locate(rows)
    run = np.searchsorted(run_at, found, "right") - 1
    begin = start[run] + found - run_at[run]
    doc_at = np.cumsum([n + 1 for n in sizes]) - np.array([n + 1 for n in sizes])
    doc = np.searchsorted(doc_at, begin, "right") - 1
    out = list(plain)
    by = np.lexsort((begin, doc))
    doc, begin, phrase = doc[by], begin[by] - doc_at[doc[by]], phrase[by]
    finish = begin + phrases.lengths[phrase]
    cuts = np.append(np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])), len(doc)) if len(doc) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        spans: list[tuple[int, int]] = []
        for x, y in zip(begin[a:b].tolist(), finish[a:b].tolist(), strict=True):
            if spans and x <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(y, spans[-1][1]))
            else:
                spans.append((x, y))
        items = frozenset().union(*(phrases.items[p] for p in np.unique(phrase[a:b]).tolist()))
        out[int(doc[a])] = (sizes[int(doc[a])], spans, items)
    return out


HIT_SCHEMA = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<long>"


def _blocks(items: DataFrame, id_col: str, text_col: str):
    """Runs of test items, each of at most about BLOCK_CHARS characters, read partition by partition."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).toLocalIterator()
    run, held = [], 0
    for row in rows:
        run.append((row.item_id, row.text))
        held += len(row.text or "")
        if held >= BLOCK_CHARS:
            yield run
            run, held = [], 0
    if run:
        yield run


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", with_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, spans, items): merged word spans and sorted item ids of each document.

    with_text adds text, the document without the spans; keep names columns of docs to be carried along.
    """
    plain = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"keep_{c}") for c in keep)]
    rows = docs.select(*plain, F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("spans"), F.expr("cast(array() as array<long>)").alias("items"))
    schema = rows.schema
    blocks = _blocks(items, item_id_col, item_text_col)
    block = next(blocks, [])
    while block is not None:  # one, unless the test set is larger than a broadcast may be
        later = next(blocks, None)
        rows = rows.mapInArrow(_searcher(docs.sparkSession.sparkContext.broadcast(block), window, ("cleaned" if with_text else "none") if later is None else "whole"), schema)
        rows, block = rows if later is None else staged(rows, "decontamination-found"), later
    return rows.select("doc_id", "n_words", "spans", "items", *(["text"] if with_text else []), *(F.col(f"keep_{c}").alias(c) for c in keep))


def without_spans(text: str | None, spans: list[dict]) -> str | None:
    """A text without some spans of words, each from its first word's first to its last word's last character."""
    if not text or not spans:
        return text
    data = text.encode("utf-8", "surrogatepass")
    words = [m.span() for m in _WORDS.finditer(data.translate(_WORD_BYTES))]
    cuts = [(words[s["start"]][0], words[s["end"] - 1][1]) for s in spans]
    edges = [0, *(x for cut in cuts for x in cut), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode("utf-8", "surrogatepass")


def _searcher(held, window: int, give: str):
    """give: which text leaves the worker, whole, cleaned or none."""
    kinds = {"n_words": pa.int64(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "items": pa.list_(pa.int64())}

    def search(batches):
        phrases = Phrases(held.value, window)
        for batch in batches:
            for run in runs(batch, "text", SHARD_BYTES):
                got = shard_hits(run.column("text").to_pylist(), phrases)
                old = zip(run.column("spans").to_pylist(), run.column("items").to_pylist(), got, strict=True)
                found = [(n, merge(before, spans), sorted({*listed, *items})) for before, listed, (n, spans, items) in old]
                text = pa.nulls(run.num_rows, pa.string()) if give == "none" else run.column("text")
                if give == "cleaned":
                    text = pa.array([without_spans(t, f[1]) for t, f in zip(text.to_pylist(), found, strict=True)], pa.string())
                new = {"text": text} | {name: pa.array([f[k] for f in found], kind) for k, (name, kind) in enumerate(kinds.items())}
                yield pa.RecordBatch.from_arrays([new.get(c, run.column(c)) for c in run.schema.names], run.schema.names)

    return search


def merge(old: list[dict], new: list[tuple[int, int]]) -> list[dict]:
    if not old:
        return [{"start": a, "end": b} for a, b in new]
    out: list[dict] = []
    for a, b in sorted([(s["start"], s["end"]) for s in old] + list(new)):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(b, out[-1]["end"])
        else:
            out.append({"start": a, "end": b})
    return out


def contamination_report(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    listed = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def naive_hits(text: str | None, items: list[tuple[int | None, str | None]], window: int) -> tuple[int, int, list[int], str]:
    """The same by comparing all windows, for tests."""
    words, hit, found = words_of(text), set(), set()
    for item, other in items:
        w = words_of(other)
        for at in range(max(1, len(w) - window + 1) if w else 0):
            part = w[at : at + window]
            for k in range(len(words) - len(part) + 1):
                if words[k : k + len(part)] == part:
                    hit.update(range(k, k + len(part)))
                    if item is not None:
                        found.add(item)
    listed = sorted(found)
    return len(words), len(hit), listed, hashlib.sha256(",".join(sorted(map(str, listed))).encode()).hexdigest()
