"""Operator 8: language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, derived from its code point. A
trigram's vector binds its letters: the product of the first one's vector
rotated by two, the second one's rotated by one, and the third one's. A text's
vector bundles (adds) those of its trigrams; a language's prototype bundles
those of all its training texts. The language of the largest cosine wins, ties
go to the smaller label.

Text is lower-cased, whatever isn't a letter separates words, and a run of
separators counts once. Null text and text without letters: `und`, score 0.
So are all if there is nothing to learn from. Training leaves out null text,
null labels and null ids; a null id is not held out. Repeated rows count each.
An empty table gives no rows. Memory follows the longest text (some 100 bytes
a character), not the number of different trigrams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwalk.llm.common import runs, staged

DIMENSIONS, SEED, UNKNOWN = 1024, 20_260, "und"
#: Labels whose prototypes are broadcast at once; more are compared block by block.
LABELS = 2000
#: Bytes of text whose trigrams a worker holds at once, but for a longer text.
RUN_BYTES = 250_000
#: Cells of a matrix of counts, and trigrams whose vectors stand side by side.
DENSE_CELLS, BLOCK_TRIGRAMS = 4_000_000, 4096
#: Tasks that add up what the partitions have learned.
MERGERS = 64
_SPACE = 32


class Letters:
    """Which code points are letters, and their vectors; worker state of bounded size."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.is_letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        self.vectors: dict[int, np.ndarray] = {}

    def vector(self, code: int) -> np.ndarray:
        if code not in self.vectors:
            if len(self.vectors) > 50_000:
                self.vectors.clear()
            self.vectors[code] = np.random.default_rng([SEED, code]).integers(0, 2, self.dimensions, np.int8) * 2 - 1
        return self.vectors[code]

    def bind(self, trigrams: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
        """Vectors of trigrams given as rows of indices into an alphabet of code points."""
        base = np.stack([self.vector(int(c)) for c in alphabet]) if len(alphabet) else np.zeros((0, self.dimensions), np.int8)
        out = np.roll(base, 2, axis=1)[trigrams[:, 0]]
        out *= np.roll(base, 1, axis=1)[trigrams[:, 1]]
        out *= base[trigrams[:, 2]]
        return out


class Trigrams:
    """Trigrams of some texts: per occurrence the text and a code, whose parts index an alphabet of code points."""

    def __init__(self, texts: list[str | None], letters: Letters):
        lowered = [(t or "").lower() for t in texts]
        codes = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(t) for t in lowered], np.int64)
        edge = np.append(0, np.cumsum(lengths + 1))  # a space before each text and after the last
        is_edge = np.zeros(len(codes), bool)
        is_edge[edge] = True
        letter = letters.is_letter[codes]
        letter[edge] = False
        codes = np.where(letter, codes, _SPACE)
        blank = ~letter & ~is_edge
        keep = ~blank
        keep[1:] |= blank[1:] & ~blank[:-1]
        doc = np.repeat(np.arange(len(texts) + 1, dtype=np.int32), np.append(lengths + 1, 1))[keep]
        codes, is_edge = codes[keep], is_edge[keep]
        self.n, self.has = len(texts), np.bincount(doc[codes != _SPACE], minlength=len(texts) + 1)[: len(texts)] > 0
        self.alphabet, index = np.unique(codes, return_inverse=True)
        self.size = len(self.alphabet)
        inner = ~is_edge[1:-1]
        self.code = ((index[:-2] * self.size + index[1:-1]) * self.size + index[2:])[inner]
        self.doc = doc[1:-1][inner]

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct codes, the place among them of each occurrence)."""
        if self.size**3 > 4_000_000:
            return np.unique(self.code, return_inverse=True)
        seen = np.flatnonzero(np.bincount(self.code, minlength=1))
        place = np.zeros(self.size**3, np.int64)
        place[seen] = np.arange(len(seen))
        return seen, place[self.code]

    def parts(self, codes: np.ndarray) -> np.ndarray:
        return np.stack([codes // (self.size * self.size), codes // self.size % self.size, codes % self.size], axis=1)

    def bound(self, letters: Letters, codes: np.ndarray) -> np.ndarray:
        """Vectors of trigrams, one byte a value, from those of their own letters alone."""
        used, local = np.unique(self.parts(codes), return_inverse=True)
        return letters.bind(local.reshape(-1, 3), self.alphabet[used])

    def bundled(self, letters: Letters, group: np.ndarray, groups: int) -> np.ndarray:
        """Sums of trigram vectors by group[text], as whole numbers; a negative group is left out.

        Few groups x trigrams: counts times bound vectors. Many: occurrences in
        the order of their groups, a bounded block at a time.
        """
        out = np.zeros((groups, letters.dimensions))
        owner = group[self.doc]
        code, owner = self.code[owner >= 0], owner[owner >= 0]
        if not len(code):
            return out
        seen, column = self.distinct() if len(code) == len(self.code) else np.unique(code, return_inverse=True)
        if groups * len(seen) <= min(DENSE_CELLS, 32 * len(code)):
            counts = np.bincount(owner * len(seen) + column, minlength=groups * len(seen)).reshape(groups, -1).astype(np.float32)
            for at in range(0, len(seen), BLOCK_TRIGRAMS):
                out += counts[:, at : at + BLOCK_TRIGRAMS] @ self.bound(letters, seen[at : at + BLOCK_TRIGRAMS]).astype(np.float32)
            return out
        order = np.argsort(owner, kind="stable")
        code, owner = code[order], owner[order]
        for at in range(0, len(code), BLOCK_TRIGRAMS):
            some, of = code[at : at + BLOCK_TRIGRAMS], owner[at : at + BLOCK_TRIGRAMS]
            bound, first = self.bound(letters, some), np.flatnonzero(np.diff(of, prepend=-1))
            out[of[first]] += np.add.reduceat(bound, first, axis=0, dtype=np.int32)
        return out


def trigram_counts(texts: list[str | None], letters: Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(counts of texts x trigrams, trigrams, alphabet, whether each text has a letter): a whole table, for few short texts."""
    t = Trigrams(texts, letters)
    seen, column = t.distinct()
    counts = np.bincount(t.doc * max(1, len(seen)) + column, minlength=t.n * max(1, len(seen))).reshape(t.n, -1)
    return counts[:, : len(seen)], t.parts(seen), t.alphabet, t.has


_letters: dict[int, Letters] = {}


def _worker_letters(dimensions: int) -> Letters:
    if dimensions not in _letters:
        _letters.clear()
        _letters[dimensions] = Letters(dimensions)
    return _letters[dimensions]


PARTS = pa.schema([("lang", pa.string()), ("vector", pa.list_(pa.float64()))])


def _flushed(sums: dict[str, np.ndarray]):
    return pa.RecordBatch.from_pydict({"lang": list(sums), "vector": list(sums.values())}, PARTS)


def train(rows: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """Prototypes (lang, vector) from all rows(text, lang), written to the shared folder.

    What leaves a task is a vector a label; MERGERS tasks add these up before
    they are summed by label and dimension. Sums are whole numbers, so their
    order doesn't matter.
    """
    def bundle(batches):
        letters, sums = _worker_letters(dimensions), {}
        for batch in batches:
            for run in runs(batch, "text", RUN_BYTES):
                texts, labels = run.column("text").to_pylist(), run.column("lang").to_pylist()
                trigrams = Trigrams(texts, letters)
                names = sorted(set(labels))
                number = {name: k for k, name in enumerate(names)}
                group = np.array([number[x] if h else -1 for x, h in zip(labels, trigrams.has, strict=True)], np.int64)
                vectors = trigrams.bundled(letters, group, len(names))
                for k in np.unique(group[group >= 0]).tolist():
                    sums[names[k]] = sums[names[k]] + vectors[k] if names[k] in sums else vectors[k]
                if len(sums) > LABELS:
                    yield _flushed(sums)
                    sums = {}
        yield _flushed(sums)

    def merge(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, vector in zip(batch.column("lang").to_pylist(), batch.column("vector"), strict=True):
                vector = vector.values.to_numpy()
                sums[name] = sums[name] + vector if name in sums else vector
                if len(sums) > LABELS:
                    yield _flushed(sums)
                    sums = {}
        yield _flushed(sums)

    kind = "lang string, vector array<double>"
    parts = rows.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(bundle, kind).repartition(MERGERS).mapInArrow(merge, kind)
    summed = parts.select("lang", F.posexplode("vector").alias("dim", "x")).groupBy("lang", "dim").agg(F.sum("x").alias("x"))
    whole = F.array_sort(F.collect_list(F.struct("dim", "x")))
    return staged(summed.groupBy("lang").agg(whole.alias("v")).select("lang", F.col("v.x").alias("vector")).orderBy("lang"), "language-prototypes")


def _blocks(model: DataFrame):
    """(labels, prototypes) of at most LABELS labels, in order; one without labels if there are none."""
    names, vectors = [], []
    for row in model.orderBy("lang").toLocalIterator():
        if len(names) == LABELS:
            yield names, np.array(vectors)
            names, vectors = [], []
        names.append(row.lang)
        vectors.append(row.vector)
    yield names, np.array(vectors)


def scores(texts: list[str | None], prototypes: np.ndarray, letters: Letters) -> tuple[np.ndarray, np.ndarray]:
    """(cosines of texts x labels to 12 digits, whether each text has a letter)."""
    trigrams = Trigrams(texts, letters)
    vectors = trigrams.bundled(letters, np.arange(len(texts)), len(texts))
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    scaled = prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)
    return np.round((vectors @ scaled.T) / np.maximum(norms, 1e-12), 12), trigrams.has  # what is left doesn't depend on how products are added up


def predict(docs: DataFrame, model: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of docs, with lang_pred and score, by prototypes(lang, vector)."""
    rows = docs.select(*(F.col(c).alias(f"keep_{c}") for c in keep), F.col(text_col).cast("string").alias("body"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    blocks = _blocks(model)
    block = next(blocks)
    while block is not None:  # one, unless there are very many labels
        later = next(blocks, None)
        rows = rows.mapInArrow(_labeler(docs.sparkSession.sparkContext.broadcast(block)), rows.schema)
        rows, block = rows if later is None else staged(rows, "language-best"), later
    return rows.select(*(F.col(f"keep_{c}").alias(c) for c in keep), "lang_pred", "score")


def _labeler(held):
    def label(batches):
        labels, prototypes = held.value
        for batch in batches:
            for run in runs(batch, "body", RUN_BYTES, each=100):
                if not labels:
                    yield run
                    continue
                letters = _worker_letters(prototypes.shape[1])
                names, best = run.column("lang_pred").to_pylist(), run.column("score").to_numpy(zero_copy_only=False)
                cosine, has = scores(run.column("body").to_pylist(), prototypes, letters)
                top = cosine.argmax(axis=1)
                found = np.clip(cosine[np.arange(len(names)), top], 0, 1)
                # Labels come in order, so an equal score doesn't replace an earlier label.
                better = has & ((found > best) | np.array([x == UNKNOWN for x in names], bool))
                names = [labels[k] if b else old for k, b, old in zip(top.tolist(), better.tolist(), names, strict=True)]
                columns = {"lang_pred": pa.array(names, pa.string()), "score": pa.array(np.where(better, found, best), pa.float64())}
                yield pa.RecordBatch.from_arrays([columns.get(c, run.column(c)) for c in run.schema.names], run.schema.names)

    return label


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that a model isn't learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame) -> DataFrame:
    """The prototypes of documents(doc_id, text, lang) that aren't held out."""
    return train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of all documents, learned from those that aren't held out."""
    flagged = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(flagged, learn(docs), ["doc_id", "held_out"])
