"""Operator 2: SentencePiece segmentations by Gumbel top-k without replacement, and decoding.

A text's segmentations are the paths of a lattice whose edges are pieces. An
edge weighs 1 / (rank + 1) in a BPE model, whose scores are ranks alone, and
exp(score) in a unigram model; a character without a piece is an edge of byte
pieces. Exact sums over all completions turn weights into probabilities, so
that a path's probability is the product of its edges'.

The k segmentations come from a perturbed A-star search: each prefix of a path
stands for all its completions, and its key is the largest of their Gumbel
perturbed log-probabilities, drawn top down: one child inherits the key of its
prefix, the rest get a key truncated by it. The prefix of the largest key is
expanded next, so completed paths leave in the order of their keys: a sample
without replacement. The key after the k-th gives the inclusion scores,
1 - exp(-exp(log p - key)). All draws are hashes of the row key, the sample's
number and the position: batches and retries don't change them.

Pieces hold blanks at their start alone (checked), so the lattice falls into
chunks, blanks and what follows; equal chunks of a window share their tables,
and those that a window repeats are kept for later ones, KEPT characters at most.
Sums and walks go through all short chunks of a run together, and through a
chunk of more than LONG characters (scripts without blanks, encoded data) place
by place, in blocks: time and memory are linear in the longest text.

Null and empty text: one segmentation without pieces. Texts with fewer than k
segmentations give fewer rows. Rows of equal id draw alike; a null id counts
as -1. A text that holds the model's own blank mark decodes with a blank in
its place. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from driftwalk.llm.common import runs, two_columns

BLANK = "▁"
_CHUNK = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
#: Bytes of text whose lattice a worker holds at once, and of those it samples together, but for a longer text.
WINDOW_BYTES, RUN_BYTES = 300_000, 100_000
#: Characters of chunks that a worker keeps from window to window.
KEPT = 150_000
#: Characters of a chunk that is gone through place by place, and of a block of it.
LONG, BLOCK = 400, 1 << 15
_STEP = np.uint64(0x9E3779B97F4A7C15)  # mixing factors
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_WORD = (1 << 64) - 1


def _hash(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[0]
    x ^= x >> np.uint64(29)
    x *= _MIX[1]
    x ^= x >> np.uint64(32)
    return x


def stream(key: np.ndarray, sample: int, purpose: int) -> np.ndarray:
    """What the draws of a row key, a sample and a purpose share."""
    with np.errstate(over="ignore"):
        return _hash(key + np.uint64(sample * 8 + purpose + 1) * _STEP)


def drawn(of: np.ndarray, position: np.ndarray) -> np.ndarray:
    """In (0, 1), by stream and position."""
    return _unit(of ^ mixed(position))


def mixed(position: np.ndarray) -> np.ndarray:
    return position.astype(np.uint64) * _MIX[0]


def _unit(x: np.ndarray) -> np.ndarray:
    out = (_hash(x) >> np.uint64(11)).astype(np.float64)
    out += 0.5
    out *= 1.0 / (1 << 53)
    return out


def uniform(key: np.ndarray, sample: int, position: np.ndarray, purpose: int) -> np.ndarray:
    """In (0, 1), a pure function of its arguments."""
    return drawn(stream(key, sample, purpose), position)


def _whole_hash(x: int) -> int:
    """_hash of one number."""
    x = (x ^ (x >> 31)) * int(_MIX[0]) & _WORD
    x = (x ^ (x >> 29)) * int(_MIX[1]) & _WORD
    return x ^ (x >> 32)


def uniform_one(key: int, sample: int, position: int, purpose: int) -> float:
    """uniform() of single numbers."""
    of = _whole_hash(key + (sample * 8 + purpose + 1) * int(_STEP) & _WORD)
    return ((_whole_hash(of ^ (position * int(_MIX[0]) & _WORD)) >> 11) + 0.5) / float(1 << 53)


def gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(u))


def truncated(location: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel of a location, given that it is below the bound."""
    drawn = location + gumbel(u)
    return np.where(np.isneginf(location), -np.inf, -np.logaddexp(-bound, -drawn))


def _multiples(x: np.ndarray, bits: int) -> np.ndarray:
    """Rounded to multiples of 2 ** -bits: their sums are exact, so the texts beside one don't change its results."""
    return np.rint(x * float(1 << bits)) * (1.0 / (1 << bits))


class Model:
    """Pieces with log weights, and hashes of all their prefixes."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        n, self.unknown = self.processor.get_piece_size(), self.processor.unk_id()
        pieces = [self.processor.id_to_piece(i) for i in range(n)]
        special = [self.processor.is_control(i) or self.processor.is_unknown(i) or self.processor.is_unused(i) for i in range(n)]
        byte = [self.processor.is_byte(i) for i in range(n)]
        self.size, self.bytes = n, {int(p[3:5], 16): i for i, p in enumerate(pieces) if byte[i]}
        plain = [i for i in range(n) if not special[i] and not byte[i]]
        if any(BLANK in pieces[i].lstrip(BLANK) for i in plain):
            raise ValueError("a piece has a blank after its start")
        scores = np.array([self.processor.get_score(i) for i in range(n)])
        ranks = scores.max() - scores
        bpe = np.allclose(scores[plain], np.round(scores[plain])) and scores[plain].max() <= 0
        self.weights = -np.log1p(ranks) if bpe else scores
        self.byte_weight = float(self.weights[plain].min()) - 1.0
        raw = [bytes([int(p[3:5], 16)]) if byte[i] else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.raw, self.raw_pool = raw, np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        longest = max(len(pieces[i]) for i in plain)
        found: dict[int, int] = {}
        own, key = np.array(plain), np.zeros(len(plain), np.uint64)
        for length in range(1, longest + 1):
            fits = np.array([len(pieces[i]) >= length for i in own], bool)
            own, key = own[fits], key[fits]
            key = self._extend(key, np.array([ord(pieces[i][length - 1]) for i in own], np.uint64))
            for h, i in zip(key.tolist(), own.tolist(), strict=True):
                if len(pieces[i]) == length:
                    found[h] = i
                else:
                    found.setdefault(h, -1)
        self.longest = longest
        self.keys = np.array(sorted(found), np.uint64)
        self.ids = np.array([found[int(k)] for k in self.keys], np.int64)
        bits = 20
        self.shift = np.uint64(64 - bits)
        self.slots = np.searchsorted(self.keys, np.arange((1 << bits) + 1, dtype=np.uint64) << self.shift).astype(np.int32)
        self.slots[-1] = len(self.keys)
        self.single = np.full(0x110000, -2, np.int32)  # what lookup() gives for single characters
        letters = sorted({ord(pieces[i][0]) for i in plain})
        self.single[letters] = self.lookup(self._extend(np.zeros(len(letters), np.uint64), np.array(letters, np.uint64)))

    @staticmethod
    def _extend(key: np.ndarray, code: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            key = (key + code + np.uint64(1)) * _MIX[0]
            return (key ^ (key >> np.uint64(32))) * _STEP

    def lookup(self, key: np.ndarray) -> np.ndarray:
        """Piece id of a prefix hash; -1: a prefix but no piece; -2: nothing starts so."""
        slot = (key >> self.shift).astype(np.int64)
        at, end = self.slots[slot], self.slots[slot + 1]
        out = np.full(len(key), -2, np.int64)
        todo = np.flatnonzero(at < end)
        at, end, key = at[todo], end[todo], key[todo]
        while len(todo):
            hit = self.keys[at] == key
            out[todo[hit]] = self.ids[at[hit]]
            at += 1
            more = ~hit & (at < end)
            todo, at, end, key = todo[more], at[more], end[more], key[more]
        return out

    def normalized(self, text: str) -> str:
        return self.processor.normalize(text)

    def fallback(self, code: int) -> list[int]:
        return [self.bytes.get(b, self.unknown) for b in chr(code).encode("utf-8", "surrogatepass")]


PLACE_TABLES, EDGE_TABLES = ("total", "first", "last"), ("length", "piece", "value", "upto")


class Lattice:
    """Edges of distinct chunks, by start: piece, length, probability and its running sum."""

    def __init__(self, model: Model, chunks: list[str]):
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        ends = np.cumsum(size)
        self.base, self.size, n = ends - size, size, len(codes)
        left = np.repeat(ends, size) - np.arange(n)  # characters from here to the chunk's end
        found, counts = [], np.zeros(n, np.int64)
        at, key = np.arange(n), np.zeros(n, np.uint64)
        for length in range(1, model.longest + 1):
            if length > 1:
                fits = left[at] >= length
                at, key = at[fits], key[fits]
            if not len(at):
                break
            if length == 1:
                piece = model.single[codes]
                found.append((at.astype(np.int32), np.where(piece < 0, model.size + codes, piece).astype(np.int32)))
                key = model._extend(key, codes.astype(np.uint64))
            else:
                key = model._extend(key, codes[at + length - 1].astype(np.uint64))
                piece = model.lookup(key)
                hit = piece >= 0
                found.append((at[hit].astype(np.int32), piece[hit].astype(np.int32)))
            counts[found[-1][0]] += 1  # a place has one edge of a length at most
            alive = piece > -2
            at, key = at[alive], key[alive]
        # Places by their distance to the chunk's end, those of long chunks last: edges stand in the order in which sums are made.
        short = size <= LONG
        longest = int(size[short].max(initial=0))
        stage = np.where(np.repeat(short, size), left, longest + 1).astype(np.uint16 if longest < 65_000 else np.int64)
        order = np.argsort(stage, kind="stable")
        sorted_counts = counts[order]
        heads = np.append(0, np.cumsum(sorted_counts))
        self.first = np.zeros(n, np.int64)
        self.first[order] = heads[:-1]
        self.last = self.first + counts - 1
        edges, used = int(heads[-1]), self.first.copy()
        self.length, self.piece = np.zeros(edges, np.int64), np.zeros(edges, np.int32)
        for length, (where, piece) in enumerate(found, 1):
            slots = used[where]
            self.length[slots], self.piece[slots] = length, piece
            used[where] += 1
        found.clear()
        if (self.piece < model.size).all():
            weight = model.weights[self.piece]
        else:
            own = self.piece < model.size
            weight = np.where(own, model.weights[np.where(own, self.piece, 0)], 0.0)
            code = self.piece[~own] - model.size
            weight[~own] = model.byte_weight * (1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
        # Sums over all completions, from the chunks' ends; places of equal distance at once.
        # Of each edge: log weight of itself and all completions, and its share of its place's.
        total, self.value, share = np.zeros(n + 1), np.zeros(edges), np.zeros(edges)
        start = np.repeat(order, sorted_counts)
        to = np.where(self.length < left[start], start + self.length, n)  # the last of total stands for a chunk's end
        cuts = np.searchsorted(stage[order], np.arange(1, longest + 2)).tolist()
        for x, y in zip(cuts, cuts[1:], strict=False):
            if x < y:
                nodes, many, a, b = order[x:y], sorted_counts[x:y], heads[x], heads[y]
                head, value = heads[x:y] - a, self.value[a:b]
                np.add(weight[a:b], total[to[a:b]], out=value)
                top = np.maximum.reduceat(value, head)
                np.exp(value - np.repeat(top, many), out=share[a:b])
                whole = np.add.reduceat(share[a:b], head)
                share[a:b] /= np.repeat(whole, many)
                total[nodes] = top + np.log(whole)
        for k in np.flatnonzero(~short).tolist():
            self._long_sums(int(self.base[k]), int(ends[k]), weight, total, share, model.longest)
        self.total = total[:n]
        run = np.cumsum(_multiples(share, 32))
        self.upto = run - np.repeat(np.append(0, run)[heads[:-1]], sorted_counts)
        self.upto[self.last] = np.inf

    @classmethod
    def of(cls, tables: dict[str, np.ndarray], base: np.ndarray, size: np.ndarray) -> Lattice:
        """A lattice whose chunks stand in tables that are there."""
        self = cls.__new__(cls)
        vars(self).update(tables, base=base, size=size)
        return self

    def part(self, chunks: np.ndarray) -> Lattice:
        """The lattice of some chunks, by number."""
        size = self.size[chunks]
        ends = np.cumsum(size)
        places = np.arange(int(ends[-1])) + np.repeat(self.base[chunks] - (ends - size), size)
        many = self.last[places] - self.first[places] + 1
        last = np.cumsum(many)
        edges = np.arange(int(last[-1])) + np.repeat(self.first[places] - (last - many), many)
        tables = {name: getattr(self, name)[edges] for name in EDGE_TABLES}
        return Lattice.of({**tables, "total": self.total[places], "first": last - many, "last": last - 1}, ends - size, size)

    def log_p(self, edge: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Log-probabilities of edges that leave the places `row`."""
        return _multiples(self.value[edge] - self.total[row], 26)

    def _long_sums(self, begin: int, end: int, weight: np.ndarray, total: np.ndarray, share: np.ndarray, longest: int) -> None:
        """total of a long chunk's places, and value and share of its edges, block by block from its end."""
        beyond = [0.0] * longest  # sums at a block's end and after it
        for high in range(end, begin, -BLOCK):
            low = max(begin, high - BLOCK)
            first = [*self.first[low:high].tolist(), int(self.last[high - 1]) + 1]
            length, own = self.length[first[0] : first[-1]].tolist(), weight[first[0] : first[-1]].tolist()
            base, sums = first[0], [0.0] * (high - low) + beyond
            for i in range(high - low - 1, -1, -1):
                a, b = first[i] - base, first[i + 1] - base
                values = own[a:b] = [own[e] + sums[i + length[e]] for e in range(a, b)]
                if len(values) == 1:
                    sums[i] = values[0]
                else:
                    top = max(values)
                    sums[i] = top + math.log(sum([math.exp(v - top) for v in values]))
            total[low:high] = sums[: high - low]
            inside = slice(first[0], first[-1])
            self.value[inside] = own
            share[inside] = np.exp(self.value[inside] - np.repeat(total[low:high], np.diff(first)))
            beyond = sums[:longest]

    def choose(self, row: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge from each start, by running sums."""
        edge = self.first[row]
        todo = np.flatnonzero(u > self.upto[edge])
        at, u = edge[todo], u[todo]
        while len(todo):
            at += 1
            more = u > self.upto[at]
            edge[todo] = at
            todo, at, u = todo[more], at[more], u[more]
        return edge


def _numbered(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct chunks, number of each chunk of all texts, chunks of each text)."""
    whole = [model.normalized(t) if t else "" for t in texts]
    if all(s[:1] == BLANK and BLANK + BLANK not in s for s in whole):
        cut = pc.split_pattern(pa.array([s[1:] for s in whole], pa.large_string()), BLANK)
        coded = pc.dictionary_encode(cut.values)
        chunks = [BLANK + p for p in coded.dictionary.to_numpy(zero_copy_only=False)]
        return chunks, coded.indices.to_numpy().astype(np.int64), np.diff(cut.offsets.to_numpy()).astype(np.int64)
    lists = [_CHUNK.findall(s) for s in whole]
    coded = pc.dictionary_encode(pa.array([c for x in lists for c in x], pa.large_string()))
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), np.array([len(x) for x in lists], np.int64)


class Kept:
    """Tables of chunks that windows have repeated, one after the other; those of a window's new chunks stand behind them.

    The next window's overwrite the latter, so a lattice holds until the next is asked for.
    """

    def __init__(self, model: Model, most: int = KEPT):
        self.model, self.most = model, most
        self.tables: dict[str, np.ndarray] = {}
        self._forget()

    def _forget(self) -> None:
        self.base: dict[str, int] = {}
        self.places = self.edges = 0

    def _put(self, lattice: Lattice) -> None:
        """Writes a lattice's tables behind what is kept."""
        for names, at in ((PLACE_TABLES, self.places), (EDGE_TABLES, self.edges)):
            for name in names:
                new, old = getattr(lattice, name), self.tables.get(name)
                if old is None or len(old) < at + len(new):
                    self.tables[name] = np.empty((at + len(new)) * 5 // 4, new.dtype)
                    if at:
                        self.tables[name][:at] = old[:at]
                self.tables[name][at : at + len(new)] = new
        for name in ("first", "last"):
            self.tables[name][self.places : self.places + len(lattice.total)] += self.edges

    def lattice(self, chunks: list[str], counts: np.ndarray) -> Lattice:
        """The lattice of a window's distinct chunks, which stand in it so often."""
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        if int(size.sum()) > self.most:
            return Lattice(self.model, chunks)
        base = np.fromiter(map(self.base.get, chunks, itertools.repeat(-1)), np.int64, len(chunks))
        often = (counts > 1) & (size <= LONG)
        if self.places + int(size[often & (base < 0)].sum()) > self.most:
            self._forget()
            base[:] = -1
        new = np.flatnonzero(base < 0)
        if len(new):
            made = Lattice(self.model, [chunks[k] for k in new.tolist()])
            stay = np.flatnonzero(often[new])
            if len(stay):
                part = made.part(stay)
                self._put(part)
                self.base.update(zip([chunks[k] for k in new[stay].tolist()], (part.base + self.places).tolist(), strict=True))
                self.places, self.edges = self.places + len(part.total), self.edges + len(part.piece)
            self._put(made)
            base[new] = made.base + self.places
        return Lattice.of(self.tables, base, size)


def shared_lattice(model: Model, texts: list[str | None], runs_of: list[int], kept: Kept | None = None):
    """(lattice of all texts, number of each chunk, chunks of each text) for each run of the texts; runs_of: texts of each run."""
    chunks, index, per = _numbered(model, texts)
    lattice = kept.lattice(chunks, np.bincount(index, minlength=len(chunks))) if kept and chunks else Lattice(model, chunks)
    upto, at = np.append(0, np.cumsum(per)), 0
    for n in runs_of:
        yield lattice, index[upto[at] : upto[at + n]], per[at : at + n]
        at += n


class Sampler:
    """Segmentations of a run of texts. shared: what shared_lattice() gives for them."""

    def __init__(self, model: Model, texts: list[str | None], keys: np.ndarray, shared: tuple[Lattice, np.ndarray, np.ndarray] | None = None):
        self.model, self.n = model, len(texts)
        self.lattice, index, per = shared or next(shared_lattice(model, texts, [len(texts)]))
        size = self.lattice.size[index]
        self.occ_end = np.cumsum(size)
        self.occ_start = self.occ_end - size
        total = int(size.sum())
        edge = np.append(0, self.occ_end)
        self.doc_start = edge[np.cumsum(per) - per]
        self.doc_end = edge[np.cumsum(per)]
        self.occ_doc = np.repeat(np.arange(self.n), per)
        # Row of the lattice at each character of the run.
        self.row = np.arange(total) + np.repeat(self.lattice.base[index] - self.occ_start, size)
        self.doc = np.repeat(np.arange(self.n), self.doc_end - self.doc_start)
        self.end = np.repeat(self.occ_end, size)
        self.mixed = mixed(np.arange(total) - self.doc_start[self.doc])
        self.keys = _hash(keys.astype(np.int64).view(np.uint64) * _STEP + np.uint64(1))

    def _walk(self, at: np.ndarray, sample: int, edges: np.ndarray) -> None:
        """Samples edges from each start on, to the end of its chunk."""
        of = stream(self.keys, sample, 0)
        far = self.end[at] - at > LONG
        if far.any():
            for start in at[far].tolist():
                self._long_walk(start, of, edges)
            at = at[~far]
        while len(at):
            edge = self.lattice.choose(self.row[at], _unit(of[self.doc[at]] ^ self.mixed[at]))
            edges[at] = edge
            after = at + self.lattice.length[edge]
            at = after[after < self.end[at]]

    def _long_walk(self, at: int, of: np.ndarray, edges: np.ndarray) -> None:
        """As _walk, from one start: all places of a block draw their edges, then the path is followed."""
        doc, end = int(self.doc[at]), int(self.end[at])
        while at < end:
            low, high = at, min(end, at + BLOCK)
            places = np.arange(low, high)
            edge = self.lattice.choose(self.row[low:high], drawn(of[doc : doc + 1], places - self.doc_start[doc]))
            ahead, path = (places + self.lattice.length[edge]).tolist(), []
            while at < high:
                path.append(at)
                at = ahead[at - low]
            edges[path] = edge[np.array(path) - low]

    def _draws_of_rest(self, log_p: np.ndarray, before: np.ndarray, at: np.ndarray, sample: int) -> np.ndarray:
        """Perturbed log-probability of what else leaves each start than an edge of log_p, not yet truncated by its path's key.

        Truncation by one bound keeps the order, so it can wait for the largest.
        """
        lattice, row = self.lattice, self.row[at]
        out = np.full(len(at), -np.inf)
        some = np.flatnonzero(lattice.first[row] != lattice.last[row])
        at = at[some]
        with np.errstate(divide="ignore"):
            location = before[some] + np.log(np.maximum(1 - np.exp(log_p[some]), 0))
        out[some] = location + gumbel(_unit(stream(self.keys, sample, 1)[self.doc[at]] ^ self.mixed[at]))
        return out

    def run(self, k: int):
        """k rounds: (number, edges by position, key, log-probability, alive), and at last the next key."""
        lattice, docs = self.lattice, np.arange(self.n)
        edges = np.full(len(self.row), -1, np.int64)
        self._walk(self.occ_start.copy(), 0, edges)
        bound = gumbel(uniform(self.keys, 0, np.zeros(self.n, np.int64), 2))
        alive = np.ones(self.n, bool)
        open_: list[dict] = []
        rounds = []
        for number in range(k + 1):
            if number:
                # The open prefix of the largest key in each text.
                top, which, where = np.full(self.n, -np.inf), np.full(self.n, -1), np.full(self.n, -1)
                for j, x in enumerate(open_):
                    best, at = self._largest(x)
                    better = best > top
                    top, which, where = np.where(better, best, top), np.where(better, j, which), np.where(better, at, where)
                alive = alive & (which >= 0) & np.isfinite(top)
                if number == k:
                    rounds.append((np.where(alive, top, -np.inf),))
                    break
                edges = np.full(len(self.row), -1, np.int64)
                bound = np.where(alive, top, 0.0)
                for j, x in enumerate(open_):
                    for d in docs[alive & (which == j)].tolist():
                        t = int(x["at"][where[d]])
                        edges[self.doc_start[d] : t] = x["edges"][self.doc_start[d] : t]
                        edges[t] = self._other(x, int(where[d]), t, d, number, float(bound[d]))
                branch = np.full(self.n, -1, np.int64)
                for j, x in enumerate(open_):
                    mine = docs[alive & (which == j)]
                    branch[mine] = x["at"][where[mine]]
                lead = branch[alive]
                onward = lead + lattice.length[edges[lead]]
                inside = onward[onward < self.end[lead]]
                later = self.occ_start[alive[self.occ_doc] & (self.occ_start > branch[self.occ_doc])]
                self._walk(np.concatenate([inside, later]), number, edges)
            at = np.flatnonzero(edges >= 0)
            log_p = lattice.log_p(edges[at], self.row[at])
            run = np.append(0, np.cumsum(log_p))
            cuts = np.searchsorted(at, np.append(self.doc_start, len(self.row)))
            head = run[cuts[:-1]]
            rounds.append((edges, bound.copy(), run[np.searchsorted(at, self.doc_end)] - head, alive.copy()))
            before = run[:-1] - head[self.doc[at]]
            if number:
                later = at > branch[self.doc[at]]
                at, before, log_p = at[later], before[later], log_p[later]
                cuts = np.searchsorted(at, np.append(self.doc_start, len(self.row)))
            draws = self._draws_of_rest(log_p, before, at, number)
            open_.append({"at": at, "draws": draws, "before": before, "edges": edges, "cuts": cuts, "bound": bound, "taken": {}})
        return rounds

    def _largest(self, x: dict) -> tuple[np.ndarray, np.ndarray]:
        best, at = np.full(self.n, -np.inf), np.full(self.n, -1)
        cuts, keys = x["cuts"], x["draws"]
        some = np.flatnonzero(cuts[1:] > cuts[:-1])
        if len(some):
            best[some] = np.maximum.reduceat(keys, cuts[some])
            first = np.flatnonzero(keys == np.repeat(best[some], (cuts[1:] - cuts[:-1])[some]))
            doc = self.doc[x["at"][first]]
            at[doc[::-1]] = first[::-1]
        with np.errstate(invalid="ignore"):
            return np.where(np.isneginf(best), -np.inf, -np.logaddexp(-x["bound"], -best)), at

    def _other(self, x: dict, slot: int, t: int, d: int, number: int, bound: float) -> int:
        """An edge from t that no earlier path took; what remains there gets a new key."""
        lattice, row = self.lattice, int(self.row[t])
        first, last = int(lattice.first[row]), int(lattice.last[row])
        taken = x["taken"].setdefault(slot, [int(x["edges"][t])])
        left = [e for e in range(first, last + 1) if e not in taken]
        log_p = lattice.log_p(np.array(left), np.array([row])).tolist()
        p, place, key = list(map(math.exp, log_p)), t - int(self.doc_start[d]), int(self.keys[d])
        target, k = uniform_one(key, number, place, 3) * sum(p), 0
        while k < len(p) - 1 and target > p[k]:
            target, k = target - p[k], k + 1
        pick = left[k]
        taken.append(pick)
        rest = log_p[:k] + log_p[k + 1 :]
        top = max(rest, default=-math.inf)
        location = float(x["before"][slot]) + top + math.log(sum(math.exp(v - top) for v in rest)) if rest else -math.inf
        left_key = float(truncated(np.array([location]), np.array([bound]), np.array([uniform_one(key, number, place, 4)]))[0])
        # Stored so that truncation by the path's own key gives it back.
        own = float(x["bound"][d])
        x["draws"][slot] = left_key - np.log(-np.expm1(min(left_key - own, -1e-300))) if np.isfinite(left_key) else -np.inf
        return pick

    def ids(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids of all texts one after the other, number of each)."""
        at = np.flatnonzero(edges >= 0)
        piece, doc = self.lattice.piece[edges[at]], self.doc[at]
        if len(piece) and piece.max() >= self.model.size:
            whole = np.flatnonzero(piece >= self.model.size)
            codes, which = np.unique(piece[whole] - self.model.size, return_inverse=True)
            spelled = [self.model.fallback(c) for c in codes.tolist()]
            sizes = np.array([len(x) for x in spelled], np.int64)
            extra = np.ones(len(piece), np.int64)
            extra[whole] = sizes[which]
            place = np.cumsum(extra) - extra
            out, pool, at = np.repeat(piece, extra), np.array([i for x in spelled for i in x], np.int32), np.cumsum(sizes) - sizes
            for k in range(int(sizes.max())):
                some = np.flatnonzero(sizes[which] > k)
                out[place[whole[some]] + k] = pool[at[which[some]] + k]
            piece, doc = out, np.repeat(doc, extra)
        return piece.astype(np.uint32), np.bincount(doc, minlength=self.n)


def decoded_bytes(model: Model, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bytes of all pieces, end of each piece in them)."""
    size = model.raw_size[ids]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return model.raw_pool[np.repeat(model.raw_at[ids] - (ends - size), size) + np.arange(total)].tobytes(), ends


_models: dict[str, Model] = {}


def worker_model(path: str) -> Model:
    if path not in _models:
        _models.clear()
        _models[path] = Model(path)
    return _models[path]


SAMPLES = pa.schema([("doc_id", pa.int64()), ("sample", pa.int32()), ("n_pieces", pa.int64()), ("ids", pa.list_(pa.int32())), ("ids_crc32", pa.int64()), ("log_prob", pa.float64()), ("key", pa.float64()), ("inclusion", pa.float64()), ("decodes", pa.bool_()), ("text", pa.string())])
SAMPLES_SQL = "doc_id long, sample int, n_pieces long, ids array<int>, ids_crc32 long, log_prob double, key double, inclusion double, decodes boolean, text string"


def decoded_texts(model: Model, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The text of each run of ids (the k-th ends at ends[k]): bytes of its pieces, without the first blank."""
    spelled, upto = decoded_bytes(model, ids)
    edges = np.append(0, upto)[np.append(0, ends)]
    pool = np.frombuffer(spelled, np.uint8)
    some = edges[:-1] < edges[1:]
    lead = edges[:-1][some][pool[edges[:-1][some]] == 32]
    cut = np.delete(pool, lead).tobytes()
    edges = edges - np.searchsorted(lead, edges)
    try:
        cut.decode()
    except UnicodeDecodeError:  # ids that don't stem from a text
        return pa.array([cut[a:b].decode("utf-8", "replace") for a, b in zip(edges, edges[1:], strict=False)], pa.string())
    return pa.StringArray.from_buffers(len(ends), pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(cut))


def sample_batches(model: Model, ids: list[int | None], texts: list[str | None], k: int, seed: int, with_text: bool = True, shared: tuple | None = None):
    """Arrow batches of SAMPLES for a run of texts, one a round. shared: as in Sampler."""
    keys = np.array([-1 if i is None else i for i in ids], np.int64) ^ np.int64(seed << 32)
    sampler = Sampler(model, texts, keys, shared)
    *rounds, (after,) = sampler.run(k)
    expected = pa.array([(t or "").replace(BLANK, " ") for t in texts], pa.string())
    for number, (edges, key, log_p, alive) in enumerate(rounds, 1):
        some = np.flatnonzero(alive)
        if not len(some):
            break
        flat, counts = sampler.ids(edges)
        counts = counts[some]  # the others have no ids
        ends = np.cumsum(counts)
        raw, at = memoryview(flat.astype("<u4")).cast("B") if len(flat) else b"", (4 * np.append(0, ends)).tolist()
        with np.errstate(over="ignore"):
            inclusion = np.where(np.isneginf(after), 1.0, -np.expm1(-np.exp(np.minimum(log_p - after, 700))))
        text = decoded_texts(model, flat, ends)
        same = pc.equal(text, expected.take(pa.array(some)))
        listed = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat.astype(np.int32)))
        columns = [
            pa.array([ids[d] for d in some.tolist()], pa.int64()), pa.array(np.full(len(some), number), pa.int32()), pa.array(counts, pa.int64()), listed, pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.int64()),
            pa.array(log_p[some], pa.float64()), pa.array(key[some], pa.float64()), pa.array(inclusion[some], pa.float64()), same, text if with_text else pa.nulls(len(some), pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(columns, schema=SAMPLES)


def sample_rows(model: Model, ids: list[int | None], texts: list[str | None], k: int, seed: int, with_ids: bool = True) -> list[tuple]:
    """Rows of SAMPLES for a run of texts, as tuples without the decoded text."""
    batches = sample_batches(model, ids, texts, k, seed, with_text=False)
    return [(*row[:3], row[3] if with_ids else None, *row[4:9]) for batch in batches for row in map(tuple, map(dict.values, batch.to_pylist()))]


def sampled(model: Model, batches, k: int, seed: int, with_text: bool):
    """Arrow batches of SAMPLES for batches(doc_id, text)."""
    kept = Kept(model)
    for batch in batches:
        for window in runs(batch, "text", WINDOW_BYTES):
            parts = list(runs(window, "text", RUN_BYTES))
            lattices = shared_lattice(model, window.column("text").to_pylist(), [run.num_rows for run in parts], kept)
            for run, shared in zip(parts, lattices, strict=True):
                yield from sample_batches(model, run.column("doc_id").to_pylist(), run.column("text").to_pylist(), k, seed, with_text, shared)


def sample_segmentations(docs: DataFrame, model_path: str, k: int = 2, seed: int = 7, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sample, n_pieces, ids, ids_crc32, log_prob, key, inclusion, decodes), k rows a document at most.

    decodes: whether the ids decode to the text; with_text adds what they decode to.
    """
    def encode(batches):
        yield from sampled(worker_model(model_path), batches, k, seed, with_text)

    found = two_columns(docs, id_col, text_col).mapInArrow(encode, SAMPLES_SQL)
    return found if with_text else found.drop("text")


def decode_ids(rows: DataFrame, model_path: str, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, the columns `keep`, text) of rows with ids; null ids give null.

    Bytes of pieces are joined, blanks restored, the first one dropped.
    """
    columns = [id_col, *keep]

    def back(batches):
        model = worker_model(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = part.column("ids")
                ends = np.cumsum(pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False))
                texts = decoded_texts(model, ids.flatten().to_numpy(zero_copy_only=False), ends)
                texts = pc.if_else(ids.is_valid(), texts, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), texts], [*columns, "text"])

    kept = rows.select(*columns).schema
    return rows.select(*dict.fromkeys([*columns, "ids"])).mapInArrow(back, kept.add("text", "string"))
